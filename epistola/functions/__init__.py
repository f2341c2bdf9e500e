"""Part of the correspondence engine."""
