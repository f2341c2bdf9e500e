"""Training-data operators: dedup, decontamination, packing, scoring and scanning of text corpora.

Nothing else in the library imports this subpackage.
"""
