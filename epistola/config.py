"""Typed configuration of accounts."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from .errors import ConfigError
from .sources.mail import Scope

_POLICY = {"query": str, "since": str, "limit": int, "includeSent": bool}


@dataclass(frozen=True)
class Account:
    label: str
    adapter: str
    address: str | None = None
    policy: Scope = field(default_factory=Scope)


def parse_config(raw: object) -> dict[str, Account]:
    accounts = raw.get("accounts") if isinstance(raw, dict) else None
    if not isinstance(accounts, dict) or not accounts:
        raise ConfigError("accounts must be an object with at least one entry")
    out = {}
    for label, a in accounts.items():
        if not isinstance(a, dict) or not isinstance(a.get("adapter"), str) or not a["adapter"]:
            raise ConfigError(f"accounts.{label}.adapter must be a non-empty string")
        policy = a.get("syncPolicy", {})
        if not isinstance(policy, dict):
            raise ConfigError(f"accounts.{label}.syncPolicy must be an object")
        for key, kind in _POLICY.items():
            if key in policy and (not isinstance(policy[key], kind) or (kind is int and (isinstance(policy[key], bool) or policy[key] <= 0))):
                raise ConfigError(f"accounts.{label}.syncPolicy.{key} must be a {'positive integer' if kind is int else kind.__name__}")
        out[label] = Account(label, a["adapter"], a.get("account"), Scope(policy.get("query"), policy.get("since"), policy.get("limit"), policy.get("includeSent", True)))
    return out


def load_config(path: str) -> dict[str, Account]:
    try:
        return parse_config(json.loads(Path(path).read_text()))
    except (OSError, json.JSONDecodeError) as e:
        raise ConfigError(f"can't read {path}: {e}") from e


def resolve_account(accounts: dict[str, Account], label: str | None) -> Account:
    if label is None and len(accounts) == 1:
        return next(iter(accounts.values()))
    if label not in accounts:
        raise ConfigError(f"no account {label!r}; there are {', '.join(sorted(accounts))}")
    return accounts[label]
