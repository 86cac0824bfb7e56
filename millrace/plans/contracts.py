"""Checks of configurations and runs, on the driver."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os


class ContractError(ValueError):
    """A configuration or a run that breaks its contract."""


def load_config(cls, text: str):
    """A frozen dataclass from JSON with exactly its fields; lists become tuples."""
    raw = json.loads(text)
    want = {f.name for f in dataclasses.fields(cls)}
    if not isinstance(raw, dict) or set(raw) != want:
        raise ContractError(f"{cls.__name__} takes exactly {sorted(want)}")
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def config_hash(config, only: tuple[str, ...] | None = None) -> str:
    """SHA-256 of a configuration's canonical JSON, or of the fields that affect data."""
    d = dataclasses.asdict(config)
    d = {k: v for k, v in d.items() if only is None or k in only}
    return hashlib.sha256(json.dumps(d, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def open_holdout_once(marker: str, inputs: dict[str, str], frozen: dict[str, str]) -> None:
    """Opens a holdout: its inputs' hashes must be the frozen ones, and it was never opened before."""
    changed = sorted(k for k in frozen if inputs.get(k) != frozen[k])
    if changed:
        raise ContractError(f"inputs changed since they were frozen: {changed}")
    try:
        os.close(os.open(marker, os.O_CREAT | os.O_EXCL))
    except FileExistsError:
        raise ContractError("the holdout was opened before") from None


def primary_gate(metrics: dict, rules: dict[str, tuple[str, float]], least_fills: int) -> tuple[str, list[str]]:
    """pass, fail or inconclusive with the rules that failed; adequacy comes before profit."""
    if (metrics.get("fills") or 0) < least_fills:
        return "inconclusive", ["fills"]
    ok = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    bad = [k for k, (op, v) in rules.items() if metrics.get(k) is None or not ok[op](metrics[k], v)]
    return ("fail" if bad else "pass"), bad


def split_saturated(fetch, start: int, end: int, limit: int) -> list:
    """Rows of [start, end] from a source that returns at most `limit` a call: saturated spans are
    halved; a single second that is saturated fails."""
    rows = fetch(start, end)
    if len(rows) < limit:
        return rows
    if start == end:
        raise ContractError(f"second {start} has {limit} rows or more")
    mid = (start + end) // 2
    return split_saturated(fetch, start, mid, limit) + split_saturated(fetch, mid + 1, end, limit)
