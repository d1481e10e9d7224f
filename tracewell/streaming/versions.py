"""What merging adds to the state of one key: the helper of T5, by the rules of R3 to R6."""

from __future__ import annotations

import re

VERSION_FIELDS = ("props", "origin", "timestamp", "version", "tombstone", "seq")


def plain(x):
    """A value of a batch as JSON can hold it."""
    if isinstance(x, (list, tuple)):  # a map may come as its entries
        return dict(x)
    if isinstance(x, dict) or x is None or isinstance(x, str):
        return x
    return None if x != x else x.item() if hasattr(x, "item") else x


def _whole(x: str | None) -> int | None:
    return int(x) if x is not None and re.fullmatch(r"\s*[+-]?[0-9]{1,18}\s*", x) else None


def _order(*values) -> tuple:
    """Nulls before all else."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


def merge_version(state: dict | None, v: dict, fields: dict[str, list[str]]) -> dict:
    """The state with one more version: the winner, the local side, and what sightings add up to."""
    rank = lambda x: _order(x["tombstone"], x["timestamp"], x["origin"], x["version"], None if x["seq"] is None else -x["seq"])
    s = state or {"winner": v, "local": v, "top": None, "dead": False, "sums": {}, "ends": {}, "newest": {}}
    props = v["props"] or {}
    s["winner"] = max(s["winner"], v, key=rank)
    if v["seq"] is not None and (s["local"]["seq"] is None or v["seq"] < s["local"]["seq"]):
        s["local"] = v
    top = [v["timestamp"], v["origin"], v["version"]]
    s["top"] = top if s["top"] is None else max(s["top"], top, key=lambda t: _order(*t))
    s["dead"] = s["dead"] or bool(v["tombstone"])
    for f in fields.get("sum", []):
        s["sums"][f] = s["sums"].get(f, 0) + (_whole(props.get(f)) or 0)
    for kind, best in (("min", min), ("max", max)):
        for f in fields.get(kind, []):
            n = _whole(props.get(f))
            if n is not None:
                s["ends"][f] = best(s["ends"].get(f, n), n)
    for f in fields.get("newest", []):
        if props.get(f) is not None:
            new = [v["timestamp"], v["origin"], props[f]]
            s["newest"][f] = max(s["newest"].get(f, new), new, key=lambda t: _order(*t))  # of one time and origin the greatest value, as R4 and R9
    return s


def sighted_version(s: dict, fields: dict[str, list[str]]) -> dict:
    """The version that a key's sightings add up to."""
    named = {f for kind in fields.values() for f in kind}
    props = {k: x for k, x in (s["local"]["props"] or {}).items() if k not in named}
    props |= {f: str(n) for f, n in (s["sums"] | s["ends"]).items()} | {f: t[2] for f, t in s["newest"].items()}
    timestamp, origin, version = s["top"]
    return {"props": props, "origin": origin, "timestamp": timestamp, "version": version, "tombstone": False, "seq": s["local"]["seq"]}
