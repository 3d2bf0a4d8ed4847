"""Sets of transaction ids in their text form, `uuid:a-b:c,...`: small, one a checkpoint, so handled as texts."""

from __future__ import annotations

import re

Ranges = dict[str, list[tuple[int, int]]]


def parse(text: str | None) -> Ranges:
    """Sources in lower case with their ranges, merged and in order; white space doesn't count, what can't be read is left out."""
    out: Ranges = {}
    for part in filter(None, re.sub(r"\s+", "", text or "").lower().split(",")):
        source, *ranges = part.split(":")
        for r in ranges:
            m = re.fullmatch(r"(\d+)(?:-(\d+))?", r)
            if m and int(m[1]) <= int(m[2] or m[1]):
                out.setdefault(source, []).append((int(m[1]), int(m[2] or m[1])))
    return {s: _merged(r) for s, r in out.items()}


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def text(sets: Ranges) -> str:
    return ",".join(":".join([s, *[str(lo) if lo == hi else f"{lo}-{hi}" for lo, hi in sets[s]]]) for s in sorted(sets) if sets[s])


def union(a: str | None, b: str | None) -> str:
    """Both sets as one, in canonical form."""
    x, y = parse(a), parse(b)
    return text({s: _merged(x.get(s, []) + y.get(s, [])) for s in {*x, *y}})


def add(sets: str | None, gtid: str) -> str:
    """The set with one more transaction `uuid:number`."""
    return union(sets, gtid)


def contains(sets: str | None, gtid: str) -> bool:
    source, _, number = gtid.strip().lower().partition(":")
    return number.isdigit() and any(lo <= int(number) <= hi for lo, hi in parse(sets).get(source, []))
