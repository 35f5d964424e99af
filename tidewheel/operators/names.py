"""Names for helper columns."""

from __future__ import annotations


def fresh(taken: list[str], *wished: str) -> list[str]:
    """The wished names with as many lines under them as keep them apart from a table's columns and from each other."""
    seen, out = {c.lower() for c in taken}, []
    for name in wished:
        name = f"__{name}"
        while name.lower() in seen:
            name += "_"
        seen.add(name.lower())
        out.append(name)
    return out
