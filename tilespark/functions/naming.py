"""Column names that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to differ from all ``columns`` (upper and lower case alike)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
