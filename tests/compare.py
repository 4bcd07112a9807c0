"""Tables as sorted lists of rows, for comparison between engines."""

from __future__ import annotations

import math
from typing import Any


def plain(value: Any) -> Any:
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return str(value)[:19] if hasattr(value, "isoformat") else value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)
