"""Fixed-width text of small results."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame


def format_table(rows: Mapping[str, Mapping[str, float]], keys: Sequence[str], digits: int = 3) -> str:
    """A line for each name with the values of keys; NaN where a value is missing."""
    lines = [["", *keys], *([name, *(f"{v:.{digits}f}" if isinstance(v := of.get(k, math.nan), float) else str(v) for k in keys)] for name, of in rows.items())]
    widths = [max(map(len, column)) for column in zip(*lines, strict=True)]
    return "\n".join("  ".join(x.rjust(w) if k else x.ljust(w) for k, (x, w) in enumerate(zip(line, widths, strict=True))).rstrip() for line in lines)


def print_report(df: DataFrame, name: str, keys: Sequence[str], most: int = 1000) -> str:
    """format_table() of the first `most` rows of df by name, a bounded report."""
    return format_table({str(r[name]): {k: r[k] for k in keys if r[k] is not None} for r in df.orderBy(name).limit(most).collect()}, keys)
