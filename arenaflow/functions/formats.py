"""Numbers as text, as boards show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Format name -> pattern and factor. Thousands are parted by commas.
KINDS = {"pct": ("%.1f%%", 100), "plus1": ("%+.1f", 1), "ratio2": ("%.2f", 1), "plusnum": ("%+,.0f", 1), "num0": ("%,.0f", 1), "num1": ("%.1f", 1), "num2": ("%.2f", 1)}
#: What stands for no value.
NOTHING = "—"


def formatted(x: Column | str, kind: str) -> Column:
    pattern, factor = KINDS[kind]
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.format_string(pattern, x * factor)).otherwise(NOTHING)


def share_pct(part: Column, whole: Column, digits: int = 0) -> Column:
    """A share in percent, null without a whole."""
    return F.round(100 * F.try_divide(part, whole), digits)
