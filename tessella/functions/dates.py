"""Dates of uneven quality, and bins of days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower edges of the staleness bins, in days; each bin runs up to the next edge.
BIN_EDGES = ((1095, "36m+"), (730, "24-36m"), (365, "12-24m"), (183, "6-12m"))


def tolerant_date(x: Column, first: int = 1900, last: int = 2100) -> Column:
    """Struct of the date (null unless usable) and its quality."""
    t = F.trim(x)
    shaped = t.rlike(r"^\d{1,4}-\d{1,2}-\d{1,2}$")
    date = F.try_to_timestamp(t, F.lit("y-M-d")).cast("date")
    quality = (
        F.when(t.isNull() | (t == ""), "missing")
        .when(~shaped, "unparseable")
        .when(date.isNull(), "invalid_calendar")
        .when(~F.year(date).between(first, last), "implausible_year")
        .when(~t.rlike(r"^\d{4}-\d\d-\d\d$"), "ok_padding_fixed")
        .otherwise("ok")
    )
    return F.struct(F.when(quality.startswith("ok"), date).alias("date"), quality.alias("quality"))


def day_bin(days: Column) -> Column:
    """The half-open bin of a number of days; '<6m' below the first edge."""
    out = F.when(days.isNull(), None)
    for edge, name in BIN_EDGES:
        out = out.when(days >= edge, name)
    return out.otherwise("<6m")
