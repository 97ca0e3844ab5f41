"""Document dates: a text to (ISO date, precision), without guesses, and the choice among candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

# English month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_date(text: Column | str) -> Column:
    """struct(date string, precision string) from ISO, ``12 March 2020``, ``March 12, 2020``, ``March 2020``, ``2020-03`` or ``2020``; null if none."""
    t = F.lower(F.trim(as_column(text)))
    name = "(" + "|".join(MONTHS) + ")"
    month = F.lit(0)
    for i, m in enumerate(MONTHS, 1):
        month = F.when(F.regexp_extract(t, name, 1) == m, i).otherwise(month)
    iso, dmy, mdy, my, ym, y = r"^(\d{4})-(\d{2})-(\d{2})", rf"^(\d{{1,2}}) {name} (\d{{4}})$", rf"^{name} (\d{{1,2}}),? (\d{{4}})$", rf"^{name} (\d{{4}})$", r"^(\d{4})-(\d{2})$", r"^(\d{4})$"
    pick = lambda d, p: F.struct(d.alias("date"), F.lit(p).alias("precision"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    day = (
        F.when(t.rlike(iso), F.try_to_date(F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd"))
        .when(t.rlike(dmy), F.try_to_date(F.concat_ws("-", F.regexp_extract(t, dmy, 3), two(month), two(F.regexp_extract(t, dmy, 1))), "yyyy-MM-dd"))
        .when(t.rlike(mdy), F.try_to_date(F.concat_ws("-", F.regexp_extract(t, mdy, 3), two(month), two(F.regexp_extract(t, mdy, 2))), "yyyy-MM-dd"))
    )
    return (
        F.when(day.isNotNull(), pick(F.date_format(day, "yyyy-MM-dd"), "day"))
        .when(t.rlike(my), pick(F.concat_ws("-", F.regexp_extract(t, my, 2), two(month)), "month"))
        .when(t.rlike(ym) & F.regexp_extract(t, ym, 2).between("01", "12"), pick(t, "month"))
        .when(t.rlike(y) & t.between("1400", "2199"), pick(t, "year"))
    )


def best_date(candidates: Column) -> Column:
    """Of array<struct<date, confidence>>, the most confident; the first of equals."""
    ranked = F.transform(candidates, lambda c, i: F.struct(c["confidence"].alias("k"), (-i).alias("o"), c["date"].alias("date")))
    return F.array_max(F.filter(ranked, lambda c: c["date"].isNotNull()))["date"]
