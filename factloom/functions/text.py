"""Ages, SQL fingerprints and capped name lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit lengths in milliseconds.
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
WEEK, MONTH, YEAR = 7 * DAY, 30 * DAY, 365 * DAY


def age_label(then_ms: Column, now_ms: Column) -> Column:
    """``3 days ago``; null for missing, non-positive or future times."""
    delta = now_ms - then_ms

    def ago(unit: str, size: int) -> Column:
        n = F.floor(delta / size).cast("bigint")
        return F.when(n == 1, F.lit(f"1 {unit} ago")).otherwise(F.concat(n.cast("string"), F.lit(f" {unit}s ago")))

    return F.when((then_ms <= 0) | (delta < 0) | then_ms.isNull(), F.lit(None).cast("string")).otherwise(
        F.when(delta < MINUTE, F.lit("just now"))
        .when(delta < HOUR, ago("minute", MINUTE))
        .when(delta < DAY, ago("hour", HOUR))
        .when(delta < 2 * DAY, F.lit("yesterday"))
        .when(delta < WEEK, ago("day", DAY))
        .when(delta < MONTH, ago("week", WEEK))
        .when(delta < YEAR, ago("month", MONTH))
        .otherwise(ago("year", YEAR))
    )


def sql_fingerprint(sql: Column) -> Column:
    """Literals to ``?``, one space between words, lower case."""
    # The possessive loop reads a literal of any length without recursion.
    s = F.regexp_replace(sql, r"(?s)'(?:[^'\\]++|\\.)*+(?:'|\\?$)", "?")
    s = F.regexp_replace(s, r"[0-9][0-9.]*", "?")
    s = F.regexp_replace(s, r"\s+", " ")
    return F.trim(F.lower(s))


def joined_capped(names: Column, total: Column, cap: int) -> Column:
    """First ``cap`` names and how many more there are."""
    shown = F.array_join(F.slice(names, 1, cap), ", ")
    return F.when(total <= cap, shown).otherwise(
        F.concat(shown, F.lit(" (+"), (total - cap).cast("string"), F.lit(" more)"))
    )


def plural(n: Column, noun: str, suffix: str = "s") -> Column:
    return F.when(n == 1, F.lit(noun)).otherwise(F.lit(noun + suffix))
