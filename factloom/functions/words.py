"""Word and name matching as column expressions, and fuzzy matching as an exact equi-join.

Two words are the same word when they are equal ignoring case, or share a prefix of
at least 4 bytes that covers 70 % of the shorter one and leaves at most 3 bytes on
either side. For two given lengths that is one condition on one prefix length, so a
word has at most seven join keys (partner lengths -3..+3) and the fuzzy match becomes a
hash-partitioned equality join with no residual filter and no oversized block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shortest shared prefix, share of the shorter word in tenths, longest remainder.
MIN_PREFIX, MIN_TENTHS, MAX_REST = 4, 7, 3

# Role words that say nothing about the domain.
GENERIC_ROLE_WORDS = (
    "executor", "manager", "handler", "service", "controller", "factory", "builder",
    "adapter", "provider", "client", "worker", "engine", "repository", "store",
    "registry", "gateway", "middleware", "config", "result", "response", "request",
    "context", "state",
)


def folded(c: Column) -> Column:
    """Lower-cased UTF-8 bytes; all lengths below are byte lengths."""
    return F.encode(F.lower(c), "utf-8")


def _needed_prefix(la: Column, lb: Column) -> Column:
    tenths = F.floor((F.least(la, lb) * MIN_TENTHS + 9) / 10).cast("int")
    return F.greatest(F.lit(MIN_PREFIX), tenths, la - MAX_REST, lb - MAX_REST)


def same_word(a: Column, b: Column) -> Column:
    """Bounded-inflection word equality of two string columns."""
    x, y = folded(a), folded(b)
    la, lb = F.length(x), F.length(y)
    need = _needed_prefix(la, lb)
    return (x == y) | (
        (need <= F.least(la, lb)) & (F.substring(x, F.lit(1), need) == F.substring(y, F.lit(1), need))
    )


def name_tokens(name: Column) -> Column:
    """Split snake_case and camelCase; ``HTTPServer`` stays one token."""
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(spaced, F.lit("[A-Za-z0-9]+"), F.lit(0))


def names_concept(name: Column, term: Column) -> Column:
    """The whole name, or any of its tokens, is the same word as ``term``."""
    return same_word(name, term) | F.exists(name_tokens(name), lambda t: same_word(t, term))


def is_generic_role_word(token: Column) -> Column:
    return F.lower(token).isin(*GENERIC_ROLE_WORDS)


def slugify(text: Column) -> Column:
    """Lower-case ASCII slug with single dashes; empty text becomes ``section``."""
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(F.regexp_replace(dashed, "^-", ""), "-$", "")
    return F.when(trimmed == "", F.lit("section")).otherwise(trimmed)


def _keyed(vocab: DataFrame, keep: list[str], col: str, left_side: bool) -> DataFrame:
    """One row per word and possible partner length, with the prefix both must share."""
    rows = vocab.select(*keep, folded(F.col(col)).alias("w"), F.explode(F.array(*[F.lit(d) for d in range(-MAX_REST, MAX_REST + 1)])).alias("d"))
    rows = rows.withColumn("n", F.length("w")).withColumn("m", F.col("n") + F.col("d")).where(F.col("m") > 0)
    need, short = _needed_prefix(F.col("n"), F.col("m")), F.least(F.col("n"), F.col("m"))
    # Short equal words have no valid prefix length; they match on their full text.
    rows = rows.withColumn("size", F.when((need > short) & (F.col("d") == 0), F.col("n")).otherwise(need))
    la, lb = ("n", "m") if left_side else ("m", "n")
    return rows.where(F.col("size") <= short).select(
        *keep, F.col(la).alias("la"), F.col(lb).alias("lb"), F.substring("w", F.lit(1), F.col("size")).alias("prefix")
    )


def match_words(
    left: DataFrame,
    right: DataFrame,
    left_col: str,
    right_col: str,
    on: tuple[str, ...] = (),
    right_cols: tuple[str, ...] = (),
) -> DataFrame:
    """All pairs of distinct words that are the same word, each pair once.

    Works on the two vocabularies, so a word used by a third of all rows still is one
    row here. ``on`` names columns (such as ``repo``) that must be equal as well.
    ``right_cols`` are carried along; the right side then has one row per word already.
    """
    lv = left.select(*on, left_col).where(F.col(left_col) != "").distinct()
    rv = right.select(*on, right_col, *right_cols).where(F.col(right_col) != "")
    if not right_cols:
        rv = rv.distinct()
    # words are short and have many keys: by bytes, AQE would leave a vocabulary of millions to one task; by the columns it is distinct in, this exchange would fall away
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda words, col: words.repartition(n, F.xxhash64(*on, col))
    lk = _keyed(dealt(lv, left_col), [*on, left_col], left_col, True)
    rk = _keyed(dealt(rv, right_col), [*on, right_col, *right_cols], right_col, False)
    return lk.join(rk, [*on, "la", "lb", "prefix"]).select(*on, left_col, right_col, *right_cols)


def name_words(names: DataFrame, name_col: str, keep: tuple[str, ...] = ("repo",)) -> DataFrame:
    """One row per (name, word): pos 0 is the whole name, 1.. are its tokens; words are lower case."""
    words = F.concat(F.array(F.col(name_col)), name_tokens(F.col(name_col)))
    return names.select(*keep, name_col, F.posexplode(F.transform(words, lambda w: F.lower(w))).alias("pos", "word"))


def starts(df: DataFrame, col: str, on: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Distinct first four bytes of the words of a column: same words share them."""
    return df.select(*on, F.substring(folded(F.col(col)), 1, MIN_PREFIX).alias("start")).distinct()


def starting_like(words: DataFrame, wanted: DataFrame | None, on: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Rows of ``words`` whose word can match at all. Asked terms are few next to a vocabulary, so
    this drops most words before anything is aggregated or shuffled; AQE picks the join."""
    if wanted is None:
        return words
    keyed = words.withColumn("start", F.substring(folded(F.col("word")), 1, MIN_PREFIX))
    return keyed.join(wanted, [*on, "start"], "left_semi").drop("start")
