"""URL filters: rules are indexed by their rarest literal token, a URL's tokens fetch candidate rules,
and only those run their regular expressions. DataFrame operations only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.spread import pick

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """``name`` is reported where ``listed``; ``pattern`` runs on host and path and must hold all ``tokens``."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool
    rank: int


# The rules (host, path) that every page is judged by.
LISTED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words of hosts that are blocked unless a listed rule says otherwise.
BLOCKED_HOST_WORDS = ("ads", "adult", "bets", "casino", "escort", "pills", "poker", "porn", "sex", "viagra", "xxx")
DEFAULT = "allow"


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; the longest fitting one wins."""
    whole = (host + path.rpartition("/")[0]).lower()  # the last segment may be cut short
    tokens = tuple(t for t in re.split(r"[^0-9a-z]+", whole) if t)
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tokens, True, len(host + path))


def word_rule(word: str) -> Rule:
    return Rule(word, "block", rf"^(?:[^/]*[^0-9a-z/])?{word}(?:[^0-9a-z]|$)", (word,), False, 0)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in LISTED] + [word_rule(w) for w in BLOCKED_HOST_WORDS]


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` and for null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule] | DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` for every row of ``pages`` (``page_id``, ``url``).

    Distinct addresses are judged once and joined back, so repeated rows and hot addresses cost one. A null or
    empty URL has an empty host and path, no rule and the default verdict. A rule whose pattern has no literal token
    is tried on every distinct address. Among listed rules the longest wins, then the smaller name; a pattern rule
    counts only where no listed rule fits. Other columns are ignored.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else _rule_table(spark, default_rules() if rules is None else rules)
    host, path = host_and_path(F.col("url"))
    rows = pick(pages, "page_id", "url").select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    distinct = rows.select("host", "path").distinct()
    address = F.concat("host", "path")
    tokens = distinct.select("host", "path", F.explode(F.array_distinct(F.split(lower(address), "[^0-9a-z]+"))).alias("token")).where("token <> ''")
    # the index: each rule under the one of its tokens that fewest addresses hold
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    seen = tokens.join(wanted, "token").groupBy("token").count()
    weighed = table.select("*", F.explode_outer("tokens").alias("token")).join(seen, "token", "left")
    best = weighed.groupBy("name", "verdict", "pattern", "listed", "rank").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).alias("token"))
    fetched = tokens.join(best.where("token is not null"), "token").unionByName(distinct.withColumn("token", F.lit("")).join(best.where("token is null").drop("token").withColumn("token", F.lit("")), "token"))
    fits = fetched.where(F.expr("regexp_like(concat(host, path), pattern)"))
    won = fits.groupBy("host", "path").agg(F.min_by(F.struct("name", "verdict", "listed"), F.struct((~F.col("listed")).alias("a"), (-F.col("rank")).alias("b"), F.col("name").alias("c"))).alias("w"))
    return rows.join(won, ["host", "path"], "left").select("page_id", "host", "path", F.when(F.col("w.listed"), F.col("w.name")).alias("rule"), F.coalesce("w.verdict", F.lit(DEFAULT)).alias("verdict"))


def _rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    def row(r: Rule) -> Column:
        tokens = F.array(*[F.lit(t) for t in r.tokens]) if r.tokens else F.array().cast("array<string>")
        return F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), tokens.alias("tokens"), F.lit(r.listed).alias("listed"), F.lit(r.rank).alias("rank"))

    return spark.range(1).select(F.inline(F.array(*[row(r) for r in rules])))


def judge_sql(table: str = "pages") -> str:
    """The same verdicts in DuckDB SQL, every rule on every page."""
    listed = " union all ".join(f"select '{h}' as h, '{p}' as p, '{v}' as v" for v, h, p in LISTED)
    words = "|".join(BLOCKED_HOST_WORDS)
    return f"""
with rest as (select row_number() over () as r, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as u from {table}),
parts as (select r, page_id, translate(regexp_extract(u, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(u, '^[^/?#]*(/[^?#]*)', 1) as path from rest),
listed as ({listed}),
fit as (select r, h || p as rule, v, row_number() over (partition by r order by length(h || p) desc, h || p) as k
  from parts join listed on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, case when regexp_matches(host, '(^|[^0-9a-z])({words})($|[^0-9a-z])') then 'block' else '{DEFAULT}' end) as verdict
from parts left join (select * from fit where k = 1) using (r)"""
