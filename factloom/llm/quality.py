"""Quality rules of texts and of the hosts they come from.

Each text is measured once: words, repeats and symbols, exactly. A host's failure rate is shrunk with a beta prior that is fitted to
the rates of all hosts, so that a host with few texts is judged by what hosts are like, and a host with many by its own.
A document goes if it fails a rule itself, or if its host fails: nearly all that such a host holds is junk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.spread import numbered, partitions, pick
from factloom.llm.text import Words, offsets, slices
from factloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
#: A slice in work, in bytes of text: sorting its words takes some tens of times that.
SLICE = 4 << 20
FACTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """A text fails below ``least_words``, or above the other bounds, in hundredths of its words, its lines' words or its length."""

    least_words: int = 50
    most_repeated: int = 50
    most_symbols: int = 10
    least_mean_length: int = 2
    most_mean_length: int = 15
    #: A host whose shrunk rate of failing texts is above this fails with all its texts.
    worst_host: float = 0.5


def base_failed(rules: Rules = Rules()) -> Column:
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))


def rule_failed(rules: Rules = Rules()) -> Column:
    """The base rules, symbols a word, and the mean length of words."""
    words = F.col("n_words")
    length = (F.col("word_chars") < rules.least_mean_length * words) | (F.col("word_chars") > rules.most_mean_length * words)
    return base_failed(rules) | (100 * F.col("n_symbols") > rules.most_symbols * words) | length


def _coded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct key, and how often the key of each row occurs."""
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    return at, times[at]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """``FACTS`` of each text; words and lines are compared as they are, not by hashes."""
    words = Words(texts)
    n = len(texts)
    rows, data = offsets(texts)
    owner = np.repeat(np.arange(n), words.counts)
    in_word = np.zeros(len(data) + 1, np.int64)
    in_word[words.starts] = 1
    in_word[words.ends] -= 1
    inside_word = np.cumsum(in_word)[:-1] > 0
    points = np.r_[0, np.cumsum(inside_word & ((data & 0xC0) != 0x80))]
    symbols = np.r_[0, np.cumsum(_SYMBOL[data])]
    # equal words have equal codes; a window's code comes from the code of its first two words and its third
    bounds = np.r_[0, np.cumsum(words.ends - words.starts)].astype(np.int32)
    letters = np.ascontiguousarray(data[inside_word])
    each = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    code = each.dictionary_encode().indices.to_numpy().astype(np.int64)
    repeated = np.zeros(len(code) + 1, np.int64)
    if len(code) > 2:
        pair, _ = _coded(code[:-1] << 32 | code[1:])
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        triple, _ = _coded(pair[inside] << 32 | code[inside + 2])
        _, times = _coded(owner[inside] << 32 | triple)
        for k in range(3):
            repeated[inside[times > 1] + k] = 1
    counted = np.r_[0, np.cumsum(repeated)]
    lines = pc.split_pattern(texts.fill_null("") if texts.null_count else texts, "\n")
    of_line = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    line = lines.flatten()
    worded = np.flatnonzero(pc.match_substring_regex(line, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False))
    line_code = line.dictionary_encode().indices.to_numpy().astype(np.int64)[worded]
    distinct = np.unique(of_line[worded] << 32 | line_code)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": np.diff(points[rows]),
        "n_symbols": np.diff(symbols[rows]),
        "n_dup_lines": np.bincount(of_line[worded], minlength=n) - np.bincount(distinct >> 32, minlength=n),
        "n_repeat_words": np.diff(counted[words.first]),
    }


def host_verdicts(facts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``host``, ``n``, ``failed``, ``rate`` (shrunk) and ``host_failed`` of facts with their hosts.

    The prior is the beta distribution with the mean and, beyond what sampling explains, the variance of the hosts' rates, each host with two texts
    or more counted once. Hosts that do not differ by more than chance all get the common rate; a null host is a host of its own.
    """
    hosts = cut_lineage(facts.groupBy("host").agg(F.count("*").alias("n"), F.sum(rule_failed(rules).cast("long")).alias("failed")))
    exact = "decimal(38,12)"
    n, k = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.where("n > 1").agg(F.count("*").alias("h"), F.sum((k / n).cast(exact)).alias("m"), F.sum((k * (k - 1) / (n * (n - 1))).cast(exact)).alias("s")).first()
    mean, weight = prior(sums.h, float(sums.m or 0), float(sums.s or 0))
    rate = (F.col("failed") + mean * weight) / (F.col("n") + weight)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate > rules.worst_host).alias("host_failed"))


#: A prior's weight in texts: hosts that agree would give an infinite one, hosts of one text each none.
MOST_WEIGHT, NO_HOSTS_WEIGHT = 1e6, 2.0


def prior(hosts: int, rates: float, squares: float) -> tuple[float, float]:
    """Mean and weight (alpha + beta) of the beta prior: moments of the rates, ``squares`` the sum of unbiased squared rates."""
    if not hosts:
        return 0.5, NO_HOSTS_WEIGHT
    mean, square = rates / hosts, squares / hosts
    spread = square - mean * mean
    if spread <= 0:
        return mean, MOST_WEIGHT
    return mean, min(MOST_WEIGHT, max(NO_HOSTS_WEIGHT, (mean - square) / spread))


def judge(df: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``df`` (``doc_id``, ``text`` and the column ``host``): facts, ``base_failed``, ``host_rate`` and ``kept``.

    Words are counted over whole texts; a null text has none, and neither has an empty one: both fail. A long text is
    measured whole, in memory of some tens of times its size. Repeated rows count as often as they come; rows without an id are judged like any other,
    rows without a host share one; other columns are ignored. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "host": part.column(1)} | {k: pa.array(v) for k, v in measure(part.column(2)).items()})

    rows = pick(df, "doc_id", host, "text").toDF("doc_id", "host", "text").select(F.col("doc_id").cast("long"), F.col("host").cast("string"), "text")
    facts = cut_lineage(rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{k} long" for k in FACTS)))
    hosts = cut_lineage(host_verdicts(facts, rules))
    known = _with_hosts(facts, hosts)
    own = rule_failed(rules)
    return known.select("doc_id", *FACTS, base_failed(rules).alias("base_failed"), (~own & ~F.col("host_failed")).alias("kept"), "host", F.col("rate").alias("host_rate"))


def _with_hosts(facts: DataFrame, hosts: DataFrame) -> DataFrame:
    """Facts joined with their hosts. Hosts with more than a partition's share of the rows are at most as many as partitions: their
    verdicts are broadcast and their rows stay where they are; all other hosts are joined by key."""
    total = hosts.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * partitions(facts.sparkSession) > total
    few = F.broadcast(hosts.where(heavy).select(F.coalesce("host", F.lit("")).alias("_host"), F.col("host").isNull().alias("_none"), "rate", "host_failed"))
    keyed = facts.withColumn("_host", F.coalesce("host", F.lit(""))).withColumn("_none", F.col("host").isNull())
    rest = hosts.where(~heavy).select(F.coalesce("host", F.lit("")).alias("_host"), F.col("host").isNull().alias("_none"), "rate", "host_failed")
    by = ["_host", "_none"]
    return keyed.join(few, by).unionByName(keyed.join(few, by, "left_anti").join(rest, by))


def drop_failed(df: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, with all their columns; each row is judged on its own, repeated ids as well."""
    named = numbered(df)
    text, source = (named.columns[df.columns.index(c)] for c in ("text", host))
    held = cut_lineage(named.withColumn("_row", F.monotonically_increasing_id()))
    verdicts = judge(held.select(F.col("_row").alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("host")), "host", rules)
    return held.join(verdicts.where("kept").select(F.col("doc_id").alias("_row")), "_row").drop("_row").toDF(*df.columns)


def judge_sql(rules: Rules = Rules()) -> str:
    """The same in DuckDB, from ``documents`` with ``source`` as host."""
    r = rules
    return f"""
with w as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
d as (select row_number() over () as row, * from w),
shingles as (select row, unnest(range(1, len(words) - 1)) as pos, words from d where len(words) > 2),
keyed as (select row, pos, [words[pos], words[pos + 1], words[pos + 2]] as g from shingles),
again as (select row, pos from keyed qualify count(*) over (partition by row, g) > 1),
covered as (select row, count(distinct pos + k) as n_repeat_words from again, (select unnest([0, 1, 2]) as k) group by row),
lines as (select row, unnest(string_split(t, chr(10))) as line from d),
dup as (select row, cast(count(*) - count(distinct line) as bigint) as n_dup_lines from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by row),
f as (select doc_id, source, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d left join dup using (row) left join covered using (row)),
v as (select *, n_words < {r.least_words} or 100 * n_repeat_words > {r.most_repeated} * n_words as base_failed,
  n_words < {r.least_words} or 100 * n_repeat_words > {r.most_repeated} * n_words or 100 * n_symbols > {r.most_symbols} * n_words
  or word_chars < {r.least_mean_length} * n_words or word_chars > {r.most_mean_length} * n_words as own from f),
h as (select source, cast(count(*) as double) as n, cast(count(*) filter (own) as double) as k from v group by source),
m as (select count(*) as c, avg(k / n) as mean, avg(k * (k - 1) / (n * (n - 1))) as square from h where n > 1),
p as (select case when c = 0 then 0.5 else mean end as mean, case when c = 0 then {NO_HOSTS_WEIGHT} when square <= mean * mean then {MOST_WEIGHT}
  else least({MOST_WEIGHT}, greatest({NO_HOSTS_WEIGHT}, (mean - square) / (square - mean * mean))) end as weight from m),
s as (select source, (k + mean * weight) / (n + weight) as rate from h, p)
select v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed, not v.own and not (s.rate > {r.worst_host}) as kept
from v join s on v.source is not distinct from s.source"""
