"""Fill-in-middle texts: prefix, middle and suffix cut at unit boundaries found through a learned rank index.

The boundaries of a run of texts are one rising sequence of byte offsets. ``RankIndex`` learns it as straight segments whose error
stays within a bound, and keeps each boundary's error in one byte: an offset is its segment's prediction plus the stored
residual, exactly. Cuts are drawn from a keyed hash of the document's id, so reruns and other layouts agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.spread import pick
from factloom.llm.text import offsets, slices


@dataclass(frozen=True)
class Plan:
    """Shares in hundredths; sentinels open prefix, suffix and middle and must not occur in a text that is cut.

    No sentinel may begin another, and what one begins with may not stand inside one: so a text's end and a sentinel never make another.
    """

    seed: str = "7"
    cut: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        pairs = [(a, b) for i, a in enumerate(self.marks) for j, b in enumerate(self.marks) if i != j]
        if not all(self.marks) or any(b.startswith(a) for a, b in pairs) or any(a[0] in b[1:] for a in self.marks for b in self.marks):
            raise ValueError(f"sentinels {self.marks} cannot be told apart")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


class RankIndex:
    """A rising sequence as segments (first rank, first value, slope) and a residual of at most ``error`` for each rank."""

    def __init__(self, values: np.ndarray, error: int = 127):
        n = len(values)
        done: list[np.ndarray] = []
        lo, hi = np.array([0] * (n > 0), np.int64), np.array([n] * (n > 0), np.int64)
        while len(lo):
            slope = (values[hi - 1] - values[lo]) / np.maximum(hi - 1 - lo, 1)
            size = hi - lo
            rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            off = values[np.repeat(lo, size) + rank] - self._line(np.repeat(values[lo], size), np.repeat(slope, size), rank)
            wide = np.maximum.reduceat(np.abs(off), np.cumsum(size) - size) > error
            done.append(np.stack([lo[~wide], values[lo[~wide]], slope[~wide].view(np.int64)]))
            lo, hi, middle = lo[wide], hi[wide], (lo[wide] + hi[wide]) // 2
            lo, hi = np.r_[lo, middle], np.r_[middle, hi]
        found = np.concatenate(done, axis=1) if done else np.zeros((3, 0), np.int64)
        found = found[:, np.argsort(found[0])]
        self.first, self.base, self.slope = found[0], found[1], np.ascontiguousarray(found[2]).view(np.float64)
        self.residual = np.zeros(n, np.int8 if error < 128 else np.int64)
        self.residual = (values - self.predict(np.arange(n))).astype(self.residual.dtype)

    @staticmethod
    def _line(base: np.ndarray, slope: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return base + np.rint(slope * rank).astype(np.int64)

    def predict(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.first, rank, side="right") - 1
        return self._line(self.base[at], self.slope[at], rank - self.first[at])

    def __getitem__(self, rank: np.ndarray) -> np.ndarray:
        return self.predict(rank) + self.residual[rank]


def boundaries(rows: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets where lines begin or end in texts with offsets ``rows``, and each text's first rank among them.

    Each text has one more boundary than lines; neighbours share an offset but not a rank.
    """
    after = np.flatnonzero(data == 10) + 1
    inner = after[~np.isin(after, rows)]
    owner = np.searchsorted(rows, inner, side="right") - 1
    full = np.flatnonzero(np.diff(rows) > 0)
    place = np.r_[inner, rows[:-1], rows[1:][full]]
    doc = np.r_[owner, np.arange(len(rows) - 1), full]
    order = np.lexsort((place, doc))
    first = np.searchsorted(doc[order], np.arange(len(rows)))
    return place[order], first


def draws(doc_id: int | None, seed: str) -> list[int]:
    """The first four numbers of 32 bits of the SHA-256 of seed and id; no id is an empty one."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(raw[k : k + 4], "big") for k in range(0, 16, 4)]


def _formed(ids: list, column: pa.Array, plan: Plan) -> dict[str, list]:
    rows, data = offsets(column)
    raw = data.tobytes()
    places, first = boundaries(rows, data)
    index = RankIndex(places)
    n = np.diff(first) - 1
    h = np.array([draws(i, plan.seed) for i in ids], np.int64).reshape(-1, 4)
    low, high = np.sort(np.stack([h[:, 0] % (n + 1), h[:, 1] % (n + 1)]), axis=0)
    one, two = index[first[:-1] + low], index[first[:-1] + high]
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    marks = [m.encode() for m in plan.marks]
    out: dict[str, list] = {"n": n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "text": []}
    for k in range(len(ids)):
        text = raw[rows[k] : rows[k + 1]]
        plain = not text or h[k, 2] % 100 >= plan.cut or any(m in text for m in marks)
        form = "plain" if plain else "spm" if h[k, 3] % 100 < plan.spm else "psm"
        a, b, c = text[: one[k] - rows[k]], text[one[k] - rows[k] : two[k] - rows[k]], text[two[k] - rows[k] :]
        parts = {"plain": (text,), "psm": (marks[0], a, marks[1], c, marks[2], b), "spm": (marks[1], c, marks[0], a, marks[2], b)}[form]
        out["form"].append(form)
        out["prefix_chars"].append(None if plain else int(points[one[k]] - points[rows[k]]))
        out["middle_chars"].append(None if plain else int(points[two[k]] - points[one[k]]))
        out["text"].append(b"".join(parts))
    return out


FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, text string"


def transform(df: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """One row per row of ``df`` (``doc_id``, ``text``): the number of lines, the form, the sizes of its parts in code points and the new text.

    The cuts fall between lines, each with its line break. A null text is empty; empty texts and texts that
    hold a sentinel stay plain, with null sizes. Repeated rows give equal rows, rows without an id share one draw; long texts are worked on whole, at some ten times their
    size in memory; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = _formed(part.column(0).to_pylist(), part.column(1), plan)
                long = {k: pa.array(found[k], pa.int64()) for k in ("n", "prefix_chars", "middle_chars")}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n": long["n"], "form": pa.array(found["form"], pa.string()), "prefix_chars": long["prefix_chars"], "middle_chars": long["middle_chars"], "text": pa.array(found["text"], pa.binary()).cast(pa.string())})

    return pick(df, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FORMED)


def restore(text: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    escaped = lambda mark: "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in mark)
    parts = F.split(text, "|".join(map(escaped, plan.marks)))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def digest(df: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``transform`` with SHA-256 digests of the new and of the restored text in place of the text."""
    back = restore(F.col("text"), F.col("form"), plan)
    return transform(df, plan).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def digest_sql(plan: Plan = Plan()) -> str:
    """The same in DuckDB, from ``documents``."""
    p, s, m = plan.marks
    hold = " or ".join(f"contains(t, '{x}')" for x in plan.marks)
    return f"""
with d as (select doc_id, coalesce(text, '') as t, sha256('{plan.seed}:' || coalesce(cast(doc_id as varchar), '')) as h, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as units from documents),
k as (select *, cast(len(units) as bigint) as n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as g from d),
c as (select *, least(g[1] % (n + 1), g[2] % (n + 1)) as a, greatest(g[1] % (n + 1), g[2] % (n + 1)) as b,
  case when t = '' or {hold} or g[3] % 100 >= {plan.cut} then 'plain' when g[4] % 100 < {plan.spm} then 'spm' else 'psm' end as form from k),
x as (select *, array_to_string(units[1:a], '') as pre, array_to_string(units[a + 1:b], '') as mid, array_to_string(units[b + 1:], '') as suf from c)
select doc_id, n, form, case when form <> 'plain' then length(pre) end as prefix_chars, case when form <> 'plain' then length(mid) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{p}' || pre || '{s}' || suf || '{m}' || mid else '{s}' || suf || '{p}' || pre || '{m}' || mid end) as output_sha256,
  sha256(t) as restored_sha256 from x"""
