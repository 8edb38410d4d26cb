"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text compress
the same windows, and how much shorter the toxic one makes them is held against calibrated thresholds.

A window is a word between spaces, followed by a closing run that both dictionaries hold. Windows that
differ only in place compress alike, so each distinct one is compressed once per batch. A document's features are
the shares of its windows whose gain reaches each threshold, absolute and per byte; their weights are
fitted by penalised logistic regression.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.spread import column, map_slices, numbered, pick
from factloom.llm.text import Words

#: Labelled rows that the model is fitted on: at most this many, of texts of at most so many bytes.
SAMPLE_ROWS, SAMPLE_TEXT = 6_000, 16_384
#: Words of their ordinary texts that the ordinary dictionary is trained on, evenly from all of them.
ORDINARY_WORDS = 200_000
LEVEL = 9
ORDINARY_DICT, TOXIC_DICT = 16_384, 4_096
#: A word is telling if toxic texts hold it at least so often as ordinary ones, and at least so many do.
LEAST_RATIO, LEAST_TEXTS = 3.0, 3
#: Share of toxic texts from which on a telling word is put into their dictionary whole.
LEAST_SHARE = 0.05
LONGEST = 64
CLOSING = b"0123456789ABCDEFGHIJKLMNOPQRSTUV"
GAINS = np.arange(1, 9)
RELATIVE = np.arange(1, 8)


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content + CLOSING, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def _lengths(content: bytes, windows: list[bytes]) -> np.ndarray:
    """Compressed length of each window under one dictionary."""
    if not windows:
        return np.zeros(0, np.int64)
    size = np.array([len(w) for w in windows], np.uint64)
    segments = np.stack([np.cumsum(size, dtype=np.uint64) - size, size], 1).tobytes()
    packed = _compressor(content).multi_compress_to_buffer(zstandard.BufferWithSegments(b"".join(windows), segments))
    return np.fromiter((len(packed[k]) for k in range(len(packed))), np.int64, len(packed))


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (lower-cased, those over ``LONGEST`` bytes in pieces), the word of each window, and windows per text."""
    w = Words(texts, lower=True)
    starts, ends, counts = w.starts, w.ends, w.counts
    if len(starts) and int((ends - starts).max()) > LONGEST:
        n = -(-(ends - starts) // LONGEST)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        counts = np.add.reduceat(np.r_[n, 0], np.minimum(w.first[:-1], len(n))) * (counts > 0)
        starts = np.repeat(starts, n) + at * LONGEST
        ends = np.minimum(starts + LONGEST, np.repeat(ends, n))
    size = (ends - starts).astype(np.int64)
    gather = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.py_buffer(w.data[gather])])
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), counts


def _features(ordinary: bytes, toxic: bytes, texts: pa.Array) -> np.ndarray:
    words, at, counts = _words(texts)
    windows = [b" " + w + b" " + CLOSING for w in words]
    gain = _lengths(ordinary, windows) - _lengths(toxic, windows)
    per = np.round(8 * gain / np.maximum([len(w) for w in words], 4)).astype(np.int64) if words else gain
    doc, n = np.repeat(np.arange(len(counts)), counts), np.maximum(counts, 1)
    shares = [np.bincount(doc, weights=(x >= t)[at], minlength=len(counts)) / n for x, ts in ((gain, GAINS), (per, RELATIVE)) for t in ts]
    return np.sqrt(np.stack(shares, 1)) if len(counts) else np.zeros((0, len(GAINS) + len(RELATIVE)))


def _logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mean, spread = features.mean(0), features.std(0) + 1e-9
    x = np.c_[(features - mean) / spread, np.ones(len(features))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) / len(labels) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(labels) + penalty * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return mean, spread, w


def _trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _spread_words(texts: list[bytes], most: int) -> list[bytes]:
    """The words of the texts, each between spaces; if they are more than ``most``, so many at even distances over all texts."""
    ends = np.cumsum([len(t.split()) for t in texts])
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) if total <= most else np.arange(most) * total // most
    out, start = [], 0
    for t, end in zip(texts, ends, strict=True):
        words = t.lower().split()
        out += [b" " + words[k - start] + b" " for k in at[np.searchsorted(at, start) : np.searchsorted(at, end)]]
        start = int(end)
    return out


def fit(texts: list[bytes], labels: list[int]) -> Model | None:
    """Fits dictionaries, thresholds' weights and scale; None unless both labels occur.

    The toxic dictionary is trained on the words that tell toxic texts from ordinary ones, each as often as toxic
    texts hold it; the ordinary one on at most ``ORDINARY_WORDS`` words, evenly from all ordinary texts.
    """
    y = np.array(labels)
    if not (y == 1).any() or not (y == 0).any():
        return None
    column = pa.array(texts, pa.binary())
    words, at, counts = _words(column)
    doc = np.repeat(np.arange(len(counts)), counts)
    held = np.unique(doc * max(1, len(words)) + at)  # each word once a text
    word, label = held % max(1, len(words)), y[held // max(1, len(words))]
    in_toxic = np.bincount(word[label == 1], minlength=len(words))
    in_ordinary = np.bincount(word[label == 0], minlength=len(words))
    ratio = (in_toxic / max(1, (y == 1).sum())) / ((in_ordinary + 1) / (y == 0).sum())
    telling = [k for k in np.lexsort((np.arange(len(words)), -ratio)) if ratio[k] > LEAST_RATIO and in_toxic[k] >= LEAST_TEXTS]
    trained = _trained([b" " + words[k] + b" " for k in telling for _ in range(int(in_toxic[k]))], TOXIC_DICT)
    # the trained dictionary keeps frequent pieces; telling words that many toxic texts hold follow whole
    common = [words[k] for k in reversed(telling) if in_toxic[k] >= LEAST_SHARE * (y == 1).sum()]
    toxic = trained + (b" " + b" ".join(common) + b" ")[-TOXIC_DICT:]
    plain = [t for t, label in zip(texts, labels, strict=True) if label == 0]
    ordinary = _trained(_spread_words(plain, ORDINARY_WORDS), ORDINARY_DICT)
    return Model(ordinary, toxic, *_logistic(_features(ordinary, toxic, column), y.astype(float)))


def fit_on(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fits the model in one task on a bounded sample, of which only the model reaches the driver.

    The sample: of the labelled ids with crc32 mod 5 other than 0 the ``SAMPLE_ROWS`` with the smallest hashes, two numbers
    each, which are broadcast; of their rows those with texts of at most ``SAMPLE_TEXT`` bytes. Ids with two different
    labels, and null ids, labels or texts, teach nothing.
    """
    known = pick(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_top")).where("toxic = _top").drop("_top")
    known = known.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where(F.octet_length("text") <= SAMPLE_TEXT)
    picked = rows.join(F.broadcast(few), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE_ROWS).select("text", "toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(tuple(found) if (found := fit(texts, marks)) else None)], pa.binary())})

    found = picked.coalesce(1).mapInArrow(learn, "model binary").first()
    content = pickle.loads(bytes(found.model)) if found else None
    return Model(*content) if content else None


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) for every row of ``docs``.

    Only whole texts enter a score. Null and empty texts have no window and get the score of a text without any
    gain. Without a label of each kind to learn from every score is 0. Repeated rows score alike; a null id is
    not held out; other columns are ignored.
    """
    model = model or fit_on(docs, labels)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = batch.num_rows
        if model is None:
            p = np.zeros(n)
        else:
            x = np.c_[(_features(model.ordinary, model.toxic, batch.column(1)) - model.mean) / model.spread, np.ones(n)]
            p = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    scored = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(map_slices(run), "doc_id long, score double")
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns; scored where they lie, without a join."""
    model = model or fit_on(docs, labels)
    if model is None:
        return docs
    rows, text = numbered(docs), column(docs, "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.c_[(_features(model.ordinary, model.toxic, batch.column(text)) - model.mean) / model.spread, np.ones(batch.num_rows)]
        yield batch.filter(pa.array(x @ model.weights < 0.0))

    return rows.mapInArrow(map_slices(run, text), rows.schema).toDF(*docs.columns)
