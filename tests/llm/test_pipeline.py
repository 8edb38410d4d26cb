"""The corpus pipeline as a whole: against its stages one by one, and on empty tables."""

from __future__ import annotations

import random
import zlib

import numpy as np

import corpus_pipeline
from factloom.llm.encode import Encoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}" for k in range(300)]
BAD = ["idiotic", "moronic", "pathetic", "worthless"]


def write(spark, folder, rows, labels):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def corpus_rows():
    rng = random.Random(12)
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    rows, labels = [], []
    for k in range(700):
        w = [rng.choice(WORDS) + rng.choice(("ing", "ed", "")) for _ in range(rng.randint(60, 200))]
        toxic = int(k % 6 == 0)
        for _ in range(len(w) // 12 + 1 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        text = " ".join(w)
        rows.append((k, text + (" " + passage if k % 50 == 1 else ""), "en", f"s{k % 3}", len(text)))
        labels.append((k, 1, toxic))
    rows += [(800 + k, rows[k][1], "en", "s0", 1) for k in range(1, 40, 7)] + [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, "long " * 20_000, "en", "s1", 1)]
    return rows, labels, passage


def test_run_is_its_stages_one_by_one(corpus, tmp_path):
    rows, labels, passage = corpus_rows()
    folder = f"file://{tmp_path}/in"
    write(corpus, folder, rows, labels)
    docs = corpus.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(corpus, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = corpus.read.parquet(f"file://{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    clean, single, cut, _ = kept
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & clean.keys()) < 0.05 * len(toxic) and len({r[0] for r in rows} - toxic - clean.keys()) < 5
    # one of each group of copies, and the first of it
    assert not any(800 <= i < 900 for i in single if i - 800 in single) and {900, 901, 902} <= single.keys()
    assert all(passage not in (t or "") for t in cut.values()) and cut.keys() == single.keys()
    encoder = Encoder(tokenizer_path())
    ids = lambda text: np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    want = sorted((r.doc_id, len(ids(r.text))) for r in docs.collect())
    pieces = corpus_pipeline.run(corpus, folder).collect()
    assert sorted((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0) == want
    texts = {r.doc_id: ids(r.text) for r in docs.collect()}
    assert all(zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)
    assert sum(r.length for r in pieces) == sum(n for _, n in want)


def test_run_on_empty_tables(corpus, tmp_path):
    folder = f"file://{tmp_path}/in"
    write(corpus, folder, [], [])
    assert corpus_pipeline.run(corpus, folder).collect() == []
