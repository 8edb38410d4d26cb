"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables for every operator and stage."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from factloom.llm import licenses, mixing, ngram_join, packing, substrings, token_files, top_products, toxicity, url_filter, vector_range

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, key long, _t long, c0 string"


def documents(spark, rows=None):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    long_text = " ".join(rng.choice(words) for _ in range(9000))
    some = " ".join(rng.choice(words) for _ in range(60))
    if rows is None:
        rows = [(1, some, "a"), (2, some, "a"), (2, some, "a"), (None, some, None), (None, None, None), (3, None, "b"), (4, "", "b"), (5, " \n\t ", "b"), (6, "one", "c"), (6, "one", "c"), (7, long_text, "c"), (8, long_text + " more", "a"), (9, "x" * 5000, "a")]
    return spark.createDataFrame([(i, t, None, s, None if t is None else len(t), "other", 1, 2, "z") for i, t, s in rows], DOCS)


def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2, "x") for k in range(10)] + [(None, 1, 1, "x"), (3, 1, None, "x"), (1, 0, 0, "y")], "doc_id long, quality int, toxic int, DOC_ID_ string")


def vectors(spark, rows=None):
    nan, inf = float("nan"), float("inf")
    if rows is None:
        rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (50, [0.9, 0.1], 1), (51, [2.0, 0.0], 1), (52, [0.0, -0.0], 1), (53, None, 1), (54, [], 1), (55, [1.0, None], 1), (56, [nan, 1.0], 1), (57, [inf, 1.0], 1), (58, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (None, None, None), (100, [1.0, 0.0, 0.0], 1)]
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<double>, label int, LABEL_ string, key int")


TEXT_OPERATORS = {
    "mix": (mixing.plan_mix, 13),
    "substrings": (substrings.removal_digest, 13),
    "licenses": (licenses.scan, 13),
    "packing": (packing.pack, None),
    "ngrams": (ngram_join.jaccard_components, 13),
    "tokens": (lambda d: token_files.read_token_files(token_files.write_token_files(d)), 13),
}


@pytest.mark.parametrize("name", TEXT_OPERATORS)
def test_text_operators(corpus, name):
    f, n = TEXT_OPERATORS[name]
    rows = f(documents(corpus)).collect()
    assert n is None or len(rows) == n
    assert f(documents(corpus, [])).collect() == []


def test_toxicity(corpus):
    rows = toxicity.score(documents(corpus), labels(corpus)).collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(documents(corpus, []), labels(corpus)).collect() == []
    assert all(r.score == 0 for r in toxicity.score(documents(corpus), labels(corpus).where("false")).collect())


def test_defined_results(corpus):
    docs = documents(corpus)
    near = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert near[(2, 58)] == 1 and near[(None, 58)] == 1 and near[(4, 0)] == 4 and near[(None, 0)] is None and near[(6, 1)] == 6
    cut = {r.doc_id: r for r in substrings.removal_digest(docs).collect() if r.doc_id is not None}
    assert cut[1].n_removed == 60 and cut[6].n_removed == 0 and cut[3].n_words == 0 and cut[7].n_removed == 9000 and cut[8].n_removed == 9000
    assert {r.doc_id: r.n_tokens for r in TEXT_OPERATORS["tokens"][0](docs).collect()}[4] == 1
    taken = mixing.plan_mix(docs).collect()
    assert all(r.taken <= 2 * r.size for r in taken)


def test_pages(corpus):
    rows = [(1, "http://A.Net/x"), (1, "http://A.Net/x"), (2, None), (3, ""), (4, "no scheme"), (5, "http://example.net/en/1"), (6, "ftp://example.net"), (7, "http://x.org/fr/?a://b/de/"), (8, "http://free-bets.example.org/"), (None, "http://bets/")]
    pages = corpus.createDataFrame([(*r, "a", "b") for r in rows], "page_id long, url string, host string, URL_ string")
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages).collect()), key=str)
    want = [(1, "net/", "block"), (1, "net/", "block"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, "example.net/en/", "allow"), (6, None, "allow"), (7, "org/fr/", "allow"), (8, None, "block"), (None, None, "block")]
    assert got == sorted(want, key=str)
    assert url_filter.judge(pages.where("false")).collect() == []


def test_vectors(corpus):
    rows = vector_range.range_links(vectors(corpus)).collect()
    assert len(rows) == 14
    by = {r.vec_id: r for r in rows if r.vec_id is not None}
    assert by[0].n_links == 4 and by[51].n_links == 4 and by[51].component_id == 0 and by[50].n_links == 4 and not by[51].kept and by[52].n_links == 0 and by[58].kept and by[100].n_links == 0
    assert sorted((r.n_links, r.component_id, r.kept) for r in rows if r.vec_id is None and r.component_id is not None) == [(4, 0, False)]
    found = top_products.top_products(vectors(corpus)).collect()
    assert {(r.rank, r.vec_id, r.score) for r in found if r.query_id == 0} == {(1, 51, 131072), (2, 58, 65536), (3, None, 65536), (4, 50, 58880), (5, 52, 0)}
    assert [r for r in found if r.query_id == 100] == []
    empty = vectors(corpus, [])
    assert vector_range.range_links(empty).collect() == [] and top_products.top_products(empty).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages(corpus, tmp_path, k):
    labels(corpus).write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    docs = documents(corpus)
    out = stage(corpus, docs, str(tmp_path))
    rows = out.collect()
    assert k == 4 or out.columns == docs.columns
    assert k != 1 or sum(r.doc_id is not None for r in rows) == 7
    assert stage(corpus, documents(corpus, []), str(tmp_path)).collect() == []


def test_wide_vectors_match_brute_force(corpus):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16))
    rows = []
    for k in range(600):
        v = base[k % 40] + rng.normal(size=16) * rng.choice([0.05, 0.3, 2.0])
        rows.append((k, [float(x) for x in v], int(k % 3)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_range.range_links(vectors(corpus, rows)).collect()}
    m = np.array([r[1] for r in rows])
    u = m / np.linalg.norm(m, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    link = (u @ u.T >= 0.93) & (lab[:, None] == lab[None]) & ~np.eye(len(rows), dtype=bool)
    comp = np.arange(len(rows))
    while True:
        low = np.minimum(comp, np.where(link, comp[None], len(rows)).min(1))
        if (low == comp).all():
            break
        comp = low
    assert got == {k: (int(link[k].sum()), int(comp[k])) for k in range(len(rows))}
    ints = np.floor(256 * m).astype(int)
    want = {}
    for q in range(0, 600, 50):
        s = ints @ ints[q]
        order = [k for k in np.lexsort((np.arange(600), -s)) if k != q][:5]
        want.update({(q, i + 1): (int(k), int(s[k])) for i, k in enumerate(order)})
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_products.top_products(vectors(corpus, rows)).collect()} == want


def test_near_copies_keep_other_texts_of_a_repeated_id(corpus):
    some, other, third = (" ".join(f"{p}{k}" for k in range(40)) for p in "abc")
    # the second text of 2 copies the text of 1; 3 has two texts of its own; the second text of 4 is blank
    rows = [(1, some, "s"), (2, other, "s"), (2, some, "s"), (3, third, "s"), (3, third[:60], "s"), (3, third, "s"), (4, other + " end", "s"), (4, " ", "s")]
    got = sorted((r.doc_id, r.text) for r in ngram_join.drop_near_copies(documents(corpus, rows)).collect())
    assert got == sorted([(1, some), (2, other), (3, third), (3, third[:60]), (4, " ")])


def test_ordinary_words_come_from_all_texts():
    texts = [b"X " * 300, b"", b" y" * 100]
    got = toxicity._spread_words(texts, 100)
    assert len(got) == 100 and got.count(b" x ") == 75 and got.count(b" y ") == 25
    assert toxicity._spread_words(texts, 400) == [b" x "] * 300 + [b" y "] * 100 and toxicity._spread_words([], 5) == []
