"""Token alignment, host quality and fill-in-middle against brute force, round trips and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from factloom.checks.compare import rows_of
from factloom.llm import fill_middle, quality, token_align, top_products
from factloom.llm.csr import Rows, members, spans

WILD = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, key long, _t long, c0 string, n_a long, host string, _row long"
PARTS = [" ", " ", "  ", "\n", "\n\n", "\t", "a", "Bc", "ee ", "xx yy", "　", "\x1c", "é", "1", ".", "'s", "<|endoftext|>", "<s>", "</s>", "漢", "\x85", "​", "\0", "▁", "the and", "\xa0", "ñ é", "disgusting ", " 🙂"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "other", 1, 2, "z", 5, "h", 9) for i, t, s in rows], WILD).repartition(3)


def wild_rows(seed, n):
    rng = random.Random(seed)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))), f"s{k % 4}") for k in range(n)]
    plain = [" ".join(rng.choice(["stream", "aligned", "tokens", "of", "the", "unbelievable", "naïve"]) for _ in range(60)) for _ in range(20)]
    rows += [(n + k, t, None) for k, t in enumerate(plain)]
    return rows + [(0, rows[0][1], "s0"), (None, plain[0], None), (None, None, "s1"), (7000, None, "s2"), (7001, "", "s2"), (7002, " ", "s2"), (7003, "long words " * 4000, "s3")]


# -- token alignment ------------------------------------------------------------------------------
def test_products_match_dense_matrices():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = (rng.integers(0, 3, size) * (rng.random(size) < 0.3) for size in ((6, 9), (9, 5)))
        rows = [Rows(np.r_[0, np.cumsum((m != 0).sum(1))], np.nonzero(m)[1], m[m != 0], m.shape[1]) for m in (a, b)]
        i, j, v = rows[0].times(rows[1]).entries()
        dense = np.zeros((6, 5), int)
        dense[i, j] = v
        want = a @ b
        assert np.array_equal(dense, want)
        i, j, v = rows[0].transposed().entries()
        assert sorted(zip(i, j, v)) == sorted(zip(*np.nonzero(a)[::-1], a[a != 0]))
    assert spans(np.array([2, 5])).times(spans(np.array([3, 5])).transposed()).entries()[2].tolist() == [2, 1, 2]
    assert members(np.array([0, 0, 1]), 2).times(members(np.array([0, 1, 1]), 2).transposed()).columns.tolist() == [0, 0, 1, 2]


def brute_links(both, text):
    """Ids, groups and links of a text by the definition, or None where it has no tokens."""
    if not text:
        return None
    a, b = both.a.encode([" " + text])[0], both.b.model.encode(text)
    letters = [[bytes(v.data[v.start[i] : v.start[i] + v.size[i]]) for i in ids] for v, ids in ((both.a.vocabulary, a), (both.b.vocabulary, b))]
    if any(b"".join(x) != (" " + text).encode() for x in letters):
        return None
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in letters]
    groups, p, q = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        left, right = [], []
        while p < len(a) and ends[0][p] <= end:
            left.append(a[p])
            p += 1
        while q < len(b) and ends[1][q] <= end:
            right.append(b[q])
            q += 1
        groups.append((left, right))
    links = [(i, j) for x, y in _near(ends, letters) for i, j in [(x, y)]]
    return a, b, groups, links


def _near(ends, letters):
    j = 0
    for i, end in enumerate(ends[0]):
        start = end - len(letters[0][i])
        while ends[1][j] <= start:
            j += 1
        k = j
        while k < len(ends[1]) and ends[1][k] - len(letters[1][k]) < end:
            yield i, k
            k += 1


@pytest.mark.parametrize("broadcast_pairs", [token_align.BROADCAST_PAIRS, 0])
def test_alignment_matches_brute_force(corpus, broadcast_pairs):
    both = token_align.Aligner(*token_align._paths(None, None))
    rows = wild_rows(11, 400)
    found = [brute_links(both, t) for _, t, _ in rows]
    count = Counter(p for f in found if f for p in {(f[0][i], f[1][j]) for i, j in f[3]})
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    want = []
    for (i, _, _), f in zip(rows, found, strict=True):
        if not f:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        of = [count[a[i], b[j]] for i, j in links]
        best = sum(count[a[i], b[j]] == most[a[i]] for i, j in links)
        want.append((i, len(a), len(b), len(groups), len(links), best, sum(of), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in token_align.link_counts(table(corpus, rows), broadcast_pairs=broadcast_pairs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(f is None for f in found) > 20
    assert token_align.link_counts(table(corpus, []), broadcast_pairs=broadcast_pairs).collect() == []


def test_units_join_to_whole_texts_and_links_come_as_rows(corpus):
    both = token_align.Aligner(*token_align._paths(None, None))
    rows = [(k, t, "s") for k, (_, t, _) in enumerate(wild_rows(5, 200))]
    of = {i: brute_links(both, t) for i, t, _ in rows}
    overlap = {(r.doc_id, r.a_index, r.b_index) for r in token_align.token_links(table(corpus, rows)).collect()}
    assert overlap == {(i, x, y) for i, f in of.items() if f for x, y in f[3]}
    shared = Counter(r.doc_id for r in token_align.token_links(table(corpus, rows), "group").collect())
    assert shared == Counter({i: n for i, f in of.items() if f and (n := sum(len(x) * len(y) for x, y in f[2]))})


def test_pairs_beyond_what_a_task_holds(corpus, monkeypatch):
    rows = [(k, t, "s") for k, (_, t, _) in enumerate(wild_rows(5, 60))]
    aligned = token_align.alignments(table(corpus, rows)).cache()
    want = Counter(x for r in aligned.collect() for x in np.frombuffer(r.pairs, "<i8").tolist())
    monkeypatch.setattr(token_align, "HELD_PAIRS", 5)
    got = token_align.pair_counts(aligned, 32000).collect()
    assert {r.pair: r.n for r in got} == want and len(got) == len(want)
    aligned.unpersist()


# -- host quality ----------------------------------------------------------------------------------
def brute_facts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def quality_rows():
    rng = random.Random(4)
    rows = wild_rows(9, 150)
    rows = [(i, t, s if s is None else s) for i, t, s in rows]
    for k in range(300):
        good = " ".join(rng.choice(["river", "été", "stone", "walks", "under", "moon"]) + str(rng.randint(0, 99)) for _ in range(80))
        junk = "buy now ## \nbuy now ##\n" * 30
        rows.append((1000 + k, junk if k % 3 == 0 else good, "farm" if k % 3 == 0 or k < 20 else f"host{k % 7}"))
    return rows + [(5000, "a" * 70_000, "s0"), (5001, "same line here\n" * 3000, "s0")]


def test_quality_facts_and_verdicts(corpus):
    rows = quality_rows()
    got = quality.judge(table(corpus, rows)).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted([(i, *brute_facts(t)) for i, t, _ in rows], key=str)
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    duck.executemany("insert into documents values (?, ?, ?)", rows)
    cur = duck.execute(quality.judge_sql())
    cols = [d[0] for d in cur.description]
    assert rows_of(cols, cur.fetchall()) == rows_of(cols, [tuple(r[c] for c in cols) for r in got])
    clean = {r.doc_id: r.kept for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1300}
    # a farm's clean pages go with it, those of other hosts stay
    assert not any(clean[1000 + k] for k in range(20)) and all(clean[1000 + k] for k in range(20, 300) if k % 3)
    kept = quality.drop_failed(table(corpus, rows))
    assert kept.columns == WILD.replace(" long", "").replace(" string", "").split(", ") and kept.count() == sum(r.kept for r in got)
    assert quality.judge(table(corpus, [])).collect() == [] and quality.drop_failed(table(corpus, [])).collect() == []


def test_prior_shrinks_small_hosts_only(corpus):
    facts = [(h, k < bad, n) for h, (n, bad) in {"big": (400, 300), "one": (1, 1), **{f"g{k}": (50, 5) for k in range(40)}, None: (30, 3)}.items() for k in range(n)]
    rows = [(h, 0 if failed else 100, 500, 0, 0, 0) for h, failed, _ in facts]
    of = corpus.createDataFrame(rows, "host string, " + ", ".join(f"{k} long" for k in quality.FACTS))
    rates = {r.host: (r.rate, r.host_failed) for r in quality.host_verdicts(of).collect()}
    assert rates["big"][1] and rates["big"][0] > 0.7 and not rates["one"][1] and rates["one"][0] < 0.5 and None in rates
    # hosts that agree, no hosts, and the moments of a known beta distribution
    assert quality.prior(10, 2.0, 0.4) == (0.2, quality.MOST_WEIGHT) and quality.prior(0, 0, 0) == (0.5, quality.NO_HOSTS_WEIGHT)
    mean, weight = quality.prior(1, 0.25, 0.25 * 3 / 9)
    assert mean == 0.25 and abs(weight - 8) < 1e-9


# -- fill in middle ----------------------------------------------------------------------------------
def test_rank_index_gives_back_every_value():
    rng = np.random.default_rng(1)
    for error in (3, 127, 5000):
        for n in (0, 1, 2, 3, 1000, 20_000):
            steps = rng.integers(0, 90, n)
            steps[rng.random(n) < 0.01] = 100_000
            values = np.cumsum(steps)
            index = fill_middle.RankIndex(values, error)
            assert np.array_equal(index[np.arange(n)], values) and (n == 0 or np.abs(index.residual.astype(int)).max() <= error)
            assert error < 100 or n < 1000 or len(index.first) < n / 2


def brute_middle(i, text, plan):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digest = len(units), hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in plan.marks) or h[2] % 100 >= plan.cut:
        return i, n, "plain", None, None, text
    p, s, m = plan.marks
    form = "spm" if h[3] % 100 < plan.spm else "psm"
    return i, n, form, len(pre), len(mid), f"{p}{pre}{s}{suf}{m}{mid}" if form == "psm" else f"{s}{suf}{p}{pre}{m}{mid}"


@pytest.mark.parametrize("plan", [fill_middle.Plan(), fill_middle.Plan("x", 70, 20, "[a]", "\\E|", "(é")])
def test_middles_match_brute_force_and_come_back(corpus, plan):
    rng = random.Random(8)
    parts = ["\n", "\n\n", "a line\n", "é漢🙂 ", "end", "<P", "P>", "<S>", "<", "\r\n", "\0", " ", "[a]", "\\E"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), "s") for k in range(500)]
    rows += [(600, None, "s"), (601, "", "s"), (None, "x\ny\n", "s"), (None, None, "s"), (602, "one line of many\n" * 20_000, "s"), (603, "\n" * 70_000, "s"), (3, rows[3][1], "s"), (604, "z" * 300_000 + "\n" + "y", "s")]
    got = fill_middle.transform(table(corpus, rows), plan)
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted([brute_middle(i, t, plan) for i, t, _ in rows], key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    back = sorted([(r.doc_id, r.restored_sha256) for r in fill_middle.digest(table(corpus, rows), plan).collect()], key=str)
    assert back == sorted([(i, sha(t)) for i, t, _ in rows], key=str)
    assert fill_middle.transform(table(corpus, []), plan).collect() == []
    for marks in (("<", "<P>", "<S>"), ("aa", "b", "c"), ("x<", "<y", "z"), ("", "a", "b"), ("a", "a", "b")):
        with pytest.raises(ValueError):
            fill_middle.Plan("7", 100, 50, *marks)


# -- exact products of large components ------------------------------------------------------------
@pytest.mark.parametrize("size", [1.0, 1e5, 1e6, 3e6, 1e7, 1e12, 1e16, 1e300])
def test_products_are_integers_at_any_size(corpus, size):
    rng = np.random.default_rng(int(np.log10(size)) + 1)
    cells = rng.normal(size=(160, 12)) * size
    rows = [(k, [float(x) for x in v], 1) for k, v in enumerate(cells)]
    most = top_products.MOST_COMPONENT
    ints = [[max(-most, min(most, int(np.floor(np.float64(256) * x)) if abs(256 * x) < 1e300 else int(np.sign(x)) * most)) for x in v] for v in cells]
    want = {}
    for q in range(0, 160, 50):
        scores = [sum(a * b for a, b in zip(ints[q], v, strict=True)) for v in ints]
        order = sorted((k for k in range(160) if k != q), key=lambda k: (-scores[k], k))[:5]
        want.update({(q, i + 1): (k, max(-(2**63), min(2**63 - 1, scores[k]))) for i, k in enumerate(order)})
    df = corpus.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_products.top_products(df).collect()} == want
