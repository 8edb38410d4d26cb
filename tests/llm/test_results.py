"""Operators that SQL cannot express, against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import random
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from factloom.llm import licenses, mixing, ngram_join, packing, substrings, token_files, toxicity
from factloom.llm.encode import Encoder, tokenizer_path

WORDS = [f"w{k}" for k in range(300)]


def texts(seed, n=120, most=400):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.fixture(scope="module")
def docs(corpus):
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts(1))]
    rows += [(200 + k, rows[k][1] + " tail", "en", "s0", 1) for k in range(10)] + [(300, rows[5][1], "en", None, 1), (301, None, "en", "s1", None)]
    return table(corpus, rows).cache()


def whole_ids(encoder, text, end):
    return np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, end], np.uint32)


def test_encode_equals_whole_texts():
    encoder, rng = Encoder(tokenizer_path()), random.Random(2)
    parts = [" ", " ", "  ", "\n", "\t", "a", "Bc", "ee ", "xx yy", "　", "\x1c", "é", "1", ".", "'s", "<|endoftext|>", "漢", "\x85", "​", "\0"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + texts(3, 30)
    for text, ids in zip(some, encoder.encode(pa.array(some)), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_mix_meets_targets_and_reruns_agree(corpus):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(0, 900), "en", ("a", "b", "c", None)[min(3, int(rng.expovariate(0.7)))], 1) for k in range(3000)]
    plan = mixing.plan_mix(table(corpus, rows)).collect()
    assert len(plan) == 3000
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    weights = dict(zip(("a", "b", "c", None), (3, 1, 2, 3)))
    total, target, free = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        left, w = total - sum(target.values()), sum(weights[s] for s in free)
        full = {s for s in free if left * weights[s] / w >= 2 * sizes[s]}
        if not full:
            break
        target.update({s: 2 * sizes[s] for s in full})
        free -= full
    target.update({s: left * weights[s] / w for s in free})
    for s in sizes:
        mine = [r for r in plan if r.source == s]
        assert abs(mine[0].target - target[s]) < 1e-6 * total and mine[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in mine) - target[s]) <= 20
        assert all(r.taken <= 2 * r.size for r in mine)
    again = mixing.plan_mix(table(corpus, rows).repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in plan)
    times = {r.doc_id: r.times for r in plan}
    out = [r.doc_id for r in mixing.mix(table(corpus, rows)).select("doc_id").collect()]
    assert sorted(out) == sorted(d for d, n in times.items() for _ in range(n))


def test_packing_places_every_id_once(docs):
    encoder = Encoder(tokenizer_path())
    ids = {r.doc_id: whole_ids(encoder, r.text, 0) for r in docs.collect()}
    rows = packing.pack(docs, with_ids=True, size=256, open_windows=4).collect()
    seqs, cover = {}, {}
    for r in rows:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert np.frombuffer(r.ids, "<u4").tolist() == piece.tolist() and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert cover.keys() == ids.keys()
    for spans, end in [(v, len(ids[d])) for d, v in cover.items()] + [(v, None) for v in seqs.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == end if end is not None else at <= 256
    used = sum(length for v in seqs.values() for _, length in v)
    assert used / (256 * len(seqs)) > 0.95


def test_token_files_round_trip_and_random_access(docs, tmp_path):
    encoder = Encoder(tokenizer_path())
    ids = {r.doc_id: whole_ids(encoder, r.text, 2) for r in docs.collect()}
    manifest = token_files.write_token_files(docs, folder=f"file://{tmp_path}/tokens").cache()
    rows = sorted(token_files.read_token_files(manifest, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids)
    start = 0
    for r in rows:
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == ids[r.doc_id].tolist() and r.n_tokens == len(ids[r.doc_id])
        start += r.n_tokens
    fs, path = token_files._open(manifest.first().file)
    with fs.open_input_file(path) as source:
        reader = token_files.Reader(source)
        got = dict(reader.documents(np.array([1, 3])))
        assert {int(reader.docs[d]): v.tolist() for d, v in got.items()} == {int(reader.docs[d]): ids[int(reader.docs[d])].tolist() for d in (1, 3)}
    damaged = tmp_path / "damaged"
    raw = bytearray(open(path, "rb").read())
    raw[20] ^= 255
    damaged.write_bytes(raw)
    with fs.open_input_file(str(damaged)) as source, pytest.raises(Exception):
        list(token_files.Reader(source).documents())


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_near_copies_match_all_pairs(corpus, n, percent):
    rng, base = random.Random(6), texts(7, 12, 160)
    rows = []
    for k in range(240):
        w = base[k % 12].split()
        for _ in range(rng.choice((0, 0, 1, 2, 4, 9)) if w else 0):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((k, " ".join(w), "en", "s", 1))
    sets = [shingles(r[1], n) for r in rows]
    comp = list(range(240))
    for _ in range(240):
        low = [min([comp[a]] + [comp[b] for b in range(240) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]) for a in range(240)] if comp else comp
        if low == comp:
            break
        comp = low
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(corpus, rows), n, percent).collect()}
    assert got == {k: (len(sets[k]), comp[k]) for k in range(240)}
    kept = {r.doc_id for r in ngram_join.drop_near_copies(table(corpus, rows), n, percent).collect()}
    assert kept == set(comp)


def test_repeats_match_all_windows(corpus):
    rng, passage = random.Random(8), " ".join(random.Random(9).choice(WORDS) for _ in range(70))
    rows = []
    for k in range(60):
        w = [rng.choice(WORDS) for _ in range(rng.randint(0, 200))]
        at = rng.randint(0, len(w))
        part = passage.split()[rng.randint(0, 30) : rng.randint(40, 70)] if k % 3 else ["same"] * rng.randint(0, 60)
        rows.append((k, "  ".join(w[:at] + part + w[at:]), "en", "s", 1))
    rows += [(90, rows[0][1], "en", "s", 1), (91, None, None, None, None)]
    seen = {}
    for i, t, *_ in rows:
        w = (t or "").split()
        for s in range(len(w) - 34):
            seen.setdefault(tuple(w[s : s + 35]), []).append((i, s))
    gone = {i: set() for i, *_ in rows}
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i].update(range(s, s + 35))
    got = {r.doc_id: r.n_removed for r in substrings.removal_digest(table(corpus, rows)).collect()}
    assert got == {i: len(g) for i, g in gone.items()}
    text = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(corpus, table(corpus, rows), "").collect()}
    for i, t, *_ in rows:
        assert text[i] == (t if not gone[i] else " ".join(w for k, w in enumerate(t.split()) if k not in gone[i]))


def test_toxicity_on_held_out_rows(corpus):
    rng, bad = random.Random(10), ["idiotic", "moronic", "pathetic", "worthless"]
    rows, labels = [], []
    for k in range(900):
        w = [rng.choice(WORDS) + rng.choice(("ing", "ed", "")) for _ in range(rng.randint(20, 200))]
        toxic = int(k % 6 == 0)
        for _ in range(len(w) // 12 + 1 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((k, " ".join(w), "en", "s", 1))
        labels.append((k, 1, toxic))
    known = corpus.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = toxicity.score(table(corpus, rows), known).collect()
    truth = {k: t for k, _, t in labels}
    held = [r for r in scored if r.held_out]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(table(corpus, rows), known).collect()}
    assert kept == {r.doc_id for r in scored if r.predicted == 0}


def test_license_notices(corpus):
    mit = [s for n, s in licenses.SENTENCES if n in ("MITGrant", "MITNotice", "MITAsIs", "MITNoLiability")]
    bsd = [s for n, s in licenses.SENTENCES if n.startswith("BSD") and "Ref" not in n]
    rows = [(1, "Intro. " + ". ".join(s.capitalize() for s in mit) + ".\n"), (2, ". ".join(bsd)), (3, ".\n".join(bsd[:3])), (4, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License. Licensed under CC BY-NC 4.0."), (5, "MIT"), (6, None)]
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in licenses.scan(corpus.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (4, "MIT"), 2: (4, "BSD-3-Clause"), 3: (3, "BSD-2-Clause"), 4: (3, "CC-BY-NC-4.0,MIT"), 5: (0, ""), 6: (0, "")}


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL2 = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
PUBLISHED = {"Apache-2.0": (APACHE, 4), "GPL-2.0-or-later": (GPL2, 4), "MIT": (MIT, 4), "MPL-2.0": (MPL, 1)}


def test_published_notices_on_one_line_wrapped_and_as_comments(corpus):
    rows, want = [], {}
    for name, (notice, n) in PUBLISHED.items():
        for width in (10_000, 78, 72, 40):
            for mark in ("", "# ", " * "):
                lines = [line for p in notice.split("\n\n") for line in [*textwrap.wrap(p, width, break_on_hyphens=False), ""]]
                want[len(rows)] = (n, name)
                rows.append((len(rows), "Copyright (c) 2020 someone\n\n" + "".join(f"{mark}{line}\n" for line in lines) + "code();"))
    got = {r.doc_id: (r.n_sentences, r.licenses) for r in licenses.scan(corpus.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_no_license_from_a_part_of_a_sentence_or_of_a_line(corpus):
    rows = [(0, "Released under the\nMIT"), (1, "not released under the MIT license"), (2, "released under the\nold MIT license"), (3, "Released under the MIT license\nand more")]
    got = {r.doc_id: r.licenses for r in licenses.scan(corpus.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "MIT"}
