"""The operators against brute force, and on odd and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.llm import bpe, dac, fingerprints, language, lines, mixing, neighbours, ngram_join, passages, substrings
from strandlake.llm.common import Scratch, components, shingle_hashes, word_hashes

from .conftest import ODD, frame, sentence

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def roots(n, pairs):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 400)] + [(7, k) for k in range(1000, 1500)] + [(5, 5), (3, 2), (2, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[k] == 100 for k in range(100, 401)) and all(got[k] == 7 for k in range(1000, 1500)) and got[3] == 2 and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_components_end_with_stars_and_broadcast_nothing(spark, monkeypatch):
    plans, save = [], Scratch.save

    def spied(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", spied)
    for edges, rounds in (([(7, k) for k in range(8, 60)], 1), ([(k, 60) for k in range(7, 60)], 2)):
        plans.clear()
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
        assert set(got.values()) == {7} and len(got) >= 53 and len(plans) <= 1 + rounds
        assert not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("edges", [[(k, 60) for k in range(7, 60)], [(1, 3), (2, 3), (2, 4), (4, 9), (8, 9)], [(1, 2), (2, 3)], [(5, 1), (6, 5), (9, 8)]])
def test_components_of_odd_trees(spark, edges):
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    root = roots(61, edges)
    assert got == {k: root[k] for e in edges for k in e}


# BPE

@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=6))
def test_bpe_equals_the_library(texts):
    from tokenizers import Tokenizer

    t = test_bpe_equals_the_library.__dict__.setdefault("t", Tokenizer.from_file(bpe.default_vocabulary()))
    for text, (n, ids, decoded) in zip(texts, bpe.codec(bpe.default_vocabulary()).texts(texts), strict=True):
        expected = t.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(expected), " ".join(map(str, expected)), t.decode(expected, skip_special_tokens=False))


def test_bpe_on_odd_and_real_texts(spark, library, docs, odd, empty):
    for df, texts in ((odd, dict(enumerate(ODD))), (docs, {r.doc_id: r.text for r in docs.collect()})):
        got = by_id(bpe.digests(bpe.encode_decode(df)))
        for i, text in texts.items():
            ids = library.encode(text or "", add_special_tokens=False).ids
            assert got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty).count() == 0


# Directly addressable codes

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.data())
def test_codes_give_every_id_back(ids, data):
    packed = dac.Codes(*dac.pack(np.array(ids, np.uint32)))
    assert packed.slice(0, len(ids)).tolist() == ids
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert packed.slice(a, b).tolist() == ids[a:b]
    for i in range(a, min(b, a + 20)):
        assert packed[i] == ids[i]


def test_token_table(spark, library, docs, odd, empty):
    for df in (odd, docs):
        rows = sorted(((r.doc_id, r.text) for r in df.collect()))
        got = dac.token_table(df).orderBy("doc_id").collect()
        start = 0
        for (i, text), r in zip(rows, got, strict=True):
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
            assert tuple(r) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    assert dac.token_table(empty).count() == 0


def test_null_and_repeated_ids_have_rows(spark):
    df = frame(spark, ["a b", "c", "c", None], [None, 1, 1, None])
    got = [(r.doc_id, r.start, r.n_tokens) for r in dac.token_table(df).orderBy("start").collect()]
    assert got == [(None, 0, 1), (None, 1, 3), (1, 4, 2), (1, 6, 2)]


# Fingerprints

def test_edit_report(spark, odd, docs, empty):
    for df in (odd, docs.repartition(7)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
        got = by_id(fingerprints.edit_report(df))
        for k, (i, text) in enumerate(rows):
            following = rows[(k + 1) % len(rows)][1]
            changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
            assert r.fingerprint == fingerprints.signature(text).tobytes().hex() and r.edited_fingerprint == fingerprints.signature(changed).tobytes().hex()
            assert r.near_next == fingerprints.likeness(fingerprints.signature(text), fingerprints.signature(following))
        assert len(got) == len(rows)
    assert fingerprints.edit_report(empty).count() == 0
    alone = fingerprints.edit_report(frame(spark, ["ab cd"])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


def test_likeness_estimates_jaccard():
    for share in (0.2, 0.5, 0.9):
        a, b = [f"w{k}" for k in range(2000)], [f"w{k}" if k < 2000 * share else f"v{k}" for k in range(2000)]
        x, y = (set(shingle_hashes(word_hashes(" ".join(t)), 5).tolist()) for t in (a, b))
        est = fingerprints.likeness(fingerprints.signature(" ".join(a)), fingerprints.signature(" ".join(b)))
        assert abs(est - len(x & y) / len(x | y)) < 0.15


def near_copy(text, every):
    w = text.split()
    return " ".join("edited" if k % every == every - 1 else x for k, x in enumerate(w))


def test_minhash_near_duplicates(spark):
    base = [sentence(k, 300) for k in range(5)]
    texts = base + [near_copy(t, 120) for t in base] + [base[0], base[0], None, ""]
    got = by_id(fingerprints.near_duplicates(frame(spark, texts)))
    assert [got[i].component for i in range(5)] == list(range(5)) == [got[i].component for i in range(5, 10)]
    assert got[10].component == got[11].component == 0


# Line dedup

def test_minhash_near_duplicates_of_one_template(spark):
    """Texts of one template are at 0.7 or so to each other, pairs of them over 0.8."""
    r, texts, base = random.Random(8), [], sentence(950, 300).split()
    for k in range(150):
        at = r.sample(range(300), 9)
        texts += [" ".join(f"own{k}x{i}" if i in at[:n] else w for i, w in enumerate(base)) for n in (5, 9)]
    sets = [set(shingle_hashes(word_hashes(t), 5).tolist()) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = by_id(fingerprints.near_duplicates(frame(spark, texts)))
    expected = roots(len(texts), near)
    assert len(set(expected)) > 100 and [got[k].component for k in range(len(texts))] == expected


def test_line_dedup_equals_sql(spark, docs):
    c = duckdb.connect()
    for df in (docs.select("doc_id", "text"), frame(spark, ODD).select("doc_id", "text")):
        c.register("documents", df.toPandas())
        expected = {r[0]: r[1:] for r in c.execute(lines.SQL).fetchall()}
        got = {r.doc_id: tuple(r)[1:] for r in lines.report(df).collect()}
        null = {r.doc_id for r in df.where("text is null").collect()}
        assert {k: v for k, v in got.items() if k not in null} == {k: v for k, v in expected.items() if k not in null}


def test_line_dedup_keeps_rows_and_columns(spark, odd, empty):
    out = lines.dedup(odd)
    assert out.drop("line_dedup").columns == odd.columns and out.count() == len(ODD)
    kept = by_id(out)
    assert kept[0].text is None and kept[3].text == "One" and kept[16].n_chars == len(kept[16].text)
    assert lines.dedup(empty).count() == 0
    passage = "\n".join(f"line number {k} of a shared passage" for k in range(40))
    two = by_id(lines.dedup(frame(spark, [f"own start\n{passage}\nown end", f"other\nstart\nhere\n{passage}\nother end"])))
    assert two[0].text.count("shared passage") == 40 and two[1].text.count("shared passage") <= 8 and two[1].text.startswith("other\nstart\nhere")


# N-gram join

def brute_join(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    holders = defaultdict(list)
    pairs = []
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        pairs += [(j, i) for j, o in common.items() if 100 * o >= percent * (len(s) + len(sets[j]) - o)]
        for x in s:
            holders[x].append(i)
    return [len(s) for s in sets], roots(len(texts), pairs)


def test_ngram_join(spark, docs, empty):
    r = random.Random(5)
    base = [sentence(k, r.randint(5, 120)) for k in range(40)]
    made = base + [near_copy(r.choice(base), r.randint(8, 150)) for _ in range(160)] + [t + " " + sentence(99, 40) for t in base] + ODD
    for texts, n, percent in ((made, 4, 85), (made, 5, 80), (made, 3, 50), ([x.text for x in docs.orderBy("doc_id").collect()], 4, 85)):
        sizes, component = brute_join(texts, n, percent)
        got = by_id(ngram_join.join(frame(spark, texts), n, percent))
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert [got[i].component_id for i in range(len(texts))] == component
    assert ngram_join.join(empty).count() == 0


def test_hot_columns_keep_the_join_whole(spark):
    hot = sentence(7, 30)
    texts = [f"{hot} {sentence(100 + k, 30)}" for k in range(150)] + [near_copy(hot + " " + sentence(3, 60), 30 + k) for k in range(120)]
    sizes, component = brute_join(texts, 4, 70)
    got = by_id(ngram_join.join(frame(spark, texts).coalesce(1), 4, 70))
    assert [got[i].component_id for i in range(len(texts))] == component


# Mixing

def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    left, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = float(cap * sizes[s])
            left -= fixed[s]


def test_mixing(spark, docs, odd, empty):
    for df in (docs, odd, frame(spark, [sentence(k, 5 + 40 * (k % 4 == 1)) for k in range(200)])):
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
        size = {i: len((t or "").encode().split()) for i, t, _ in rows}
        total = defaultdict(int)
        for i, _, s in rows:
            total[s] += size[i]
        want, taken = brute_targets(total), defaultdict(int)
        got = by_id(mixing.plan(df))
        for i, _, s in rows:
            r = got[i]
            assert (r.size, r.source_size) == (size[i], total[s]) and r.target == pytest.approx(want[s], rel=1e-9) and 0 <= r.copies <= 3
            taken[s] += r.copies * r.size
        for s in total:
            own = [size[i] for i, _, x in rows if x == s and size[i]] or [0]
            # whole copies of a handful of documents can't come nearer than about half of the largest
            near = max(own) / 2 if len(own) < 12 else max(min(own), 0.02 * want[s])
            assert abs(taken[s] - want[s]) <= near, (s, taken[s], want[s])
        assert sum(want.values()) == pytest.approx(sum(total.values()))
        again = by_id(mixing.plan(df.repartition(3)))
        assert {i: r.copies for i, r in got.items()} == {i: r.copies for i, r in again.items()}
        out = mixing.mix(df)
        assert out.columns == df.columns and Counter(r.doc_id for r in out.collect()) == Counter({i: r.copies for i, r in got.items() if r.copies})
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_of_many_equal_sizes(spark):
    df = spark.range(12_000).selectExpr("id AS doc_id", "concat('a b c ', id % 7) AS text", "if(id < 4000, 'p', 'q') AS source")
    rows = mixing.plan(df).groupBy("source").agg({"target": "max", "size": "count"}).collect()
    taken = {r.source: r.t for r in mixing.plan(df).selectExpr("source", "size * copies AS t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "t").collect()}
    for r in rows:
        assert abs(taken[r.source] - r["max(target)"]) <= 4


def test_repeated_rows_share_their_copies(spark):
    df = frame(spark, ["same text here"] * 4 + [sentence(k, 9) for k in range(20)], [1] * 4 + list(range(10, 30)))
    assert mixing.mix(df).count() == mixing.plan(df).agg({"copies": "sum"}).first()[0]


# Suffix arrays

def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def test_two_stage_suffix_array():
    r = random.Random(1)
    for alphabet, n in (("ab", 300), ("a", 60), ("abcdefgh", 500), ("ab\x00", 200)):
        text = bytes(ord(r.choice(alphabet)) for _ in range(n))
        sym = np.frombuffer(text, np.uint8).astype(np.int64) + 1
        order = substrings.two_stage(sym, n + 1, np.arange(n))
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])


@pytest.mark.parametrize("length", [40, 400])
def test_substring_dedup(spark, odd, empty, docs, length):
    r = random.Random(length)
    shared = [sentence(50 + k, 200) for k in range(4)]
    made = [sentence(k, 100) + " " + r.choice(shared)[r.randint(0, 300) :] + sentence(900 + k, 30) for k in range(40)] + [shared[0] * 2, shared[1], shared[1], "ab" * 700, "é" * 500]
    for texts in (made, ODD, [x.text for x in docs.orderBy("doc_id").limit(80).collect()]):
        raw = [(t or "").encode() for t in texts]
        got = by_id(substrings.report(frame(spark, texts), length))
        for i, gone in enumerate(brute_removed(raw, length)):
            kept = bytes(np.frombuffer(raw[i], np.uint8)[~gone])
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw[i]), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert substrings.report(empty, length).count() == 0


# Passages

def test_compact_windows_are_the_large_nodes_of_the_cartesian_tree():
    r = random.Random(3)
    a = np.array([r.getrandbits(64) for _ in range(300)], np.uint64)
    got = set(zip(*(x.tolist() for x in passages.compact_windows(a, 12)), strict=True))
    expected = set()
    for c in range(300):
        left, right = c, c
        while left > 0 and a[left - 1] > a[c]:
            left -= 1
        while right < 299 and a[right + 1] > a[c]:
            right += 1
        if right - left + 1 >= 12:
            expected.add((left, c, right))
    assert got == expected


def test_passages(spark, docs, odd, empty):
    shared, own = sentence(700, 70), [sentence(800 + k, 90) for k in range(12)]
    texts = [f"{own[0]} {shared} {own[1]}", f"{own[2]} {shared}", f"{near_copy(shared, 40)} {own[3]}", own[4], own[5], own[6] + " " + own[6], None, "", " ".join(shared.split()[:40]) + " " + own[7]]
    got = by_id(passages.report(frame(spark, texts)))
    assert [got[i].component_id for i in range(9)] == [0, 0, 0, 3, 4, 5, 6, 7, 8]
    assert [got[i].n_spans > 0 for i in range(9)] == [True, True, True, False, False, True, False, False, False]
    assert abs(got[0].n_dup_words - 70) <= 10
    assert passages.report(odd).count() == len(ODD) and passages.report(empty).count() == 0
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in docs.collect()}
    seen = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 54):
            seen[tuple(w[k : k + 55])].add(i)
    need = {i for v in seen.values() if len(v) > 1 for i in v}
    found = {i for i, r in by_id(passages.report(docs)).items() if r.n_spans}
    assert len(need - found) <= 0.02 * len(need)


@pytest.mark.parametrize("change", [lambda w: w[:45] + ["q1", "q2", "q3"] + w[45:], lambda w: w[:46] + ["q1"] + w[47:51] + ["q2"] + w[52:], lambda w: w[:45] + ["q1", "q2", "q3", "q4", "q5", "q6"] + w[51:]])
def test_passages_with_wide_gaps_are_verified_as_a_whole(change):
    for k in range(20):
        w = sentence(300 + k, 95).split()
        a, b = (shingle_hashes(word_hashes(" ".join(x)), 5) for x in (w, change(w)))
        assert passages.aligned(a, b, (0, len(a) - 1, 0, len(b) - 1), 46, 0.8) == [(0, len(a) - 1, 0, len(b) - 1)]


def test_passages_at_the_threshold_are_found(spark):
    texts = []
    for k in range(200):  # 52 words with one changed in the middle: Jaccard 43 / 53
        w = sentence(10000 + k, 52).split()
        texts += [f"{sentence(20000 + k, 20)} {' '.join(x)} {sentence(22000 + k, 20)}" for x in (w, w[:26] + ["changed"] + w[27:])]
    got = by_id(passages.report(frame(spark, texts)))
    assert sum(got[2 * k].n_spans > 0 and got[2 * k + 1].component_id == 2 * k for k in range(200)) >= 196


def test_very_common_passage(spark):
    passage = sentence(900, 60)
    got = passages.report(frame(spark, [f"{sentence(2000 + k, 30)} {passage} {sentence(4000 + k, 30)}" for k in range(1000)])).collect()
    assert all(r.n_spans == 1 and r.component_id == 0 and abs(r.n_dup_words - 60) <= 4 for r in got)


def test_passages_whose_leaders_are_unlike_them(spark):
    """A fragment too short to be a passage gives all texts equal windows; passages around it are in two texts each."""
    fragment = sentence(901, 30)
    texts = [f"{sentence(5000 + k, 10)} {sentence(6000 + k // 2, 30)} {fragment} {sentence(7000 + k, 10)}" for k in range(300)]
    got = by_id(passages.report(frame(spark, texts)))
    assert all(got[k].n_spans == 1 and got[k].component_id == k // 2 * 2 for k in range(300))


# Language

def test_language_identification(spark, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = language.Identifier.fit(docs.where(~language.held_out()))
    rows = fitted.predict(docs.withColumn("out", language.held_out()), ("doc_id", "lang", "out")).where("out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.rejected for r in rows]) < 0.02
    odd = by_id(fitted.predict(frame(spark, [*ODD, "qxzjq vvkq wqzzx jjkxq " * 30])))
    assert [odd[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and odd[0].score == 0 and odd[3].lang_pred != "und" and odd[len(ODD)].rejected
    assert fitted.predict(empty).count() == 0
    nothing = language.Identifier.fit(empty)
    assert {r.lang_pred for r in nothing.predict(frame(spark, ["text"])).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    text = sentence(1, 3000)
    g, n = np.unique(language.grams(language.characters(text)), return_counts=True)
    model = language.KneserNey.fit(g, n)
    letters = np.unique(language.characters(text))
    for context in (g[:5] >> np.uint64(16)):
        p = np.exp(model.log_probs((context << np.uint64(16)) | letters)).sum()
        assert 0.97 < p < 1.01


# Embeddings

def brute_links(frame_):
    n, component = np.zeros(len(frame_), int), frame_.vec_id.to_numpy().copy()
    for i in range(len(frame_)):
        frame_.at[i, "ok"] = frame_.embedding[i] is not None and len(frame_.embedding[i]) > 0 and all(x is not None and np.isfinite(x) for x in frame_.embedding[i]) and any(frame_.embedding[i]) and not pd.isna(frame_.label[i])
    pairs = []
    good = [i for i in range(len(frame_)) if frame_.ok[i]]
    for label in {frame_.label[i] for i in good}:
        own = [i for i in good if frame_.label[i] == label]
        for size in {len(frame_.embedding[i]) for i in own}:
            at = [i for i in own if len(frame_.embedding[i]) == size]
            x = neighbours.unit([frame_.embedding[i] for i in at])
            for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)), strict=True):
                pairs.append((at[a], at[b]))
                n[at[a]] += 1
                n[at[b]] += 1
    return n, [component[r] for r in roots(len(frame_), pairs)]


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_links(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "PER_PIVOT", 40)
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 8))
    vectors = [(centres[k % 30] + r.normal(size=8) * (0.05 if k % 30 < 5 else 0.35)).tolist() for k in range(600)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[0]], None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0]]
    labels = [k % 30 // 10 for k in range(600)] + [0] * (len(vectors) - 600)
    labels[3] = None
    df = spark.createDataFrame(list(zip(range(len(vectors)), vectors, labels, strict=True)), "vec_id long, embedding array<double>, label int")
    n, component = brute_links(pd.DataFrame({"vec_id": range(len(vectors)), "embedding": vectors, "label": pd.array(labels, dtype="Int64")}))
    got = by_id(neighbours.link(df), "vec_id")
    assert [got[i].n_links for i in range(len(vectors))] == n.tolist()
    assert [got[i].component_id for i in range(len(vectors))] == component
    assert all(got[i].kept == (component[i] == i) for i in range(len(vectors)))
    assert neighbours.link(df.limit(0)).count() == 0
