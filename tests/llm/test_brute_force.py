"""Operators and pipeline stages against independent plain versions, and edge cases of their inputs."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import bpe, dac, fingerprints, language, lines, mixing, neighbours, ngram_join, passages, substrings
from strandlake.llm.common import Scratch, salted_join, shingle_hashes, word_hashes

from .conftest import ODD, frame, sentence
from .test_operators import brute_join, by_id, library, near_copy, roots  # noqa: F401  library is a fixture

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def test_salted_join_is_a_join(spark):
    left = spark.range(5000).selectExpr("id AS row", "if(id % 3 > 0, 7, id % 50) AS k")
    right = Scratch(spark, "t").save(left.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 4").selectExpr("k", "n", "k * 10 AS v"))
    got = sorted(tuple(r) for r in salted_join(left, right, ["k"]).select("row", "k", "v").collect())
    assert got == sorted((r, k, 10 * k) for r, k in ((i, 7 if i % 3 else i % 50) for i in range(5000)) if k != 4)
    assert salted_join(left.limit(0), right.limit(0), ["k"]).count() == 0


# Fingerprints

def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_signature(text, n=5):
    words = [xxhash.xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
    m = min(n, len(words))
    shingles = set()
    for i in range(len(words) - m + 1 if words else 0):
        h = words[i] + m & M64
        for k in range(1, m):
            h = (h * 0x9E3779B97F4A7C15 + words[i + k]) & M64
        shingles.add(mix(h))
    return [min((((mix(k) | 1) * x + mix(128 + k)) & M64 for x in shingles), default=M64) >> 48 for k in range(1, 129)]


def test_fingerprints_equal_plain_minhash(spark):
    texts = [*ODD[:8], *ODD[9:], sentence(5, 400), near_copy(sentence(5, 400), 60)]
    rows = sorted(enumerate(t or "" for t in texts), reverse=True)
    got = by_id(fingerprints.edit_report(frame(spark, texts)))
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, edit, nxt = (plain_signature(t) for t in (text, changed, following))
        assert np.frombuffer(bytes.fromhex(got[i].fingerprint), "<u2").tolist() == own
        assert np.frombuffer(bytes.fromhex(got[i].edited_fingerprint), "<u2").tolist() == edit
        assert got[i].near_edited == np.mean([x == y for x, y in zip(own, edit, strict=True)])
        assert got[i].near_next == np.mean([x == y for x, y in zip(own, nxt, strict=True)])


def test_near_duplicates_on_odd_and_empty_tables(spark, odd, empty):
    assert fingerprints.near_duplicates(odd).count() == len(ODD) and fingerprints.near_duplicates(empty).count() == 0


# Suffix arrays: every document of sf0.01 against hashes of all strings of 400 bytes

def test_substring_dedup_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    raw = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    strings = {i: np.array([xxhash.xxh3_64_intdigest(t[k : k + 400]) for k in range(len(t) - 399)], np.uint64) for i, t in raw.items()}
    values, n = np.unique(np.concatenate(list(strings.values())), return_counts=True)
    repeated = values[n > 1]
    got, losing = by_id(substrings.report(docs)), 0
    for i, t in raw.items():
        gone = np.zeros(len(t) + 1, int)
        for k in np.flatnonzero(np.isin(strings[i], repeated)):
            gone[k] += 1
            gone[k + 400] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        assert tuple(got[i]) == (i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        losing += gone.any()
    assert losing > 100 and len(got) == len(raw)


# Language models

def plain_kneser_ney(text, order):
    """Conditional probabilities by dictionaries: p(last, context of order - 1 characters)."""
    folded = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    padded = " " * (order - 2) + folded
    counts = {order: Counter(padded[i : i + order] for i in range(len(padded) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        c = counts[k]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        return max(c[gram] - d, 0) / sum(own) + d * len(own) / sum(own) * p(gram[1:])

    return p, sorted(counts[order])


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_equals_a_plain_version(order):
    text = " ".join(sentence(k, 15) for k in range(6)) + " Grüße aus Köln"
    p, seen = plain_kneser_ney(text, order)
    g, n = np.unique(language.grams(language.characters(text), order), return_counts=True)
    model = language.KneserNey.fit(g, n, order)
    r = random.Random(3)
    wanted = [*seen[::7], *("".join(r.choice("abcdjü zq") for _ in range(order)) for _ in range(60))]
    packed = np.array([sum(ord(c) << 16 * (order - 1 - k) for k, c in enumerate(w)) for w in wanted], np.uint64)
    assert np.allclose(model.log_probs(packed), [math.log(p(w)) for w in wanted], rtol=0, atol=1e-9)


def test_models_as_tables_equal_models_as_arrays(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = language.Identifier.fit(docs), language.Identifier.fit(docs, broadcast=0)
    assert one.models and two.tables
    for lang, threshold in one.thresholds.items():
        assert two.thresholds[lang] == pytest.approx(threshold, abs=1e-4)
    for df in (docs, odd):
        a, b = by_id(one.predict(df)), by_id(two.predict(df))
        assert a.keys() == b.keys()
        for i, r in a.items():
            assert r.lang_pred == b[i].lang_pred and r.rejected == b[i].rejected and r.score == pytest.approx(b[i].score, abs=1e-3)
            assert (r.cross_entropy is None) == (b[i].cross_entropy is None) and (r.cross_entropy is None or r.cross_entropy == pytest.approx(b[i].cross_entropy, abs=1e-4))


def test_many_languages(spark):
    df = spark.createDataFrame([(k, sentence(k, 40), f"l{k}") for k in range(80)], "doc_id long, text string, lang string")
    found = by_id(language.Identifier.fit(df).predict(df))
    assert sum(found[k].lang_pred == f"l{k}" for k in range(80)) == 80


# Mixing: the dual solved document by document

def test_rates_equal_a_direct_solution(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.sized(docs)
    classes = Scratch(spark, "t").save(rows.groupBy("source", "size").count().withColumnRenamed("count", "c"))
    goals = mixing.targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    solved = {r.source: r for r in mixing.solve(classes, goals, Scratch(spark, "t")).collect()}
    sizes = defaultdict(list)
    for r in rows.where("size > 0").collect():
        sizes[r.source].append(r["size"])
    compared = 0
    for source, own in sizes.items():
        r = solved[source]
        if r.lam is None:
            assert r.target in (0, pytest.approx(3 * sum(own)))
            continue
        x = np.array(own) / np.mean(own)
        lo, hi = -1e4, 1e4
        for _ in range(200):
            lam = (lo + hi) / 2
            with np.errstate(over="ignore"):
                taken = (np.array(own) * 3 / (1 + 2 * np.exp(-lam * x))).sum()
            lo, hi = (lam, hi) if taken < r.target else (lo, lam)
        assert r.mean == pytest.approx(np.mean(own)) and r.lam == pytest.approx(lam, rel=1e-6, abs=1e-8)
        compared += 1
    assert compared


@pytest.mark.parametrize("sequential, size", [(0, 5), (3, 5), (512, 10**6)])
def test_mixing_on_both_sides_of_its_switches(spark, monkeypatch, sequential, size):
    monkeypatch.setattr(mixing, "SEQUENTIAL", sequential)
    monkeypatch.setattr(mixing, "CLASS", size)
    df = frame(spark, [sentence(k, 3 + k % 9) for k in range(300)])
    got = mixing.plan(df).selectExpr("source", "target", "size * copies AS taken", "copies").groupBy("source").agg({"target": "max", "taken": "sum", "copies": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 12 and r["max(copies)"] <= 3 for r in got)


# Passages: links of drifting copies, isolated and crowded

def brute_links(texts):
    a = [shingle_hashes(word_hashes(t), 5) for t in texts]
    return [(i, j) for i in range(len(a)) for j in range(i) if passages.aligned(a[i], a[j], (0, len(a[i]) - 1, 0, len(a[j]) - 1), 46, 0.8)]


def test_links_of_drifting_copies(spark):
    r, chains = random.Random(6), []
    for c in range(8):
        w = sentence(600 + c, 90).split()
        for k in range(20):
            chains.append(f"{sentence(7000 + 50 * c + k, 25)} {' '.join(w)} {sentence(9000 + 50 * c + k, 25)}")
            at = r.randrange(10, 80)
            w = w[:at] + [f"drift{c}x{k}"] + w[at + 1 :]
    links = [(20 * c + i, 20 * c + j) for c in range(8) for i, j in brute_links(chains[20 * c : 20 * c + 20])]
    got = by_id(passages.report(frame(spark, chains)))
    found = sum(got[i].component_id == got[j].component_id for i, j in links)
    assert len(links) > 400 and found >= 0.99 * len(links)


def test_crowded_passages_through_blocks(spark, monkeypatch):
    """Every text holds a common phrase; passages around it are in pairs of texts. With small limits all go through leaders and blocks."""
    monkeypatch.setattr(passages, "FEW", 4)
    monkeypatch.setattr(passages, "HEAVY", 4)
    monkeypatch.setattr(passages, "ROWS", 16)
    phrase = sentence(901, 36)
    texts = [f"{sentence(5000 + k, 10)} {sentence(6000 + k // 2, 30)} {phrase} {sentence(7000 + k, 10)}" for k in range(120)]
    expected = roots(len(texts), brute_links(texts))
    got = by_id(passages.report(frame(spark, texts)))
    assert sum(got[k].component_id == expected[k] for k in range(120)) >= 118


def test_blocks_cover_open_windows_within_a_component():
    """A text of which many nearer texts of its component share one half, and one text, far down the list, the other."""
    first, second = sentence(31, 90), sentence(32, 60)
    own = f"{first} {sentence(33, 20)} {second}"
    rights = [f"{first} {sentence(100 + k, 30)}" for k in range(12)] + [f"{sentence(200, 30)} {second}"]
    n = len(own.split())
    rows = [{"cls": 1, "component": 1, "rows": [{"l": 0, "r": n - 5}], "left": True, "text": own}] + [{"cls": 2 + k, "component": 1, "rows": None, "left": False, "text": t} for k, t in enumerate(rights)]
    found = passages.compare(5, 46, 0.8)(pa.Table.from_pylist(rows)).to_pylist()
    assert {f["b"] for f in found} == set(range(2, 15))
    assert {w for f in found for w in range(f["a_first"], f["a_last"] + 1)} >= {*range(90), *range(110, n)}


def test_trees_of_many_texts_in_one_pass_are_those_of_each_text():
    parts = [shingle_hashes(word_hashes(sentence(k, 50 + 37 * k) + " again" * (60 if k % 3 == 0 else 0)), 5) for k in range(9)]
    start = np.cumsum([0, *map(len, parts[:-1])])
    w = passages.outer_windows(np.concatenate(parts), 46, 6, start)
    for x, begin in zip(parts, start.tolist(), strict=True):
        own = w[:, (w[3] >= begin) & (w[3] < begin + len(x))]
        assert {tuple(c) for c in (own - np.array([[0], [0], [begin], [begin], [begin]])).T.tolist()} == {tuple(c) for c in passages.outer_windows(x, 46, 6).T.tolist()}


def test_parts_of_a_sequence_align_like_their_copies():
    w = sentence(41, 300).split()
    a, b = (shingle_hashes(word_hashes(" ".join(x)), 5) for x in (w, w[:70] + ["other"] + w[72:250]))
    for begin, end in ((0, len(a)), (20, 200), (60, 110), (250, len(a))):
        found = passages.chains(passages.Sequence(a, 46).part(begin, end), passages.Sequence(b, 46), 0.8)
        assert found == passages.chains(passages.Sequence(a[begin:end].copy(), 46), passages.Sequence(b, 46), 0.8)


def test_blocks_verify_few_pairs_and_agree_in_any_order(monkeypatch):
    """Texts with a word over and over share little with others; of texts that cover a window equally well the same one is taken in any order of rows."""
    calls = []
    chains = passages.chains
    monkeypatch.setattr(passages, "chains", lambda *a: calls.append(1) or chains(*a))
    passage, n = sentence(51, 80), 80
    rows = [{"cls": 1, "component": 1, "rows": [{"l": 0, "r": n - 5}], "left": True, "text": passage}]
    rows += [{"cls": 2 + k, "component": 1, "rows": None, "left": False, "text": f"{sentence(300 + k, 30)} {passage}"} for k in range(20)]
    found = [passages.compare(5, 46, 0.8)(pa.Table.from_pylist(r)).to_pylist() for r in (rows, rows[::-1], rows[:1] + rows[:0:-1])]
    assert found[0] == found[1] == found[2] and len(found[0]) == 1
    calls.clear()
    common = sentence(52, 8)
    lone = [f"{common} {' '.join([f'word{k}'] * 60)} {sentence(400 + k, 60)}" for k in range(30)]
    rows = [{"cls": k, "component": k, "rows": [{"l": 0, "r": len(t.split()) - 5}] if left else None, "left": left, "text": t} for k, t in enumerate(lone) for left in (True, False)]
    assert passages.compare(5, 46, 0.8)(pa.Table.from_pylist(rows)).num_rows == 0 and not calls


def test_vectors_are_dealt_in_bounded_frames():
    """Every vector is a guest in most cells; none is left out, and no frame holds more than ROWS of them."""
    r = np.random.default_rng(4)
    x = r.normal(size=(5000, 3))
    pivots, radius = neighbours.unit(list(r.normal(size=(60, 3)))), math.sqrt(2 - 2 * neighbours.COSINE)
    edges = np.array([0.0, radius / 2, *(radius / 2 + radius * k for k in range(1, math.ceil(2 / radius) + 1))])
    frames = list(neighbours.assigned({3: pivots}, edges, radius)(iter([pd.DataFrame({"head": np.arange(5000), "embedding": list(x)})])))
    assert max(len(f) for f in frames) <= neighbours.ROWS
    d = np.sqrt(np.maximum(2 - 2 * neighbours.unit(list(x)) @ pivots.T, 0))
    home, guests = pd.concat([f for f in frames if f["home"].all()]), pd.concat([f for f in frames if not f["home"].any()])
    assert sorted(home["head"]) == list(range(5000)) and len(guests) > 20_000 and not guests.duplicated(["head", "pivot", "ring"]).any()
    assert (d[guests["head"], guests["pivot"]] <= d.min(axis=1)[guests["head"]] + 2 * radius + 1e-6).all()


def test_interval_join_equals_all_triples():
    r = random.Random(2)
    a = np.array([r.getrandbits(64) for _ in range(400)], np.uint64)
    w = passages.outer_windows(a, 30, 6)
    heavy = (np.arange(w.shape[1]) % 5 == 0).astype(np.int64)
    rows = np.stack([w[1], w[0], w[2], w[3], w[4], heavy])
    rows = rows[:, np.argsort(rows[2], kind="stable")]
    key, first, last = passages.crossing(passages.around_heavy(rows, 30), 30)
    expected = set()
    cols = rows.T.tolist()
    for i in range(len(cols)):
        for j in range(i):
            lo, hi = max(cols[i][2], cols[j][2]), min(cols[i][4], cols[j][4])
            if cols[i][0] == cols[j][0] or hi - lo + 1 < 30:
                continue
            for k in range(j):
                x = (cols[i], cols[j], cols[k])
                lo, hi = max(y[2] for y in x), min(y[4] for y in x)
                if len({y[0] for y in x}) == 3 and hi - lo + 1 >= 30 and all(lo <= y[3] <= hi for y in x) and any(y[5] for y in x):
                    expected.add((lo, hi, tuple(sorted(y[1] for y in x))))
    assert len(key) == len({e[2] for e in expected}) and {(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True)} <= {(min(e[0] for e in expected if e[2] == k), max(e[1] for e in expected if e[2] == k)) for k in {e[2] for e in expected}}


# Edge cases

def test_very_long_words(spark, library):  # noqa: F811
    texts = ["x" * 20_000, "ab" * 9_000 + " end", "é" * 5_000, "9" * 8_000]
    encoded, coded = by_id(bpe.digests(bpe.encode_decode(frame(spark, texts)))), by_id(dac.token_table(frame(spark, texts)))
    for i, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoded[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and coded[i].n_tokens == len(ids) + 1


def test_null_and_repeated_ids(spark):
    texts = [sentence(1, 90), sentence(1, 90), sentence(2, 90), "short", None]
    df = frame(spark, texts, [None, 4, 4, None, 4])
    sizes, _ = brute_join(texts, 4, 85)
    joined = ngram_join.join(df, 4, 85).collect()
    assert sorted((r.doc_id is None, r.n_shingles) for r in joined) == sorted((i is None, n) for i, n in zip([None, 4, 4, None, 4], sizes, strict=True))
    assert {r.component_id for r in joined if r.n_shingles == sizes[0]} >= {4}
    assert Counter(r.n_bytes for r in substrings.report(df).collect()) == Counter(len((t or "").encode()) for t in texts)
    assert language.Identifier.fit(df).predict(df).count() == 5 and passages.report(df).count() == 5
    assert fingerprints.edit_report(df).count() == 5 and mixing.plan(df).count() == 5 and lines.report(df).count() == 5


def test_embeddings_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 0, "a", 5, 7, 1.5), (2, [1.0, 0.01], 0, "b", 5, 7, 1.5), (2, [0.0, 1.0], 0, "c", 5, 7, 1.5), (None, [1.0, 0.0], None, "d", 5, 7, 1.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, head string, weight int, pivot int, ring double")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neighbours.link(df).collect()), key=str)
    assert got == sorted([(1, 1, 1), (2, 1, 1), (2, 0, 2), (None, 0, None)], key=str)


# Pipeline stages

def test_language_stage_keeps_what_a_plain_model_keeps(spark):
    texts = [sentence(k, 60) for k in range(12)] + ["ΑΒΓΔ ΕΖΗΘ ΙΚΛΜ ΝΞΟΠ " * 20, None, "12345"]
    docs = frame(spark, texts)
    labelled = [t for t in texts if t]
    p, _ = plain_kneser_ney(labelled[0], 4)  # the plain model is checked above; here only the letters decide
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, SF).collect()}
    assert set(range(12)) <= kept and 13 not in kept and 14 not in kept and p("    ") > 0


def test_line_stage_equals_sql(spark):
    shared = "\n".join(f"shared line {k} of a passage" for k in range(25))
    docs = frame(spark, [*(f"own {k}\n{shared}\nend {k}" for k in range(5)), *[t for t in ODD if t is not None]])
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toPandas())
    expected = {r[0]: r[-1] for r in c.execute(lines.SQL).fetchall()}
    got = by_id(corpus_pipeline.drop_repeated_lines(spark, docs, SF))
    assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in got.items()} == expected


def test_near_duplicate_stage_equals_brute_force(spark):
    base = [sentence(k, 80) for k in range(15)]
    texts = base + [near_copy(t, 25 + 3 * k) for k, t in enumerate(base)] + ODD
    _, component = brute_join(texts, 5, 80)
    got = {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, texts), SF).collect()}
    assert got == {i for i, c in enumerate(component) if i == c}


def test_near_duplicate_stage_judges_texts_of_one_id_by_themselves(spark):
    a, b = sentence(1, 80), sentence(2, 80)
    out = corpus_pipeline.keep_one_of_near_duplicates(spark, frame(spark, [a, b, a], [1, 7, 7]), SF).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(1, a), (7, b)])


def test_last_stages_equal_plain_versions(spark, library):  # noqa: F811
    docs = frame(spark, [sentence(k, 5 + k % 40) for k in range(60)])
    copies = {r.doc_id: r.copies for r in mixing.plan(docs).collect()}
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.encode(spark, mixed, SF).collect():
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids == " ".join(map(str, ids)) and r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
