"""Spelling variants, fill-in-middle and quality rules against plain versions, SQL and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import fim, quality, spelling
from strandlake.llm.common import Scratch, fresh

from .conftest import ODD, frame, sentence

SF = "/root/testdata/sf0.001"
#: Names that the operators use inside, or that users may have.
NAMES = ["n", "form", "word", "run", "key", "ref", "root", "fim", "quality", "row", "counts", "t", "words", "lines", "v0", "kept", "h", "n_words", "votes", "output", "best", "__key"]


def crowded(df):
    """The table with an extra column of each of those names."""
    return df.drop("h").select("*", *[F.lit("extra").alias(c) for c in NAMES])


def same_as_sql(df, sql, docs):
    con = duckdb.connect()
    con.register("given", docs)
    con.sql("CREATE VIEW documents AS SELECT * FROM given")
    expected = con.sql(sql)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert sorted(expected.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(expected.select(*columns).fetchall())


# Spelling variants

def plain_variants(docs, ratio=5, least_chars=6, least_n=5, divisor=199):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % divisor == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_chars and n >= least_n}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]

    out = {}
    for w, n in words.items():
        links = [(-m, v) for v, m in words.items() if near(w, v)]
        best = min(links, default=None)
        held = best is not None and -best[0] >= ratio * n
        out[w] = [best[1] if held else None, n, len(links), -best[0] if held else None]
    result = {}
    for w, (form, n, near_n, form_n) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        result[w] = (form, root, n, near_n, form_n)
    return result


def misspelt(seed, n=250):
    """Texts over a few words with all kinds of slips, so that words have chains of commoner forms."""
    r = random.Random(seed)
    base = ["banana", "anagram", "Éclairé", "strength", "aaaaaaa", "mississippi", "kayaking" * 3, "x" * 70 + "yz" * 20]
    out = []
    for _ in range(n):
        line = []
        for _ in range(r.randint(1, 12)):
            w = r.choice(base)
            for _ in range(r.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("ae") + w[i:], w[:i] + r.choice("ae") + w[i + 1 :]])
            line.append(w)
        out.append(" ".join(line))
    return out


@pytest.mark.parametrize("long", [4, 12, spelling.LONG])
def test_variants_against_all_pairs(spark, long):
    texts = misspelt(1)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(frame(spark, texts), ratio=2, least_n=1, divisor=7, long=long).collect()}
    expected = plain_variants(list(enumerate(texts)), ratio=2, least_n=1, divisor=7)
    assert got == expected
    assert any(root not in (form, word) for word, (form, root, *_) in expected.items() if form)


def test_variants_on_odd_real_and_empty_tables(spark, odd, empty):
    extra = [sentence(5, 300)] * 6 + ["Straße straße STRASSE", "naïve"] * 5
    rows = [*ODD, *extra]
    df = crowded(frame(spark, rows, [None, *range(len(rows) - 1)]))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.report(df).collect()}
    assert got == plain_variants(list(zip([None, *range(len(rows) - 1)], rows, strict=True))) and len(got) > 3
    assert spelling.report(empty).count() == 0 and spelling.report(odd.where("text is null")).count() == 0


def test_variants_equal_sql(spark):
    same_as_sql(spelling.report(spark.read.parquet(f"{SF}/documents.parquet")), spelling.SQL, spark.read.parquet(f"{SF}/documents.parquet").toPandas())


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.text("abc", min_size=1, max_size=9), st.sampled_from([2, 5, 64]))
def test_near_words_share_exactly_one_key(a, b, long):
    common = set(spelling.deletions(a, long)) & set(spelling.deletions(b, long))
    one = [a[:i] + a[i + 1 :] for i in range(len(a))]
    inserted = [b[:i] + b[i + 1 :] for i in range(len(b))]
    replaced = len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if a != b and (replaced or b in one or a in inserted):
        assert len(common) == 1
    assert len(set(spelling.deletions(a, long))) == len(spelling.deletions(a, long))


def test_a_very_long_run_of_letters(spark):
    r = random.Random(3)
    long = "".join(r.choice("abcdefgh") for _ in range(30_000))
    other = long[:777] + long[778:]
    got = {r.word: r for r in spelling.report(frame(spark, [long] * 30 + [other] * 5)).collect()}
    assert got[other].form == long and got[other].root == long and got[long].n_near == 1 and got[long].form is None


def test_roots_follow_chains_of_any_length(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [("a", "w5"), ("w37", None), ("solo", None)]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark, "t")).collect())
    assert got == {w: "w37" for w, f in chain if f}


# Fill-in-middle

def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert "".join(tokens) == text
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fim_of_odd_texts(spark, empty):
    odd = [*ODD, "a <P> b", "<S>", "x <M", " lead", "trail ", " wide space ", "💡 emoji 日本", *[f"{k} <{k}> <P <S" for k in range(60)]]
    for ids in (list(range(len(odd))), [None] * len(odd), [7] * len(odd)):
        df = crowded(frame(spark, odd, ids))
        want = sorted(repr((i, *plain_fim(i, t)[:4], digest(plain_fim(i, t)[4]), digest(t or ""))) for i, t in zip(ids, odd, strict=True))
        assert sorted(repr(tuple(r)) for r in fim.report(df).collect()) == want
    forms = Counter(r.fim.form for r in fim.transform(frame(spark, odd)).collect())
    assert set(forms) == {"plain", "spm", "psm"}
    assert fim.report(empty).count() == 0


def test_fim_keeps_columns_and_restores_in_spark(spark):
    df = crowded(frame(spark, ODD))
    made = fim.transform(df, rate=100, suffix_first=50, keep=tuple(df.columns))
    assert made.columns == [*df.columns, "fim_"]
    back = made.select(*df.columns, fim.restored(F.col("fim_.output"), F.col("fim_.form")).alias("back"))
    assert all(r.back == (r.text or "") for r in back.collect())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("a <>PSM\né"), max_size=30), st.text(max_size=5))
def test_fim_round_trip(text, key):
    for suffix_first in (0, 100):
        n, form, _, _, output = fim.cut(text, key, 1, 100, suffix_first, fim.MARKERS)
        assert fim.rebuild(output, form, fim.MARKERS) == text
        assert n == len(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text))


def test_fim_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same_as_sql(fim.report(docs), fim.SQL, docs.toPandas())


def test_fresh_names():
    assert fresh("fim", ["a"]) == "fim" and fresh("fim", ["FIM", "fim_"]) == "fim__"


# Quality rules

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_model(patterns, n, rounds=100):
    """Expectation maximisation in plain loops."""
    good, a, b = 0.5, [0.8] * n, [0.8] * n
    p = lambda v: 1 / (1 + (1 - good) / good * math.prod((1 - y) / x if s == 1 else y / (1 - x) if s == -1 else 1 for s, x, y in zip(v, a, b, strict=True)))
    for _ in range(rounds):
        post = {v: p(v) for v in patterns}
        total = sum(patterns.values())
        share = lambda k, s, w: (sum(c * w(post[v]) for v, c in patterns.items() if v[k] == s) + 8) / (sum(c * w(post[v]) for v, c in patterns.items() if v[k]) + 10)
        na = [share(k, 1, lambda q: q) for k in range(n)]
        nb = [max(share(k, -1, lambda q: 1 - q), 1.01 - x) for k, x in enumerate(na)]
        good = (sum(c * post[v] for v, c in patterns.items()) + 5) / (total + 10)
        a, b = na, nb
    return good, a, b, p


def test_counts_of_odd_texts(spark, empty):
    texts = [*ODD, "a a a a", "a b c a b c", "x y z w x y z", "a b c d", "#*$%&|<> " * 30, "one two\n \none two\n\none two", "ab c a bc ab c", " ".join("ab"[k % 2] for k in range(99)), "é" * 60 + " É"]
    df = crowded(frame(spark, texts))
    got = {r.doc_id: r for r in quality.report(df).collect()}
    for i, t in enumerate(texts):
        want = plain_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality.report(empty).count() == 0


def test_judge_keeps_columns(spark):
    df = crowded(frame(spark, ODD, [None] * len(ODD)))
    made = quality.judge(df, keep=tuple(df.columns))
    assert made.columns == [*df.columns, "quality_"]
    assert sorted(map(repr, made.select(*df.columns).collect())) == sorted(map(repr, df.collect()))


def test_model_equals_plain_loops_and_finds_junk(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    judged = quality.judge(docs, keep=("doc_id", "text")).select("doc_id", "text", "quality.*").collect()
    patterns = defaultdict(set)
    for r in judged:
        if not r.base_failed:
            patterns[tuple(r.votes)].add(r.text)
    *_, p = plain_model({v: len(t) for v, t in patterns.items()}, len(quality.RULES))
    for r in judged:
        assert abs(r.posterior - p(tuple(r.votes))) < 1e-3 and r.kept == (not r.base_failed and p(tuple(r.votes)) >= 0.5)
    # Labels are seen by this test only.
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/../sf0.01/labels.parquet").collect()}
    mine = [(labels[r.doc_id], r.kept) for r in judged if r.doc_id in labels and not r.base_failed]
    assert sum(k for q, k in mine if q == 1) >= 0.99 * sum(q == 1 for q, _ in mine)
    assert sum(k for q, k in mine if q == 0) <= 0.05 * sum(q == 0 for q, _ in mine)


def test_a_mass_of_copies_does_not_move_the_model(spark):
    docs = [sentence(k, 80).capitalize() + "." for k in range(60)] + [" ".join(w + "$$" for w in sentence(k, 80).split()) for k in range(100, 112)]
    more = docs + [docs[-1]] * 80
    few, many = ({r.doc_id: r.quality.posterior for r in quality.judge(frame(spark, t)).collect()} for t in (docs, more))
    assert all(few[k] == many[k] for k in range(len(docs))) and len({many[k] for k in range(len(docs) - 1, len(more))}) == 1


def test_quality_equals_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same_as_sql(quality.report(docs), quality.SQL, docs.toPandas())
