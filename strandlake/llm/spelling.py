"""Spelling variant grouping by a symmetric-delete join: words that differ by one letter, the commoner form of each, and its root.

Every word emits itself and its distinct single deletions; words that share one of these keys meet in an equi-join and are
verified. Two words at distance one share exactly one distinct key: the shorter word itself where a letter is inserted, and where one is
replaced the string without it (another deletion that both had would lie in the same run of equal letters, thus be the same string).
So no pair is found twice. A key's words are at most one of its own length and those one letter longer, and so no more than an alphabet for each place.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER = "[a-zÀ-ÿ]"
#: Words of more code points are known by a digest in the join, and so are their deletions, so that a word costs space in proportion to its length.
LONG = 64
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def counts(docs: DataFrame, least_chars: int = 6, least_n: int = 5, divisor: int = 199) -> DataFrame:
    """(word, n): how often each word of at least least_chars code points stands in all texts, if at least least_n times.

    Runs of letters are lower-cased in A-Z only; of one run in `divisor`, by a checksum of document and run, a letter is left out. Words are
    counted where they are read before they are exchanged, so a word in a third of all rows is a few rows for each task.
    """
    lowered = F.translate(F.col("text"), UPPER, LOWER)
    # A run of fewer letters can't become a word, and a run isn't cut by asking for a least length.
    runs = F.regexp_extract_all(lowered, F.lit(f"{LETTER}{{{least_chars},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    each = each.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % divisor == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return each.select(word.alias("word")).where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def deletions(word: str, long: int = LONG) -> list[str]:
    """A word and its distinct single deletions as keys: of equal letters in a row the first stands for all. Strings beyond `long` are digests."""
    first = [i for i in range(len(word)) if not i or word[i] != word[i - 1]]
    if len(word) <= long:
        return [word, *(word[:i] + word[i + 1 :] for i in first)]
    # Two polynomial hashes of every deletion from those of prefixes and suffixes; what shares them is verified by the words themselves.
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(codes)
    keys = []
    with np.errstate(over="ignore"):
        for base in _BASES:
            power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, base), dtype=np.uint64)))
            total = np.concatenate(([np.uint64(0)], np.cumsum(codes * power[:n], dtype=np.uint64)))
            at = np.array(first)
            # Letters behind the gap move one place down: times the inverse of the base, modulo 2^64.
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            keys.append((total[at] + (total[n] - total[at + 1]) * inverse, total[n]))
    without = [f"#{n - 1}:{a:x}:{b:x}" for a, b in zip(keys[0][0].tolist(), keys[1][0].tolist(), strict=True)]
    own = f"#{n}:{int(keys[0][1]):x}:{int(keys[1][1]):x}"
    if n - 1 > long:
        return [own, *without]
    return [own, *(word[:i] + word[i + 1 :] for i in first)]


def keys(words: Column, long: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: deletions(w, long))

    return run(words)


def near(words: DataFrame, scratch: Scratch, long: int = LONG) -> DataFrame:
    """(ref, n_near, best_n, best): how many words are at distance one, and the commonest of them (ties: least by code points).

    words: (ref, word, n), the ref of a word of more than `long` code points being its digest.
    """
    keyed = scratch.save(words.select("ref", "n", F.explode(keys(F.col("word"), long)).alias("key")))
    other = keyed.select("key", F.col("ref").alias("other"), F.col("n").alias("other_n"))
    # The lengths follow from the key: distance one is a matter of one look at both words.
    pairs = keyed.join(other, "key").where("ref <> other")
    distance = lambda a, b: F.levenshtein(a, b, 1) == 1
    digest = lambda c: F.startswith(c, F.lit("#"))
    short = pairs.where(~digest(F.col("ref")) & ~digest(F.col("other")) & distance("ref", "other")).select("ref", "other_n", "other")
    texts = words.where(digest(F.col("ref")))
    own, its = texts.select("ref", F.col("word").alias("a")), texts.select(F.col("ref").alias("other"), F.col("word").alias("b"))
    beyond = pairs.where(digest(F.col("ref")) | digest(F.col("other"))).join(own, "ref", "left").join(its, "other", "left")
    a, b = F.coalesce("a", "ref"), F.coalesce("b", "other")
    # Digests of deletions could be equal by chance for two of a pair's keys.
    beyond = beyond.where(distance(a, b)).select("ref", "other_n", b.alias("other")).distinct()
    best = F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("best")
    return short.unionByName(beyond).groupBy("ref").agg(F.count("*").alias("n_near"), best).select("ref", "n_near", (-F.col("best.m")).alias("best_n"), F.col("best.w").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) for words with a form (word, form): the last of the chain of forms. Each round doubles the steps taken.

    Counts grow along a chain, so it has no circle, and by a factor, so its length is the logarithm of the largest count.
    """
    state = scratch.save(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.save(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(state)
        if not new.agg(F.count_if("moved")).first()[0]:
            return new.select("word", "root")
        state = new.drop("moved")
        state._scratch_path = new._scratch_path


def variants(docs: DataFrame, ratio: int = 5, least_chars: int = 6, least_n: int = 5, divisor: int = 199, long: int = LONG) -> DataFrame:
    """One row for every word: word, form, root, n, n_near, form_n.

    A form is the commonest word at distance one if it occurs `ratio` times as often at least (ties: least by code points), else null; words without one
    are their own roots. Null and empty texts have no words; a null doc_id counts as the empty string in the checksum. Repeated rows count each, though
    the same letters are left out in them. Very long texts are read row by row; a very long run of letters is joined by digests. An empty table gives an empty one.
    Of the documents only doc_id and text are read, whatever other columns are called.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    ref = F.when(F.length("word") > long, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word"))
    words = scratch.save(counts(docs, least_chars, least_n, divisor).select(ref.alias("ref"), "word", "n"))
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near(words, scratch, long), "ref", "left")
    forms = scratch.save(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")))
    ends = roots(forms, scratch).withColumnRenamed("root", "end")
    return forms.join(ends, "word", "left").select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def report(docs: DataFrame) -> DataFrame:
    return variants(docs)


#: The same in DuckDB; the checksum is made of its table of 256 remainders, and near words share a deletion at the same place or are one's deletion.
SQL = r"""
WITH RECURSIVE remainder AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))
), run AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), seen AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS s, run, count(*) AS n FROM run WHERE length(run) >= 6 GROUP BY ALL
), summed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(s), 2), lambda i: ('0x' || substr(hex(encode(s)), i, 2))::BIGINT)),
    lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8))) AS h
  FROM seen, remainder
), word AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM summed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gap AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM word)
), link AS (
  SELECT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.i = b.i AND a.key = b.key AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM gap g JOIN word w ON g.key = w.word
  UNION SELECT w.word, g.word, g.n FROM gap g JOIN word w ON g.key = w.word
), best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, n, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM link
), form AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN b.n >= 5 * w.n THEN other END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
  FROM word w LEFT JOIN best b ON w.word = b.word AND k = 1
), chain AS (
  SELECT word, word AS at FROM word
  UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON c.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM form f JOIN chain c ON f.word = c.word JOIN form e ON e.word = c.at AND e.form IS NULL
"""
