"""Quality rules as weak supervision, in DataFrame operations only.

Every rule looks at one count of a text and votes good or bad, or abstains where the count says little. How far each rule's votes are to be trusted
isn't fixed: expectation maximisation over the votes of all texts estimates the share of good texts and, for each rule, how often it votes good on
good texts and bad on bad ones. A text is kept if its posterior probability of being good reaches a threshold and it passes the base checks.
Texts become patterns of votes, of which there are no more than 3 to the power of the number of rules, so each step reads one small table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

WORD = r"[^\x20\x09-\x0D]+"
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}++(?:[-'’]\p{L}++)*+[.,;:!?]?+(?![^\x20\x09-\x0D])"
CAPITAL, LETTERS = r"[^\p{Lu}]+", r"\P{L}+"
DOUBLED, STOP = r"[!?#*$%&|<>]{2,}", r"[.!?…](?=[\x20\x09-\x0D]|\z)"
LEAST_WORDS, REPEATED = 50, 50


@dataclass(frozen=True)
class Rule:
    """Votes good where low <= share <= high, bad where share < least or share > most, and abstains in between."""

    name: str
    part: str
    whole: str
    low: float
    high: float
    least: float
    most: float


#: A share of nothing is null, and the rule abstains.
RULES = (
    Rule("symbols", "n_symbols", "n_words", 0, 0.03, 0, 0.1),
    Rule("word_length", "word_chars", "n_words", 3, 9, 2.5, 12),
    Rule("duplicate_lines", "n_dup_lines", "n_solid_lines", 0, 0.1, 0, 0.3),
    Rule("repeated_words", "n_repeat_words", "n_words", 0, 0.2, 0, 0.4),
    Rule("plain_words", "n_plain", "n_words", 0.85, 1, 0.7, 1),
    Rule("capitals", "n_capitals", "n_letters", 0, 0.2, 0, 0.4),
    Rule("doubled_marks", "n_doubled", "n_words", 0, 0.02, 0, 0.1),
    Rule("sentence_ends", "n_stops", "n_words", 0.015, 0.35, 0.005, 0.6),
)


def repeats(rows: DataFrame, words: str, out: str, n: int = 3) -> DataFrame:
    """Adds how many words of the array lie in windows of n words found twice or more in it.

    Windows are sorted by 32 bits of a hash with their place in the other half of a long, which finds all that could be equal, and a few that aren't; those are compared
    word for word. Work is that of sorting, however often a window occurs. Arrays that lambdas look into stand in columns of their own, so that
    they are made once.
    """
    names = [fresh(f"{out}_{k}", rows.columns) for k in ("hash", "key", "pair", "at", "window", "found")]
    hash_, key, pair, at, window, found = names
    rest = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1)))
    rows = rows.withColumn(hash_, F.transform(words, lambda w: F.xxhash64(w)))
    rolled = F.col(hash_)
    for k in range(1, n):
        rolled = F.zip_with(rolled, rest(hash_, k), lambda a, b: F.xxhash64(a, b))
    rolled = F.slice(rolled, F.lit(1), F.greatest(F.size(hash_) - (n - 1), F.lit(0)))
    high = lambda v: F.shiftright(v, 32)
    rows = rows.withColumn(key, F.sort_array(F.transform(rolled, lambda h, i: F.shiftleft(high(h), 32).bitwiseOR(i.cast("long")))))
    place = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    both = F.zip_with(key, rest(key, 1), lambda a, b: F.when(high(a) == high(b), F.struct(place(a).alias("a"), place(b).alias("b"))))
    rows = rows.withColumn(pair, F.filter(both, lambda p: p.isNotNull()))
    union = F.array_union(F.transform(pair, lambda p: p["a"]), F.transform(pair, lambda p: p["b"]))
    text = F.transform(union, lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("w"), i.alias("i")))
    rows = rows.withColumn(window, F.sort_array(text))
    same = F.zip_with(window, rest(window, 1), lambda a, b: F.when(a["w"] == b["w"], F.struct(a["i"].alias("a"), b["i"].alias("b"))))
    rows = rows.withColumn(found, F.filter(same, lambda p: p.isNotNull()))
    rows = rows.withColumn(at, F.sort_array(F.array_union(F.transform(found, lambda p: p["a"]), F.transform(found, lambda p: p["b"]))))
    covered = F.zip_with(at, rest(at, 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(n)), F.lit(n)))
    return rows.withColumn(out, F.aggregate(covered, F.lit(0).cast("long"), lambda s, c: s + c)).drop(*names)


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(row, h, counts): the columns `keep` in a struct, a hash of the text, and a struct of counts over every row's whole text. Null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("t"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    solid = F.filter(F.split("t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = repeats(rows.withColumn("lines", solid), "words", "n_repeat_words")
    length = F.length("t").cast("long")
    left = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")
    found = lambda pattern: F.regexp_count("t", F.lit(pattern)).cast("long")
    counts = {
        "n_words": F.size("words").cast("long"),
        "word_chars": F.length(F.translate("t", SPACE, "")).cast("long"),
        "n_symbols": length - F.length(F.translate("t", SYMBOLS, "")),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_solid_lines": F.size("lines").cast("long"),
        "n_plain": found(PLAIN),
        "n_capitals": left(CAPITAL),
        "n_letters": left(LETTERS),
        "n_doubled": found(DOUBLED),
        "n_stops": found(STOP),
    }
    return rows.select("row", F.xxhash64("t").alias("h"), F.struct(*[c.alias(k) for k, c in counts.items()]).alias("counts"))


def vote(rule: Rule) -> Column:
    """1 good, -1 bad, 0 abstains."""
    share = F.try_divide(F.col(rule.part).cast("double"), F.col(rule.whole))
    return F.when(share.between(rule.low, rule.high), 1).when((share < rule.least) | (share > rule.most), -1).otherwise(0).cast("int")


@dataclass(frozen=True)
class Model:
    """The share of good texts, and for each rule the chance of a good vote on a good text and of a bad vote on a bad one, given that it votes."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for v, a, b in zip(votes, self.on_good, self.on_bad, strict=True):
            odds = odds + F.when(v == 1, math.log(a / (1 - b))).when(v == -1, math.log((1 - a) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def fit(patterns: DataFrame, names: list[str], start: float = 0.8, edge: float = 0.01, prior: float = 10.0, rounds: int = 100, tolerance: float = 1e-5) -> Model:
    """Expectation maximisation over (votes.., c), each pattern counting c times.

    Every estimate is smoothed by `prior` votes at its start. A rule whose votes say nothing gets no weight, and none is taken for worse than chance: its two chances
    exceed 1 by `edge` at least, which keeps good and bad from changing places. Stops when nothing moves by more than the tolerance. Without any votes the
    model stays where it started.
    """
    now = Model(0.5, (start,) * len(names), (start,) * len(names))
    for _ in range(rounds):
        p = now.posterior([F.col(n) for n in names])
        rated = patterns.select("c", *names, p.alias("p"))
        good, bad = F.col("c") * F.col("p"), F.col("c") * (1 - F.col("p"))
        sums = [F.sum(good).alias("good"), F.sum("c").alias("all")]
        for k, n in enumerate(names):
            sums += [F.sum(F.when(F.col(n) == 1, good)).alias(f"gg{k}"), F.sum(F.when(F.col(n) != 0, good)).alias(f"g{k}"), F.sum(F.when(F.col(n) == -1, bad)).alias(f"bb{k}"), F.sum(F.when(F.col(n) != 0, bad)).alias(f"b{k}")]
        got = {k: v or 0.0 for k, v in rated.agg(*sums).first().asDict().items()}
        smooth = lambda hit, of: (hit + prior * start) / (of + prior)
        on_good = tuple(smooth(got[f"gg{k}"], got[f"g{k}"]) for k in range(len(names)))
        on_bad = tuple(max(smooth(got[f"bb{k}"], got[f"b{k}"]), 1 + edge - a) for k, a in enumerate(on_good))
        new = Model((got["good"] + prior * 0.5) / (got["all"] + prior), on_good, on_bad)
        moved = max(abs(a - b) for a, b in zip((new.good, *new.on_good, *new.on_bad), (now.good, *now.on_good, *now.on_bad), strict=True))
        now = new
        if moved <= tolerance:
            break
    return now


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5, name: str = "quality") -> DataFrame:
    """The columns `keep` and a struct `name`: the counts, one vote for each rule, posterior, base_failed and kept, for every row.

    Base checks fail texts of fewer than LEAST_WORDS words or with more than REPEATED of 100 words in repeated windows. Null texts count as empty, and those fail.
    The model learns from all texts that pass the base checks, repeated texts once, so that a mass of copies doesn't pass for agreement; every row is judged, equal texts alike.
    Very long texts stay in one row with a few longs for each word. A posterior at the threshold is kept. An empty table gives an empty one. Only `keep` and text are read, whatever
    other columns are called; if `keep` holds `name`, underscores are added to the struct's name. Nothing is shuffled but (votes, hash of the text), once.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    names = [f"v{k}" for k in range(len(rules))]
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    flat = features(docs, keep).select("row", "h", "counts", "counts.*").select("row", "h", "counts", base.alias("base_failed"), *[vote(r).alias(n) for r, n in zip(rules, names, strict=True)])
    rows = scratch.save(flat)
    patterns = scratch.save(rows.where(~F.col("base_failed")).groupBy(*names, "h").agg(F.lit(1).alias("one")).groupBy(*names).agg(F.count("*").alias("c")).coalesce(1))
    model = fit(patterns, names)
    posterior = model.posterior([F.col(n) for n in names])
    votes = F.struct(*[F.col(n).alias(r.name) for r, n in zip(rules, names, strict=True)])
    kept = ~F.col("base_failed") & (posterior >= threshold)
    made = F.struct("counts", votes.alias("votes"), posterior.alias("posterior"), "base_failed", kept.alias("kept"))
    return rows.select("row.*", made.alias(fresh(name, keep)))


def report(docs: DataFrame) -> DataFrame:
    """One row for every document: doc_id, the base counts, base_failed, kept, and the votes. Odd cases as in judge."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs).select("doc_id", *[f"quality.counts.{c}" for c in base], "quality.base_failed", "quality.kept", *[F.col(f"quality.votes.{r.name}").alias(f"vote_{r.name}") for r in RULES])


def _sql() -> str:
    """The same in DuckDB: votes from the rules above, expectation maximisation as a recursive table of 100 rounds."""
    share = lambda r: f"{r.part}::DOUBLE / nullif({r.whole}, 0)"
    votes = ", ".join(f"coalesce(CASE WHEN {share(r)} BETWEEN {r.low} AND {r.high} THEN 1 WHEN {share(r)} < {r.least} OR {share(r)} > {r.most} THEN -1 END, 0)::INTEGER" for r in RULES)
    named = ", ".join(f"v[{k}] AS vote_{r.name}" for k, r in enumerate(RULES, 1))
    n = len(RULES)
    term = "CASE v[k] WHEN 1 THEN ln(a[k] / (1 - b[k])) WHEN -1 THEN ln((1 - a[k]) / b[k]) ELSE 0 END"
    odds = f"ln(good / (1 - good)) + list_sum(list_transform(range(1, {n + 1}), lambda k: {term}))"
    hit = lambda k, v, p: f"(coalesce(sum(CASE WHEN v[{k}] = {v} THEN c * {p} END), 0) + 8) / (coalesce(sum(CASE WHEN v[{k}] <> 0 THEN c * {p} END), 0) + 10)"
    good = ", ".join(hit(k, 1, "p") for k in range(1, n + 1))
    bad = ", ".join(f"greatest({hit(k, -1, '(1 - p)')}, 1.01 - {hit(k, 1, 'p')})" for k in range(1, n + 1))
    return rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), tripled AS (
  SELECT *, lead(w, 1) OVER d AS w1, lead(w, 2) OVER d AS w2 FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), often AS (
  SELECT *, w2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w1, w2) > 1 AS twice FROM tripled
), per_word AS (
  SELECT doc_id, w, max(twice::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS repeated FROM often
), from_words AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(repeated)::BIGINT AS n_repeat_words,
         count(*) FILTER (WHERE regexp_full_match(w, '\p{{L}}+([-''’]\p{{L}}+)*[.,;:!?]?')) AS n_plain,
         count(*) FILTER (WHERE regexp_full_match(w, '(?s).*[.!?…]')) AS n_stops
  FROM per_word GROUP BY doc_id
), line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), from_lines AS (
  SELECT doc_id, count(*) AS n_solid_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), counted AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_solid_lines, 0) AS n_solid_lines, coalesce(n_plain, 0) AS n_plain, coalesce(n_stops, 0) AS n_stops,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS n_letters,
         len(regexp_extract_all(t, '[!?*#$%&|<>]{{2,}}')) AS n_doubled
  FROM documents LEFT JOIN from_words USING (doc_id) LEFT JOIN from_lines USING (doc_id)
), voted AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{votes}] AS v FROM counted
), pattern AS (
  SELECT v, count(DISTINCT t) AS c FROM voted WHERE NOT base_failed GROUP BY v
), em AS (
  SELECT 0 AS step, 0.5::DOUBLE AS good, list_transform(range({n}), lambda k: 0.8::DOUBLE) AS a, list_transform(range({n}), lambda k: 0.8::DOUBLE) AS b
  UNION ALL
  SELECT any_value(step) + 1, (coalesce(sum(c * p), 0) + 5) / (coalesce(sum(c), 0) + 10), [{good}], [{bad}]
  FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM em, pattern WHERE step < 100)
  HAVING count(*) > 0
), fitted AS (
  SELECT * FROM em ORDER BY step DESC LIMIT 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept, {named}
FROM voted, fitted
"""


SQL = _sql()
