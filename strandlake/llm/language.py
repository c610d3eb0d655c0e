"""Language identification with interpolated Kneser-Ney models of characters, one for each language.

Text is lower-cased and every run of non-letters becomes one space. Each language has its n-grams of ORDER
characters counted over all of its training documents; lower orders use continuation counts. A model is a few sorted
arrays of 64-bit hashes with the interpolated probabilities beside them; a look-up is a binary search. The language
with the lowest cross-entropy per character wins, and a document is rejected when even that one is
above the language's threshold, a high quantile of its own training documents plus a margin.

No n-gram and no language is left out. While all n-grams are at most BROADCAST, workers get the arrays by broadcast; beyond that the same
model is fitted and looked up as tables, by joins on the n-grams that the documents hold. Both give the same probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Scratch, mix64, salted_join

ORDER = 4
#: N-grams of all languages up to which the models are broadcast.
BROADCAST = 2_000_000
#: Calibration: documents above this quantile of cross-entropy in their own language, plus the margin in nats, are rejected.
#: Short texts vary more: SHORT over the root of the number of characters is added as well.
QUANTILE, MARGIN, SHORT = 0.999, 0.35, 3.0
#: A worker counts so many n-grams between flushes (memory bound).
FLUSH = 4_000_000
SPACE, SHIFT = U64(32), U64(16)


def letter_table() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_LETTER: list[np.ndarray] = []


def characters(text: str | None) -> np.ndarray:
    """Folded characters as 16-bit values with a space at both ends; empty without letters. Code points above 0xFFFF share values."""
    if not text:
        return np.empty(0, U64)
    if not _LETTER:
        _LETTER.append(letter_table())
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _LETTER[0][c]
    if not is_letter.any():
        return np.empty(0, U64)
    c = np.where(is_letter, c & 0xFFFF, 32)
    c = np.concatenate([[32], c, [32]])
    return c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])].astype(U64)


def grams(c: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Packed n-grams ending at each character but the first; the start is padded with spaces."""
    if len(c) < 2:
        return np.empty(0, U64)
    c = np.concatenate([np.full(order - 2, SPACE), c])
    g = c[: len(c) - order + 1]
    for k in range(1, order):
        g = g << SHIFT | c[k : len(c) - order + 1 + k]
    return g


def count_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram long, n long) over all rows of (lang, text), counted in each task before the exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = grams(characters(text), order)
                held.setdefault(lang, []).append(g)
                size += len(g)
                if size >= FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney probabilities of one language in sorted hash arrays, one pair for each order."""

    keys: list[np.ndarray]
    probs: list[np.ndarray]
    context_keys: list[np.ndarray]
    context_backoff: list[np.ndarray]
    floor: float

    @classmethod
    def fit(cls, gram: np.ndarray, n: np.ndarray, order: int = ORDER) -> KneserNey:
        """From packed n-grams of the highest order and their counts."""
        by_order: list[tuple[np.ndarray, np.ndarray]] = [(gram, n.astype(np.float64))]
        for k in range(order - 1, 0, -1):  # continuation counts: in how many (k+1)-gram types the k-gram is the end
            keep = U64((1 << (16 * k)) - 1)
            by_order.insert(0, tuple(np.unique(by_order[0][0] & keep, return_counts=True)))
        keys, probs, ckeys, backs = [], [], [], []
        floor = 1.0 / (len(by_order[0][0]) + 1)
        lower_keys, lower_probs = None, None
        for k, (g, c) in enumerate(by_order, start=1):
            c = c.astype(np.float64)
            n1, n2 = float((c == 1).sum()), float((c == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context = g >> SHIFT
            contexts, inverse = np.unique(context, return_inverse=True)
            total = np.bincount(inverse, c)
            kinds = np.bincount(inverse)
            back = discount * kinds / total
            if k == 1:
                low = np.full(len(g), floor)
            else:
                low = lower_probs[np.searchsorted(lower_keys, g & U64((1 << (16 * (k - 1))) - 1))]
            p = np.maximum(c - discount, 0) / total[inverse] + back[inverse] * low
            lower_keys, lower_probs = g, p
            for arrays, values, hashed in ((keys, probs, (g, p)), (ckeys, backs, (contexts, back))):
                h = mix64(hashed[0] + U64(k))
                at = np.argsort(h)
                arrays.append(h[at])
                values.append(hashed[1][at])
        return cls(keys, probs, ckeys, backs, floor)

    def log_probs(self, g: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the last character of each packed n-gram given those before."""
        p = np.full(len(g), self.floor)
        for k, (keys, probs, ckeys, backs) in enumerate(zip(self.keys, self.probs, self.context_keys, self.context_backoff, strict=True), start=1):
            gram = g & U64((1 << (16 * k)) - 1) if k < len(self.keys) else g
            back, seen = _find(ckeys, backs, mix64((gram >> SHIFT) + U64(k)))
            p = np.where(seen, back * p, p)
            value, known = _find(keys, probs, mix64(gram + U64(k)))
            p = np.where(known, value, p)
        return np.log(p)


def _find(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return values[at], keys[at] == h


class Scorer:
    """All languages' models, and a direct-mapped memory of the n-grams met: same results, fewer searches."""

    BITS = 20

    def __init__(self, languages: list[str], models: list[KneserNey]):
        self.languages, self.models, self.order = languages, models, len(models[0].keys)
        self.slots = np.zeros(1 << self.BITS, U64)
        self.logs = np.zeros((1 << self.BITS, len(models)), np.float32)

    def table(self, g: np.ndarray) -> np.ndarray:
        """Log-probabilities, one row for each n-gram and one column for each language."""
        slot = (mix64(g) >> U64(64 - self.BITS)).astype(np.int64)
        if len(miss := np.unique(g[self.slots[slot] != g])):
            at = (mix64(miss) >> U64(64 - self.BITS)).astype(np.int64)
            self.slots[at] = 0
            values = np.stack([m.log_probs(miss) for m in self.models], 1).astype(np.float32)
            self.logs[at] = values  # of n-grams that share a slot the last one stays ...
            self.slots[at] = miss
        out = self.logs[slot]
        if (left := self.slots[slot] != g).any():  # ... and the others are looked up by themselves
            rest, at = np.unique(g[left], return_inverse=True)
            out[left] = np.stack([m.log_probs(rest) for m in self.models], 1)[at]
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean negative log-probability per character for each text and language; number of characters scored."""
        parts = [grams(characters(t), self.order) for t in texts]
        sizes = np.array([len(p) for p in parts])
        out = np.full((len(texts), len(self.models)), np.nan)
        if sizes.sum():
            logs = self.table(np.concatenate(parts))
            has = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[has]
            out[has] = -np.add.reduceat(logs, starts, axis=0, dtype=np.float64) / sizes[has][:, None]
        return out, sizes


class Tables:
    """The models as tables: for each order k (language, n-gram, probability) and (language, context, weight of the lower order)."""

    def __init__(self, counts: DataFrame, order: int, scratch: Scratch):
        self.order, self.scratch = order, scratch
        levels = [counts.select("lang", "gram", F.col("n").cast("double").alias("c"))]
        for k in range(order - 1, 0, -1):  # continuation counts
            levels.insert(0, scratch.save(levels[0].groupBy("lang", self.last("gram", k).alias("gram")).agg(F.count("*").cast("double").alias("c"))))
        self.floors = scratch.save(levels[0].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("p")))
        self.probs: list[DataFrame] = []
        self.contexts: list[DataFrame] = []
        for k, t in enumerate(levels, start=1):
            once, twice = F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
            discount = t.groupBy("lang").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("d"))
            own = t.withColumn("context", F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long"))
            weight = own.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds")).join(discount, "lang")
            weight = scratch.save(weight.select("lang", "context", "total", "d", (F.col("d") * F.col("kinds") / F.col("total")).alias("back")))
            lower = self.floors.select("lang", F.col("p").alias("low")) if k == 1 else self.probs[-1].select("lang", F.col("gram").alias("end"), F.col("p").alias("low"))
            joined = own.join(weight, ["lang", "context"])
            joined = joined.join(lower, "lang") if k == 1 else joined.withColumn("end", self.last("gram", k - 1)).join(lower, ["lang", "end"])
            self.probs.append(scratch.save(joined.select("lang", "gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("back") * F.col("low")).alias("p"))))
            self.contexts.append(weight.select("lang", "context", "back"))

    def last(self, gram: str, k: int) -> Column:
        """The last k characters of an n-gram."""
        return F.col(gram) if k == self.order else F.col(gram).bitwiseAND(F.lit((1 << (16 * k)) - 1))

    def logs(self, wanted: DataFrame, languages: list[str]) -> DataFrame:
        """(gram, n, logs) for each of (gram, n): log-probabilities in the order of the languages."""
        rows = wanted.crossJoin(self.floors)
        for k, (contexts, probs) in enumerate(zip(self.contexts, self.probs, strict=True), start=1):
            own = self.last("gram", k)
            rows = rows.withColumn("end", own).withColumn("context", F.shiftrightunsigned("end", 16) if k > 1 else F.lit(0).cast("long"))
            rows = rows.join(contexts, ["lang", "context"], "left").join(probs.select("lang", F.col("gram").alias("end"), F.col("p").alias("known")), ["lang", "end"], "left")
            rows = rows.select("gram", "n", "lang", F.coalesce("known", F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
        at = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
        return rows.groupBy("gram", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.log("p").alias("log")))), lambda x: x["log"]).alias("logs"))


class Identifier:
    """Fitted models, as arrays or as tables, with their rejection thresholds."""

    def __init__(self, languages: list[str], models: list[KneserNey], thresholds: dict[str, float] | None = None, tables: Tables | None = None):
        self.languages, self.models, self.thresholds, self.tables = languages, models, thresholds or {}, tables

    @classmethod
    def fit(cls, train: DataFrame, calibrate: bool = True, order: int = ORDER, broadcast: int = BROADCAST) -> Identifier:
        """From every row of (lang, text) whose lang and text are not null; repeated rows count as often as they occur.

        Counts, discounts and continuation counts cover all rows. Up to `broadcast` n-grams pass the driver, which is checked first; more are fitted
        as tables. Without a usable row no language is learned. order: 2 to 4 characters.
        """
        if not 2 <= order <= 4:
            raise ValueError("n-grams of 2 to 4 characters fit into 64 bits")
        scratch = Scratch(train.sparkSession, "langid")
        rows = train.where("lang is not null and text is not null").select("lang", "text")
        counts = scratch.save(count_grams(rows, order))
        languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
        if counts.count() <= broadcast:
            got = counts.select("lang", "gram", "n").toArrow()
            which = pc.index_in(got["lang"], pa.array(languages, got.schema.field("lang").type)).to_numpy()
            gram, n = got["gram"].to_numpy().view(U64), got["n"].to_numpy()
            models = []
            for k in range(len(languages)):
                own = np.flatnonzero(which == k)
                own = own[np.argsort(gram[own])]
                models.append(KneserNey.fit(gram[own], n[own], order))
            fitted = cls(languages, models)
            scratch.drop(counts)
        else:
            fitted = cls(languages, [], tables=Tables(counts, order, scratch))
        if calibrate and languages:
            fitted.thresholds = fitted._calibrate(rows)
        return fitted

    def _calibrate(self, rows: DataFrame) -> dict[str, float]:
        own = self._scored(rows, ("lang",)).select("lang", F.element_at(F.col("entropies"), F.array_position(F.array(*map(F.lit, self.languages)), F.col("lang")).cast("int")).alias("h"))
        got = own.where("not isnan(h)").groupBy("lang").agg(F.percentile_approx("h", QUANTILE, 10000).alias("h")).collect()
        return {lang: h + MARGIN for lang, h in got}

    def _scored(self, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        languages = self.languages
        if not languages:
            return docs.select(*keep, F.array().cast("array<double>").alias("entropies"), F.lit(0).cast("long").alias("n"))
        if self.tables:
            return self._joined(docs, keep)
        shared = docs.sparkSession.sparkContext.broadcast((languages, self.models))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*shared.value)
            for batch in batches:
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    h, n = scorer.cross_entropies(part.column(len(keep)).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(list(h), pa.list_(pa.float64())), pa.array(n, pa.int64())], names=schema.names)

        schema = T.StructType([*(T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)), T.StructField("entropies", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
        columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
        return docs.select(*columns, F.col("text").alias("text")).mapInArrow(run, schema).toDF(*keep, "entropies", "n")

    def _joined(self, docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """As _scored, with the models as tables: each distinct text's n-grams meet their log-probabilities in a join."""
        order, scratch = self.tables.order, self.tables.scratch
        key = F.sha2(F.coalesce("text", F.lit("")), 256)
        texts = docs.select(key.alias("__key"), "text").where("text is not null").dropDuplicates(["__key"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    g, n = np.unique(grams(characters(text), order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["__key", "gram", "times"])

        held = scratch.save(texts.mapInArrow(run, "__key string, gram long, times long"))
        logs = scratch.save(self.tables.logs(held.groupBy("gram").agg(F.count("*").alias("n")), self.languages))
        met = salted_join(held, logs, ["gram"])
        sums = met.groupBy("__key").agg(F.sum("times").alias("__n"), *[F.sum(F.col("times") * F.col("logs")[i]).alias(f"__s{i}") for i in range(len(self.languages))])
        scored = sums.select("__key", "__n", F.array(*[-F.col(f"__s{i}") / F.col("__n") for i in range(len(self.languages))]).alias("__h"))
        none = F.array(*[F.lit(float("nan")) for _ in self.languages])
        return docs.withColumn("__key", key).join(scored, "__key", "left").select(*[F.col(f"`{c}`") for c in keep], F.coalesce("__h", none).alias("entropies"), F.coalesce("__n", F.lit(0)).cast("long").alias("n"))

    def predict(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), name: str | None = None) -> DataFrame:
        """`keep`, lang_pred, score, cross_entropy, rejected for every row; only text decides. With a name these four come as a struct of that name.

        `und`, score 0 and rejected where text is null or has no letter (or no language was learned). The score is the
        softmax of minus the cross-entropies over at most 20 characters' worth of evidence; ties go to the first language. Whole texts are scored,
        whatever their length; equal texts have equal results and repeated rows stay; an empty table gives an empty one. Columns in `keep` travel in one struct
        and may have any name; where one is called like a result, ask for a struct.
        """
        rows = self._scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), "text"), ("kept",))
        langs = F.array(*map(F.lit, self.languages)) if self.languages else F.array(F.lit("und"))
        best = F.array_min("entropies")
        known = F.col("n") > 0
        at = F.array_position("entropies", best).cast("int")
        score = 1 / F.aggregate("entropies", F.lit(0.0), lambda s, h: s + F.exp(-(h - best) * F.least(F.col("n"), F.lit(20)).cast("double")))
        bounds = F.array(*[F.lit(float(self.thresholds.get(lang, float("inf")))) for lang in self.languages]) if self.languages else F.array(F.lit(0.0))
        rejected: Column = F.when(known, best > F.element_at(bounds, at) + SHORT / F.sqrt("n")).otherwise(True)
        found = [F.when(known, F.element_at(langs, at)).otherwise("und").alias("lang_pred"), F.when(known, score).otherwise(0.0).alias("score"), F.when(known, best).alias("cross_entropy"), rejected.alias("rejected")]
        made = rows.select("kept", F.struct(*found).alias("found"))
        return made.select("kept.*", F.col("found").alias(name) if name else "found.*")


def held_out(doc_id: str = "doc_id") -> Column:
    """The contract's split: crc32 of the id as text, mod 4, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
