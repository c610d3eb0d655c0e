"""MinHash fingerprints of documents, their likeness, and near-duplicate pairs by bands of signatures.

A document's features are its shingles of five words. K hash functions x -> (a x + b) mod 2^64 (a odd, both
fixed) run over all of them in numpy; the fingerprint is the upper 16 bits of each least value. The share of
equal places estimates the Jaccard similarity of two documents' shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, components, mix64, partitions, shingle_hashes, word_hashes

K, WORDS = 128, 5
_A = mix64(np.arange(1, K + 1, dtype=U64))[:, None] | U64(1)
_B = mix64(np.arange(K + 1, 2 * K + 1, dtype=U64))[:, None]


def signature(text: str | None, n: int = WORDS) -> np.ndarray:
    """K 16-bit places; a text without words has all places 0xFFFF."""
    x = shingle_hashes(word_hashes(text), n)
    least = np.full(K, ~U64(0))
    for k in range(0, len(x), 256):
        np.minimum(least, (_A * x[None, k : k + 256] + _B).min(axis=1), out=least)
    return (least >> U64(48)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, sig binary) for every row; null text counts as empty, repeated rows have equal signatures, an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [signature(t, n).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], names=["doc_id", "sig"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sig binary")


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("sig", pa.binary()), ("edited_sig", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int32()), ("kind", pa.string()), ("text", pa.string())])


def edit_report(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """One row for every document: its fingerprint, that of its edited text and the likeness to it and to the next document.

    The next document is the next in descending doc_id (null last; equal ids by text), after the last the first;
    a single document follows itself. Null texts count as empty; equal texts have equal fingerprints, and the
    likeness of two empty texts is 1. Repeated rows follow each other and have a row each; an empty table gives an empty one. One range exchange of the texts, then each task streams its sorted run. A
    run's last document needs the first of the next run: the two are kept aside with their texts, two rows for
    each task, and joined afterwards by the runs' order. Very long texts are held two at a time in a task; only doc_id and text are read, whatever other columns are called.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "edits")

    def report(doc_id, text, sig, following, next_sig, part=0, kind="row"):
        text, following = text or "", following or ""
        changed = edited(text, following)
        other = signature(changed, n)
        return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), sig.tobytes(), other.tobytes(), likeness(sig, other), likeness(sig, next_sig), part, kind, None)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sig = signature(text, n)
                if held is None:
                    out.append((doc_id, 0, None, sig.tobytes(), None, 0.0, 0.0, part, "head", text))
                else:
                    out.append(report(*held, text, sig))
                held = (doc_id, text, sig)
            if out:
                yield batch_of(out)
        if held is not None:
            yield batch_of([(held[0], 0, None, held[2].tobytes(), None, 0.0, 0.0, part, "tail", held[1])])

    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), order[0]).sortWithinPartitions(*order)
    done = scratch.save(rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, sig binary, edited_sig binary, near_edited double, near_next double, part int, kind string, text string"))
    parts = sorted(r[0] for r in done.where("kind = 'head'").select("part").collect())
    follow = dict(zip(parts, parts[1:] + parts[:1], strict=True))
    heads = done.where("kind = 'head'").select("part", F.col("text").alias("next_text"), F.col("sig").alias("next_sig"))
    step = F.create_map(*[F.lit(x) for kv in follow.items() for x in kv]) if follow else F.create_map(F.lit(0), F.lit(0))
    tails = done.where("kind = 'tail'").withColumn("to", step[F.col("part")]).join(heads.withColumnRenamed("part", "to"), "to").select("doc_id", "text", "sig", "next_text", "next_sig")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, s, nt, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield batch_of([report(d, t, np.frombuffer(s, "<u2"), nt, np.frombuffer(ns, "<u2"))])

    both = done.where("kind = 'row'").unionByName(tails.mapInArrow(last, done.schema))
    return both.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("sig")).alias("fingerprint"), F.lower(F.hex("edited_sig")).alias("edited_fingerprint"), "near_edited", "near_next")


def near_duplicates(docs: DataFrame, n: int = WORDS, least: float = 0.8, bands: int = 32) -> DataFrame:
    """(doc_id, component): documents in groups of near copies, found by equal bands and verified by the Jaccard of their shingle sets.

    Signatures are cut into bands; in each band's bucket every text meets the bucket's least text, so a bucket
    of g copies makes g candidates. A text that isn't linked to that one then meets all texts of the bucket. Equal texts are one
    class and meet once. Candidates whose exact Jaccard is below `least` go. Each distinct text is fetched once for each of
    its candidate pairs. Documents without words link with nothing
    but equal texts; rows with null doc_id are left out. A bucket's head is its least doc_id. Repeated rows have a row each; an empty table gives an
    empty one.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "minhash")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumn("digest", F.sha2("text", 256))
    members = scratch.save(keyed.groupBy("digest").agg(F.min("doc_id").alias("head")).join(keyed.select("digest", "doc_id"), "digest"))
    classes = scratch.save(keyed.join(members.where("head = doc_id").select("digest", "doc_id").distinct(), ["digest", "doc_id"]).dropDuplicates(["digest"]).select("doc_id", "text"))
    sigs = fingerprint(classes, n).where(F.col("sig") != F.lit(b"\xff" * (2 * K)))
    width = 2 * K // bands
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.struct(k.alias("band"), F.expr("sig").substr(k * width + 1, F.lit(width)).alias("value"))))
    buckets = scratch.save(sigs.select("doc_id", cut.alias("b")).select("doc_id", F.xxhash64("b.band", "b.value").alias("bucket")))
    heads = buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("c")).where("c > 1").drop("c")
    pairs = scratch.save(buckets.join(heads, "bucket").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct())
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True):
                x, y = np.unique(shingle_hashes(word_hashes(ta), n)), np.unique(shingle_hashes(word_hashes(tb), n))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        both = pairs.join(classes.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(classes.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
        return scratch.save(both.select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"))

    links = verified(pairs)
    linked = scratch.save(components(links, scratch))
    of_text = linked.select(F.col("id").alias("doc_id"), "component")
    of_head = linked.select(F.col("id").alias("a"), F.col("component").alias("head_component"))
    others = buckets.join(heads, "bucket").where("a <> doc_id").join(of_text, "doc_id", "left").join(of_head, "a", "left")
    rest = scratch.save(others.where("component is null or head_component is null or component <> head_component").select("bucket", "doc_id"))
    every = buckets.join(heads, "bucket").where("a <> doc_id").select("bucket", F.col("doc_id").alias("other"))
    left = rest.join(every, "bucket").where("doc_id <> other").select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    links = links.unionAll(verified(left.join(pairs, ["a", "b"], "left_anti")))
    found = components(links.unionAll(members.select(F.col("head").alias("a"), F.col("doc_id").alias("b"))), scratch)
    return texts.select("doc_id").join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
