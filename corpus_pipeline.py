"""From documents to token ids: language filter, line dedup, near duplicates, source mix, BPE.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, language, lines, mixing, ngram_join
from strandlake.llm.common import Scratch, fresh


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that fit no learned language; learns from all labelled documents.

    Null and empty texts have no letter. Repeated rows are judged alike. Without a labelled document nothing is learned and nothing stays; an
    empty table stays empty.
    """
    fitted = language.Identifier.fit(docs)
    name = fresh("language", docs.columns)
    return fitted.predict(docs, tuple(docs.columns), name).where(~F.col(f"{name}.rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated chunks of lines out of the texts; every document stays, null and empty texts as they are, repeated rows alike.

    The first occurrence by doc_id (null first), then place, stays. An empty table stays empty.
    """
    return lines.dedup(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a Jaccard similarity of 0.8 the row of least doc_id stays (null first; ties by a hash of the text).

    Different texts of one id are judged by themselves; rows that repeat id and text stay or go together. Texts without words link with
    nothing and stay. An empty table stays empty.
    """
    row = F.xxhash64("doc_id", "text")
    groups = ngram_join.join(docs.select(row.alias("doc_id"), "text"), n=5, percent=80).select(F.col("doc_id").alias("row"), "component_id").distinct()
    named = docs.select(row.alias("row"), "doc_id").distinct().join(groups, "row")
    heads = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("head")).select(F.col("head.row").alias("key"))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept"), row.alias("key")).join(heads, "key", "left_semi").select("kept.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Documents without words stay once; null is a source of its own.

    Rows that repeat id and text share their copies evenly. An empty table stays empty.
    """
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (decimal, joined by one space) of every row's whole text, with the digest of the text they decode to.

    Null and empty texts have no ids. Rows are independent of each other; an empty table stays empty.
    """
    out = bpe.encode_decode(docs, keep=("doc_id", "lang", "source"), chunks=60_000, release=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", keep_known_languages),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the language models; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
