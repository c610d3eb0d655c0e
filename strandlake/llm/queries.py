"""Thin queries over the whole given tables, one for each operator; the operators keep their own interfaces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, dac, fim, fingerprints, language, lines, mixing, neighbours, ngram_join, passages, quality, spelling, substrings


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(documents(spark, sf_dir))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_table(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir), n=4, percent=85)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fitted = language.Identifier.fit(docs.where(~language.held_out()))
    found = fitted.predict(docs)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(documents(spark, sf_dir)))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(documents(spark, sf_dir))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_neighbours, op2_passages, op3_token_codes, op4_fingerprints, op5_line_dedup,
        op6_ngram_join, op7_mixing, op8_suffix_arrays, op9_language_id, op10_bpe,
        op11_spelling, op12_fill_in_middle, op13_quality_rules,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_line_dedup": lines.SQL, "op11_spelling": spelling.SQL, "op12_fill_in_middle": fim.SQL, "op13_quality_rules": quality.SQL}
