"""Registration of queries, and the domain tables as views of the driver's tables.

A domain table is a list of expressions that Spark and DuckDB read alike, so query and SQL start from the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(expr: str, values: list) -> str:
    """CASE over expr = 0, 1, ..."""
    return f"CASE {expr} " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in enumerate(values)) + " END"


FLAGS = [99, 147, 77, 141, 73, 133, 2147, 355, 1123]
_START = "(l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 100000"
ALIGNMENTS = {
    "qname": "concat('r', cast(l_orderkey AS string), '_', cast(l_linenumber AS string), '_', cast(l_partkey AS string))",
    "key": "l_orderkey",
    "cell": "concat('c', cast(l_suppkey AS string))",
    "chrom": "concat('chr', cast(1 + l_partkey % 22 AS string))",
    "pos0": _START,
    "pos1": f"{_START} + 50 + cast(l_quantity AS bigint)",
    "mapq": "cast(l_quantity AS bigint)",
    "flag": f"cast({choose('(l_orderkey + l_linenumber) % 9', FLAGS)} AS int)",
    "cigar": choose("l_linenumber % 4", ["20M500N30M", "5S40M5S", "50M", "4S46M"]),
    "seq": choose("l_partkey % 5", ["TTTTTTTTTTACG", "ACGTACGT", "GATTACA", "CCAAAAAAAAAAC", "TTTTTTTTTACG"]),
    "mate_chrom": "CASE WHEN l_suppkey % 5 = 0 THEN 'chr0' ELSE '=' END",
    "mate_pos": f"{_START} + l_partkey % 700",
    "tlen": "cast((l_partkey * 13 + l_linenumber * 7) % 1400 - 100 AS bigint)",
}
_ODD = "l_linenumber % 2 = 1"
#: Read pairs: two records of most templates, with secondary, supplementary and unmapped ones and equal ends.
MATES = {
    "qname": "concat('t', cast(l_orderkey AS string), '_', cast(cast(floor((l_linenumber - 1) / 2) AS bigint) AS string))",
    "cell": "concat('c', cast(l_orderkey % 20 AS string))",
    "chrom": f"CASE WHEN l_orderkey % 11 = 0 AND {_ODD} THEN 'chr9' ELSE concat('chr', cast(1 + l_orderkey % 3 AS string)) END",
    "pos0": f"(l_orderkey % 40) * 500 + 100 + CASE WHEN {_ODD} THEN 0 ELSE 120 END + l_partkey % 2",
    "flag": f"CASE WHEN l_orderkey % 9 = 1 THEN CASE WHEN {_ODD} THEN 73 ELSE 133 END WHEN l_orderkey % 9 = 2 THEN CASE WHEN {_ODD} THEN 77 ELSE 141 END WHEN l_partkey % 10 = 3 THEN CASE WHEN {_ODD} THEN 355 ELSE 2195 END WHEN l_partkey % 10 = 4 THEN CASE WHEN {_ODD} THEN 611 ELSE 147 END WHEN {_ODD} THEN 99 ELSE 147 END",
    "cigar": choose("l_partkey % 4", ["50M", "3S47M", "45M2S3H", "10M30N40M"]),
    "seq": choose("l_partkey % 3", ["ACGTACGTAC", "ACGT", "GATTACA"]),
    "mapq": "cast(l_quantity AS bigint)",
    "score": "cast(l_quantity * 7 AS bigint) % 31",
}
EXONS = {"chrom": "concat('chr', cast(1 + p_partkey % 22 AS string))", "pos0": "(p_partkey * 7919) % 100000", "pos1": "(p_partkey * 7919) % 100000 + p_size * 4", "gene": "p_brand"}
GENES = EXONS | {"pos1": "(p_partkey * 7919) % 100000 + p_size * 20"}
GENOME = 2_200_000
CALLS = {
    "sample": "concat('s', cast(o_custkey % 17 AS string))",
    "chrom": "concat('chr', cast(1 + l_partkey % 22 AS string))",
    "pos": "l_partkey * 10 + l_linenumber % 2",
    "ref": f"{choose('l_partkey % 4', list('ACGT'))}",
    "alt": f"{choose('(l_partkey + 1 + l_linenumber % 3) % 4', list('ACGT'))}",
    "dp": "cast(l_quantity AS bigint) + 5",
    "ad": "cast(floor((l_quantity + 5) * l_discount * 10) AS bigint)",
}


def exprs(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in columns.items()]


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*exprs(ALIGNMENTS))


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*exprs(MATES))


def exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*exprs(EXONS))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*exprs(GENES))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(*exprs(CALLS))


def calls(spark: SparkSession, sf_dir: str, near: tuple[str, ...] = ()) -> DataFrame:
    """One call for each sample and allele: the deepest, then that with most alternative reads. near: columns whose equal values are dealt to one task, so that groups of them need no shuffle of their own."""
    rows = raw_calls(spark, sf_dir)
    rows = rows.repartition(*near) if near else rows
    return rows.groupBy("sample", "chrom", "pos", "ref", "alt").agg(F.max(F.struct("dp", "ad")).alias("b")).select("sample", "chrom", "pos", "ref", "alt", "b.dp", "b.ad")


def _cte(name: str, columns: dict[str, str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(exprs(columns))} FROM {source})"


ALIGNMENTS_SQL = _cte("alignments", ALIGNMENTS, "lineitem")
MATES_SQL = _cte("mates", MATES, "lineitem")
EXONS_SQL = _cte("exons", EXONS, "part")
GENES_SQL = _cte("genes", GENES, "part")
CALLS_SQL = _cte("raw_calls", CALLS, "lineitem JOIN orders ON l_orderkey = o_orderkey") + """, calls AS (
  SELECT sample, chrom, pos, ref, alt, dp, ad FROM (
    SELECT *, row_number() OVER (PARTITION BY sample, chrom, pos, ref, alt ORDER BY dp DESC, ad DESC) AS k FROM raw_calls) WHERE k = 1)"""


def merged_sql(name: str, source: str, by: str = "chrom") -> str:
    """CTEs of the merged intervals of a source."""
    return f"""{name}_edge AS (
  SELECT {by}, pos0, pos1, max(pos1) OVER (PARTITION BY {by} ORDER BY pos0, pos1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}
), {name}_island AS (
  SELECT {by}, pos0, pos1, sum(CASE WHEN reach IS NULL OR pos0 > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY pos0, pos1 ROWS UNBOUNDED PRECEDING) AS island FROM {name}_edge
), {name} AS (SELECT {by}, min(pos0) AS pos0, max(pos1) AS pos1 FROM {name}_island GROUP BY {by}, island)"""
