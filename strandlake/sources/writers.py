"""Writers of the domain's formats through Spark's own sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.codes import header


def fastq_lines(df: DataFrame, mate: int, corrected: bool = True) -> DataFrame:
    """Four-line records of one mate: mate 2 of a corrected pair carries the insert; headers carry the barcode."""
    seq, qual = (F.col("insert"), F.col("insert_qual")) if mate == 2 and corrected else (F.col(f"seq{mate}"), F.col(f"qual{mate}"))
    comment = header() if corrected else F.coalesce("comment", F.lit(""))
    return df.select(F.concat_ws("\n", F.rtrim(F.concat(F.lit("@"), "name", F.lit(" "), comment)), seq, F.lit("+"), qual).alias("value"))


def unaligned_sam(df: DataFrame) -> DataFrame:
    """Two unmapped records (flags 77 and 141) for each pair, with the barcode as a tag."""
    def line(flag: int, seq: Column | str, qual: Column | str) -> Column:
        return F.concat_ws("\t", F.split_part("name", F.lit(" "), F.lit(1)), F.lit(str(flag)), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), seq, qual, F.concat(F.lit("CB:Z:"), "barcode"))

    return df.select(F.explode(F.array(line(77, F.col("seq1"), F.col("qual1")), line(141, F.col("insert"), F.col("insert_qual")))).alias("value"))


def write_text(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").text(path, compression=compression)


def write_csv(df: DataFrame, path: str, sep: str = ",", single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True, sep=sep, nullValue="")


def write_tsv(df: DataFrame, path: str, digits: int = 2) -> None:
    """Tab-separated with doubles in fixed digits."""
    columns = [F.format_string(f"%.{digits}f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    write_csv(df.select(*columns), path, "\t")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def matrix(df: DataFrame, row: str, column: str, value: str, columns: list | None = None, missing: float | None = None) -> DataFrame:
    """Wide form for a sink: one column for each value of `column`."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.first(value))
    return wide if missing is None else wide.na.fill(missing)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One folder for each group, one shuffle for all of them."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def resume(df: DataFrame, path: str) -> None:
    """Writes only if nothing is there yet."""
    df.write.mode("ignore").parquet(path)
