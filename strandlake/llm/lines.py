"""Line dedup by content-defined chunks of lines, in DataFrame operations only.

Every line has a hash of 32 bits. A chunk ends after a line where the rolling hash over the last two line hashes is divisible by
DIVISOR, and at the end of the text. So boundaries depend on the lines around them only, and a passage that recurs elsewhere
falls into the same chunks whatever stands before it. A chunk with two lines or more that are not blank, found more than
once anywhere, stays where it comes first (least doc_id, then position) and is removed elsewhere; equality is that of the bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, salted_join

DIVISOR, MULTIPLIER, LEAST_LINES = 3, 31, 2


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def ranges(lines: Column) -> Column:
    """Array of (first, last) line numbers from 0, one for each chunk. No array is captured by a lambda, so each is made once."""
    hashes = F.transform(lines, line_hash)
    ends = F.zip_with(hashes, F.concat(F.array(F.lit(0).cast("long")), hashes), lambda v, before: (v + MULTIPLIER * before) % DIVISOR == 0)
    at = F.filter(F.transform(ends, lambda end, i: F.when(end, i)), lambda i: i.isNotNull())
    last = F.array_distinct(F.concat(at, F.array(F.size(lines) - 1)))
    first = F.concat(F.array(F.lit(0)), F.transform(last, lambda i: i + 1))
    return F.filter(F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda r: r["last"].isNotNull())


def dedup(docs: DataFrame) -> DataFrame:
    """All rows with the columns they came with, text replaced by what stays and n_chars (if there) by its length, then n_lines,
    n_chunks, n_removed_chunks, n_removed_lines as the struct `line_dedup` (with underscores behind it if a column has that name already).

    Null text stays null, an empty one is one blank line. A text of which all chunks go becomes ''. Rows that repeat id and text are judged as one; of
    two texts of one id that share a chunk the one of lesser hash comes first. A row with null doc_id comes first in the order. An empty table
    gives an empty one, and columns keep their names whatever they are. Texts cross the exchange once, to meet the list of their removed chunks; chunks that occur once
    cross it as hashes only.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    base = docs.select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("h"), row.alias("row"), F.split("text", "\n", -1).alias("lines"))
    base = scratch.save(base.select("*", ranges(F.col("lines")).alias("ranges")))

    def text_of(r: Column) -> Column:
        return F.array_join(F.slice("lines", r["first"] + 1, r["last"] - r["first"] + 1), "\n")

    long_enough = F.filter(F.transform("ranges", lambda r, i: F.struct(i.alias("at"), r.alias("r"))), lambda c: c["r"]["last"] - c["r"]["first"] + 1 >= LEAST_LINES)
    chunks = base.select("id", "h", F.explode(F.transform(long_enough, lambda c: F.struct(c["at"].alias("at"), text_of(c["r"]).alias("chunk")))).alias("c")).select("id", "h", "c.at", "c.chunk")
    chunks = chunks.where(F.col("chunk").rlike(r"\S[^\n]*\n(?s:.*)\S")).withColumn("hash", F.xxhash64("chunk"))
    often = scratch.save(chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    # Joins of texts are of a fixed kind, so that exchanges grow with the texts and not by leaps.
    again = scratch.save(salted_join(chunks, often, ["hash"], merge=True))
    place = F.struct("id", "h", "at")
    heads = scratch.save(again.groupBy("hash", "chunk").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1"))
    gone = salted_join(again, heads, ["hash", "chunk"], merge=True).where(~place.eqNullSafe(F.col("head")))
    removed = gone.groupBy(F.col("id").alias("id2"), F.col("h").alias("h2")).agg(F.collect_set("at").alias("removed"))
    removed = scratch.save(removed)
    scratch.drop(again, often, heads)
    joined = base.hint("merge").join(removed, (F.col("h") == F.col("h2")) & F.col("id").eqNullSafe(F.col("id2")), "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    kept = F.filter("ranges", lambda r, i: ~F.array_contains("removed", i))
    dropped = F.filter("ranges", lambda r, i: F.array_contains("removed", i))
    text = F.when(F.col("lines").isNull(), F.lit(None)).when(F.size("removed") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(kept, text_of), "\n"))
    counts = F.struct(
        F.greatest(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.size("ranges"), F.lit(0)).cast("long").alias("n_chunks"), F.size("removed").cast("long").alias("n_removed_chunks"),
        F.coalesce(F.aggregate(dropped, F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1), F.lit(0)).cast("long").alias("n_removed_lines"),
    )
    name = fresh("line_dedup", docs.columns)
    out = joined.select("row", text.alias("text"), counts.alias(name))
    columns = [F.col("text") if c == "text" else F.coalesce(F.length("text"), F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*columns, name)


def report(docs: DataFrame) -> DataFrame:
    """One row for every document: doc_id, the counts, SHA-256 of what stays (null text: of '')."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "line_dedup.*", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same in DuckDB.
SQL = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i
  FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS v FROM line
), rolled AS (
  SELECT *, (v + 31 * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 3 = 0 AS ends FROM hashed
), numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM rolled
), chunk AS (
  SELECT doc_id, k, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n,
         sum((regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]'))::INT) AS solid
  FROM numbered GROUP BY doc_id, k
), judged AS (
  SELECT *, solid >= 2 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS gone FROM chunk
)
SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (WHERE gone) AS n_removed_chunks,
       coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
