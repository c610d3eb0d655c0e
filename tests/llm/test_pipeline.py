"""The pipeline's stages take effect, keep columns and clean documents, and survive odd tables."""

from collections import Counter

import corpus_pipeline as p
from strandlake.llm import ngram_join

from .conftest import ODD, frame, sentence

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    counts = [docs.count()]
    for name, stage in p.STAGES[:4]:
        after = stage(spark, before, SF)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        counts.append(after.count())
        before = after
        if name == "n-gram Jaccard join":
            groups = Counter(r.component_id for r in ngram_join.join(after, n=5, percent=80).where("n_shingles > 0").collect())
            assert max(groups.values()) == 1
    assert counts[1] >= 0.97 * counts[0] and counts[2] == counts[1] and 0 < counts[3] < counts[2]
    final = p.run(spark, SF)
    assert final.count() == counts[4] and final.where("n_tokens > 0").count() > 0


def test_odd_and_empty_tables(spark):
    base = frame(spark, [*ODD, *[sentence(k, 80) for k in range(20)]])
    for df in (base, base.limit(0)):
        for _, stage in p.STAGES:
            df = stage(spark, df, SF)
            df = spark.createDataFrame(df.collect(), df.schema)


def test_columns_of_any_name_pass_the_stages(spark):
    """Extra columns called like results or helpers of the stages come out as they went in."""
    from pyspark.sql import functions as F

    names = ["n", "rejected", "entropies", "score", "lang_pred", "cross_entropy", "language", "line_dedup", "kept", "row", "key", "h", "id", "component_id", "lines", "ranges", "removed", "size", "copies", "__copy", "__row", "__h", "__id", "__n", "text2", "a b"]
    base = frame(spark, [*ODD, *[sentence(k, 80) for k in range(20)]]).drop("h", "id")
    base = base.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in names])
    df = base
    for name, stage in p.STAGES[:4]:
        df = stage(spark, df, SF)
        assert df.columns == base.columns, name
        rows = df.collect()
        assert rows and all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in names), name
        df = spark.createDataFrame(rows, df.schema)
    assert p.STAGES[4][1](spark, df, SF).count() == df.count()
