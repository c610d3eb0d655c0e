import json

from strandlake.streaming import chunks

SF = "/root/testdata/sf0.001"


def test_running_summary(spark, tmp_path):
    for k, (total, mapped) in enumerate([(100, 80), (300, 150)]):
        (tmp_path / f"chunk_{k}.json").write_text(json.dumps({"chunk_id": str(k), "sample_name": "s", "demux": {"total_reads": total, "mapped_reads": mapped}}, indent=2))
    q = chunks.running_summary(chunks.stream_chunks(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("running").first()) == ("s", 2, 400, 230, 0.575)


def test_event_windows_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert sum(r.n for r in chunks.event_windows(events).collect()) == events.count()
    assert sum(r.n for r in chunks.event_sessions(events).collect()) == events.count()
