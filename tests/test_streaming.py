from pyspark.sql import functions as F

from talweg.sources.tables import patches, table
from talweg.streaming import ingest


def test_patches_are_summarised_as_they_arrive(spark, sf_dir, tmp_path):
    rows = patches(spark, sf_dir)
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows.where("patch_id < 100").repartition(3).write.parquet(source)
    ingest.ingest(spark, source, target, state, files_per_batch=1).awaitTermination()
    rows.where("patch_id >= 100").coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, target, state).awaitTermination()
    found = {r.label: (r.patches, r.leaves, r.junctions) for r in ingest.rolled_up(spark, target).collect()}
    whole = ingest.summaries(rows).groupBy("label").agg(F.count("*").alias("p"), F.sum("leaves").alias("l"), F.sum("junctions").alias("j"))
    assert found == {r.label: (r.p, r.l, r.j) for r in whole.collect()}


def test_windows_of_a_stream_equal_those_of_the_table(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start().awaitTermination()
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 4)) for r in df.collect())
    assert key(spark.table("windows")) == key(ingest.event_windows(events))
