"""The streaming playback against the batch form, over several micro-batches and a replay."""

from pyspark.sql import functions as F

from tessera.operators.sequence import slots
from tessera.plans.container import played, samples_of
from tessera.streaming.playback import play, play_pairs


def test_stream_plays_what_the_batch_plays(spark, tmp_path):
    events = samples_of(spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("user_id < 6"))
    want = {(r.user_id, r.event_id): (r.frame, r.fault) for r in played(slots(events, "user_id", "event_id", "mask")).collect()}
    cuts = [r[0] for r in events.select(F.expr("percentile(event_id, array(0.3, 0.7))")).collect()][0]
    parts = [events.where(F.col("event_id") <= cuts[0]), events.where((F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1])), events.where(F.col("event_id") <= cuts[1]), events.where(F.col("event_id") > cuts[1])]
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = []
    for i, part in enumerate(parts):  # the third one replays what was played
        part.coalesce(1).write.mode("append").parquet(str(source))
        query = play(stream, "user_id", "event_id").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: got.extend(df.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    assert {(r.track, r["sample"]): (r.frame, r.fault) for r in got} == want and len(got) == len(want)


def test_colour_and_alpha_change_together(spark, tmp_path):
    rows = [
        (1, 0, False, 0, 255, False, 0, 1), (1, 1, True, 3, 0, True, 5, 0), (1, 2, False, 0, 2, None, None, None), (1, 3, True, 1, 0, True, 0, 0), (1, 4, False, 0, 8, True, 7, 0), (1, 5, True, 3, 0, None, None, None),
        (2, 0, True, 0, 0, None, None, None), (2, 1, False, 0, 1, None, None, None), (2, 2, True, 0, 0, False, 0, 255), (2, 3, True, 0, 0, None, None, None),
    ]
    # 1: slot 5 of alpha is empty, so nothing is shown; 4 fails by its alpha, so colour slot 3 still holds frame 0 at 5
    want = {(1, 0): (0, 0, None), (1, 1): (None, None, "unsupported"), (1, 2): (2, 0, None), (1, 3): (2, 0, None), (1, 4): (None, None, "unsupported"), (1, 5): (0, 0, None), (2, 0): (None, None, "unsupported"), (2, 1): (1, None, None), (2, 2): (1, 2, None), (2, 3): (1, 2, None)}
    schema = "track long, sample long, shows boolean, idx int, mask int, alpha_shows boolean, alpha_idx int, alpha_mask int"
    table = spark.createDataFrame(rows, schema)
    assert {(r.track, r["sample"]): (r.frame, r.alpha, r.fault) for r in play_pairs(table, "track", "sample").collect()} == want
    source, got = tmp_path / "in", []
    source.mkdir()
    stream = play_pairs(spark.readStream.schema(table.schema).parquet(str(source)), "track", "sample")
    for low, high in ((0, 2), (0, 4), (4, 9)):
        table.where(f"sample >= {low} and sample < {high}").coalesce(1).write.mode("append").parquet(str(source))
        stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, n: got.extend(df.collect())).trigger(availableNow=True).start().awaitTermination()
    assert {(r.track, r["sample"]): (r.frame, r.alpha, r.fault) for r in got} == want and len(got) == len(want)
