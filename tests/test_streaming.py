import random

from gleanset.operators import stats
from gleanset.streaming.losses import early_stop_stream


def test_early_stop_over_batches(spark, tmp_path):
    """After every batch a key's state is what the batch operator gives for the losses so far."""
    rnd = random.Random(3)
    curves = {u: [round(rnd.random() + (6 - e) * (u % 3) * 0.3, 3) for e in range(rnd.randrange(1, 14))] for u in range(20)}
    kind = "user_id long, epoch int, value double"
    for part in range(3):
        rows = [(u, e, v) for u, c in curves.items() for e, v in enumerate(c) if e // 5 == part]
        if part == 2:
            rows += [(0, 0, -9.0), (1, 99, None)]  # a late one, and one without a loss
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {}

    def batch(df, _):
        got.update({r.user_id: r for r in df.collect()})

    query = early_stop_stream(stream, "user_id", "epoch", "value", 3, 0.01).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(batch).start()
    query.processAllAvailable()
    query.stop()
    whole = spark.createDataFrame([(u, e, v) for u, c in curves.items() for e, v in enumerate(c)], kind)
    want = {r.user_id: (r.best_loss, r.stopped_at) for r in stats.early_stop(whole, "user_id", "epoch", "value", 3, 0.01).collect()}
    assert {u: (r.best_loss, r.stopped_at) for u, r in got.items()} == want
    assert {u: r.n for u, r in got.items()} == {u: len(c) for u, c in curves.items()} and any(v for _, v in want.values())
