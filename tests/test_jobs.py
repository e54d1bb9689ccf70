"""The stateful stream of jobs against the batch, over restarts."""

import random
from datetime import datetime, timedelta

from papyrite.streaming import jobs

SCHEMA = "job long, event long, kind string, at timestamp, said string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_stream_equals_the_batch_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    begin = datetime(2024, 1, 1)
    rows = [(rng.randrange(6), i, rng.choice([*jobs.KINDS, "started", "failed"]), begin + timedelta(minutes=rng.randrange(40)), rng.choice([None, "disk full", "late"])) for i in range(60)]
    odd = [(None, 900, "started", begin, "x"), (1, None, "failed", begin, "x"), (1, 901, "strange", begin, None), (1, 902, "started", None, None), (9, 903, "submitted", begin, None)]
    rng.shuffle(rows)
    batches = [rows[:20] + odd, rows[20:45] + rows[:5], rows[45:] + rows[30:40]]  # late, and some again
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for n, part in enumerate(batches):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = jobs.stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
            query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out" / f"n={n}"))).start()
            query.awaitTermination(120)
            assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    newest = {}
    for n in range(len(batches)):
        if (tmp_path / "out" / f"n={n}").exists():
            newest |= {r.job: tuple(r)[:7] for r in spark.read.parquet(str(tmp_path / "out" / f"n={n}")).collect()}
    whole = spark.createDataFrame([r for part in batches for r in part], SCHEMA)
    assert newest == {r.job: tuple(r) for r in jobs.states(whole).collect()} and 9 in newest and newest[9][1] == "pending"


def test_states_of_a_job(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [(1, 1, "submitted", at(0), None), (2, 2, "started", at(1), None), (2, 3, "failed", at(2), "no space"), (3, 4, "started", at(1), None), (3, 5, "failed", at(2), "once"), (3, 6, "started", at(3), None), (3, 6, "started", at(3), None), (4, 7, "started", at(1), None), (4, 8, "succeeded", at(5), None), (4, 9, "failed", at(3), "late news"), (5, 10, "succeeded", at(1), None)]
    got = {r.job: (r.state, r.attempts, r.last_error, r.events) for r in jobs.states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("pending", 0, None, 1), 2: ("failed", 1, "no space", 2), 3: ("running", 2, None, 3), 4: ("succeeded", 1, None, 3), 5: ("succeeded", 0, None, 1)}
    assert jobs.states(spark.createDataFrame([], SCHEMA)).count() == 0
