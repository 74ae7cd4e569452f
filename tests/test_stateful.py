"""Streams with state against batches, and row generators."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import aggregates, generators
from docloom.streaming import stateful

SCHEMA = "id bigint, g string, v double, ts timestamp"


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, checkpoint, **more):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    found = stateful.best_so_far(events, "v", "g", ["id"], "ts", **more)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def made(first, n, seed=1):
    rnd, start = random.Random(seed), datetime.datetime(2024, 1, 1)
    return [(k, rnd.choice("abc"), None if rnd.random() < 0.1 else float(rnd.randint(0, 30)), start + datetime.timedelta(minutes=k)) for k in range(first, first + n)]


def test_stream_goes_on_after_a_restart_as_the_batch(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    write(spark, folder, made(0, 40))
    write(spark, folder, made(40, 30, 2))
    run(spark, folder, out, checkpoint)
    write(spark, folder, made(70, 40, 3))
    found = run(spark, folder, out, checkpoint)  # a new query from the checkpoint
    plain = aggregates.best_so_far(spark.read.schema(SCHEMA).parquet(folder), "v", "g", ["id"])
    names = ["g", "id", "best_before", "improved", "streak", "stopped"]
    assert sorted(map(str, found.select(names).collect())) == sorted(map(str, plain.select(names).collect()))
    assert found.filter("ended").count() == 0 and found.filter("stopped").count() > 0


def test_idle_keys_end(spark, tmp_path):
    folder, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    start = datetime.datetime(2024, 1, 1)
    write(spark, folder, [(1, "a", 5.0, start), (2, "a", 3.0, start + datetime.timedelta(minutes=1))])
    run(spark, folder, out, checkpoint, idle="30 minutes", late="1 minute")
    write(spark, folder, [(3, "b", 1.0, start + datetime.timedelta(hours=2))])
    run(spark, folder, out, checkpoint, idle="30 minutes", late="1 minute")
    write(spark, folder, [(4, "a", 2.0, start + datetime.timedelta(hours=3))])
    rows = run(spark, folder, out, checkpoint, idle="30 minutes", late="1 minute")
    ended = rows.filter("ended AND g = 'a'").collect()
    assert [(r["best_before"], r["streak"]) for r in ended] == [(5.0, 1)]
    assert rows.filter("id = 4").first()["best_before"] is None  # begins anew


def test_batches_of_partitions(spark):
    generators.register(spark)
    spark.range(10).select((F.col("id") % 2).alias("g"), "id", F.concat(F.lit("t"), F.col("id")).alias("t")).createOrReplaceTempView("generated")
    rows = spark.sql("SELECT * FROM batches(TABLE(generated) PARTITION BY g ORDER BY (id), 'id, t', 2)")
    assert rows.columns == ["batch", "n", "id", "t"] and rows.schema["id"].dataType.simpleString() == "array<bigint>"
    assert sorted(tuple(r["id"]) for r in rows.collect()) == [(0, 2), (1, 3), (4, 6), (5, 7), (8,), (9,)]
    assert spark.sql("SELECT * FROM batches(TABLE(generated) PARTITION BY g ORDER BY (id), '', 5)").columns == ["batch", "n", "g", "id", "t"]
    for call in ("'no', 2", "'id', 0"):
        with pytest.raises(Exception, match="no such column|one row at least"):
            spark.sql(f"SELECT * FROM batches(TABLE(generated) PARTITION BY g ORDER BY (id), {call})").collect()
