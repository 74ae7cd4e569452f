"""Segmented scans, sweeps over boxes and JSON set in lines, against windows and plain code."""

import json
import random

import pytest
from pyspark.sql import Window, functions as F

from docloom.functions import codec, prompt
from docloom.operators import aggregates, joins, scan, tokens


def one_group(spark, n=2000, groups=1, seed=3):
    rnd = random.Random(seed)
    rows = [(k, (None if rnd.random() < 0.02 else 0) if groups == 1 else rnd.randrange(groups), None if rnd.random() < 0.05 else rnd.randint(0, 50), rnd.randint(0, 1)) for k in range(n)]
    return spark.createDataFrame(rows, "at int, g int, v int, kind int").repartition(5)


@pytest.mark.parametrize("groups", [1, 40])
def test_scans_equal_windows(spark, groups):
    df = one_group(spark, groups=groups)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = scan.ordered(df, ["g"], ["at"])
        assert rows.select("pid_").distinct().count() == 8
        wanted = [scan.Total("a", "sum", F.col("v")), scan.Total("b", "max", F.col("v"), before=True), scan.Total("c", "count", F.col("v")), scan.Total("d", "min", F.col("v")), scan.Neighbour("e", F.col("v"), -1), scan.Neighbour("f", F.col("v"), 1)]
        found = scan.closed(scan.scanned(rows, ["g"], wanted))
        w = Window.partitionBy("g").orderBy("at")
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        plain = df.select("*", F.sum("v").over(upto).alias("a"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"), F.count("v").over(upto).alias("c"), F.min("v").over(upto).alias("d"), F.lag("v").over(w).alias("e"), F.lead("v").over(w).alias("f"))
        assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_best_so_far_and_positions_of_one_group(spark):
    rows = {r["at"]: r for r in aggregates.best_so_far(one_group(spark, 500).withColumn("g", F.lit(1)), "v", "g", ["at"]).collect()}
    best, streak, stopped = None, 0, False
    for k in range(500):
        r = rows[k]
        better = best is None or (r["v"] is not None and r["v"] > best)
        streak = 0 if better else streak + 1
        stopped |= streak >= 3
        assert (r["best_before"], r["improved"], r["streak"], r["stopped"]) == (best, better, streak, stopped)
        best = r["v"] if best is None else max(best, r["v"] or best)
    rows = sorted(tokens.shared_positions(one_group(spark, 300).withColumn("g", F.lit(1)), "g", "at", "kind").collect(), key=lambda r: r["at"])
    kinds = [r["kind"] for r in rows]
    inner = [0 < k < 299 and kinds[k - 1] == kinds[k] == kinds[k + 1] == 1 for k in range(300)]
    place = -1
    for k, r in enumerate(rows):
        place += not (inner[k] and k and inner[k - 1])
        assert r["position_id"] == place


@pytest.mark.parametrize("strip,swept", [(4096, 1 << 16), (5, 8)])
def test_sweep_finds_the_boxes_that_meet(spark, monkeypatch, strip, swept):
    monkeypatch.setattr(joins, "STRIP", strip)
    monkeypatch.setattr(joins, "SWEPT", swept)
    monkeypatch.setattr(joins, "TRIED", 40)
    rnd = random.Random(strip)
    rows = [(rnd.choice((None, "p", "q", "q", "q")), k, *(lambda x, y: (x, y, x + rnd.randint(0, 9), y + rnd.randint(0, 9)))(rnd.randint(0, 60), rnd.randint(0, 60))) for k in range(250)]
    rows += [("p", 900, None, 0, 99, 99), ("p", 901, 50, 0, 0, 99), ("flat", 1, 0, 5, 9, 5), ("flat", 2, 9, 5, 12, 5), ("flat", 3, 10, 5, 12, 6)]
    df = spark.createDataFrame(rows, "page string, k int, x1 int, y1 int, x2 int, y2 int").withColumn("strip", F.lit(1))
    found = sorted(map(str, joins.overlapping(df, "page", "k").collect()))
    ok = [r for r in rows if None not in r[2:] and r[2] <= r[4] and r[3] <= r[5]]
    plain = [(a[0], a[1], b[1]) for a in ok for b in ok if a[0] == b[0] and a[1] < b[1] and a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5]]
    assert found == sorted(f"Row(page={p!r}, left_key={a}, right_key={b})" for p, a, b in plain) and len(plain) > 50


TEXTS = [{}, [], {"a": {}}, {"a": [], "b": [1, -2.5, [True, None]], "c": {"d": {"e": "x,{}[]:\"q\\ \n"}}}, "plain", 3, {"文": "é\u0007", "": [{}, {"z": 1, "a": 2}]}]


def test_json_is_set_in_lines(spark):
    for ascii_only in (False, True):
        df = spark.createDataFrame([(json.dumps(t, ensure_ascii=ascii_only),) for t in TEXTS], "t string")
        assert [r[0] for r in df.select(codec.indented(F.col("t"))).collect()] == [json.dumps(t, ensure_ascii=False, indent=4) for t in TEXTS]


def test_tools_are_told(spark):
    tools = [{"type": "simple_browser"}, {"type": "function", "function": {"name": "f", "parameters": {"b": [1], "a": "é"}}}]
    df = spark.createDataFrame([(json.dumps(tools),), ("[]",), (None,)], "t string")
    first, *rest = [r[0] for r in df.select(prompt.glm_tools(F.col("t"))).collect()]
    own = json.dumps(tools[1]["function"], ensure_ascii=False, indent=4)
    assert rest == [None, None] and first == f"{prompt.GLM_SYSTEM}\n\n## simple_browser\n\n{prompt.GLM_TOOLS['simple_browser']}\n\n## f\n\n{own}\n{prompt.GLM_CALL}"
    with pytest.raises(Exception, match="no such kind of tool"):
        df.select(prompt.glm_tools(F.lit('[{"type": "cup"}]'))).collect()
