"""Readers, writers and incremental work on files made here."""

import io
import json
import os
import pickle
import tarfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.operators import records, splits
from docloom.sources import formats, readers, writers
from docloom.streaming import incremental


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def test_json_lines_keep_bad_lines(spark, tmp_path):
    p = write(f"{tmp_path}/a.jsonl", '{"a": 1, "b": "x"}\nnot json\n\n')
    rows = readers.json_lines(spark, p, "a int, b string").collect()
    assert [(r["a"], r["b"], r["raw"]) for r in rows] == [(1, "x", None), (None, None, "not json")]
    assert readers.json_file(spark, write(f"{tmp_path}/b.json", '[{"a": 1},\n{"a": 2}]'), "a int").count() == 2


def test_label_lines(spark, tmp_path):
    p = write(f"{tmp_path}/train/x/Label.txt", 'f1\t[{"transcription": "a", "points": [[0,0],[1,0],[1,1],[0,1]], "score": 0.5}]\nbroken\n')
    rows = readers.label_lines(spark, p, strict=False).select("file_id", readers.boxes(F.col("boxes_json")).alias("b")).collect()
    assert len(rows) == 1 and rows[0]["b"][0]["points"][2] == [1.0, 1.0]
    with pytest.raises(Exception, match="two parts"):
        readers.label_lines(spark, p).collect()
    listing = readers.files(spark, str(tmp_path), [".TXT"])
    assert [(r["usage"], r["type"]) for r in readers.discovered(listing).collect()] == [("train", "x")]


def test_text_and_csv(spark, tmp_path):
    p = write(f"{tmp_path}/t.txt", "\n".join(f" line {k} " for k in range(20)))
    assert [r["line"] for r in readers.first_lines(spark, p).orderBy("line_no").collect()] == [f"line {k}" for k in range(12)]
    assert readers.text_lines(spark, p).count() == 20
    c = write(f"{tmp_path}/c.csv", 'index,name\n0,"a,\n""b"""\n')
    assert readers.csv(spark, c, "index int, name string").collect()[0]["name"] == 'a,\n"b"'
    assert readers.processed(spark, write(f"{tmp_path}/d.txt", "a\t1\nb\t1\na\t1\n")).count() == 2


def test_arrow_dataset(spark, tmp_path):
    t = pa.table({"id": ["1"], "image": ["i"], "angle": pa.array([0.0], pa.float32()), "ground_truth": ["{}"]})
    for name, new in (("s.arrow", pa.ipc.new_stream), ("f.arrow", pa.ipc.new_file)):
        with pa.OSFile(f"{tmp_path}/{name}", "wb") as f, new(f, t.schema) as w:
            w.write_table(t)
        assert readers.dataset(spark, f"{tmp_path}/{name}").collect()[0]["id"] == "1"
    with pytest.raises(ValueError):
        readers.dataset(spark, "x.bin")


def test_pickles_hold_plain_values_only(spark, tmp_path):
    with open(f"{tmp_path}/a.pkl", "wb") as f:
        pickle.dump({"x.jpg": {"k": "v"}}, f)
    assert json.loads(readers.pickled_dicts(spark, f"{tmp_path}/a.pkl").collect()[0]["fields"]) == {"k": "v"}
    with open(f"{tmp_path}/b.pkl", "wb") as f:
        pickle.dump({"x": os.getcwd}, f)
    with pytest.raises(Exception, match="plain value"):
        readers.pickled_dicts(spark, f"{tmp_path}/b.pkl").collect()


def test_web_dataset_and_export(spark, tmp_path):
    with tarfile.open(f"{tmp_path}/0.tar", "w") as tar:
        for name, data in (("a.json", b'{"id": 1}'), ("a.jpg", b"JPG"), ("b.json", b"{}"), ("b.jpg", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = readers.web_dataset(spark, f"{tmp_path}/*.tar")
    assert {r["key"]: bytes(r["jpg"]) for r in rows.collect()} == {"a": b"JPG", "b": b""}
    planned = writers.bucketed_files(splits.buckets(rows, "key", size=1), "bucket", "key", "jpg")
    assert [r["path"] for r in planned.collect()] == ["00000/a.jpg"]
    writers.export_files(planned, f"file://{tmp_path}/out")
    assert open(f"{tmp_path}/out/00000/a.jpg", "rb").read() == b"JPG"


def test_scene_boxes(spark, tmp_path):
    write(f"{tmp_path}/f.txt", "\r\n".join(f"{k},0,1,0,1,1,0,1,{t}" for k, t in enumerate(("a,b", "###", "c", "d", "e"))))
    write(f"{tmp_path}/g.txt", "bad\n")
    lines = readers.scene_lines(spark, f"{tmp_path}/*.txt")
    found = {r["file_id"]: r["boxes"] for r in readers.scene_boxes(lines.repartition(8)).collect()}
    assert found["g"] == [] and [b["transcription"] for b in found["f"]] == ["a", "c", "d", "e"]
    assert [b["points"][0][0] for b in found["f"]] == [0.0, 2.0, 3.0, 4.0] and found["f"][0]["points"][2] == [1.0, 1.0] and found["f"][0]["score"] == 0.99


def test_shards_are_read_as_streams(spark, tmp_path, monkeypatch):
    for shard in range(3):
        with tarfile.open(f"{tmp_path}/{shard}.tar", "w") as tar:
            for k in range(20):
                for kind, data in (("json", b"{}"), ("jpg", bytes(1000))):
                    if kind == "json" or k % 4:
                        info = tarfile.TarInfo(f"d/{k:03}.{kind}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
    rows = readers.web_dataset(spark, f"file://{tmp_path}/*.tar").collect()
    assert sorted((r["shard"][-5], r["key"], len(r["jpg"] or b"")) for r in rows) == [(str(s), f"{k:03}", 1000 if k % 4 else 0) for s in range(3) for k in range(20)]


def test_exports_are_written_by_tasks(spark, tmp_path):
    planned = spark.range(200).select(F.format_string("%05d/%s.jpg", F.col("id") % 7, F.col("id")).alias("path"), F.encode(F.col("id").cast("string"), "utf-8").alias("content")).repartition(5)
    assert writers.export_files(planned, f"file:{tmp_path}/out") == 200
    assert open(f"{tmp_path}/out/00003/10.jpg").read() == "10" and len(list(tmp_path.glob("out/*/*.jpg"))) == 200
    assert writers.export_files(planned.limit(0), f"{tmp_path}/none") == 0


def test_json_arrays(spark, tmp_path):
    rows = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, F.lit("票")).alias("t"))
    writers.json_array(rows, f"{tmp_path}/a")
    (file,) = tmp_path.glob("a/part-*")
    assert sorted(json.loads(file.read_text()), key=lambda r: r["id"])[:2] == [{"id": 0, "t": "票"}, {"id": 1, "t": None}]
    writers.json_array(rows.limit(0), f"{tmp_path}/b")
    assert json.loads("".join(f.read_text() for f in tmp_path.glob("b/part-*"))) == []
    with pytest.raises(ValueError):
        writers.json_text(rows, most=499)


def test_metric_workbook(spark, tmp_path):
    import xml.etree.ElementTree as xml
    import zipfile

    rows = [("a<b", 2, 1, 0.5), ("total", 9, 3, None), ("first", 1, 2, 1.0)]
    writers.metric_xlsx(spark.createDataFrame(rows, "field string, field_order int, right_num bigint, f1 double"), f"file://{tmp_path}/m.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/m.xlsx") as book:
        assert all(xml.fromstring(book.read(n)) is not None for n in book.namelist())
        sheet = xml.fromstring(book.read("xl/worksheets/sheet1.xml"))
    assert [["".join(c.itertext()) for c in row] for row in sheet[0]] == [["field", "right_num", "f1"], ["first", "2", "1.0"], ["a<b", "1", "0.5"], ["total", "3", ""]]
    with pytest.raises(ValueError):
        writers.metric_xlsx(spark.createDataFrame(rows, "field string, field_order int, right_num bigint, f1 double"), f"{tmp_path}/n.xlsx", most=2)


def test_images_with_a_broken_one(spark, tmp_path):
    Image = pytest.importorskip("PIL.Image")
    Image.new("RGB", (4, 3), (1, 2, 3)).save(f"{tmp_path}/a.png")
    write(f"{tmp_path}/b.png", "no image")
    found = {r["path"][-5:]: r for r in readers.images(spark, f"{tmp_path}/*.png", bgr=True).collect()}
    assert (found["a.png"]["width"], found["a.png"]["height"], bytes(found["a.png"]["pixels"])[:3]) == (4, 3, b"\3\2\1") and found["b.png"]["pixels"] is None
    assert readers.decoded_image(open(f"{tmp_path}/a.png", "rb").read(), angle=90)[:2] == (3, 4)


def test_vocab_files(spark, tmp_path):
    p = write(f"{tmp_path}/tokenizer.json", json.dumps({"model": {"vocab": [["<unk>", 0.0], ["a", -1.5]]}, "added_tokens": [{"id": 0, "content": "<s>"}]}))
    assert [(r["id"], r["token"], r["score"]) for r in readers.tokenizer_vocab(spark, p).orderBy("id").collect()] == [(0, "<unk>", 0.0), (1, "a", -1.5)]
    assert readers.added_tokens(spark, p).collect()[0]["token"] == "<s>"
    r = readers.rank_vocab(spark, write(f"{tmp_path}/r.txt", "YQ== 7\n")).collect()[0]
    assert (bytes(r["token"]), r["rank"]) == (b"a", 7)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("f", "train", None), ("g", "test", "票")], "file string, usage string, text string")
    writers.json_lines(df, f"{tmp_path}/j")
    assert '"text":null' in "".join(r["value"] for r in spark.read.text(f"{tmp_path}/j").collect())
    writers.states(df, f"{tmp_path}/s", F.col("file"))
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/s").collect()) == ["f\t1", "g\t1"]
    writers.labels(df, f"{tmp_path}/l", F.col("file"), F.lit("[]"))
    writers.lines(df, f"{tmp_path}/n", "file")
    writers.csv(df, f"{tmp_path}/c")
    assert json.loads(writers.json_text(df))[1]["text"] == "票"
    metric = spark.createDataFrame([("b", 1, 1.0), ("a", 0, 0.5)], "field string, field_order int, f1 double")
    writers.metric_csv(metric, f"{tmp_path}/m")
    assert [r["field"] for r in spark.read.csv(f"{tmp_path}/m", header=True).collect()] == ["a", "b"]


def test_unknown_fields_and_usages_raise(spark):
    with pytest.raises(Exception, match="unknown usage"):
        spark.range(1).select(records.usage_label(F.lit("dev"))).collect()


def test_incremental_work_goes_on_where_it_stopped(spark, tmp_path):
    src, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    write(f"{src}/1.json", '{"k": 1}\n')
    work = lambda df: df.select((F.col("k") * 10).alias("v"))
    incremental.process_new(spark, src, "k int", work, out, state)
    write(f"{src}/2.json", '{"k": 2}\n')
    incremental.process_new(spark, src, "k int", work, out, state)
    incremental.process_new(spark, src, "k int", work, out, state)
    assert sorted(r["v"] for r in spark.read.schema("v int").json(out).collect()) == [10, 20]


def test_stream_windows_match_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e")
    q = incremental.windows(stream, "ts", "event_type", "value").writeStream.format("memory").queryName("windows_out").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = incremental.windows(events, "ts", "event_type", "value")
    count = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert count(spark.table("windows_out")) == count(batch)
    assert incremental.deduplicated(events, "ts", ["user_id"]).count() == events.select("user_id").distinct().count()


def test_arrow_files_are_read_by_batch_and_column(spark, tmp_path):
    t = pa.table({"id": [str(k) for k in range(100)], "wide": ["x" * 50] * 100, "angle": pa.array([0.5] * 100, pa.float32())})
    for k in range(2):
        with pa.OSFile(f"{tmp_path}/{k}.arrow", "wb") as f, pa.ipc.new_file(f, t.schema) as w:
            w.write_table(t, max_chunksize=10)
    rows = readers.arrow_files(spark, f"{tmp_path}/*.arrow", "angle double, id string, missing int")
    assert rows.rdd.getNumPartitions() == 20 and rows.columns == ["angle", "id", "missing"]
    assert sorted(r["id"] for r in rows.collect()) == sorted([str(k) for k in range(100)] * 2) and rows.filter("angle = 0.5 AND missing IS NULL").count() == 200
    formats.register(spark)
    whole = spark.read.format("arrow_ipc").option("batches", "4").load(f"file:{tmp_path}")
    assert whole.columns == ["id", "wide", "angle"] and whole.rdd.getNumPartitions() == 6 and whole.count() == 200


def test_large_shards_go_to_several_tasks(spark, tmp_path):
    with tarfile.open(f"{tmp_path}/0.tar", "w", format=tarfile.GNU_FORMAT) as tar:
        for k in range(60):
            for kind, data in (("json", b"{}"), ("jpg", bytes([k]) * 3000)):
                info = tarfile.TarInfo(f"{'long/' * 30}{k:03}.{kind}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    with tarfile.open(f"{tmp_path}/1.tar", "w:gz") as tar:
        info = tarfile.TarInfo("z.json")
        info.size = 2
        tar.addfile(info, io.BytesIO(b"{}"))
    formats.register(spark)
    rows = spark.read.format("tar_samples").option("split", "20000").load(f"{tmp_path}/*.tar")
    assert rows.rdd.getNumPartitions() > 8
    found = {r["key"]: r for r in rows.collect()}
    assert len(found) == 61 == rows.count() and all(bytes(found[f"{k:03}"]["jpg"]) == bytes([k]) * 3000 and found[f"{k:03}"]["json"] == "{}" for k in range(60))


def test_arrow_by_usage_is_written_whole_or_not_at_all(spark, tmp_path):
    df = spark.range(90).select(F.col("id").cast("string").alias("id"), F.element_at(F.array(*map(F.lit, formats.USAGES)), (F.col("id") % 3 + 1).cast("int")).alias("usage"), F.lit("票").alias("text")).repartition(4)
    writers.by_usage(df, f"{tmp_path}/u", "id")
    assert sorted(os.listdir(f"{tmp_path}/u")) == ["test", "train", "validation"]
    for k, usage in enumerate(formats.USAGES):
        rows = readers.arrow_files(spark, f"{tmp_path}/u/{usage}", schema=None).collect()
        assert sorted(int(r["id"]) for r in rows) == list(range(k, 90, 3)) and {r["text"] for r in rows} == {"票"}
    with pytest.raises(ValueError, match="repeated key"):
        writers.by_usage(df.union(df.limit(1)), f"{tmp_path}/v", "id")
    with pytest.raises(Exception, match="unknown usage"):
        writers.by_usage(df.withColumn("usage", F.when(F.col("id") == "77", "dev").otherwise(F.col("usage"))), f"{tmp_path}/w", "id")
    assert not os.path.exists(f"{tmp_path}/w") or os.listdir(f"{tmp_path}/w") == []
