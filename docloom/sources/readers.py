"""Readers: thin wrappers over spark.read, and archive members by Arrow."""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import suffix
from . import formats
from .files import opened

BOX = "struct<transcription:string,points:array<array<double>>,score:double,difficult:string>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The fields of schema from one JSON object a line, and ``raw``: the line itself where it cannot be read."""
    parsed = F.from_json("value", f"{schema}, bad_ string", {"columnNameOfCorruptRecord": "bad_", "mode": "PERMISSIVE"})
    rows = spark.read.text(path).filter(F.btrim("value") != "").select(parsed.alias("r"))
    return rows.select("r.*").withColumnRenamed("bad_", "raw")


def json_file(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON value."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def label_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, file_id, boxes_json) of label lines; a line without exactly two parts raises, or is left out."""
    parts = F.split(F.btrim("value", F.lit(" \t\r\n")), "\t")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), parts.alias("parts"))
    two = F.size("parts") == 2
    if not strict:
        rows = rows.filter(two)
    checked = F.when(two, F.col("parts")[0]).otherwise(F.raise_error("a label line has two parts").cast("string"))
    return rows.select("path", checked.alias("file_id"), F.get("parts", F.lit(1)).alias("boxes_json"))


def boxes(boxes_json: Column) -> Column:
    return F.from_json(boxes_json, f"array<{BOX}>")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


def first_lines(spark: SparkSession, path: str, last: int = 11) -> DataFrame:
    """(line_no, line) of a file's trimmed lines up to number `last`, counted from 0."""
    lines = F.slice(F.split("value", "\n"), 1, last + 1)
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("line_no", "line")).select("line_no", F.btrim("line", F.lit(" \t\r")).alias("line"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.btrim("value").alias("line"))


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """A training dataset by its suffix: .arrow (IPC), .parquet or .jsonl."""
    if path.endswith(".arrow"):
        return arrow_files(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    raise ValueError(f"not a dataset: {path}")


def arrow_files(spark: SparkSession, path: str, schema: str | None = "id string, image string, angle float, ground_truth string") -> DataFrame:
    """Rows of Arrow IPC files or streams, a record batch a task; of files only the columns of schema are read."""
    formats.register(spark)
    reader = spark.read.format("arrow_ipc")
    return (reader.schema(schema) if schema else reader).load(path)


class _Plain(pickle.Unpickler):
    """Reads plain values only: nothing that names a class or function is loaded."""

    def find_class(self, module: str, name: str) -> object:
        raise pickle.UnpicklingError(f"not a plain value: {module}.{name}")


def pickled_dicts(spark: SparkSession, path: str) -> DataFrame:
    """(name, fields) of pickled dicts of dicts of text. Anything but plain values is refused."""
    import json

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                held = _Plain(io.BytesIO(data.as_py())).load()
                yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in held]), pa.array([json.dumps(v, ensure_ascii=False) for v in held.values()])], ["name", "fields"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(each, "name string, fields string")


def web_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(shard, key, json, jpg) of tar shards: neighbouring members of one key are one sample; large shards go to several tasks."""
    formats.register(spark)
    return spark.read.format("tar_samples").load(path)


def files(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, length, modified) of all files below root, by lower-case suffix; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), "length", F.col("modificationTime").alias("modified"))
    return found.filter(suffix(F.col("path")).isin([s.lower() for s in suffixes])) if suffixes else found


def discovered(listing: DataFrame, path: str = "path") -> DataFrame:
    """Label files <root>/<usage>/<type>/Label.txt with their usage and type."""
    parts = F.split(F.col(path), "/")
    usage, kind = F.try_element_at(parts, F.lit(-3)), F.try_element_at(parts, F.lit(-2))
    return listing.filter((F.element_at(parts, -1) == "Label.txt") & usage.isin("train", "validation", "test")).withColumns({"usage": usage, "type": kind})


def scene_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, line_no, line) of the lines of scene text files, which are read whole, one for each image."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
    rows = spark.read.text(path, wholetext=True).select(name.alias("file_id"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    return rows.filter(F.btrim("line") != "")


def scene_boxes(lines: DataFrame, file_id: str = "file_id", line: str = "line", order: str = "line_no") -> DataFrame:
    """(file_id, boxes) from lines of eight numbers and a text, in the order of their numbers; ignore marks go, the score
    is 0.99, what follows a further comma is lost; a file without boxes has an empty array."""
    p = F.split(F.col(line), ",")
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array(F.try_element_at(p, k * 2 + 1).try_cast("double"), F.try_element_at(p, k * 2 + 2).try_cast("double")))
    box = F.struct(F.try_element_at(p, F.lit(9)).alias("transcription"), points.alias("points"), F.lit(0.99).alias("score"), F.lit("false").alias("difficult"))
    good = (F.size(p) >= 9) & (F.try_element_at(p, F.lit(9)) != "###")
    held = F.array_sort(F.collect_list(F.when(good, F.struct(F.col(order).alias("at"), box.alias("box")))))
    return lines.groupBy(file_id).agg(F.transform(held, lambda x: x["box"]).alias("boxes"))


def processed(spark: SparkSession, path: str) -> DataFrame:
    """The first columns of an earlier output's lines."""
    return spark.read.text(path).select(F.split("value", "\t")[0].alias("file_id")).distinct()


def tokenizer_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(id, token, score) of model.vocab pairs in a tokenizer.json."""
    raw = spark.read.text(path, wholetext=True)
    pairs = F.from_json(F.get_json_object("value", "$.model.vocab"), "array<array<string>>")
    return raw.select(F.posexplode(pairs).alias("id", "p")).select("id", F.col("p")[0].alias("token"), F.col("p")[1].cast("double").alias("score"))


def added_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, token) of added_tokens in a tokenizer.json."""
    raw = spark.read.text(path, wholetext=True)
    found = F.from_json(F.get_json_object("value", "$.added_tokens"), "array<struct<id:bigint,content:string>>")
    return raw.select(F.inline(found)).select("id", F.col("content").alias("token"))


def rank_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, rank) of lines with a base64 token and its rank."""
    p = F.split("value", " ")
    return spark.read.text(path).filter(F.col("value") != "").select(F.unbase64(p[0]).alias("token"), p[1].cast("bigint").alias("rank"))


def decoded_image(data: bytes, chw: bool = False, bgr: bool = False, size: tuple[int, int] | None = None, angle: float | None = None) -> tuple[int, int, bytes] | None:
    """(width, height, pixels) of an image file as RGB bytes, resized, then turned by angle; None if it cannot be read."""
    import numpy as np
    from PIL import Image

    try:
        image = Image.open(io.BytesIO(data)).convert("RGB")
    except (OSError, ValueError, Image.DecompressionBombError):
        return None
    image = image.resize(size) if size else image
    image = image.rotate(angle, expand=True) if angle else image
    x = np.asarray(image)
    x = x[:, :, ::-1] if bgr else x
    return image.width, image.height, (x.transpose(2, 0, 1) if chw else x).tobytes()


def images(spark: SparkSession, path: str, chw: bool = False, bgr: bool = False, size: tuple[int, int] | None = None) -> DataFrame:
    """(path, width, height, pixels): decoded RGB bytes, nulls for a broken image; needs an imaging library on the workers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 16):
                part = b.slice(k, 16)
                found = [decoded_image(data.as_py(), chw, bgr, size) or (None, None, None) for data in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]], ["path", "width", "height", "pixels"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, "path string, width bigint, height bigint, pixels binary")


def pdf_pages(spark: SparkSession, path: str, high_quality: bool = False) -> DataFrame:
    """(path, page, jpeg) of PDF files, none for unreadable ones; needs a PDF library on the workers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import fitz

        zoom = 1.5 if high_quality else 1.0
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    pages = [p.get_pixmap(matrix=fitz.Matrix(zoom, zoom)).tobytes("jpeg") for p in fitz.open(stream=data.as_py(), filetype="pdf")]
                except Exception:  # an unreadable file has no pages
                    pages = []
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(pages), pa.string()), pa.array(list(range(len(pages))), pa.int32()), pa.array(pages, pa.binary())], ["path", "page", "jpeg"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(each, "path string, page int, jpeg binary")
