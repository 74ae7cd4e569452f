"""Record projections and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Names of the usages in metadata records, and of the metadata fields.
USAGES = {"test": "测试集", "validation": "验证集", "train": "训练集"}
METADATA = {"source": "数据来源", "usage": "数据用途", "image_path": "图片路径", "extraction": "抽取结果", "ocr_text": "OCR文本", "ocr_boxes": "OCR坐标", "ocr_score": "OCR分数"}
IGNORED = "###"


def without_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the named columns, those that it has."""
    return df.drop(*names)


def selected(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*names)


def metadata(df: DataFrame, source: str, chinese: bool = False, **columns: Column) -> DataFrame:
    """Unified metadata records; columns not given are empty text."""
    values = {k: columns.get(k, F.lit(source) if k == "source" else F.lit("")) for k in METADATA}
    return df.select(*[v.alias(METADATA[k] if chinese else k) for k, v in values.items()])


def usage_label(usage: Column) -> Column:
    """The usage's name; an unknown one raises an error."""
    known = reduce(lambda acc, kv: acc.when(usage == kv[0], F.lit(kv[1])), USAGES.items(), F.when(F.lit(False), F.lit("")))
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown usage: "), usage)).cast("string"))


def existing(df: DataFrame, files: DataFrame, path: str, file: str = "path") -> DataFrame:
    """Rows whose path is among files: a semi join, which takes the listing once and never asks the file system by row."""
    return df.join(files.select(F.col(file).alias("file_")).distinct(), F.col(path) == F.col("file_"), "left_semi")


def marked(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text is not the ignore mark."""
    return df.filter(F.col(text) != IGNORED)


def pruned_boxes(boxes: Column) -> Column:
    """Boxes as their text and two opposite points."""
    return F.transform(boxes, lambda b: F.struct(b["transcription"].alias("transcription"), F.array(b["points"][0], b["points"][2]).alias("points")))


def document_keys(df: DataFrame, doc: str) -> DataFrame:
    """The distinct keys of JSON objects."""
    return df.select(F.explode(F.json_object_keys(doc)).alias("key")).distinct()


def key_ids(special: DataFrame, token: str, order: str) -> DataFrame:
    """(key, key_id) of opening key tokens <s_key>, in order; ending and self-closing tokens are left out."""
    from .splits import numbered

    kept = special.filter(~F.col(token).startswith("</") & ~F.col(token).endswith("/>"))
    rows = numbered(kept, [order], out="number_")
    return rows.select(F.replace(F.replace(F.col(token), F.lit("<s_"), F.lit("")), F.lit(">"), F.lit("")).alias("key"), F.col("number_").cast("int").alias("key_id"))


def quarantined(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and bad rows: complementary filters of one condition, where unknown counts as bad."""
    known = F.coalesce(bad, F.lit(True))
    return df.filter(~known), df.filter(known)


def wrapped_truth(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text_sequence")))


def as_page(file_id: Column, boxes_json: Column) -> Column:
    """struct(file_id, bboxes) from the JSON array of a label line."""
    box = "array<struct<transcription:string,points:array<array<double>>,score:double,difficult:string>>"
    return F.struct(file_id.alias("file_id"), F.from_json(boxes_json, box).alias("bboxes"))


def entity(label: Column, start: Column, end: Column, boxes: Column) -> Column:
    """An entity as a named struct; only its first box is used."""
    first = boxes[0]
    return F.struct(label.alias("label"), F.array(start, end).alias("span"), F.struct(*[first[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))]).alias("box"))


def all_empty(nested: Column) -> Column:
    """Whether every inner array is empty."""
    return ~F.exists(nested, lambda x: F.size(x) > 0)


def labelled(df: DataFrame, query: str, response: Column, image: Column) -> DataFrame:
    """Fine-tuning rows: a constant query, the response and the image in an array."""
    return df.select(F.lit(query).alias("query"), response.alias("response"), F.array(image).alias("image_path"))


def training_records(df: DataFrame, id_: Column, image: Column, angle: Column, truth: Column) -> DataFrame:
    """(id, image, angle, ground_truth); a missing angle is 0."""
    return df.select(id_.cast("string").alias("id"), image.alias("image"), F.coalesce(angle.cast("float"), F.lit(0.0).cast("float")).alias("angle"), truth.alias("ground_truth"))


def mixed_tasks(tasks: dict[str, DataFrame]) -> DataFrame:
    """All tasks' records with a task column, columns by name; those that a task lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("task", F.lit(name)) for name, df in tasks.items()])


def rename_plan(files: DataFrame, path: str, prefix: str, start: int = 100) -> DataFrame:
    """(src, dst) of files numbered from start in the order of their paths; carrying it out is not the engine's."""
    from .splits import numbered

    files = numbered(files.select(path), [path], out="number_")
    n = F.col("number_") + start
    folder = F.regexp_replace(F.col(path), r"[^/]*$", "")
    return files.select(F.col(path).alias("src"), F.concat(folder, F.lit(prefix), n.cast("string"), F.regexp_extract(F.col(path), r"\.[^./]*$", 0)).alias("dst"))


#: Preprocessing functions by dataset name, for df.transform.
PREPROCESS: dict[str, object] = {}


def preprocess(name: str):
    """Registers a DataFrame -> DataFrame function under a dataset's name."""

    def put(function):
        PREPROCESS[name] = function
        return function

    return put
