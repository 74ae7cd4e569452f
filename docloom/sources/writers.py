"""Writers: JSON lines, CSV, label files, split Parquet, bucketed binaries, vocabulary lists."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import formats
from .files import opened

USAGES = ("train", "validation", "test")
#: Rows of a table that json_text takes.
MOST = 100_000


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line; null fields are written."""
    df.write.option("ignoreNullFields", False).json(path)


def json_text(df: DataFrame, indent: int = 2, most: int = MOST) -> str:
    """A table of at most `most` rows as one pretty JSON array; a larger one raises an error (json_array writes it)."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    return json.dumps([json.loads(x) for x in rows], ensure_ascii=False, indent=indent)


def json_array(df: DataFrame, path: str) -> None:
    """A table of any size as one JSON array in one file below path, an object a line.

    One file needs one task; it passes rows through and holds a batch of them.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for b in batches:
            lines = [f"{',' if k else lead}{x}" for k, x in enumerate(b.column(0).drop_null().to_pylist())]
            lead = "," if lines else lead
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], ["value"])

    objects = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    none = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # the task runs for an empty table too
    objects.unionByName(none).repartition(1).mapInArrow(each, "value string").write.text(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').csv(path)


def metric_csv(metric: DataFrame, path: str) -> None:
    """A metric table as one CSV file, fields in their order."""
    metric.orderBy("field_order", "field").drop("field_order").coalesce(1).write.option("header", True).csv(path)


_SHEET = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
}


def metric_xlsx(metric: DataFrame, path: str, most: int = MOST) -> None:
    """A metric table of at most `most` fields as an Excel workbook, fields in their order."""
    rows = metric.orderBy("field_order", "field").drop("field_order").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} fields")

    def cell(v: object) -> str:
        if isinstance(v, (int, float)) and v == v:
            return f"<c><v>{v}</v></c>"
        return "<c/>" if v is None or v != v else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    names = [c for c in metric.columns if c != "field_order"]
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [names, *rows])
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in _SHEET.items():
            out.writestr(name, head + text)
        out.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{sheet}</sheetData></worksheet>')
    system, at = opened(path)
    with system.open_output_stream(at) as out:
        out.write(held.getvalue())


def by_usage(df: DataFrame, path: str, key: str, usage: str = "usage") -> None:
    """Arrow IPC files below train, validation and test; an unknown usage, or a key that occurs twice, raises an error.

    Nothing is left if a task fails (see formats.ArrowByUsage). readers.arrow_files reads each folder.
    """
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key).first()
    if twice is not None:
        raise ValueError(f"repeated key: {twice[0]}")
    formats.register(df.sparkSession)
    df.write.format("arrow_by_usage").option("usage", usage).mode("append").save(path)


def labels(df: DataFrame, path: str, file_id: Column, boxes_json: Column) -> None:
    """Lines of file id, tab and JSON."""
    df.select(F.concat_ws("\t", file_id, boxes_json).alias("value")).write.text(path)


def states(df: DataFrame, path: str, file: Column) -> None:
    """Lines of path, tab and 1."""
    df.select(F.concat_ws("\t", file, F.lit("1")).alias("value")).write.text(path)


def lines(df: DataFrame, path: str, column: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def statistics(df: DataFrame, path: str) -> None:
    df.write.json(path)


def bucketed_files(df: DataFrame, bucket: str, key: str, content: str, suffix: str = ".jpg") -> DataFrame:
    """(path, content) of the files to write: empty contents keep their record but no file."""
    return df.filter(F.octet_length(content) > 0).select(F.concat_ws("/", F.col(bucket), F.concat(F.col(key), F.lit(suffix))).alias("path"), F.col(content).alias("content"))


def export_files(planned: DataFrame, root: str) -> int:
    """Writes planned (path, content) rows below root, each by the task that holds it; the number of files written.

    A task that runs again writes the same files again. Only counts come to the driver.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(root)
        made: set[str] = set()
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                folder = f"{top}/{path}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return planned.select("path", "content").mapInArrow(each, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).collect()[0][0]
