"""Training batches: targets, tokenizer columns, tensors, collation and model inference over Arrow batches."""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.functions import PandasUDFType

from ..functions import codec, sequences as seq
from ..functions.text import PRE_TOKEN
from .splits import numbered

def target(truth: Column, eos: str = "</s>", sort: bool = True) -> Column:
    """Ground truth (JSON text of any depth) as tag tokens and an end mark."""
    return F.concat(codec.over_json(lambda v: codec.tags(v, sort))(truth), F.lit(eos))


class Codec:
    """Text to ids and back by a vocabulary file: tokenizer.json, a sentencepiece .model, or lines of ranks (.tiktoken).

    Rank files hold no special tokens: `special` names them with their ids, `pattern` parts texts before merging.
    """

    def __init__(self, path: str, pattern: str = PRE_TOKEN, special: dict[str, int] | None = None):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            self.encode = lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
            self.decode = own.decode_batch
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: pieces.encode(texts, num_threads=1)
            self.decode = pieces.decode
        elif path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
            merges = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
            self.encode = lambda texts: [merges.encode(t, allowed_special="all", disallowed_special=()) for t in texts]
            self.decode = lambda rows: [merges.decode(row, errors="replace") for row in rows]
        else:
            raise ValueError(f"not a vocabulary file: {path}")


def encoded(text: Column, path: str, most: int | None = None, special: dict[str, int] | None = None, pattern: str = PRE_TOKEN) -> Column:
    """Token ids by a vocabulary file (see Codec), cut to `most`; the file is read once a worker task."""

    @pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Codec(path, pattern, special)
        for texts in batches:
            yield pd.Series([x[:most] for x in own.encode(texts.fillna("").tolist())], dtype=object)

    return ids(text)


def decoded(ids: Column, path: str, special: dict[str, int] | None = None, pattern: str = PRE_TOKEN) -> Column:
    """The text of token ids; null stays null."""

    @pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Codec(path, pattern, special)
        for rows in batches:
            found = iter(own.decode([list(map(int, r)) for r in rows if r is not None]))
            yield pd.Series([None if r is None else next(found) for r in rows], dtype=object)

    return text(ids)


def right_padded(ids: Column, length: int, pad: int) -> Column:
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def preprocessed(records: DataFrame, path: str, length: int = 768, pad: int = 1, eos: str = "</s>") -> DataFrame:
    """Training records with target and labels: the target's ids, cut and padded to length."""
    with_target = records.withColumn("target", target(F.col("ground_truth"), eos))
    return with_target.withColumn("labels", right_padded(encoded(F.col("target"), path, length), length, pad))


def rotation(angle: Column) -> Column:
    """Degrees to turn an image by, null if none: 360 - angle for an angle that is neither 0 nor null."""
    return F.when(F.coalesce(angle, F.lit(0)) != 0, 360 - angle)


def uses_rotated(angle: Column, batch: Column) -> Column:
    """Whether a batch takes its rotated images: only if every one of its rows has an angle."""
    return F.min((F.coalesce(angle, F.lit(0)) != 0).cast("int")).over(Window.partitionBy(batch)) == 1


@pandas_udf(T.BinaryType())
def packed_tensor(shape: pd.Series, values: pd.Series) -> pd.Series:
    """Three int32 sizes, then float32 values."""
    return pd.Series([None if s is None or v is None else struct.pack("<3i", *map(int, s)) + np.asarray(v, "<f4").tobytes() for s, v in zip(shape, values)])


@pandas_udf(T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))]))
def unpacked_tensor(data: pd.Series) -> pd.DataFrame:
    held = [None if d is None else bytes(d) for d in data]
    return pd.DataFrame({"shape": [None if d is None else list(struct.unpack("<3i", d[:12])) for d in held], "values": [None if d is None else np.frombuffer(d[12:], "<f4").tolist() for d in held]})


def as_list(images: Column, depth: int) -> Column:
    """Images as one flat list from a single one (depth 0), a list (1) or a list of lists (2)."""
    return {0: F.array(images), 1: images, 2: F.flatten(images)}[depth]


def collated(rows: DataFrame, order: str, ids: str, size: int, pad: int, parts: str | None = None) -> DataFrame:
    """Rows with their batch number (by order, within parts) and ids, mask and positions left-padded to the batch's longest."""
    keys = [parts] if parts else []
    placed = numbered(rows, [order], keys, "batch").withColumn("batch", F.floor(F.col("batch") / size))
    placed = placed.withColumn("longest_", F.max(F.size(ids)).over(Window.partitionBy(*keys, "batch")))
    n, x = F.col("longest_"), F.col(ids)
    return placed.select(*rows.columns, "batch", seq.left_padded(x, n, pad).alias("input_ids"), seq.attention_mask(x, n).alias("attention_mask"), seq.position_ids(x, n).alias("position_ids")).drop(*([] if ids != "input_ids" else [ids]))


def multimodal_inputs(prompt: Column, answer: Column, pads: Column, bos: int, pad: int, eos: int) -> Column:
    """struct(input_ids, token_type_ids, labels): begin token, image placeholders (type 1), prompt, answer and end;
    labels cover the answer and the end."""
    image = F.array_repeat(F.lit(pad), pads.cast("int"))
    before = F.concat(F.array(F.lit(bos)), image, prompt)
    after = F.concat(answer, F.array(F.lit(eos)))
    types = F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), pads.cast("int")), F.transform(F.concat(prompt, after), lambda x: F.lit(0)))
    return F.struct(F.concat(before, after).alias("input_ids"), types.alias("token_type_ids"), F.concat(F.transform(before, lambda x: F.lit(seq.IGNORED)), after).alias("labels"))


def predicted(rows: DataFrame, make_model: Callable[[], Callable[[list[dict[str, Any]]], list[str]]], columns: list[str], out: str = "response", batch: int = 16) -> DataFrame:
    """rows with a model's answers. make_model runs once a task and gives a function of a list of rows as dicts."""

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()
        for held in batches:
            every = [json.loads(x) for x in held]
            yield pd.Series([a for k in range(0, len(every), batch) for a in model(every[k : k + batch])], dtype=object)

    return rows.withColumn(out, pandas_udf(answers, "string", PandasUDFType.SCALAR_ITER)(F.to_json(F.struct(*columns))))


def record(rows: DataFrame, key: str, value: object, encode: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of one key, encoded if asked; partition and column pruning make this a read of the file parts that may
    hold it, and nothing else is encoded."""
    found = rows.filter(F.col(key) == F.lit(value))
    return encode(found) if encode else found


def items(rows: DataFrame, path: str, length: int = 768, pad: int = 1, image: str | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """Training records as a model takes them: target and labels, and width, height and pixels of the image file's bytes
    in column `image`, turned by the record's angle."""
    out = preprocessed(rows, path, length, pad)
    if image is None:
        return out

    @pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.BinaryType())]))
    def pixels(data: pd.Series, angle: pd.Series) -> pd.DataFrame:
        from ..sources.readers import decoded_image

        found = [None if d is None else decoded_image(bytes(d), size=size, angle=None if pd.isna(a) else a) for d, a in zip(data, angle)]
        return pd.DataFrame([f or (None, None, None) for f in found], columns=["width", "height", "pixels"])

    return out.withColumn("image_", pixels(image, rotation(F.col("angle")))).select(*[c for c in out.columns if c != image], "image_.*")
