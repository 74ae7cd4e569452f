"""Token tables: positions and features of rows in the order of their sequences, which may be of any length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import scan


def shared_positions(df: DataFrame, by: str, at: str, kind: str, vision: int = 1, out: str = "position_id") -> DataFrame:
    """Position ids where the inner tokens of a vision run share one: its first and last count as language."""
    rows = scan.scanned(scan.ordered(df, [by], [at]), [by], [scan.Neighbour("before_", F.col(kind), -1), scan.Neighbour("after_", F.col(kind), 1)])
    inner = F.coalesce((F.col(kind) == vision) & (F.col("before_") == vision) & (F.col("after_") == vision), F.lit(False))
    rows = scan.scanned(rows.withColumn("inner_", inner), [by], [scan.Neighbour("inside_", F.col("inner_"), -1)])
    step = F.when(F.col("inner_") & F.coalesce("inside_", F.lit(False)), F.lit(0)).otherwise(F.lit(1))
    rows = scan.scanned(rows.withColumn("step_", step), [by], [scan.Total("steps_", "sum", F.col("step_"))])
    return scan.closed(rows.withColumn(out, F.col("steps_") - 1).drop("before_", "after_", "inner_", "inside_", "step_", "steps_"))


def scattered(df: DataFrame, by: str, at: str, is_placeholder: Column, token: str, features: DataFrame, ordinal: str, feature: str, out: str) -> DataFrame:
    """The k-th placeholder of each `by` takes the k-th feature; surplus features are left out, others keep the token."""
    marked = scan.scanned(scan.ordered(df.withColumn("place_", is_placeholder), [by], [at]), [by], [scan.Total("k_", "sum", F.col("place_").cast("int"))])
    met = scan.closed(marked.withColumn("k_", F.when(F.col("place_"), F.col("k_"))))
    right = features.select(F.col(by).alias("by_"), F.col(ordinal).alias("ordinal_"), F.col(feature).alias("feature_"))
    return met.join(right, (met[by] == right["by_"]) & (met["k_"] == right["ordinal_"]), "left").select(*df.columns, F.coalesce("feature_", met[token]).alias(out))
