"""Documents with every odd case, and columns whose names clash with those the operators add."""

from pyspark.sql import functions as F

CLASH = "text_ string, severity string, removed_spans string, dropped_lines int, key_id int, host_key string, mix_position bigint, mix_row int, component string, score string, grade string, toxic string, p_toxic string, d1 int, host_digests int, mix_source_key string, mix_block int, range_pid int"
LONG = "word " * 60_000

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    line = "This line has quite a few words in it so that it counts as a passage of its own here and now, friends."
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, LONG), (5, line), (5, line), (6, line + "\n" + line), (7, "a b c d e f"), (8, "a b c d e f"), (None, "a b c d e f"), (None, None), (9, "é ü 漢字 👍🏽 x y z"), (10, "one\n\ntwo\r\n|three|\n")]
    return [(i, t, "en" if k % 2 else None, (None, "s", "s", "t")[k % 4], len(t) if t else None) for k, (i, t) in enumerate(rows)]


def odd(spark, clash: bool = True):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    if not clash:
        return df
    for field in CLASH.split(","):
        name, kind = field.split()
        df = df.withColumn(name, F.lit(1).cast(kind))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
