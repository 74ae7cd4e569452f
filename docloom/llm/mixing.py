"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

A source's rows form blocks of ``BLOCK_ROWS``. In the fluid ideal all sources that still have blocks advance together,
each at its weight; block j of source i (weight a_i, n_i blocks) starts when sum over k of min(a_k * j / a_i, n_k) blocks
have gone out, and ends when that holds for j + 1. The floor of the start is the block's release, the ceiling of the end
its deadline, all in exact integers. Earliest deadline first among released blocks, one block a slot, keeps every block
inside its window, so no source is ever a whole block ahead of or behind the ideal. While all sources last the ideal is
the target weights; when one runs out the others go on in proportion, so every row comes out exactly once.

Weights are whole numbers, so the ideal parts into rounds: in round r source i has blocks r * a_i to (r + 1) * a_i, and
at its end no block is under way. Rounds are scheduled on their own, and rounds of the same blocks alike. Only rounds in
which a source ends differ, so what is scheduled are at most two rounds a source, whatever the number of rows; each
is folded in a task of its own. Rows get their number within the source from a range partitioning (a hot source spans
many partitions) and the counts of the partitions before, never from one sorted group, and find their block's place
from round and plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import distinct_name, scratch, staged

BLOCK_ROWS = 16
#: Blocks of a round by the default weights, more if there are more sources than that.
ROUND = 256
#: Slots folded into one array at a time.
SEGMENT = 256
#: Rows of a plan that is broadcast at most.
FEW = 200_000


def numbered(rows: DataFrame) -> DataFrame:
    """rows (row, key, o1, o2) as (row, key, number): the number (from 0) within the key, by o1 and o2."""
    dealt = rows.repartitionByRange("key", "o1", "o2").sortWithinPartitions("key", "o1", "o2")
    dealt = staged(dealt.select("row", "key", F.spark_partition_id().alias("pid"), (F.monotonically_increasing_id() % (1 << 33)).alias("place")))
    parts = dealt.groupBy("pid", "key").agg(F.min("place").alias("first_place"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("pid")) - F.col("n")
    starts = staged(parts.select(F.col("pid").alias("p"), F.col("key").alias("k"), (before - F.col("first_place")).alias("shift")))
    return dealt.join(starts, (F.col("pid") == F.col("p")) & F.col("key").eqNullSafe(F.col("k"))).select("row", "key", (F.col("place") + F.col("shift")).alias("number"))


def whole(a: Column, b: Column) -> Column:
    """a divided by b, rounded down, in whole numbers."""
    return F.call_function("div", a, b)


def shares(q: Column, blocks: int) -> Column:
    """Whole shares of a round of about so many blocks for weights q, one at least."""
    total = F.sum(q).over(Window.partitionBy(F.lit(0)))
    return F.greatest(F.lit(1).cast("bigint"), whole(q * (2 * blocks) + total, 2 * total))


def phases(sources: DataFrame) -> DataFrame:
    """(phase, first, rounds) and each source's last phase: (s, last_phase), from sources (s, a, n).

    Runs of equal rounds have even numbers, the rounds in which a source ends odd ones.
    """
    ends = sources.select(whole(F.col("n") - 1, F.col("a")).alias("end")).distinct()
    by = Window.orderBy("end")  # one row for each round in which a source ends
    told = ends.select("end", (F.row_number().over(by) - 1).alias("k"), (F.coalesce(F.lag("end").over(by), F.lit(-1)) + 1).alias("from"))
    runs = F.array(F.struct((2 * F.col("k")).alias("phase"), F.col("from").alias("first"), (F.col("end") - F.col("from")).alias("rounds")), F.struct((2 * F.col("k") + 1).alias("phase"), F.col("end").alias("first"), F.lit(1).cast("bigint").alias("rounds")))
    return told.select("end", F.inline(runs)).filter("rounds > 0")


def windows(sources: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(phase, first, rounds, s, a, j, rows, release, deadline) of every block of one round of each phase.

    sources: s (number), a (share), n (blocks), rows. Slots count from the round's start.
    """
    known = staged(phases(sources))
    last = known.filter("phase % 2 = 1").select(F.col("end").alias("e"), F.col("phase").alias("last_phase"))
    own = sources.join(last, whole(F.col("n") - 1, F.col("a")) == F.col("e")).select("s", "a", "n", "rows", F.explode(F.sequence(F.lit(0), "last_phase")).alias("phase"))
    own = own.join(known.drop("end"), "phase").withColumn("c", F.least("a", F.col("n") - F.col("first") * F.col("a")))
    # sources that last the round advance by their share; those that end in it are folded over, once for each block of the round
    partial = F.when(F.col("c") < F.col("a"), F.struct("a", "c"))
    rounds = own.groupBy("phase").agg(F.sum(F.when(F.col("c") == F.col("a"), F.col("a")).otherwise(0)).alias("full"), F.collect_list(partial).alias("partial"))
    blocks = own.join(rounds, "phase").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c") - 1)).alias("j"))
    gone = lambda j: F.aggregate("partial", F.col("full") * j, lambda acc, k: acc + F.least(k["a"] * j, k["c"] * F.col("a")))
    start, end, a = gone(F.col("j")), gone(F.col("j") + 1), F.col("a")
    held = F.least(F.lit(block_rows).cast("bigint"), F.col("rows") - (F.col("first") * a + F.col("j")) * block_rows)
    return blocks.select("phase", "first", "rounds", "s", "a", "j", held.alias("rows"), whole(start, a).alias("release"), whole(end + a - 1, a).alias("deadline"))


_FOLD = f"""
aggregate(
  sequence(0, cast((slots - 1) div {SEGMENT} as int)),
  named_struct('pending', slice(array(at[0].came[0]), 1, 0), 'out', slice(array(array(at[0].came[0])), 1, 0)),
  (done, seg) -> aggregate(
    array(aggregate(
      slice(at, seg * {SEGMENT} + 1, {SEGMENT}),
      named_struct('pending', done.pending, 'out', slice(array(at[0].came[0]), 1, 0)),
      (a, slot) -> aggregate(
        array(concat(a.pending, slot.came)),
        a,
        (b, all) -> named_struct('pending', array_remove(all, array_min(all)), 'out', concat(b.out, array(array_min(all))))
      )
    )),
    done,
    (d, e) -> named_struct('pending', e.pending, 'out', concat(d.out, array(e.out)))
  )
).out
"""


def schedule(blocks: DataFrame) -> DataFrame:
    """(phase, first, rounds, s, a, j, release, deadline, slot, first_row, slots, round_rows): earliest deadline first
    among released blocks of a round, one a slot.

    Ties go to the source of the smaller number. first_row counts the rows of the slots before.
    """
    came = blocks.groupBy("phase", "release").agg(F.collect_list(F.struct("deadline", "s", "j", "release", "rows", "a")).alias("came"))
    rounds = blocks.groupBy("phase", "first", "rounds").agg(F.count(F.lit(1)).alias("slots"))
    every = rounds.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("release"))
    none = F.expr("cast(array() as array<struct<deadline bigint, s int, j bigint, release bigint, rows bigint, a bigint>>)")
    at = every.join(came, ["phase", "release"], "left").select("phase", "first", "rounds", "slots", F.col("release").alias("t"), F.coalesce("came", none).alias("came"))
    one = at.groupBy("phase", "first", "rounds", "slots").agg(F.sort_array(F.collect_list(F.struct("t", "came"))).alias("at"))
    order = one.select("phase", "first", "rounds", "slots", F.posexplode(F.flatten(F.expr(_FOLD))).alias("slot", "b")).select("phase", "first", "rounds", "slots", F.col("slot").cast("bigint").alias("slot"), "b.*")
    before = Window.partitionBy("phase").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return order.select("*", (F.sum("rows").over(before) - F.col("rows")).alias("first_row"), F.sum("rows").over(Window.partitionBy("phase")).alias("round_rows"))


def planned(sources: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(s, j, first, upto, slots, round_rows, slot, release, deadline, row): the plan of the rounds from first to below
    upto. slot, release, deadline and row (the first one of the block) are those of round first; slots and round_rows
    lie between one round and the next."""
    told = staged(schedule(windows(sources, block_rows)))
    by = Window.orderBy("phase")  # a row for each phase, two a source at most
    runs = told.select("phase", "rounds", "slots", "round_rows").distinct()
    runs = runs.select(F.col("phase").alias("p"), (F.sum(F.col("rounds") * F.col("slots")).over(by) - F.col("rounds") * F.col("slots")).alias("slot0"), (F.sum(F.col("rounds") * F.col("round_rows")).over(by) - F.col("rounds") * F.col("round_rows")).alias("row0"))
    met = told.join(runs, F.col("phase") == F.col("p"))
    moved = [(F.col(c) + F.col("slot0")).alias(c) for c in ("slot", "release", "deadline")]
    return met.select("s", "j", "first", (F.col("first") + F.col("rounds")).alias("upto"), "slots", "round_rows", *moved, (F.col("first_row") + F.col("row0")).alias("row0"))


def mixed(df: DataFrame, source_col: str = "source", id_col: str = "doc_id", weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, prefix: str = "mix_") -> DataFrame:
    """df and {prefix}block, _release, _deadline, _slot, _position (bigint): the row's place in the mixture, from 0.

    weights: whole numbers above 0 by source (1 if not named), taken as they are; a round has their sum of blocks, so
    they should be small. None: shares of a round of about ``ROUND`` blocks that go with the square root of the
    source's rows, which lifts small sources; one block at least. Inside a source the order is that of md5(id) and then
    id. A null source is a source of its own, the first; null ids come first in their source. Repeated rows each get a
    place. An empty table gives no rows. Columns of df that have the name of a new one make the new one end in an
    underscore.
    """
    # the row travels as one struct, so none of its names can meet those used here
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(source_col).cast("string").alias("key"), F.md5(F.col(id_col).cast("string")).alias("o1"), F.col(id_col).alias("o2"))
    found = numbered(rows)
    with scratch(df.sparkSession) as keep:
        counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
        if weights is None:
            a = shares(F.ceil(F.sqrt(F.col("rows").cast("double")) * 100).cast("bigint"), ROUND)
        else:
            a = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("key")], F.lit(1)) if weights else F.lit(1)
        n = F.ceil(F.col("rows") / block_rows).cast("bigint")
        sources = staged(counts.select("key", "rows", n.alias("n"), a.cast("bigint").alias("a"), (F.row_number().over(Window.orderBy(F.col("key").asc_nulls_first())) - 1).cast("int").alias("s")))
        plan = staged(planned(sources, block_rows).join(sources.select("s", "key", "a"), "s"))
        keep(sources, plan)
    few = lambda t: F.broadcast(t) if t.count() <= FEW else t
    number = F.col("number")
    met = found.join(few(sources.select(F.col("key").alias("own"), F.col("a").alias("share"))), F.col("key").eqNullSafe(F.col("own")))
    met = met.select("row", "key", number, whole(number, F.lit(block_rows).cast("bigint")).alias("b"), "share")
    met = met.select("*", whole(F.col("b"), F.col("share")).alias("round"), (F.col("b") % F.col("share")).alias("at"))
    plan = plan.withColumnRenamed("key", "plan_key")
    met = met.join(few(plan), F.col("key").eqNullSafe(F.col("plan_key")) & (F.col("at") == F.col("j")) & (F.col("round") >= F.col("first")) & (F.col("round") < F.col("upto")))
    later = F.col("round") - F.col("first")
    slots = {c: F.col(c) + later * F.col("slots") for c in ("release", "deadline", "slot")}
    new = {"block": F.col("b"), **slots, "position": F.col("row0") + later * F.col("round_rows") + number % block_rows}
    return met.select("row.*", *[v.cast("bigint").alias(distinct_name(df, prefix + k)) for k, v in new.items()])
