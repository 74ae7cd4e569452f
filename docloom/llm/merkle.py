"""A Merkle manifest of a dataset: one tree a group, one over the groups' roots, and a proof for every row.

Nodes are named by coordinates: group, level (0: leaves) and number. Every ``FAN`` consecutive nodes of a level have one
parent, the last run of a level being as long as it comes, until one node is left.

1. Leaves get their number within the group from ranges of keys, never from one sorted group.
2. Nodes are made ``TIER`` levels at a time: the leaves below one node of level ``TIER`` come together (``FAN ** TIER`` at
   most), and so do those nodes after them. All nodes are materialised as one table.
3. The coordinates of a node's siblings follow from its number and the size of its group. Each tier's nodes explode theirs
   and join the node table, and put what they find in order: the steps up to the next tier. As all coordinates lie under
   one node of that tier, no node of the table is asked for by more rows than it has leaves in a tier.
4. A row's steps are those of its own tier, of the tiers above and of the tree over groups. Folding its leaf through
   them gives the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.splits import numbered
from .common import scratch, staged

#: Children of a node, and levels made at a time.
FAN, TIER = 3, 4
BLOCK = FAN**TIER


def _none() -> Column:
    return F.array().cast("array<struct<before:string,after:string>>")


def field(value: Column) -> Column:
    """What stands for a value in a leaf: '-' if null, else its bytes in UTF-8, counted."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column | str) -> Column:
    return F.sha2(F.concat(*[field(F.col(v) if isinstance(v, str) else v) for v in values]), 256)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _parents(nodes: Column) -> Column:
    """The level above an array of nodes that starts at a run's start."""
    runs = F.sequence(F.lit(0), _div(F.size(nodes) - 1, FAN).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(nodes, k * FAN + 1, F.lit(FAN)), ""), 256))


def _depth(n: Column, most: int) -> Column:
    """Levels above n nodes until one is left, for n up to FAN ** most."""
    out = F.lit(most)
    for k in range(most - 1, -1, -1):
        out = F.when(n <= FAN**k, F.lit(k)).otherwise(out)
    return out


def _level_size(n: Column, level: Column) -> Column:
    """Nodes of a level of a tier above n nodes."""
    out = n
    for k in range(1, TIER):
        out = F.when(level == k, _div(n + (FAN**k - 1), FAN**k)).otherwise(out)
    return out


def tiers(leaves: DataFrame) -> tuple[DataFrame, int]:
    """(key, tier, level, number, n, digest) of every node below the roots, and the roots; and the number of tiers.

    leaves: key, number, n (leaves of the key) and digest. level counts from the tier's first, which holds n nodes.
    A root stands alone in its tier, with n 1. Each tier is a job of its own; there are log n of them.
    """
    base = staged(leaves.select("key", F.lit(0).alias("tier"), F.lit(0).alias("level"), "number", "n", "digest"))
    table, tier = base, 0
    while base.filter("n > 1").limit(1).count():
        upper = base.filter("n > 1").groupBy("key", "n", _div(F.col("number"), BLOCK).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "digest"))), lambda x: x["digest"]).alias("l0"))
        names = ["l0"]
        for k in range(1, TIER + 1):  # beyond the root of a small tree a level repeats; it is left out below
            upper = upper.withColumn(f"l{k}", _parents(F.col(names[-1])))
            names.append(f"l{k}")
        depth = _depth(F.col("n"), TIER)
        inner = [F.struct(F.lit(tier).alias("tier"), F.lit(k).alias("level"), (F.col("block") * (BLOCK // FAN**k)).alias("from"), F.col(f"l{k}").alias("nodes")) for k in range(1, TIER)]
        top = F.element_at(F.array(*names), depth + 1)
        made = upper.withColumn("depth_", depth).withColumn("up_", F.struct(F.lit(tier + 1).alias("tier"), F.lit(0).alias("level"), F.col("block").alias("from"), top.alias("nodes")))
        wanted = F.concat(F.filter(F.array(*inner), lambda x: x["level"] < F.col("depth_")), F.array(F.col("up_")))
        made = made.select("key", "n", F.explode(wanted).alias("x")).select("key", "n", "x.tier", "x.level", "x.from", F.posexplode("x.nodes").alias("at", "digest"))
        here = F.when(F.col("tier") == tier, F.col("n")).otherwise(_div(F.col("n") + (BLOCK - 1), BLOCK))
        made = staged(made.select("key", "tier", "level", (F.col("from") + F.col("at")).alias("number"), here.alias("n"), "digest"))
        table = table.unionByName(made)
        tier += 1
        base = made.filter(F.col("tier") == tier)
    return table, tier


def sibling_coordinates(number: Column, n: Column) -> Column:
    """(level, number, before) of the siblings of a node and of its ancestors below the next tier; before: left of them."""

    def one(level: int) -> Column:
        own = _div(number, FAN**level)
        size = _level_size(n, F.lit(level))
        first = _div(own, FAN) * FAN
        each = F.array(*[F.struct(F.lit(level).alias("level"), (first + k).alias("number"), (first + k < own).alias("before")) for k in range(FAN)])
        return F.filter(each, lambda x: (x["number"] != own) & (x["number"] < size) & (F.lit(level) < _depth(n, TIER)))

    return F.concat(*[one(level) for level in range(TIER)])


def tier_steps(nodes: DataFrame, table: DataFrame, tier: int) -> DataFrame:
    """(key, number, steps) of nodes (key, number, n) of a tier's first level: siblings on the way to the next tier."""
    asked = nodes.select("key", "number", F.explode(sibling_coordinates(F.col("number"), F.col("n"))).alias("c"))
    asked = asked.select("key", "number", F.col("c.level").alias("level"), F.col("c.number").alias("wanted"), F.col("c.before").alias("before"))
    held = table.filter(F.col("tier") == tier).select(F.col("key").alias("key_"), F.col("level").alias("level_"), F.col("number").alias("number_"), "digest")
    found = asked.join(held, (F.col("key") == F.col("key_")) & (F.col("level") == F.col("level_")) & (F.col("wanted") == F.col("number_")))
    by_node = found.groupBy("key", "number").agg(F.sort_array(F.collect_list(F.struct("level", "wanted", "before", "digest"))).alias("found"))
    side = lambda level, before: F.array_join(F.transform(F.filter("found", lambda x: (x["level"] == level) & (x["before"] == before)), lambda x: x["digest"]), "")
    each = F.array(*[F.struct(side(level, F.lit(True)).alias("before"), side(level, F.lit(False)).alias("after")) for level in range(TIER)])
    return by_node.select("key", "number", each.alias("steps"))


def _ends(keys: DataFrame, above: DataFrame | None) -> DataFrame:
    """(key, block, upper, subroot): what follows the roots of keys (key, block)."""
    if above is not None:
        return keys.join(above, "key", "left").select("key", "block", F.coalesce("upper", _none()).alias("upper"), "subroot")
    return keys.select("key", "block", _none().alias("upper"), F.lit(None).cast("string").alias("subroot"))


def _filled(steps: str, n: Column) -> Column:
    """A tier's steps, empty ones where a node has no siblings, as many as it has levels."""
    empty = F.struct(F.lit("").alias("before"), F.lit("").alias("after"))
    return F.slice(F.coalesce(F.col(steps), F.array_repeat(empty, TIER)), F.lit(1), _depth(n, TIER))


def _steps_up(table: DataFrame, count: int, above: DataFrame | None) -> DataFrame:
    """(key, block, upper, subroot) of the nodes over the first tier: all steps from there on, and the key's root."""
    upper: DataFrame | None = None
    for tier in range(count, 0, -1):
        nodes = table.filter((F.col("tier") == tier) & (F.col("level") == 0)).select("key", "number", "n")
        # A key whose tree ended below has its root here alone, with n 1: no steps of its own.
        found = _ends(nodes.filter("n = 1").select("key", F.col("number").alias("block")), above)
        if upper is not None:
            nodes = nodes.filter("n > 1").join(tier_steps(nodes.filter("n > 1"), table, tier), ["key", "number"], "left")
            nodes = nodes.select("key", F.col("number").alias("block"), _div(F.col("number"), BLOCK).alias("over"), _filled("steps", F.col("n")).alias("steps"))
            nodes = nodes.join(upper.withColumnRenamed("block", "over"), ["key", "over"])
            found = found.unionByName(nodes.select("key", "block", F.concat("steps", "upper").alias("upper"), "subroot"))
        upper = staged(found)
    return upper


def folded(leaf: Column, steps: Column) -> Column:
    """The digest that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof(steps: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def proved(leaves: DataFrame, table: DataFrame, count: int, above: DataFrame | None = None) -> DataFrame:
    """leaves (key, number, n and others) with their steps to the root and what above adds.

    above: (key, upper, subroot): the steps that follow a key's root, and that root.
    """
    upper = _ends(leaves.filter("n = 1").select("key", F.col("number").alias("block")), above)
    out = leaves.withColumn("block", _div(F.col("number"), BLOCK))
    if not count:
        return out.withColumn("steps", _none()).join(upper, ["key", "block"]).withColumn("steps", F.col("upper")).drop("upper", "block")
    own = tier_steps(leaves.filter("n > 1").select("key", "number", "n"), table, 0)
    own = own.select(F.col("key").alias("key_"), F.col("number").alias("number_"), "steps")
    out = out.join(own, (F.col("key") == F.col("key_")) & (F.col("number") == F.col("number_")), "left").drop("key_", "number_")
    out = out.withColumn("steps", _filled("steps", F.col("n"))).join(upper.unionByName(_steps_up(table, count, above)), ["key", "block"])
    return out.withColumn("steps", F.concat("steps", "upper")).drop("upper", "block")


def manifest(df: DataFrame, group: str, id_col: str, leaf: Column, tampered: Column) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of df.

    group: the column that names a row's tree, null being a group of its own; id_col: the order of leaves in it, nulls
    first, equal ids by their leaves. leaf: a row's digest; tampered: the digest to fold in its place, null for leaf
    itself. Groups are ordered nulls first, then by the bytes of their names. Repeated rows have leaves of their own. An
    empty table gives no rows. Other columns are not read.
    """
    name = F.col(group).cast("string")
    with scratch(df.sparkSession) as keep:
        rows = df.select(F.col(id_col).alias("id"), F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("key"), leaf.alias("digest"), tampered.alias("tampered"))
        rows = numbered(staged(rows), ["id", "digest"], ["key"], total="n")
        leaves = staged(rows.select("id", "key", "digest", "tampered", F.col("number").cast("bigint").alias("number"), F.col("n").cast("bigint").alias("n")))
        table, count = tiers(leaves)
        roots = table.filter("n = 1 AND level = 0").select("key", "digest")
        # "" (null) comes before "=...", so the keys are in the groups' order.
        roots = numbered(staged(roots).withColumnRenamed("key", "name").withColumn("key", F.lit("")), ["name"], total="n")
        roots = staged(roots.select("key", "name", "digest", F.col("number").cast("bigint").alias("number"), F.col("n").cast("bigint").alias("n")))
        over, over_count = tiers(roots)
        top = over.filter("n = 1 AND level = 0").select("digest").first()  # one digest
        above = staged(proved(roots, over, over_count).drop("subroot").select(F.col("name").alias("key"), F.col("digest").alias("subroot"), F.col("steps").alias("upper")))
        found = proved(leaves, table, count, above)
        out = found.select(
            "id", F.col("digest").alias("leaf"), "subroot", F.lit(top["digest"] if top else None).cast("string").alias("root"),
            F.sha2(proof(F.col("steps")), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "digest"), F.col("steps")).alias("folded_root"),
        )
        out = staged(out.withColumn("verified", F.col("folded_root") == F.col("root")))
        keep(out)
    return out
