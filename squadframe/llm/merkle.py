"""A Merkle manifest of a table, level by level in higher-order functions.

Rows become leaves in the order of their group and id. Leaves are put into ordered arrays of a fixed size; an array
collapses its levels by sequence, slice and transform inside one aggregate, and yields its root, and for each of its
leaves what stands beside it on the way up. The roots of the arrays are the leaves of the next round; the groups' roots
are collapsed in the same way. A few rounds do for any number of rows: each divides it by the size of an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import work_table

#: Nodes of a run that become one node, and levels that one array collapses (fan ** levels nodes).
FAN, LEVELS = 2, 9
_STEP = "struct<l string, r string>"


def field(value: Column) -> Column:
    """What stands for a value in a leaf: its length in bytes, a colon and its UTF-8 text; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a node and what stands to its left and right on each level lead to."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings on the way, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""), 256)


def ordered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds pos, the gapless place (from 0) of each row in its group by the order columns, and of, the group's rows.

    Rows are dealt out by ranges of the group and order, so no group is sorted by one task; the places come from the
    ranges' counts. The group must not be null. Rows that are equal in all of it are numbered in any order.
    """
    rows = work_table(rows, "leaves").withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie")
    dealt = work_table(dealt.drop("tie").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ordered")
    # a group's ranges, one row for each
    ranges = dealt.groupBy(group, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("of"))
    return dealt.join(shifts, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _collapse(nodes: Column, levels: Column, fan: int) -> Column:
    """All levels of an array of nodes, the nodes themselves first."""
    up = lambda last: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(last) / fan).cast("int") - 1), lambda i: F.sha2(F.array_join(F.slice(last, i * fan + 1, F.lit(fan)), ""), 256))
    steps = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda all_, _: F.concat(all_, F.array(up(F.element_at(all_, -1)))))


def _path(levels: Column, place: Column, fan: int) -> Column:
    """What stands to the left and right of the node's ancestors in their runs, for every level but the last."""

    def step(nodes: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fan)), level)).cast("int")
        start = at - at % fan
        return F.struct(F.array_join(F.slice(nodes, start + 1, at - start), "").alias("l"), F.array_join(F.slice(nodes, at + 2, start + fan - 1 - at), "").alias("r"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), lambda nodes, k: step(nodes, k))


def rise(nodes: DataFrame, group: str, keep: list[str], fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """The arrays of each round, up to one array for every group, with all their levels.

    nodes has the group (not null), pos and of (as `ordered` gives them), node, a digest, and the columns `keep`.
    """
    size = fan**levels
    last = nodes.agg(F.max("of")).first()[0] or 1  # how many rounds there are
    rounds, below = [], nodes
    names = list(dict.fromkeys(["node", *(c for c in keep if c != group)]))
    while True:
        # a lone array stops at its root; one of several goes up by all its levels
        own = F.when(F.col("of") > size, F.lit(levels)).otherwise(F.ceil(F.round(F.log(F.col("of").cast("double")) / F.log(F.lit(float(fan))), 9)).cast("int"))
        arrays = (
            below.groupBy(group, F.floor(F.col("pos") / size).alias("array"), "of").agg(F.sort_array(F.collect_list(F.struct("pos", *names))).alias("members"))
            .withColumn("levels", _collapse(F.transform("members", lambda m: m["node"]), own, fan))
        )
        rounds.append(work_table(arrays, "arrays"))
        if last <= size:
            return rounds
        last = -(-last // size)
        below = rounds[-1].select(group, F.col("array").alias("pos"), F.ceil(F.col("of") / size).alias("of"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
        names = ["node"]


def roots(rounds: list[DataFrame], group: str) -> DataFrame:
    """(group, root) of the last round."""
    return rounds[-1].select(group, F.element_at(F.element_at("levels", -1), 1).alias("root"))


def descend(rounds: list[DataFrame], known: DataFrame, group: str, keep: list[str], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """For every node of the first round the columns `keep`, those of its group in known, and path, what stands beside
    on the way up. known has a row for each group, with what stands beside above the group's root as path."""
    told = [c for c in known.columns if c not in (group, "path")]
    known = known.withColumnRenamed("path", "above").withColumn("array", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        steps = lambda m: F.concat(_path(F.col("levels"), (m["pos"] % fan**levels).cast("int"), fan), F.col("above"))
        more = [c for c in keep if c != group] if k == 0 else []
        one = F.explode(F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), steps(m).alias("path"), *[m[c].alias(c) for c in more]))).alias("x")
        found = rounds[k].join(known, [group, "array"]).select(group, *told, one).select(group, *told, "x.*")
        if k:
            # a group that ended in an earlier round has one member there, the root of its only array
            known = work_table(found.withColumnsRenamed({"pos": "array", "path": "above"}), "known")
    return found.select(*keep, *told, "path")


def manifest(docs: DataFrame, columns: list[str], group: str, id_col: str, tampered: dict[str, Column] | None = None, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Per row of docs: id_col, leaf, subroot (its group's root), root, path, and seen, the leaf of the tampered row.

    A leaf is the digest of the row's columns, in the order given. A group's leaves stand in ascending order of the id
    (nulls first; rows with equal ids by leaf) and its runs of `fan` nodes become one node until one is left; so do the
    groups' roots, in the order of the group (null first, else by UTF-8 bytes of its text). tampered gives other values
    of some columns, for seen. Null and empty texts and repeated rows are leaves like any other; one row is its own root.
    """
    values = lambda other: [other.get(c, F.col(c)) for c in columns]
    name = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null becomes the least text
    leaves = docs.select(F.col(id_col).alias("id"), name.alias("name"), leaf(*values({})).alias("node"), leaf(*values(tampered or {})).alias("seen"))
    rows = rise(ordered(leaves, "name", "id", "node"), "name", ["name", "id", "node", "seen"], fan, levels)
    subroots = ordered(roots(rows, "name").withColumnRenamed("root", "node").withColumn("whole", F.lit("")), "whole", "name")
    upper = rise(subroots, "whole", ["name", "node"], fan, levels)
    top = descend(upper, roots(upper, "whole").withColumn("path", F.array().cast(f"array<{_STEP}>")), "whole", ["name", "node"], fan, levels)
    top = work_table(top.withColumnRenamed("node", "subroot"), "top")
    found = descend(rows, top, "name", ["id", "node", "seen"], fan, levels)
    return found.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", "seen")


def verified(found: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root (from seen and the original siblings) and verified (equals root)."""
    out = found.withColumn("proof_sha256", proof(F.col("path"))).withColumn("folded_root", fold(F.col("seen"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
