"""Merkle manifest of a dataset: a leaf for each row, a tree for each group of rows, a tree of the groups' roots.

A node is H, the lowercase hex SHA-256 of its children's digests as text; FAN consecutive nodes have one parent, and a last
run may be shorter. Rows are numbered in their group (range sort, counts for each partition), and their numbers cut a group into
blocks of FAN ** LEVELS rows, so that a group of any size is dealt out. Within a block a level is a step of lag and lead
windows with a fixed offset: the node of level k stands on the row whose number FAN ** k divides. Lag and lead columns by
FAN ** k and its multiples, masked by the node's slot in its run, are its siblings (beyond the last run there is no
row); a run's first child hashes them to the parent, and the last row with a node up to a row has the row's ancestor. All levels
share one shuffle and one sort. The blocks' heads are the rows of the next table, a FAN ** LEVELS-th as many, until a group
is one row; the groups' roots then climb in the same way. What stands above comes down by one join on the block's number,
for which the rows stand right already. The driver gets the size of the largest group, no rows.

Order: by group (null first, UTF-8 bytewise), row id (null first), leaf. Rows alike in all three are interchangeable. Nulls
and empty texts have leaves of their own; an empty table gives no rows; other columns are carried on where `keep` names them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cutscape.llm.common import joined_evenly, with_row_number, written

#: Children of a node; levels within a block.
FAN, LEVELS = 3, 5
BLOCK = FAN**LEVELS


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column | str) -> Column:
    """H of the values as decimals or texts, each with its number of UTF-8 bytes before it; a null is `-`."""
    told = [F.col(v).cast("string") if isinstance(v, str) else v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in told)))


def _glued(parts: list[Column]) -> Column:
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def _levels(rows: DataFrame) -> DataFrame:
    """rows (_key, _pos, _n, _node, ...) with _block, _path (siblings left and right of each ancestor within the block) and
    _top, the block's node on its first row. _n is the group's number of rows, _pos counts them from 0."""
    rows = rows.withColumn("_block", F.floor(F.col("_pos") / BLOCK).cast("long"))
    window = Window.partitionBy("_key", "_block").orderBy("_pos")
    node, entries = F.col("_node"), []
    for k in range(LEVELS):
        step = FAN**k
        slot = F.pmod(F.floor(F.col("_pos") / step), F.lit(FAN))
        here, many = F.pmod("_pos", F.lit(step)) == 0, F.col("_n") > step
        rows = rows.withColumn("_level", node)
        near = {j: F.when(slot + j >= 0, F.when(slot + j < FAN, F.lag("_level", -j * step).over(window) if j < 0 else F.lead("_level", j * step).over(window))) for j in range(1 - FAN, FAN) if j}
        rows = rows.select("*", _glued([near[j] for j in range(1 - FAN, 0)]).alias("_left"), _glued([near[j] for j in range(1, FAN)]).alias("_right"))
        entry, parent = F.when(here & many, F.struct(F.col("_left").alias("l"), F.col("_right").alias("r"))), digest(F.concat("_level", "_right"))
        first = F.pmod("_pos", F.lit(step * FAN)) == 0
        rows = rows.select(*(c for c in rows.columns if c not in ("_level", "_left", "_right", "_node")), entry.alias(f"_entry{k}"), F.when(many, F.when(first, parent)).otherwise(F.col("_level")).alias("_node"))
        node, entries = F.col("_node"), [*entries, f"_entry{k}"]
    above = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.filter(F.array(*(F.last(e, ignorenulls=True).over(above) if k else F.col(e) for k, e in enumerate(entries))), lambda x: x.isNotNull())
    return rows.withColumn("_path", path).withColumnRenamed("_node", "_top").drop(*entries)


def _climbed(rows: DataFrame, most: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with _path up to the root that finish() knows of, and finish()'s other columns. most: rows of the largest group.

    finish() gets a row (_key, _pos, _n, _node) for each group, and returns it with _path.
    """
    low = _levels(rows)
    heads = low.filter(F.pmod("_pos", F.lit(BLOCK)) == 0).select("_key", F.col("_block").alias("_pos"), F.ceil(F.col("_n") / BLOCK).cast("long").alias("_n"), F.col("_top").alias("_node"))
    heads = written(heads, "heads")
    above = _climbed(heads, -(-most // BLOCK), finish) if most > BLOCK else finish(heads)
    told = [c for c in above.columns if c not in ("_key", "_pos", "_n", "_node", "_path")]
    above = above.select("_key", F.col("_pos").alias("_block"), F.col("_path").alias("_above"), *told)
    joined = low.join(above, ["_key", "_block"])
    return joined.select(*(c for c in rows.columns if c != "_node"), F.concat("_path", "_above").alias("_path"), *told)


def _rooted(subroots: DataFrame) -> DataFrame:
    """Of the groups' roots (_key, _pos, _n, _node): with subroot, root and the _path from one to the other."""
    rows = written(with_row_number(subroots.select("_key", F.col("_node").alias("subroot")), ["_key"]), "subroots")
    n = rows.count()
    tree = rows.select(F.col("_key").alias("_group"), "subroot", F.lit("").alias("_key"), F.col("row_no").alias("_pos"), F.lit(n).cast("long").alias("_n"), F.col("subroot").alias("_node"))
    top = _climbed(tree, n, lambda one: one.withColumn("root", F.col("_node")).withColumn("_path", F.array().cast("array<struct<l:string,r:string>>")))
    up = top.select(F.col("_group").alias("_key"), "subroot", "root", "_path")
    return subroots.join(up, "_key")


def manifest(leaves: DataFrame, group: str, id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(group, id, leaf, keep..., subroot, root, path) of leaves (group, id, leaf, keep...).

    path: for each level from the leaf to the root of all, the digests left (l) and right (r) of the row's ancestor in its
    run, glued together.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    rows = leaves.select(key.alias("_key"), F.col(id).alias("_id"), F.col("leaf").alias("_node"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    placed = with_row_number(written(rows, "leaves"), ["_key", "_id", "_node"])
    groups = written(placed.groupBy("_key").agg(F.min("row_no").alias("_first"), F.count("*").alias("_n"), F.count("*").alias("_rows")), "groups")
    size = groups.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("most"), F.coalesce(F.sum("_n"), F.lit(0)).alias("all")).first()
    placed = joined_evenly(placed, groups, ["_key"], "_rows", size["all"])
    placed = placed.withColumn("_pos", F.col("row_no") - F.col("_first")).withColumn("_leaf", F.col("_node")).drop("row_no", "_first")
    whole = _climbed(written(placed, "placed"), size["most"], _rooted)
    back = F.when(F.col("_key") != "", F.expr("substring(_key, 2)"))
    return whole.select(back.alias(group), F.col("_id").alias(id), F.col("_leaf").alias("leaf"), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), "subroot", "root", F.col("_path").alias("path"))


def folded(shown: Column, path: Column) -> Column:
    """The root that a leaf gives with a path's siblings."""
    return F.aggregate(path, shown, lambda node, s: digest(F.concat(s["l"], node, s["r"])))


def proof_digest(path: Column) -> Column:
    """H of all siblings of a path, from the leaf up, each level left to right."""
    return digest(F.concat_ws("", F.transform(path, lambda s: F.concat(s["l"], s["r"]))))


def differing(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """(group, old, new): the groups of two manifests whose subroots differ, null where one has no such group."""
    one = lambda m, name: m.groupBy(group).agg(F.first("subroot").alias(name))
    x, y = one(old, "old"), one(new, "new").withColumnRenamed(group, "_group")
    both = x.join(y, x[group].eqNullSafe(y["_group"]), "full")
    return both.filter(~F.col("old").eqNullSafe(F.col("new"))).select(F.coalesce(group, "_group").alias(group), "old", "new")
