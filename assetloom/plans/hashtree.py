"""Tables kept with a tree of digests, so that a comparison reads and shuffles only the ranges of keys that differ.

A key belongs to the leaf that the first bits of its hash name; a leaf's digest is made from sums over its entries' hashes
(the order of rows doesn't matter, and they combine before the shuffle), that of an inner node from its children's. Two
trees are compared from the root down; where the roots are equal, one row of each was read. A full outer join of two tables
shuffles both whole; here the new one is scanned, and of either only rows of differing leaves travel.

Below a location lie ``entries``, a folder for each commit that holds the leaves it wrote, and published snapshots (see
``snapshots``) of the tree, which names the commit of every leaf. A commit writes the leaves that differ and no others.

Entries may have a key of null (nulls are one key), and keys may repeat: then a key's rows are compared as a whole, in any
order. Columns of any name but ``__leaf`` are kept. An empty table has a root and no leaves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.sources import snapshots
from assetloom.sources.scratch import stored

#: Each node has two to this power children.
BITS = 4
TREE = "level int, node long, n long, digest string, run string, depth int"
_LANES = [f"__s{i}" for i in range(4)]


@dataclass
class Changes:
    """``rows``: (key, status) of what is to be added, changed or removed; ``leaves`` that differ; ``tree`` of the new table."""

    rows: DataFrame
    leaves: list[int]
    tree: DataFrame


def leaf_of(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - BITS * depth) if depth else F.lit(0).cast("long")


def _entries(m: DataFrame, key: str, values: Sequence[str], depth: int) -> DataFrame:
    """(leaf, key, four numbers of 32 bits that are the entry's digest)."""
    digest = F.md5(F.to_json(F.struct(F.col(key).alias("k"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])))
    m = m.select(leaf_of(key, depth).alias("__leaf"), F.col(key).alias("__key"), digest.alias("__md5"))
    return m.select("__leaf", "__key", *[F.conv(F.substring("__md5", 8 * i + 1, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(_LANES)])


def tree_of(m: DataFrame, key: str, values: Sequence[str], depth: int) -> DataFrame:
    """All nodes, level 0 being the root, from one aggregation over the table and small ones over its leaves."""
    if not 0 <= depth <= 4:
        raise ValueError("the depth of a tree is between 0 and 4")
    sums = _entries(m, key, values, depth).groupBy(F.col("__leaf").alias("node")).agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in _LANES])
    level = stored(sums.select("node", "n", F.md5(F.concat_ws(":", "n", *_LANES)).alias("digest")), "leaves")
    levels = [level.select(F.lit(depth).alias("level"), "node", "n", "digest")] if depth else []
    for i in range(depth - 1, 0, -1):
        level = _parents(level).groupBy("node").agg(*_node())
        levels.append(level.select(F.lit(i).alias("level"), "node", "n", "digest"))
    root = _parents(level).agg(*_node())  # a row even where there is no leaf
    levels.append(root.select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), "n", "digest"))
    out = levels[0]
    for part in levels[1:]:
        out = out.unionByName(part)
    return out.withColumns({"run": F.lit(None).cast("string"), "depth": F.lit(depth)})


def _parents(level: DataFrame) -> DataFrame:
    return level.select(F.shiftright("node", BITS).alias("node"), "n", F.struct("node", "digest").alias("child"))


def _node() -> list[Column]:
    """Size and digest of a node from its children, of which there are sixteen at most."""
    children = F.transform(F.array_sort(F.collect_list("child")), lambda c: F.concat_ws(":", c["node"], c["digest"]))
    return [F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.md5(F.array_join(children, ",")).alias("digest")]


def differing(a: DataFrame, b: DataFrame, depth: int) -> list[int]:
    """The leaves that differ between two trees of one depth: a join of a level each, of children of differing nodes only.

    What comes to the driver are numbers of nodes, at most 16 to the power of ``depth``."""
    found = [0]
    for level in range(depth + 1):
        x, y = (_level(t, level, found).select("node", F.struct("n", "digest").alias(name)) for t, name in ((a, "x"), (b, "y")))
        found = sorted(r[0] for r in x.join(y, "node", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("node").collect())
        if not found:
            break
    return found


def _level(tree: DataFrame, level: int, parents: list[int]) -> DataFrame:
    nodes = tree.filter(F.col("level") == level)
    return nodes.filter(F.shiftright("node", BITS).isin(parents)) if level else nodes


def read_tree(spark: SparkSession, root: str) -> DataFrame | None:
    name = snapshots.current(spark, root)
    return None if name is None else spark.read.schema(TREE).parquet(f"{root}/{name}/tree")


def depth_of(tree: DataFrame) -> int:
    return tree.filter("level = 0").select("depth").head()[0]


def read_entries(spark: SparkSession, root: str, leaves: Sequence[int] | None = None) -> DataFrame | None:
    """The current table, or the given leaves of it (other folders aren't opened); None where there are no such entries."""
    tree = read_tree(spark, root)
    if tree is None:
        return None
    held = tree.filter((F.col("level") == F.col("depth")) & F.col("run").isNotNull())
    if leaves is not None:
        held = held.filter(F.col("node").isin(list(leaves)))
    by_run = held.groupBy("run").agg(F.collect_list("node").alias("nodes")).orderBy("run").collect()  # bounded as in ``differing``
    out = None
    for run, nodes in by_run:
        part = spark.read.parquet(f"{root}/entries/{run}").filter(F.col("__leaf").cast("long").isin(nodes)).drop("__leaf")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def diff(desired: DataFrame, root: str, key: str, values: Sequence[str], depth: int = 3) -> Changes:
    """What turns the table kept below ``root`` into ``desired``: rows by key with status add, change or remove.

    Keys that stay as they are have no row. ``desired`` is scanned twice (for digests, and for rows of differing leaves), so
    it should be read from files. ``depth`` counts where nothing is kept yet; else the kept tree's is used."""
    spark = desired.sparkSession
    kept = read_tree(spark, root)
    depth = depth if kept is None else depth_of(kept)
    tree = stored(tree_of(desired, key, values, depth), "tree")
    leaves = differing(tree, spark.createDataFrame([], TREE) if kept is None else kept, depth)
    new = _entries(desired, key, values, depth).filter(F.col("__leaf").isin(leaves)).withColumn("__sign", F.lit(1))
    old = read_entries(spark, root, leaves)
    both = new if old is None else new.unionByName(_entries(old, key, values, depth).withColumn("__sign", F.lit(-1)))
    sums = both.groupBy("__key").agg(
        F.count_if(F.col("__sign") > 0).alias("__new"), F.count_if(F.col("__sign") < 0).alias("__old"), *[F.sum(F.col(s) * F.col("__sign")).alias(s) for s in _LANES]
    )
    other = F.col("__new") != F.col("__old")
    for s in _LANES:
        other = other | (F.col(s) != 0)
    status = F.when(F.col("__old") == 0, "add").when(F.col("__new") == 0, "remove").when(other, "change")
    rows = sums.select(F.col("__key").alias(key), status.alias("status")).filter("status is not null")
    return Changes(rows, leaves, tree)


def commit(desired: DataFrame, root: str, key: str, values: Sequence[str], depth: int = 3) -> Changes:
    """``desired`` is what is kept from now on. Leaves that differ are written, the tree names for all others the commit that
    did; if no leaf differs, nothing is written. ``rows`` of the result were stored before, as their inputs may go.

    Two tables that differ in columns beside ``values`` alone are the same. Folders of commits that neither this tree nor the
    one before names are removed. A run that fails before the pointer is replaced leaves the kept table as it was."""
    spark = desired.sparkSession
    before = read_tree(spark, root)
    changes = diff(desired, root, key, values, depth)
    changes.rows = stored(changes.rows, "changes")
    if before is not None and not changes.leaves:
        return changes
    name, path = snapshots.fresh(root)
    depth = depth if before is None else depth_of(before)
    part = desired.withColumn("__leaf", leaf_of(key, depth)).filter(F.col("__leaf").isin(changes.leaves))
    if changes.leaves:
        part.repartitionByRange("__leaf", key, *values).write.partitionBy("__leaf").parquet(f"{root}/entries/{name}")
    tree, leaf, fresh = changes.tree.drop("run"), (F.col("level") == depth) & (F.col("n") > 0), F.col("node").isin(changes.leaves)
    if before is None:
        tree = tree.withColumn("run", F.when(leaf, name))
    else:
        was = before.filter(F.col("level") == F.col("depth")).select("level", "node", "run")
        tree = tree.join(F.broadcast(was), ["level", "node"], "left").withColumn("run", F.when(leaf & fresh, name).when(leaf, F.col("run")))
    tree.select("level", "node", "n", "digest", "run", "depth").repartition(1).write.parquet(f"{path}/tree")  # 16 ** depth rows and inner nodes
    snapshots.publish(spark, root, name)
    used = {r[0] for t in (spark.read.schema(TREE).parquet(f"{path}/tree"), before) if t is not None for r in t.select("run").distinct().collect()}
    snapshots.keep_only(spark, f"{root}/entries", used)
    return changes
