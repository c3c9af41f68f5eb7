"""A Merkle manifest of a table: one root over all rows, and a proof for each row.

Every row is a leaf. The leaves of a source form a tree of three, the trees' roots (subroots, in order of their source)
form the tree above, whose root stands for the table.

Cogrouped subtree exchange: a tree is cut into superblocks of BLOCK consecutive leaves, and small trees that lie next to
each other share one, so neither one source with most rows nor as many sources as rows make a large or an idle group. On
the way up each superblock sends one node, the root of its subtree, which is a leaf of the next level. On the way down the
nodes of a superblock are cogrouped with the outer nodes they need, the steps from the superblock's root to the table's
root; the group reduces its own nodes again, joins both parts of the proofs and folds them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from adjudica.llm.common import remainder, written

RUN = 3
LEVELS = 6
BLOCK = RUN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, total long, start long, pos long, digest string, down_a long, down_b long"
PATHS = "tree long, pos long, down_a long, down_b long, path string"
PROVEN = ("has_id boolean, doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "verified boolean")


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """How often n nodes are joined in runs until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def up_one(nodes: list[str]) -> list[str]:
    return [digest_of("".join(nodes[k:k + RUN])) for k in range(0, len(nodes), RUN)]


def steps_within(nodes: list[str], levels: int) -> tuple[list[list[str]], str]:
    """The steps of each node up to the root of the subtree, and that root.

    A step is the node's place in its run, one digit, and then the digests of the run's others.
    """
    steps: list[list[str]] = [[] for _ in nodes]
    at, span = nodes, 1
    for _ in range(levels):
        here = [f"{k % RUN}" + "".join(at[k - k % RUN:k]) + "".join(at[k + 1:k - k % RUN + RUN]) for k in range(len(at))]
        for k, own in enumerate(steps):
            own.append(here[k // span])
        at, span = up_one(at), span * RUN
    return steps, at[0]


def folded(digest: str, steps: list[str]) -> str:
    for step in steps:
        at = 1 + int(step[0]) * len(digest)
        digest = digest_of(step[1:at] + digest + step[at:])
    return digest


def split_path(path: str) -> list[str]:
    return path.split(";") if path else []


def subtrees(block: pd.DataFrame) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """(tree, levels inside the block, nodes in order) of each tree that has nodes in this superblock."""
    block = block.sort_values(["tree", "pos"], kind="stable")
    edges = [0, *((block["tree"].to_numpy()[1:] != block["tree"].to_numpy()[:-1]).nonzero()[0] + 1).tolist(), len(block)]
    for a, b in zip(edges[:-1], edges[1:]):
        rows = block.iloc[a:b]
        yield int(rows["tree"].iloc[0]), min(LEVELS, height(int(rows["total"].iloc[0]))), rows


def at_home(nodes: DataFrame) -> DataFrame:
    """The superblock (a, b) of each node: of its own tree, or of the trees that begin close to each other."""
    small = F.col("total") <= BLOCK
    return nodes.select(
        "*", F.when(small, F.lit(-1)).otherwise(F.col("tree")).cast("long").alias("a"),
        F.floor(F.when(small, F.col("start")).otherwise(F.col("pos")) / BLOCK).cast("long").alias("b"))


def _send_up(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    sent = []
    for tree, levels, rows in subtrees(block):
        nodes = rows["digest"].tolist()
        for _ in range(levels):
            nodes = up_one(nodes)
        first = rows.iloc[0]
        sent.append((tree, -(-int(first["total"]) // BLOCK), int(first["start"]) // BLOCK, int(first["pos"]) // BLOCK, nodes[0], key[0], key[1]))
    return pd.DataFrame(sent, columns=["tree", "total", "start", "pos", "digest", "down_a", "down_b"])


def _send_down(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    paths = dict(zip(outer["tree"].tolist(), outer["path"].tolist()))
    sent = []
    for tree, levels, rows in subtrees(block):
        steps, _ = steps_within(rows["digest"].tolist(), levels)
        above = split_path(paths[tree])
        sent += zip(rows["tree"], rows["pos"], rows["down_a"], rows["down_b"], (";".join([*own, *above]) for own in steps))
    return pd.DataFrame(sent, columns=["tree", "pos", "down_a", "down_b", "path"])


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All levels of the trees, each a written table, and the root of every tree as (tree, start, digest) of its level."""
    levels, roots = [nodes], nodes.where("total = 1")
    while levels[-1].where("total > 1").limit(1).count():
        up = at_home(levels[-1].where("total > 1")).select("a", "b", "tree", "total", "start", "pos", "digest").groupBy("a", "b").applyInPandas(_send_up, NODES)
        levels.append(written(up, "nodes"))
        roots = roots.unionByName(levels[-1].where("total = 1"))
    return levels, roots.select("tree", "digest")


def outer_of(nodes: DataFrame, above: DataFrame | None, tops: DataFrame) -> DataFrame:
    """(a, b, tree, path): for each superblock of the nodes, and each tree in it, the steps from there to the table's root."""
    outer = at_home(nodes.where("total = 1")).select("a", "b", "tree").join(tops, "tree").select("a", "b", "tree", "path")
    if above is not None:
        outer = outer.unionByName(above.select(F.col("down_a").alias("a"), F.col("down_b").alias("b"), "tree", "path"))
    # New names for the columns: both sides of the cogroup come from the same nodes.
    return outer.toDF("a", "b", "tree", "path")


def paths_to_root(levels: list[DataFrame], tops: DataFrame, stop: int) -> DataFrame | None:
    """The steps to the table's root from every node of the level `stop`, from the top level down."""
    paths = None
    for nodes in levels[:stop - 1:-1] if stop else levels[::-1]:
        outer = outer_of(nodes, paths, tops)
        left = at_home(nodes).select("a", "b", "tree", "total", "pos", "digest", "down_a", "down_b")
        paths = written(left.groupBy("a", "b").cogroup(outer.groupBy("a", "b")).applyInPandas(_send_down, PATHS), "paths")
    return paths


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves with their tree (the rank of their source), its first place and size, and their place in it.

    One range exchange sorts the rows; places then follow from counts of (task, source), of which there are as many as
    sources and tasks. Equal rows are dealt by a salt, so that they do not fill one task.
    """
    ranged = written(
        leaves.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("source", "doc_id", "leaf", "salt")
        .sortWithinPartitions("source", "doc_id", "leaf", "salt").drop("salt").withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    by_source = Window.partitionBy("source").orderBy("part")
    runs = ranged.groupBy(part.alias("part"), "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = written(runs.select(
        "*", F.coalesce(F.sum("n").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("source")).alias("total")), "runs")
    opens = (F.col("before") == 0).cast("long")
    # One row per task of the range exchange.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.groupBy("part").agg(F.sum("n").alias("rows"), F.sum(opens).alias("trees")).select(
        "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("trees").over(earlier), F.lit(0)).alias("trees_before"))
    opened = runs.select("*", F.sum(opens).over(Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, 0)).alias("nth")).join(bases, "part")
    whole = by_source.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = opened.select(
        F.col("part").alias("run_part"), F.col("source").alias("run_source"), "first", "before", "total",
        F.first(F.when(F.col("before") == 0, F.col("trees_before") + F.col("nth") - 1), ignorenulls=True).over(whole).alias("tree"),
        F.first(F.when(F.col("before") == 0, F.col("rows_before") + F.col("first") - F.shiftleft("part", 33)), ignorenulls=True).over(whole).alias("start"))
    joined = ranged.join(runs, (part == F.col("run_part")) & F.col("source").eqNullSafe(F.col("run_source")))
    return written(joined.select(
        F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "leaf", "tampered",
        "tree", "total", "start", (F.col("before") + F.col("at") - F.col("first")).alias("pos")), "leaves")


def proven(docs: DataFrame) -> DataFrame:
    """leaf, subroot, root and proof of every row, and what its tampered copy folds to.

    A row's copy is tampered with if its id's crc32 is even: its text loses its line feeds. A row without an id is never
    tampered with and comes first in its source; a row without a source is in a source of its own, which comes first. Null
    fields are `-`. Equal rows are leaves of their own, next to each other. An empty table has no rows and no root. Other
    columns are not part of a leaf.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in FIELDS[1:]))
    values = {c: F.col(c) for c in FIELDS}
    bare = {**values, "text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    leaves = placed(written(named.select(
        "doc_id", "source", leaf_of(*values.values()).alias("leaf"),
        F.when(remainder(F.col("doc_id"), 2) == 0, leaf_of(*bare.values())).alias("tampered")), "digests"))

    nowhere = F.lit(0).cast("long")
    nodes = leaves.select("tree", "total", "start", "pos", F.col("leaf").alias("digest"), nowhere.alias("down_a"), nowhere.alias("down_b"))
    levels, subroots = climbed(nodes)
    subroots = written(subroots, "subroots")
    trees = subroots.count()
    tops = subroots.select(nowhere.alias("tree"), F.lit(trees).cast("long").alias("total"), nowhere.alias("start"), F.col("tree").alias("pos"), "digest",
                           nowhere.alias("down_a"), nowhere.alias("down_b"))
    top_levels, top = climbed(tops)
    row = top.first()
    root = row.digest if row else ""
    above = docs.sparkSession.createDataFrame([(0, "")], "tree long, path string")
    to_root = paths_to_root(top_levels, above, 0).select(F.col("pos").alias("tree"), "path")
    outer = outer_of(nodes, paths_to_root(levels, to_root, 1) if len(levels) > 1 else None, to_root)

    def prove(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        paths = dict(zip(outer["tree"].tolist(), outer["path"].tolist()))
        out = []
        for tree, levels_here, rows in subtrees(block):
            steps, own_root = steps_within(rows["leaf"].tolist(), levels_here)
            above = split_path(paths[tree])
            subroot = folded(own_root, above[:height(int(rows["total"].iloc[0])) - levels_here])
            siblings = "".join(s[1:] for s in above)
            for has_id, doc_id, leaf, tampered, own in zip(rows["has_id"], rows["doc_id"], rows["leaf"], rows["tampered"], steps):
                reached = folded(leaf if tampered is None else tampered, [*own, *above])
                out.append((has_id, doc_id, leaf, subroot, root, digest_of("".join(s[1:] for s in own) + siblings), reached, reached == root))
        return pd.DataFrame(out, columns=["has_id", "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    result = at_home(leaves).groupBy("a", "b").cogroup(outer.groupBy("a", "b")).applyInPandas(prove, PROVEN)
    return result.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")
