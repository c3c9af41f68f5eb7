"""Near-dedup by MinHash with one permutation.

The distinct shingle hashes of a text fall into SLOTS bins by their high bits and the least of each bin is kept; an
empty bin takes the value of a bin picked by a hash of its number and the attempt (optimal densification). BANDS bands of
ROWS slots make buckets: a pair at similarity 0.75 shares none of them with probability (1 - 0.75^3)^32 = 2e-8.

Texts of equal shingle sets are one class, and only classes are compared. A bucket proposes a star: an edge from each
member to its least member, never all pairs. Edges are confirmed on the full sets. A star can miss a link between two
members that are both unlike the centre. So a second round looks at the buckets of three or more that still hold several
components: members outside the bucket's largest component are held against all members, in blocks of sets, by one
matrix product per pair of blocks; only found links leave a task. Pairs inside a component could not change the result,
so after it every pair that shares a bucket is confirmed, refuted or connected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adjudica.llm.anchors import arrow_schema, gram_hashes, mixed
from adjudica.llm.common import drop_written, in_rows, texts, written
from adjudica.llm.substring import hashes_of_words

SHINGLE, ROWS, BANDS = 5, 3, 32
SLOTS = ROWS * BANDS
SIGNED = "doc_id long, key long, n long, node long, bands array<long>"


def shingle_sets(found: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, A-Z lower-cased."""
    symbols, edges = hashes_of_words([t.encode("utf-8", "surrogatepass").lower() for t in found])
    full = gram_hashes(symbols, SHINGLE)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(full[a:b - SHINGLE + 1]))
        elif b > a:
            out.append(gram_hashes(symbols[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(shingles: np.ndarray) -> int:
    """64-bit digest of a whole set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SLOTS minima per non-empty set."""
    edges = np.array([((k << 64) + SLOTS - 1) // SLOTS for k in range(SLOTS)], np.uint64)
    out = np.zeros((len(sets), SLOTS), np.uint64)
    empty = np.zeros((len(sets), SLOTS), bool)
    for k, s in enumerate(sets):
        first = np.searchsorted(s, edges)
        out[k] = s[np.minimum(first, len(s) - 1)]
        empty[k] = np.diff(np.append(first, len(s))) == 0
    row, slot = np.nonzero(empty)
    attempt = 0
    while len(row):
        attempt += 1
        with np.errstate(over="ignore"):
            donor = (mixed(slot.astype(np.uint64) * np.uint64(0x9E3779B1) + np.uint64(attempt << 40)) % np.uint64(SLOTS)).astype(np.int64)
        found = ~empty[row, donor]
        out[row[found], slot[found]] = out[row[found], donor[found]]
        row, slot = row[~found], slot[~found]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """BANDS bucket keys per signature row; the number of the band is part of the key."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_rows(batches):
        sets = shingle_sets(batch.column("text").to_pylist())
        full = [k for k, s in enumerate(sets) if len(s)]
        keys = dict(zip(full, band_keys(signatures([sets[k] for k in full])).tolist()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
             pa.array([keys.get(k) for k in range(len(sets))], pa.list_(pa.int64()))], names=["doc_id", "key", "n", "node", "bands"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes whose full sets are 0.75 alike or more."""
    schema = arrow_schema("a long, b long")
    for batch in in_rows(batches):
        c = {name: batch.column(name).to_pylist() for name in ("a", "b", "text_a", "text_b")}
        names = {t: k for k, t in enumerate(dict.fromkeys(c["text_a"] + c["text_b"]))}
        sets = shingle_sets(list(names))
        a_out, b_out = [], []
        for a, b, ta, tb in zip(c["a"], c["b"], c["text_a"], c["text_b"]):
            x, y = names[ta], names[tb]
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * common >= 75 * (len(sets[x]) + len(sets[y]) - common):
                a_out.append(a), b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], schema=schema)


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a hash of their text: with it the text of a class is found again, however often its id occurs."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key"))


def texts_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): one text of each class in nodes, so what is joined to it later grows with the pairs only."""
    wanted = nodes.select("node").distinct().join(classes.select("node", F.col("first").alias("id"), F.col("key").alias("of")), "node")
    found = keyed(docs).join(wanted, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return found.select("node", "text").dropDuplicates(["node"])


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs(a, b) of classes that hold on their full sets; pairs whose sizes exclude it are not read."""
    sizes = classes.select("node", "n")
    near = written(pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b")
                   .where((100 * F.col("n_a") >= 75 * F.col("n_b")) & (100 * F.col("n_b") >= 75 * F.col("n_a"))).select("a", "b"), "near")
    said = texts_of(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))), classes, docs)
    paired = near.join(said.toDF("b", "text_b"), "b").join(said.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    return paired.mapInArrow(_confirmed, "a long, b long")


def links_between(u: list[np.ndarray], m: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Which sets of u are 0.75 alike or more to which sets of m, as a matrix."""
    sets = u + m
    lengths = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), lengths)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    row, code = row[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    common = np.zeros((len(u), len(m)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, columns):
        a, b = np.searchsorted(code, [at, at + columns])
        has = np.zeros((len(sets), columns), np.float32)
        has[row[a:b], code[a:b] - at] = 1.0
        common += has[:len(u)] @ has[len(u):].T
    common = common.astype(np.int64)
    return 100 * common >= 75 * (lengths[:len(u), None] + lengths[None, len(u):] - common)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_rows(batches):
        found = shingle_sets(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "shingles"])


def _block_links(group: pa.Table) -> pa.Table:
    """Links of one pair of blocks: of each member outside the main part, one per part it is linked to."""
    side, node, part = (group.column(c).to_numpy() for c in ("side", "node", "part"))
    sets = [np.frombuffer(b, np.uint64) for b in group.column("shingles").to_pylist()]
    u, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = np.nonzero(links_between([sets[k] for k in u], [sets[k] for k in m]) & (part[u][:, None] != part[m][None, :]))
    _, first = np.unique(np.stack([a, part[m][b]]), axis=1, return_index=True) if len(a) else (None, np.zeros(0, np.int64))
    return pa.Table.from_pydict({"a": node[u][a[first]], "b": node[m][b[first]]}, schema=arrow_schema("a long, b long"))


def across_parts(members: DataFrame, labels: DataFrame, classes: DataFrame, docs: DataFrame, block: int = 256) -> DataFrame:
    """Links between different components inside buckets that stars have not settled."""
    held = (members.select("bucket", "node").join(labels, "node", "left").join(classes.select("node", "first"), "node")
            .select("bucket", "node", F.coalesce("label", "first").alias("part")))
    sizes = held.groupBy("bucket", "part").agg(F.count("*").alias("size"))
    mixed_buckets = (sizes.groupBy("bucket").agg(F.max(F.struct("size", "part")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("all"))
                     .where("parts > 1 and all > 2").select(
                         "bucket", F.col("most.part").alias("main"), F.ceil((F.col("all") - F.col("most.size")) / block).cast("int").alias("blocks_u"),
                         F.ceil(F.col("all") / block).cast("int").alias("blocks_m")))
    split = written(held.join(mixed_buckets, "bucket"), "split")
    place = F.xxhash64("node", F.lit(1))
    right = split.select("bucket", "node", "part", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks_u") - 1)).alias("u"),
                         F.pmod(place, F.col("blocks_m")).cast("int").alias("m"))
    left = split.where(F.col("part") != F.col("main")).select(
        "bucket", "node", "part", F.lit(0).alias("side"), F.pmod(place, F.col("blocks_u")).cast("int").alias("u"),
        F.explode(F.sequence(F.lit(0), F.col("blocks_m") - 1)).alias("m"))
    sets = texts_of(split, classes, docs).mapInArrow(_sets, "node long, shingles binary")
    return (left.unionByName(right).join(sets, "node").groupBy("bucket", "u", "m").applyInArrow(_block_links, "a long, b long").distinct())


def components(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, label): the least document of the component, for the nodes that have an edge.

    Labels travel along edges and then jump to the label of the label, so long chains shrink by a factor each round. Every
    round is a written table of nodes with an edge; only a count comes to the driver.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.select(F.col("a").alias("node")).distinct().join(classes, "node").select("node", "first", F.col("first").alias("label")), "labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", "first", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.groupBy(F.col("first").alias("label")).agg(F.min("label").alias("jump"))
        after = written(moved.join(jump, "label", "left").select("node", "first", F.least("label", "jump").alias("label"), "was"), "labels")
        changed = after.where(F.col("label") != F.col("was")).count()
        drop_written(labels)
        labels = after.drop("was")
        if not changed:
            drop_written(both)
            return labels.select("node", "label")


def grouped(docs: DataFrame) -> DataFrame:
    """The result of group() and the hash of each row's text."""
    docs = texts(docs)
    signed = written(keyed(docs).mapInArrow(_signed, SIGNED), "signed")
    classes = written(signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.first("n").alias("n"), F.coalesce(F.min_by("key", "doc_id"), F.min("key")).alias("key")), "classes")
    # All rows of a class have the same bands; those of its first document are taken.
    firsts = signed.join(classes.select("node", "first"), "node").where(F.col("doc_id").eqNullSafe(F.col("first")))
    member = firsts.select("node", F.explode("bands").alias("bucket")).distinct()
    stars = member.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("top")).where(F.col("a") < F.col("top"))
    members = written(member.join(stars.select("bucket", "a"), "bucket"), "members")
    proposed = members.where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    edges = written(confirm(proposed, classes, docs), "confirmed")
    labels = components(edges, classes)

    more = written(across_parts(members, labels, classes, docs), "confirmed")
    if more.limit(1).count():
        drop_written(labels)
        labels = components(edges.unionByName(more), classes)
    for used in (members, edges, more):
        drop_written(used)

    component = classes.join(labels, "node", "left").select("node", F.coalesce("label", "first").alias("component"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "node", "key").join(component, "node", "left")
    chosen = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", chosen.alias("component_id"), "key").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def group(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Linked are rows whose sets of 5-word shingles have 100 * intersection >= 75 * union; a text of one to four words is
    one shingle. Null and empty texts have no shingle and are linked with nothing. Equal rows are linked; a row is kept if
    its id is the least of its component. Rows without an id have component null only if no linked row has an id. Where an
    id has several texts, each row belongs to the component of its own text.
    """
    return grouped(docs).drop("key")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all columns: those of each group that have its least id.

    Rows that repeat both id and text stay or go together; a row whose id is kept for another text goes.
    """
    kept = grouped(docs).where("kept").select("doc_id", "key").distinct()
    own = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["doc_id"]) & (own == kept["key"]), "left_semi")
