"""Trie of conversation prefixes, by van Emde Boas recursion.

Conversations are rebuilt first (`rebuilt`). Turns are then only hashes of role and text, with the length of the text; sequences
are rows (conversation, position), so no conversation has to fit one task.

Going down, all sequences are cut at half depth, the half rounded to a power of two: the upper parts form one trie, the lower parts a
forest whose trees are named by the prefix cut off. Names are SHA-256 hashes made of the name of the tree and of the block of turns
up to the cut; blocks of 2, 4, 8, ... turns are named beforehand, each from its two halves. Upper and lower parts of all trees are cut
again, in the same pass, until each is one turn deep; by then every turn knows the name of the prefix before it. Grouping
by name counts the nodes. Going up, neighbouring parts meet again: the totals of a lower tree, summed over its topmost nodes, are grafted
onto the node it hangs from and onto that node's ancestors inside the upper part, found along one conversation that runs through them.
Both ways take as many passes as the depth has binary digits, each over rows no more than there are turns.

Cases: rows without a conv_id belong to no conversation and are left out. A null role or text is empty. Turns of equal number, null
ones too, are ordered by the hash of role and text, so repeated rows are turns next to each other. A conversation whose base is missing or
shorter than its share has just what there is. An empty table gives no nodes, not even the root. The hash over the conversations that end
at a node reads their ids as a stream in order; however many, they are never held together. Other columns, whatever their
names, are left out.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seamline.operators.skew import skew_join
from seamline.session import written

SHARED = 100
MOST_SHARED = 5
ROOT = bytes(32)


def _named(*parts):
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _numbered(batches):
    """Adds the number of the partition and the position within the conversation there; rows come in order."""
    part, last, reached = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
        at = np.arange(len(ids)) - np.repeat(starts, np.diff([*starts, len(ids)]))
        if last is not None and ids[0] == last:
            at[: starts[1] if len(starts) > 1 else len(ids)] += reached
        last, reached = ids[-1], at[-1] + 1
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("symbol"), batch.column("length"), pa.array(np.full(len(ids), part, np.int32)), pa.array(at)], ["conv_id", "symbol", "length", "part", "at"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (position from 0), symbol (hash of role and text) and length (code points of the text) of every turn.

    Rows are range-partitioned in their order, so a long conversation lies in several partitions; at most one a partition goes on from
    the partition before, so the table of what came before them has no more rows than there are partitions.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("symbol"),
        F.length(text).cast("long").alias("length"), F.monotonically_increasing_id().alias("row"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "symbol", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.select("conv_id", "symbol", "length").mapInArrow(_numbered, "conv_id long, symbol binary, length long, part int, at long"), "turns")
    sizes = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = written(sizes.select("conv_id", "part", before.alias("before")).filter("before > 0"), "offsets")
    whole = placed.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    return whole.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "symbol", "length")


def rebuilt(own: DataFrame) -> DataFrame:
    """The turns of every rebuilt conversation: the first of its base's, then its own after as many. Rows like those of `turns`."""
    ids = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    shares = ids.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).alias("share"))
    bases = ids.filter(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    shares = written(shares.join(bases, "base", "left").withColumn("taken", F.least("share", F.coalesce("base_n", F.lit(0)))), "shares")
    first = own.filter((F.col("conv_id") % SHARED == 0) & (F.col("at") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    shared = shares.select("conv_id", "base", "taken").join(first, "base").filter("at < taken")
    left = skew_join(own, shares.select("conv_id", "share", "taken"), ["conv_id"], spread=["at"]).filter("at >= share")
    columns = ["conv_id", "at", "symbol", "length"]
    return shared.select(columns).unionByName(left.withColumn("at", F.col("at") - F.col("share") + F.col("taken")).select(columns))


def prefix_names(sequences: DataFrame, ids: DataFrame, depth: int) -> DataFrame:
    """conv_id, at, name: the name of the first `at` turns, for 0 to all turns of every conversation of `ids`."""
    levels = depth.bit_length()  # 2^levels exceeds the depth, so the end of every sequence gets a name
    blocks = [sequences.select("conv_id", F.col("at").alias("i"), F.col("symbol").alias("block"))]
    for _ in range(levels - 1):
        halves = blocks[-1]
        upper = halves.filter("i % 2 = 0").select("conv_id", F.expr("i div 2").alias("i"), F.col("block").alias("upper"))
        lower = halves.filter("i % 2 = 1").select("conv_id", F.expr("i div 2").alias("i"), F.col("block").alias("lower"))
        blocks.append(written(upper.join(lower, ["conv_id", "i"]).select("conv_id", "i", _named("upper", "lower").alias("block")), "blocks"))
    trees = ids.select("conv_id", F.lit(0).cast("long").alias("i"), F.lit(ROOT).alias("name"))
    for cut in reversed(blocks[:levels]):
        upper = trees.withColumn("i", F.col("i") * 2)
        lower = upper.join(cut, ["conv_id", "i"]).select("conv_id", (F.col("i") + 1).alias("i"), _named("name", "block").alias("name"))
        trees = written(upper.unionByName(lower), "trees")
    return trees.withColumnRenamed("i", "at")


def grafted(nodes: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """`nodes` (name, parent, depth, conv_id, leaves, saved) with leaves and saved summed over the subtrees; `paths` (conv_id, at, name)
    leads from a conversation to its nodes."""
    size = 1
    while size < depth:
        tops = nodes.filter((F.col("depth") - 1) % (2 * size) == size)
        hanging = tops.groupBy("parent").agg(
            F.min("conv_id").alias("conv_id"), F.expr(f"(min(depth) - 1) div {size} - 1").alias("piece"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
        )
        above = paths.withColumn("piece", F.expr(f"at div {size}")).join(hanging.drop("parent"), ["conv_id", "piece"])
        grown = nodes.select("name", "leaves", "saved").unionByName(above.select("name", "leaves", "saved"))
        sums = grown.groupBy("name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        nodes = written(nodes.drop("leaves", "saved").join(sums, "name"), "nodes")
        size *= 2
    return nodes


def _ends(batches):
    """Streams (name, conv_id), sorted, into one hash a name."""
    name, sha, out = None, None, []
    for batch in batches:
        for own, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()):
            if own != name:
                if name is not None:
                    out.append((name, sha.hexdigest()))
                name, sha = own, hashlib.sha256(str(conv).encode())
            else:
                sha.update(b",%d" % conv)
        if len(out) >= 1 << 16:
            yield _hashes(out)
            out = []
    if name is not None:
        out.append((name, sha.hexdigest()))
    yield _hashes(out)


def _hashes(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["name", "ends_sha256"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    own = turns(conversations)
    sequences = written(rebuilt(own), "sequences")
    ids = written(own.select("conv_id").distinct(), "ids")
    depth = (sequences.agg(F.max("at")).first()[0] or 0) + 1 if not sequences.isEmpty() else 0
    everyone = ids.agg(F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("n")).first()
    names = prefix_names(sequences, ids, depth)
    met = names.join(sequences.select("conv_id", "at", "length"), ["conv_id", "at"], "left").withColumnRenamed("name", "parent")
    after = names.select("conv_id", (F.col("at") - 1).alias("at"), "name")
    paths = written(met.join(after, ["conv_id", "at"], "left"), "paths")  # without a name: a conversation's end
    inner = paths.filter("name IS NOT NULL")
    nodes = inner.groupBy("name").agg(
        F.first("parent").alias("parent"), (F.first("at") + 1).alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.first("length").alias("length"),
    )
    nodes = written(nodes, "nodes")
    families = nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("n_children"))
    leaf = F.coalesce("n_children", F.lit(0))
    counted = written(nodes.join(families, "name", "left").select(*nodes.columns, leaf.cast("long").alias("n_children")), "nodes")
    valued = counted.select("name", "parent", "depth", "conv_id", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("length")).alias("saved"))
    totals = grafted(valued, inner.select("conv_id", "at", "name"), depth)
    top = totals.filter("depth = 1").agg(F.count(F.lit(1)).alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).first()
    below = counted.join(totals.select("name", "leaves", "saved"), "name")
    first = below.filter("depth = 1").withColumn("parent_conv_id", F.lit(everyone["least"]).cast("long"))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deeper = skew_join(below.filter("depth > 1"), parents, ["parent"], spread=["name"])
    columns = ["name", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "leaves", "saved"]
    root = ids.sparkSession.createDataFrame(
        [(ROOT, everyone["least"], 0, None, everyone["n"], top["n"], top["leaves"] or 1, top["saved"] or 0)] if everyone["n"] else [],
        "name binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, leaves long, saved long",
    )
    found = first.select(columns).unionByName(deeper.select(columns)).unionByName(root)
    ends = paths.filter("name IS NULL").select(F.col("parent").alias("name"), "conv_id")
    hashes = ends.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(_ends, "name binary, ends_sha256 string")
    return found.join(hashes, "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
