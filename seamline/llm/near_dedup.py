"""Near-duplicate documents: weighted Jaccard similarity of five-word shingles of at least 0.8, found with BagMinHash signatures.

A document is the multiset of its shingles. A shingle of count w owns a Poisson process over the weights [0, w). The weights are
cut into [0,1), [1,2), [2,4), [4,8), ...; each block has a process of its own with a rate of its width, made by hashes of shingle,
block and point, so equal parts of two documents have equal points. A point has a time, a component of the signature, and a
weight inside the block that counts only if it lies below w. Component i is the earliest time of a point of component i; two
documents agree in it with the probability of their weighted Jaccard similarity. Points are made in order of time, and a
process ends once its next point comes later than all components.

Equal documents are one node. Nodes that agree in a band of the signature are candidates. A bucket's members are compared with
its smallest member only; exact multiset overlap decides, and components join what is linked. Where a bucket then still holds
several components, its members are compared across them in tiles (`tiles`): first by signature, which leaves the members that have a
likely partner, then these by their multisets, as products of matrices over the shingles that occur more than once in the tile. A
tile gives out one link for each two components it joins, so rows grow with members and links, never with pairs.

Words are the stretches between ASCII white space, in lower case. Shorter documents have one shingle of all their words. Cases: a
null or blank text has no words and is near to nothing, not even its like; each such row is a class of its own. Of each class the
row with the smallest doc_id stays (null ids last; of equal ids one row). Other columns are carried by `keep_one` and ignored by
`classes`. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.components import roots, with_roots
from seamline.llm.fast_words import BY_SPACE, giving_back, mixed, slabs, stretch_hash, stretch_sums, words
from seamline.llm.tables import small_side
from seamline.llm.tiles import tile_by_tile, tiles
from seamline.session import written

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
COMPONENTS = BANDS * ROWS
#: Agreeing signature components below which a pair isn't compared: over eight standard deviations below what 0.8 gives.
LEAST_AGREEING = int(0.52 * COMPONENTS)
#: Members, and numbers of their multisets, in one block of a tile: 8 MB of either side.
BLOCK_MEMBERS = 2048
BLOCK_NUMBERS = 1 << 20
#: Cells of the matrices compared at a time in a tile.
CELLS = 1 << 23
#: Cells of a tile's counts that are turned into similarities at a time.
BAND_CELLS = 1 << 18
#: Bytes of text handled at a time: shingles and points of a text take some 100 bytes for each of its own.
SLAB = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: Column) -> Column:
    """Lower case, one space between words, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\n\\x0B\\f\\r]+", " "))


def shingles(slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of plain texts, sorted by text and hash."""
    w = words(slab, BY_SPACE)
    n = np.bincount(w.text, minlength=slab.texts)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    per = np.where(n > 0, np.maximum(n - WORDS + 1, 1), 0)
    text = np.repeat(np.arange(slab.texts), per)
    at = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(per)])[:-1], per) + first[text]
    last = np.minimum(at + WORDS - 1, first[text] + n[text] - 1)
    hashes = stretch_hash(stretch_sums(slab.data), w.starts[at], w.ends[last])
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, int)
    return text[new], hashes[new], np.diff([*new, len(text)])


def signatures(text: np.ndarray, hashes: np.ndarray, counts: np.ndarray, texts: int) -> np.ndarray:
    """The signature of each text as times; infinite where a text has no shingle."""
    times = np.full(texts * COMPONENTS, np.inf)
    blocks = np.ceil(np.log2(counts)).astype(np.int64) + 1
    own = np.repeat(np.arange(len(text)), blocks)
    block = np.arange(len(own)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
    rate = np.maximum(low, 1).astype(float)
    base, weight, state = text[own] * COMPONENTS, counts[own], mixed(hashes[own] + block.astype(np.uint64) * _ODD)
    now, step = np.zeros(len(own)), 0
    whose, bound = text[own], np.full(texts, np.inf)
    while len(now):
        k = int(np.clip(200_000 // len(now), 1, 64))
        steps = np.arange(step + 1, step + k + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            draws = mixed(state[:, None] + steps * np.uint64(0xD1B54A32D192ED03))
        waits = -np.log(((draws >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        waits[:, 0] += now
        at = np.cumsum(waits, axis=1)
        more = mixed(draws)
        place = low[:, None] + ((more >> np.uint64(32)).astype(float) * 2.0**-32 * rate[:, None]).astype(np.int64)
        good = (place < weight[:, None]) & (at < bound[whose][:, None])
        component = (base[:, None] + (more & np.uint64(0xFFFFFFFF)).astype(np.int64) % COMPONENTS)[good]
        np.minimum.at(times, component, at[good])
        bound = times.reshape(texts, COMPONENTS).max(axis=1) if texts else bound
        step += k
        left = at[:, -1] < bound[whose]
        now, base, weight, state, low, rate, whose = at[left, -1], base[left], weight[left], state[left], low[left], rate[left], whose[left]
    return times.reshape(texts, COMPONENTS)


@giving_back
def _sign(batches):
    for batch in batches:
        for slab in slabs(batch.column("plain"), SLAB):
            times = signatures(*shingles(slab), slab.texts)
            bits = mixed(times.view(np.uint64))
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (slab.texts, BANDS))
            for i in range(ROWS):
                with np.errstate(over="ignore"):
                    key = mixed(key * _ODD + bits.reshape(slab.texts, BANDS, ROWS)[:, :, i])
            some = np.isfinite(times[:, 0])
            bands = [k if s else [] for k, s in zip(key.view(np.int64), some)]
            short = (bits & np.uint64(255)).astype(np.uint8)
            own = batch.slice(slab.first, slab.texts)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("key"), pa.array(bands, pa.list_(pa.int64())), pa.array([s.tobytes() for s in short], pa.binary())], ["doc_id", "key", "bands", "short"])


@giving_back
def _bodies(batches):
    """The multiset of each text as distinct numbers: the n-th copy of a shingle is an element of its own."""
    for batch in batches:
        for slab in slabs(batch.column("plain"), SLAB):
            text, hashes, counts = shingles(slab)
            own = np.repeat(np.arange(len(text)), counts)
            copy = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            with np.errstate(over="ignore"):
                ids = mixed(hashes[own] + copy.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            text = text[own]
            order = np.lexsort((ids, text))
            ids, cuts = ids[order], np.searchsorted(text[order], np.arange(slab.texts + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.slice(slab.first, slab.texts).column("node"), lists], ["node", "body"])


@giving_back
def _agreeing(batches):
    """In how many components the short signatures of each pair agree."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(x.as_py() for x in batch.column(c)), np.uint8).reshape(-1, COMPONENTS) for c in ("short_a", "short_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((left == right).sum(axis=1), pa.int32())], ["a", "b", "agree"])


def _with_likely_partners(tile, left, right):
    """The members of a tile that agree with a member of another component in enough signature components."""
    short = np.frombuffer(b"".join(tile.column("short").to_pylist()), np.uint8).reshape(-1, COMPONENTS)
    root, found = tile.column("root").to_numpy(), np.zeros(len(short), bool)
    step = max(1, CELLS // (COMPONENTS * len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        agree = (short[rows][:, None, :] == short[right][None]).sum(axis=2, dtype=np.uint16)
        likely = (agree >= LEAST_AGREEING) & (root[rows][:, None] != root[right][None])
        found[rows] |= likely.any(axis=1)
        found[right] |= likely.any(axis=0)
    own = np.flatnonzero(found)
    return [pa.array(tile.column("bucket").to_numpy()[own]), pa.array(tile.column("node").to_numpy()[own])] if len(own) else None


def _links(similarity):
    def compare(tile, left, right):
        bodies, n = tile.column("body").combine_chunks(), tile.num_rows
        if isinstance(bodies, pa.ChunkedArray):
            bodies = bodies.chunk(0)
        sizes, ids = np.diff(bodies.offsets.to_numpy()), bodies.flatten().to_numpy()
        own, order = np.repeat(np.arange(n), sizes), np.argsort(ids, kind="stable")
        own, ids = own[order], ids[order]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        run = np.cumsum(first) - 1
        often = np.bincount(run)[run] > 1  # a number of one text alone is in no overlap
        own, column = own[often], (np.cumsum(first[often]) - 1)
        both, columns = np.zeros((len(left), len(right)), np.float32), int(column[-1]) + 1 if len(column) else 0
        step = min(max(1, CELLS // n), columns)
        for at in range(0, columns, step or 1):
            a, b = np.searchsorted(column, [at, at + step])
            holds = np.zeros((n, step), np.float32)
            holds[own[a:b], column[a:b] - at] = 1
            both += holds[left] @ holds[right].T
        root, node = tile.column("root").to_numpy(), tile.column("node").to_numpy()
        # Band by band of the left members, because what is made of the counts on the way takes several times their room.
        found, band = [], max(1, BAND_CELLS // len(right))
        for at in range(0, len(left), band):
            rows = left[at : at + band]
            common = both[at : at + band]
            either = sizes[rows][:, None] + sizes[right][None] - common.astype(float)
            apart = root[rows][:, None] < root[right][None] if left is right else root[rows][:, None] != root[right][None]
            x, y = np.nonzero((common / np.maximum(either, 1) >= similarity) & apart)
            found.append((x + at, y))
        x, y = (np.concatenate(part) for part in zip(*found))
        if not len(x):
            return None
        a, b = left[x], right[y]
        joined = np.stack([np.minimum(root[a], root[b]), np.maximum(root[a], root[b])], axis=1)
        _, one = np.unique(joined, axis=0, return_index=True)
        return [pa.array(np.maximum(node[a[one]], node[b[one]])), pa.array(np.minimum(node[a[one]], node[b[one]]))]

    return compare


class Nodes:
    """The distinct texts of a table: `rows` has a stored row per document, `nodes` one per distinct text, both with bands."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", plain(F.col("text")).alias("plain")).withColumn("key", F.md5("plain"))
        kind = docs.schema["doc_id"].dataType.simpleString()
        signed = self.docs.mapInArrow(_sign, f"doc_id {kind}, key string, bands array<long>, short binary")
        self.rows = written(signed.withColumn("tag", F.monotonically_increasing_id()), "signed")
        full = self.rows.filter(F.size("bands") > 0)
        first = full.groupBy("key").agg(F.min("tag").alias("node"), F.count(F.lit(1)).alias("copies"))
        self.first = written(first, "first-of-text")
        self.nodes = self.rows.join(small_side(self.first.select(F.col("node").alias("tag"), "copies")), "tag").withColumnRenamed("tag", "node")

    def buckets(self) -> DataFrame:
        """(bucket, node) of the buckets with at least two nodes."""
        each = self.nodes.select("node", F.explode("bands").alias("bucket"))
        hubs = each.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        return written(each.join(small_side(written(hubs, "hubs")), "bucket"), "buckets")

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        short = self.nodes.select("node", "short")
        both = pairs.join(short.select(F.col("node").alias("a"), F.col("short").alias("short_a")), "a").join(short.select(F.col("node").alias("b"), F.col("short").alias("short_b")), "b")
        return both.mapInArrow(_agreeing, "a long, b long, agree int")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of stored pairs."""
        bodies = self.bodies(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        joined = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a").join(bodies.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
        both = F.size(F.array_intersect("body_a", "body_b"))
        return joined.withColumn("both", both).select("a", "b", (F.col("both") / (F.size("body_a") + F.size("body_b") - F.col("both"))).alias("similarity"))

    def bodies(self, asked: DataFrame) -> DataFrame:
        """(node, body) of the nodes asked for, stored."""
        asked = written(asked.join(self.nodes.select("node", "doc_id", "key"), "node"), "asked")
        side = small_side(asked.withColumnRenamed("doc_id", "_id").withColumnRenamed("key", "_key"))
        texts = self.docs.join(side, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "plain")
        return written(texts.mapInArrow(_bodies, "node long, body array<long>").dropDuplicates(["node"]), "bodies")


def node_roots(nodes: Nodes, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) for the nodes that are not the smallest of their component."""
    buckets = nodes.buckets()
    star = buckets.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    star = written(nodes.agreeing(star), "star")
    compared = written(nodes.compared(written(_likely(star), "likely")), "compared")
    links = compared.filter(F.col("similarity") >= similarity).select("a", "b")
    now = roots(links)
    # what the stars leave open: buckets with several components
    members = with_roots(buckets, now)
    several = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    open_ = written(members.join(small_side(written(several, "open-buckets")), "bucket").select("bucket", "node", "root"), "open")
    signed = open_.join(nodes.nodes.select("node", "short"), "node")
    likely = tiles(signed, F.lit(1 / BLOCK_MEMBERS)).mapInArrow(giving_back(tile_by_tile(_with_likely_partners, ["bucket", "node"])), "bucket long, node long")
    likely = _once(written(likely.distinct(), "likely-members"))
    held = open_.join(likely, ["bucket", "node"]).join(nodes.bodies(likely.select("node").distinct()), "node")
    weight = F.greatest(F.size("body") / BLOCK_NUMBERS, F.lit(1 / BLOCK_MEMBERS))
    more = written(tiles(held, weight).mapInArrow(giving_back(tile_by_tile(_links(similarity), ["a", "b"])), "a long, b long").distinct(), "more-links")
    return roots(now.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)) if more.take(1) else now


def _once(members: DataFrame) -> DataFrame:
    """Of the buckets with the same members (copies of a pair agree in many bands) only one: told by their number and two hashes over them."""
    sets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    kept = written(sets.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket"), "different-buckets")
    return written(members.join(small_side(kept), "bucket"), "likely-members")


def _likely(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("agree") >= LEAST_AGREEING).select("a", "b")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept."""
    return _classes(docs, similarity).select("doc_id", "class_id", "class_size", "kept")


def _classes(docs, similarity):
    nodes = Nodes(docs)
    rooted = written(with_roots(nodes.first, node_roots(nodes, similarity)), "rooted")
    rows = nodes.rows.select("doc_id", "key", "tag", F.size("bands").alias("n"))
    rows = rows.join(small_side(rooted.select("key", "root")), "key", "left").withColumn("root", F.coalesce(F.when(F.col("n") > 0, F.col("root")), F.col("tag")))
    rows = written(rows.drop("n"), "rooted-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("tag"))
    size = rows.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("class_size"))
    several = small_side(written(size.filter("class_size > 1"), "several"))
    rows = rows.join(several, "root", "left")
    alone = F.col("best").isNull()
    return rows.select(
        "doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), (alone | (F.col("tag") == F.col("best.tag"))).alias("kept"),
    )


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` with one row of each class. All columns of `docs`, and only those, come back."""
    names = docs.columns
    gone = _classes(docs, similarity).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("stay")).filter("stay < n")
    gone = written(gone, "dropped-rows")
    side = small_side(gone.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "stay"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.md5(plain(F.col("text"))).alias("key"))
    marked = whole.join(side, (F.col("key") == F.col("_key")) & F.col("row.doc_id").eqNullSafe(F.col("_id")), "left")
    stay = marked.filter("stay IS NULL").select("row")
    # rows of one doc_id and text of which some stay: any of them
    some = marked.filter("stay > 0").groupBy("_id", "_key").agg(F.first("row").alias("row")).select("row")
    return stay.unionByName(some).select(*[F.col("row").getField(c).alias(c) for c in names])
