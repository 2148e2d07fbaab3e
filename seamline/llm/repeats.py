"""Repeated passages: every byte covered by a 100-byte string that also starts earlier, in any document, is removed.

Windows of 100 bytes that are equal have the same anchor (see `anchors`), so only pieces of equal anchors are compared.
  1. Anchors are counted; pieces of an anchor that occurs once are done. Most text ends here, and no text has moved.
  2. Equal pieces collapse to their first place; every other place is a repeat as a whole. Counting combines before the shuffle,
     so a passage that a third of all documents share is one row for each task.
  3. Different pieces of one anchor are compared in a run-length index (see `run_index`) over chunks of whole anchors of a bounded
     size, sorted by place. Matching statistics are streamed through it: they and the places sampled at run ends decide which
     matches of 100 bytes began earlier, and those are marked.
  4. An anchor with more than `MOST` different pieces isn't given to one task: its pieces are cut into single windows, which are
     grouped by their hash, again combining before the shuffle.

Positions are those of the input. "Earlier" is a smaller doc_id, or an earlier start in the same document. Cases: a null text is
the empty one. Where doc_ids repeat or are null, or aren't whole numbers, rows are ordered by doc_id (null first) and text, and each row is a
document of its own in that order. Texts shorter than 100 bytes keep everything. Other columns are left out. An empty table gives
an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm import anchors
from seamline.llm.anchors import WINDOW
from seamline.llm.fast_words import slabs, stretch_hash, stretch_sums
from seamline.llm.run_index import RunIndex
from seamline.llm.tables import small_side, texts
from seamline.session import written

MOST = 2048
CHUNK = 1 << 20
#: Anchors, 8 bytes each, that are sent to every executor at most (about 100 MB there); beyond it the join is a shuffled one.
ANCHOR_ROWS = 3_000_000
#: A run of windows in one number: start * STEP + how many.
STEP = 128


def _bytes(batch):
    return (bytes(t.as_buffer()) for t in batch.column("text"))


def _pieces(batches):
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for slab in slabs(batch.column("text"), anchors.SLAB):
            text, anchor, start, count, piece = anchors.pieces(slab)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(ids[slab.first + text]), pa.array(start * STEP + count)], ["anchor", "piece", "id", "run"])


def _bodies(batches):
    """The bytes of asked-for pieces; those of hot anchors as single windows, by hash, without bytes."""
    for batch in batches:
        out = []
        for i, text in enumerate(_bytes(batch)):
            key, asked = batch.column("id")[i].as_py(), batch.column("asked")[i].as_py()
            sums = None
            for one in asked:
                start, count = divmod(one["run"], STEP)
                if not one["hot"]:
                    out.append((one["anchor"], key, one["run"], text[start : start + count - 1 + WINDOW]))
                    continue
                if sums is None:
                    sums = stretch_sums(np.frombuffer(text, np.uint8))
                at = np.arange(start, start + count)
                out += [(h, key, int(a) * STEP + 1, None) for h, a in zip(stretch_hash(sums, at, at + WINDOW).view(np.int64).tolist(), at)]
        for k in range(0, len(out), 10_000):
            columns = [*zip(*out[k : k + 10_000])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["anchor", "id", "run", "body"])


def _marks(batches):
    """Runs of repeated windows. Rows come sorted by anchor, id and run; chunks end between anchors."""

    def marked(rows):
        texts_, ids, runs = rows
        if len(texts_) < 2:
            return None
        text, place = RunIndex(texts_, WINDOW).repeats()
        if not len(text):
            return None
        new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(place) != 1)]))
        counts, first = np.diff([*new, len(text)]), text[new]
        start = np.array(runs, np.int64)[first] // STEP + place[new]
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[first]), pa.array(start * STEP + counts)], ["id", "run"])

    held, size, last = ([], [], []), 0, None
    for batch in batches:
        for anchor, key, run, body in zip(*[batch.column(c).to_pylist() for c in ("anchor", "id", "run", "body")]):
            if size >= CHUNK and anchor != last:
                if (found := marked(held)) is not None:
                    yield found
                held, size = ([], [], []), 0
            for column, value in zip(held, (body, key, run)):
                column.append(value)
            size, last = size + len(body), anchor
    if (found := marked(held)) is not None:
        yield found


def _merged(batches):
    """Byte spans of each document from its runs of windows, joined where they touch: (starts and ends as numbers)."""
    for batch in batches:
        out = []
        for runs in batch.column("runs"):
            runs = np.sort(np.array(runs.as_py(), np.int64))
            start, end = runs // STEP, runs // STEP + runs % STEP - 1 + WINDOW
            reach = np.maximum.accumulate(end)
            new = np.concatenate([[True], start[1:] > reach[:-1]])
            out.append(np.stack([start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(runs) - 1]])]], axis=1).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, spans), stored: for each document of `docs` (id, text) with repeats their byte spans, as pairs of 64-bit numbers."""
    pieces = docs.mapInArrow(_pieces, "anchor long, piece long, id long, run long")
    several = written(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    count = several.count()
    shared = written(pieces.join(F.broadcast(several) if count <= ANCHOR_ROWS else several, "anchor"), "shared-pieces")
    place = F.struct("id", "run")
    distinct = written(shared.groupBy("anchor", "piece").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "distinct-pieces")
    copied = written(distinct.filter("n > 1").drop("n"), "copied-pieces")
    again = shared.join(copied, ["anchor", "piece"]).filter(place != F.col("first")).select("id", "run")
    rivals = written(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("pieces")).filter("pieces > 1"), "contested-anchors")
    rows = rivals.count()
    asked = distinct.join(small_side(rivals, rows), "anchor").select(F.col("first.id").alias("id"), "anchor", F.col("first.run").alias("run"), (F.col("pieces") > MOST).alias("hot"))
    asked = written(asked.groupBy("id").agg(F.collect_list(F.struct("anchor", "run", "hot")).alias("asked")), "asked-pieces")
    pieces_asked = asked.agg(F.sum(F.size("asked")).alias("n")).first()["n"] or 0
    bodies = written(docs.join(small_side(asked, max(pieces_asked // 4, asked.count())), "id").mapInArrow(_bodies, "anchor long, id long, run long, body binary"), "bodies")
    size = bodies.agg(F.sum(F.length("body")).alias("s")).first()["s"] or 0
    sorted_ = bodies.filter("body IS NOT NULL").repartition(int(max(8, size // (4 * CHUNK) + 1)), "anchor").sortWithinPartitions("anchor", "id", "run")
    marked = sorted_.mapInArrow(_marks, "id long, run long")
    windows = bodies.filter("body IS NULL").select("anchor", "id", "run")
    first = windows.groupBy("anchor").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    hot = windows.join(first, "anchor").filter(place != F.col("first")).select("id", "run")
    runs = again.unionByName(marked).unionByName(hot).groupBy("id").agg(F.collect_list("run").alias("runs"))
    return written(runs.mapInArrow(_merged, "id long, spans binary"), "repeated-spans")


def _cut(batches):
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(_bytes(batch), batch.column("spans")):
            cuts = np.frombuffer(spans.as_py() or b"", "<i8").reshape(-1, 2)
            edges = [0, *cuts.ravel().tolist(), len(text)]
            left = b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(left))
            n_spans.append(len(cuts))
            kept.append(left)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()), batch.column("spans")], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])


def _digest(batches):
    for batch in _cut(batches):
        yield batch.select(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and id: a whole number in the order of documents, different for each row."""
    rows = texts(docs)
    if rows.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        seen = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
        if not seen.filter("n > 1 OR doc_id IS NULL").take(1):
            return rows.withColumn("id", F.col("doc_id").cast("long"))
    ordered = written(rows.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn("id", F.monotonically_increasing_id()), "ordered-documents")
    return ordered


def without_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and without `digest` kept (the bytes left) and spans (pairs of
    64-bit numbers: the byte ranges removed)."""
    rows = _numbered(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(rows.select("id", "text"))
    size = spans.agg(F.sum(F.length("spans")).alias("n")).first()["n"] or 0
    joined = rows.join(small_side(spans, max(size // 64, spans.count())), "id", "left").select("doc_id", "text", "spans")
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInArrow(_digest, schema) if digest else joined.mapInArrow(_cut, schema + ", kept binary, spans binary")
