"""Nearest vectors by inner product, as a block matrix join with int8 tiles.

Vectors are gathered in blocks with an int8 copy: x = s q + e, with one scale s a vector and the length of the error e known. A
tile is a block of queries against a block of candidates. The product of the int8 copies, times the scales, is off by at most
|s q||e'| + |e||x'|. So every candidate whose upper bound reaches the k-th largest lower bound survives, and only survivors are
computed again from the original numbers, in double precision. The result is exact; the bounds only save work. The lists of the
tiles are merged with heaps, 64 at a time.

Query blocks are sent to as many lanes as there are candidate blocks; an equi-join on the lane brings both together.

Cases: a vector that is null, empty, zero, or holds null or non-finite components takes no part, and neither does a row without
an id. Vectors of different length are never compared. Rows with the query's id are not its candidates. Repeated rows are
candidates of their own; ties go to the smaller id. Of rows that share a query's id the one with the smallest vector asks. Fewer than k candidates give shorter lists, an empty table none.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.session import written

BLOCK_ROWS = 4096
BLOCK_BYTES = 8 << 20
QUERY_ROWS = 1024
FAN_IN = 64
PAIRS = 100_000
_BLOCK = "dim int, ids binary, numbers binary, codes binary, scales binary, lengths binary, errors binary"
_LISTS = "block long, part long, lists binary, ids binary, scores binary"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(sound).filter(F.exists("vector", lambda x: x != 0))


def _blocks(rows_a_block: int):
    def gather(batches):
        waiting: dict[int, list] = {}

        def block(dim):
            ids, numbers = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            peak = np.abs(numbers).max(axis=1)
            scales = peak / 127
            safe = np.where(scales > 0, scales, 1.0)  # below the smallest normal numbers a scale may vanish
            codes = np.rint(numbers / safe[:, None]).clip(-127, 127).astype(np.int8)
            errors = np.linalg.norm(numbers - codes * safe[:, None], axis=1)
            arrays = ids, numbers, codes, safe, np.linalg.norm(numbers, axis=1), errors
            return pa.RecordBatch.from_pylist([dict(zip(("dim", "ids", "numbers", "codes", "scales", "lengths", "errors"), (dim, *[a.tobytes() for a in arrays])))], pa.schema([("dim", pa.int32()), *[(n, pa.binary()) for n in ("ids", "numbers", "codes", "scales", "lengths", "errors")]]))

        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("vector")
            flat, dims = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(dims)])[:-1]
            for dim in np.unique(dims):
                own, most = np.flatnonzero(dims == dim), max(1, min(rows_a_block, BLOCK_BYTES // (8 * int(dim))))
                while len(own):
                    held = sum(len(x[0]) for x in waiting.get(dim, []))
                    now, own = own[: most - held], own[most - held :]
                    waiting.setdefault(dim, []).append((ids[now], flat[starts[now][:, None] + np.arange(dim)]))
                    if held + len(now) == most:
                        yield block(dim)
        for dim in [*waiting]:
            yield block(dim)

    return gather


def blocks(rows: DataFrame, rows_a_block: int, name: str) -> tuple[DataFrame, int]:
    """`rows` dealt into stored blocks, each with a `number` of its own, and how many there are."""
    dealt = rows.repartition(max(1, -(-rows.count() // rows_a_block))).mapInArrow(_blocks(rows_a_block), _BLOCK)
    stored = written(dealt.withColumn("number", F.monotonically_increasing_id()), name)
    return stored, stored.count()


def _unpack(row: dict, side: str):
    dim = row[f"{side}dim"]
    read = lambda name, kind: np.frombuffer(row[f"{side}{name}"], kind)
    return read("ids", np.int64), read("numbers", np.float64).reshape(-1, dim), read("codes", np.int8).reshape(-1, dim), read("scales", np.float64), read("lengths", np.float64), read("errors", np.float64)


def tile(queries, candidates, k: int):
    """(query number, id, score), best first within each query: the exact k best candidates of the tile."""
    (q_ids, q, q_codes, q_scale, q_length, q_error), (c_ids, c, c_codes, c_scale, c_length, c_error) = queries, candidates
    about = np.zeros((len(q), len(c)))
    for at in range(0, q.shape[1], 1024):  # sums of 1024 products of int8 are exact in single precision
        about += q_codes[:, at : at + 1024].astype(np.float32) @ c_codes[:, at : at + 1024].astype(np.float32).T
    about *= q_scale[:, None] * c_scale
    off = (q_length + q_error)[:, None] * c_error + q_error[:, None] * c_length + 1e-12 * q_length[:, None] * c_length
    about[q_ids[:, None] == c_ids] = -np.inf
    least = about - off
    floor = np.partition(least, -k, axis=1)[:, -k] if len(c) > k else np.full(len(q), -np.inf)
    rows, cols = np.nonzero((about + off >= floor[:, None]) & (about > -np.inf))
    score = np.concatenate([(q[rows[i : i + PAIRS]] * c[cols[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(rows), PAIRS)] or [np.zeros(0)])
    order = np.lexsort((c_ids[cols], -score, rows))
    rows, ids, score = rows[order], c_ids[cols[order]], score[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], ids[rank < k], score[rank < k]


def _lists(block, part, rows, ids, scores):
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in (rows, ids, scores)]], ["block", "part", "lists", "ids", "scores"])


def _tiles(k):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                rows, ids, scores = tile(_unpack(row, "q_"), _unpack(row, "c_"), k)
                yield _lists(row["q_number"], row["lane"], _unpack(row, "q_")[0][rows], ids, scores)

    return run


def merge(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """The k best of several lists of (query id, id, score), each sorted by score within its queries."""
    by_query: dict[int, list] = {}
    for queries, ids, scores in lists:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(queries)) + 1, [len(queries)]]) if len(queries) else [0]
        ids, scores = ids.tolist(), (-scores).tolist()
        for a, b in zip(cuts, cuts[1:]):
            by_query.setdefault(int(queries[a]), []).append(list(zip(scores[a:b], ids[a:b])))
    out = [(query, i, -score) for query, own in by_query.items() for score, i in _first(heapq.merge(*own), k)]
    queries, ids, scores = zip(*out) if out else ((), (), ())
    return np.array(queries, np.int64), np.array(ids, np.int64), np.array(scores, np.float64)


def _first(items, k):
    return [x for x, _ in zip(items, range(k))]


def _merged(k):
    def run(key, table):
        parts = [tuple(np.frombuffer(table.column(n)[i].as_py(), t) for n, t in (("lists", np.int64), ("ids", np.int64), ("scores", np.float64))) for i in range(table.num_rows)]
        return pa.Table.from_batches([_lists(key[0].as_py(), key[1].as_py(), *merge(parts, k))])

    return run


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            queries, ids, scores = (np.frombuffer(batch.column(n)[i].as_py(), t) for n, t in (("lists", np.int64), ("ids", np.int64), ("scores", np.float64)))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(queries)) + 1]) if len(queries) else np.zeros(0, int)
            rank = np.arange(len(queries)) - np.repeat(cuts, np.diff([*cuts, len(queries)])) + 1
            yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, queries, k: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` that `queries` (a condition on `id`) holds for, its k nearest others."""
    rows = usable(vectors, key, column)
    asking = rows.filter(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    asked, _ = blocks(asking, QUERY_ROWS, "query-blocks")
    held, lanes = blocks(rows, BLOCK_ROWS, "candidate-blocks")
    lanes = max(1, lanes)
    left = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns]).withColumn("lane", F.explode(F.expr(f"sequence(0L, {lanes - 1}L)")))
    right = held.select(F.pmod(F.xxhash64("number"), F.lit(lanes)).alias("lane"), *[F.col(c).alias(f"c_{c}") for c in held.columns])
    pairs = left.join(right, "lane").filter("q_dim = c_dim")
    lists = pairs.mapInArrow(_tiles(k), _LISTS)
    while True:
        lists = lists.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("block", "part").applyInArrow(_merged(k), _LISTS)
        lanes = -(-lanes // FAN_IN)
        if lanes <= 1:
            break
    return lists.mapInArrow(_rows, "query_id long, rank int, vec_id long, score double")

