"""Packing documents into as few sequences as possible, by minimum bin slack.

Documents become pieces of at most `size` tokens. A bin is filled by a subset-sum search over the lengths still available: bit s
of a number says whether some combination adds up to s, so one shift and one OR extend all combinations by one more piece. The
fullest combination that holds the longest piece left is taken out, as often as the counts of its lengths allow.

Only the number of pieces of each length, at most `size` numbers, goes to the driver. Each round leaves of one length less than the
combination held of it, at most half of what its last such round left; so a length ends at most log2(size / length) + 2 rounds,
all lengths of 2048 fewer than 8000, and a combination has fewer than 64 different lengths. That plan is the one thing that is
broadcast, and its size doesn't depend on the data. Pieces are numbered within their length by counts per slice
of the table, and the number says which bin and place is theirs.

Cases: a null text is the empty one (one piece, the closing id alone). Repeated rows are packed as documents of their own. A
null doc_id is carried along. Other columns are left out. An empty table gives an empty result.
"""

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.fast_words import giving_back
from seamline.llm.tables import texts
from seamline.session import written

SIZE = 2048
CLOSING = 0
#: Rows that number their pieces together; see `_numbered`.
SLICES = 256


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str):
    """Text -> ids, as the tokenizers library gives them for this vocabulary. Its merges are read as ranks of byte strings, for the
    faster library, which takes a text whole; a special token in it is one id, as there. That library gives up on a stretch of a
    million white-space characters; such texts go to the slower one."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    from seamline.llm.word_bpe import byte_characters

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    value = {c: b for b, c in enumerate(byte_characters())}
    specials = {t["content"]: t["id"] for t in whole["added_tokens"]}
    ranks = {bytes(value[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in specials}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)

    def ids(text: str) -> bytes:
        try:
            found = library.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            found = np.array(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
        return found.astype("<u4", copy=False).tobytes()

    return ids


def pieces(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (array): documents with their closing id, longer ones cut from their end."""
    return _cut(docs, size, path, True)


def _cut(docs, size, path, with_ids):
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    key = texts(docs).schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches):
        encode = byte_bpe(path)
        closing = np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py()) + closing
                total = len(ids) // 4
                first = total % size or size
                cuts = [0, *range(first, total + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[4 * a : 4 * b]
                    at.append(i)
                    rows.append((k, a, b - a, zlib.crc32(own), *([np.frombuffer(own, "<i4")] if with_ids else [])))
            columns = [*zip(*rows)] if rows else [[]] * (4 + with_ids)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names)

    return texts(docs).mapInArrow(giving_back(cut, byte_bpe), f"doc_id {key}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """The combination of available lengths that holds the longest one and fills `size` best: {length: times}."""
    order = sorted((n for n, c in counts.items() if c), reverse=True)
    longest = order[0]
    room = size - longest
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in order:
        left = counts[length] - (length == longest)
        if length > room or not left:
            continue
        take = 1
        while left > 0:  # 1, 2, 4, ... pieces at a time, as many as there are and fit
            take = min(take, left)
            wide = (reach | reach << (length * take)) & mask if length * take <= room else reach
            if wide != reach:
                steps.append((reach, length, take))
                reach = wide
            left -= take
            if length * take > room:
                break
            take *= 2
        if reach >> room & 1:
            break
    found, rest = {longest: 1}, reach.bit_length() - 1
    for before, length, take in reversed(steps):
        if not before >> rest & 1:
            found[length] = found.get(length, 0) + take
            rest -= length * take
    return found


def bin_plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """[(combination, how many bins have it)] for all pieces."""
    left, plan = dict(counts), []
    while any(left.values()):
        found = fullest(left, size)
        times = min(left[n] // k for n, k in found.items())
        for n, k in found.items():
            left[n] -= k * times
        plan.append((found, times))
    return plan


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` plus `number`: 0, 1, ... within each length. Rows count within slices of the table; the counts of the slices before
    are added. A slice of one length holds the rows of few files' worth, whatever share of the table that length has."""
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "start", "tag"), F.lit(SLICES)))
    counts = rows.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = counts.selectExpr("length", "slice", "sum(n) OVER (PARTITION BY length ORDER BY slice) - n AS base")
    inside = rows.selectExpr("*", "row_number() OVER (PARTITION BY length, slice ORDER BY tag) - 1 AS own")
    return inside.join(F.broadcast(before), ["length", "slice"]).withColumn("number", F.col("base") + F.col("own"))


def packed(docs: DataFrame, size: int = SIZE, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = written(_cut(docs, size, path, False).withColumn("tag", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    entries, base, used = [], 0, dict.fromkeys(counts, 0)
    for found, times in bin_plan(counts, size):
        offset = 0
        for length, k in found.items():
            entries.append((length, used[length], k, base, offset))
            used[length] += k * times
            offset += k * length
        base += times
    plan = docs.sparkSession.createDataFrame(entries, "length long, first long, times long, base long, place long")
    by_length = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "times", "base", "place"))).alias("entries"))
    placed = _numbered(rows).join(F.broadcast(by_length), "length")
    entry = F.expr("element_at(filter(entries, e -> e.first <= number), -1)")
    placed = placed.withColumn("e", entry).withColumn("k", F.col("number") - F.col("e.first"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("e.base") + F.expr("k div e.times")).alias("sequence_id"),
        (F.col("e.place") + F.pmod(F.col("k"), F.col("e.times")) * F.col("length")).alias("offset"),
    )
