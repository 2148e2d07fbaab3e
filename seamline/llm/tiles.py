"""All pairs within groups of any size, as tiles: blocks of members against blocks of members.

The members of a group are dealt to blocks of a bounded weight by a hash; each goes to the tiles of its block with every block of the
group. A tile is compared inside a task, as matrices, and gives out only what it found, so no row ever stands for a pair. Tiles of
one group lie in different tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.tables import small_side
from seamline.session import written

TILE = ["bucket", "low", "high"]


def tiles(members: DataFrame, weight: Column) -> DataFrame:
    """`members` (bucket, node, ...) sorted into tiles: adds block, low and high. `weight`: a member's share of a block."""
    blocks = members.groupBy("bucket").agg(F.greatest(F.ceil(F.sum(weight)), F.lit(1)).cast("int").alias("_blocks"))
    larger = small_side(written(blocks.filter("_blocks > 1"), "larger-buckets"))
    dealt = members.join(larger, "bucket", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    met = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = met.withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other")).drop("_other", "_blocks")
    return placed.repartition(*TILE).sortWithinPartitions(*TILE)


def tile_by_tile(compare, columns):
    """The body of a `mapInArrow` over `tiles`: `compare` (a table of one tile, left rows, right rows) gives the arrays of `columns`, or None.

    In a tile of a block with itself left and right are the same rows.
    """

    def one(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        block = table.column("block").to_numpy()
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        found = compare(table, left, right) if len(left) and len(right) and table.num_rows > 1 else None
        return None if found is None else pa.RecordBatch.from_arrays(found, columns)

    def run(batches):
        held, last = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in TILE])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(keys[:, a])
                if key != last and held:
                    if (found := one(held)) is not None:
                        yield found
                    held = []
                last = key
                held.append(batch.slice(a, b - a))
        if held and (found := one(held)) is not None:
            yield found

    return run
