"""Running totals, positions and carried-forward values in order within a key.

A window over a whole key would put that key into one task. Here every key is cut into chunks of
consecutive rows: one window works inside the chunks, others only over one summary row per
chunk, and the two are added by an equi-join on the chunk. The rows themselves are shuffled once.
Where rows lie so far apart that nearly every one has a chunk of its own, summaries are as many as rows;
so they are scanned in blocks of 2^24 chunk numbers the same way, and only blocks are scanned by key.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from seamline.operators.skew import CHUNK, HOT_MIN_ROWS, PART, in_chunks, skew_join
from seamline.session import written

POSITIONS = 65_536
SECONDS = 600.0
BLOCK_BITS = 24
BLOCK = "_block"
AT = ["_hash", "_at"]


def at_place(place):
    """`AT`: the columns of `place` as one that is never null, after its hash, which decides nearly every comparison of a sort.

    Windows and plain equi-joins on `AT` lie alike, so rows are shuffled once for both, and null equals null. Worth its bytes where
    rows hold texts; narrow rows take less with `same_place`.
    """
    return dict(zip(AT, (F.xxhash64(*place), F.struct(*place))))


def same_place(left: DataFrame, right: DataFrame, place) -> DataFrame:
    """Equi-join on `place` in which null equals null, so rows without a key or an order stay."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in place})
    alike = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in place]
    return left.join(renamed, alike).drop(*[f"_r_{c}" for c in place])


def scanned_before(chunks: DataFrame, keys, combined, together, totals=None) -> DataFrame:
    """(keys, _chunk, _part, ...): what all earlier chunks of the key hold, for every chunk.

    `combined` (name -> column of `chunks`) are the results wanted, `together` the aggregate that combines columns. `totals` (name ->
    column) are added, combined over the whole key.
    """
    blocks = chunks.withColumn(BLOCK, F.shiftright(CHUNK, BLOCK_BITS))
    place = [*keys, BLOCK]
    columns = list({*combined.values(), *(totals or {}).values()})
    order = F.struct(CHUNK, PART)
    inside = W.partitionBy(*place).orderBy(CHUNK, PART).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    by_block = blocks.groupBy(*place).agg(*[together(c, order).alias(c) for c in columns]).select(
        *place,
        *[together(c).over(across).alias(f"_earlier_{name}") for name, c in combined.items()],
        *[together(c).over(W.partitionBy(*keys)).alias(name) for name, c in (totals or {}).items()],
    )
    here = blocks.select(*place, CHUNK, PART, *[together(c).over(inside).alias(f"_here_{name}") for name, c in combined.items()])
    return same_place(here, by_block, place)


def _sum(column, order=None):
    return F.sum(column)


def _last(column, order=None):
    """The last value that isn't null: of a window's rows, or in `order` of a group's."""
    return F.last(column, True) if order is None else F.max_by(column, F.when(F.col(column).isNotNull(), order))


def running_totals(
    df: DataFrame, keys, order, sums, totals=None, width=POSITIONS, ties=(), split_hot=False, min_rows=HOT_MIN_ROWS
) -> DataFrame:
    """Add, per entry of `sums` (name -> value), the sum of the value over this and all earlier rows of the key.

    `totals` (name -> an entry of `sums`) adds sums over the whole key; they come with the chunk totals.
    """
    totals = totals or {}
    rows = in_chunks(df, keys, order, width, split_hot, min_rows)
    place = [*keys, CHUNK, PART]
    rows = rows.withColumns({f"_value_{name}": value for name, value in sums.items()}).withColumns(at_place(place))
    chunks = rows.groupBy(*place).agg(*[F.sum(f"_value_{name}").alias(f"_sum_{name}") for name in sums])
    sums_of = {name: f"_sum_{name}" for name in sums}
    scanned = scanned_before(chunks, keys, sums_of, _sum, {total: sums_of[name] for total, name in totals.items()})
    both = lambda name: F.coalesce(f"_here_{name}", F.lit(0)) + F.coalesce(f"_earlier_{name}", F.lit(0))
    before = scanned.withColumns(at_place(place)).select(*AT, *[both(name).alias(f"_before_{name}") for name in sums], *totals)
    inside = W.partitionBy(*AT).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    local = rows.withColumns({f"_inside_{name}": F.sum(f"_value_{name}").over(inside) for name in sums})
    return local.join(before, AT).select(
        *df.columns,
        *[(F.col(f"_inside_{name}") + F.col(f"_before_{name}")).alias(name) for name in sums],
        *totals,
    )


def numbered(df: DataFrame, keys, order, out, total=None, width=POSITIONS) -> DataFrame:
    """Add `out`, the 1-based dense position in `order` (unique integers per key), and optionally the row count."""
    one = F.lit(1).cast("long")
    return running_totals(df, keys, order, {out: one}, {total: out} if total else None, width)


def carry_forward(
    df: DataFrame, keys, order, value, out, width=POSITIONS, ties=(), current=True, split_hot=False, min_rows=HOT_MIN_ROWS
) -> DataFrame:
    """Add `out`, the latest non-null `value` at this row or before it (`current=False`: strictly before it)."""
    rows = in_chunks(df.withColumn("_value", value), keys, order, width, split_hot, min_rows)
    place = [*keys, CHUNK, PART]
    rank = F.struct(order, *ties) if ties else F.col(order)
    lasts = rows.groupBy(*place).agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), rank)).alias("_last")
    )
    scanned = scanned_before(lasts, keys, {"last": "_last"}, _last)
    carried = scanned.select(*place, F.coalesce("_here_last", "_earlier_last").alias("_carried"))
    inside = W.partitionBy(*place).orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0 if current else -1)
    return (
        same_place(rows.withColumn("_inside", F.last("_value", True).over(inside)), carried, place)
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop(CHUNK, PART, "_value", "_inside", "_carried")
    )


def asof_join(
    left: DataFrame, right: DataFrame, keys, left_time, right_time, payload, out, ties=None, width=SECONDS,
    min_rows=HOT_MIN_ROWS,
) -> DataFrame:
    """Add to each left row `out`: `payload` of the last right row at or before `left_time`, null if there is none.

    Both sides are first reduced to distinct instants, so many rows at one instant cost one row in the
    ordered pass; chunks crowded with distinct instants are cut at quantiles. The instants are stored
    once, because sizing the chunks, summing them up and the pass itself all read them.
    """
    moments = left.select(*keys, F.col(left_time).alias("_t")).distinct().withColumn("_payload", F.lit(None))
    found = right.groupBy(*keys, F.col(right_time).alias("_t")).agg(
        F.max_by(F.struct(*payload), F.struct(*payload) if ties is None else ties).alias("_payload")
    )
    both = written(found.withColumn("_asked", F.lit(0)).unionByName(moments.withColumn("_asked", F.lit(1))), "instants")
    answered = carry_forward(
        both, keys, "_t", F.col("_payload"), out, width, ties=["_asked"], split_hot=True, min_rows=min_rows
    ).filter("_asked = 1")
    return skew_join(
        left.withColumn("_t", F.col(left_time)), answered.select(*keys, "_t", out), [*keys, "_t"], "left", min_rows=min_rows
    ).drop("_t")
