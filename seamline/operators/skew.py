"""Joins and chunks that stay balanced when one key holds a large share of the rows.

A key counts as hot when it holds more than `1/HOT_SHARES` of all rows (and more than `min_rows`).
Fewer than HOT_SHARES keys can do so, whatever the data, which is what makes it safe to broadcast
the table of hot keys.
"""

from pyspark.sql import DataFrame, functions as F

from seamline.session import written

HOT_SHARES = 1000
HOT_MIN_ROWS = 1_000_000
CUTS = 255

SALT = "_salt"
RIGHT_SALT = "_right_salt"
CHUNK = "_chunk"
PART = "_part"


def hot_keys(df: DataFrame, keys, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Hot keys with `_fan`, the number of pieces that brings each below the limit (pieces sum to < 2*HOT_SHARES)."""
    limit = df.agg(F.greatest(F.lit(min_rows), F.count(F.lit(1)) / HOT_SHARES)).scalar()
    sized = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return sized.filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_fan"))


def skew_join(
    left: DataFrame, right: DataFrame, keys, how="inner", spread=None, right_spread=None, min_rows=HOT_MIN_ROWS
) -> DataFrame:
    """Equi-join in which hot keys of `left` are spread over several tasks and their `right` rows repeated.

    `spread` names the columns that tell left rows of one key apart (default: all of them). The spread
    is a hash, so a task that is run again sends its rows to the same place. `how` may be inner, left,
    left_semi or left_anti. `right_spread` (inner joins only) does the same for hot keys of `right`.
    """
    if right_spread and how != "inner":
        raise ValueError("right_spread needs an inner join")
    salted, repeated = _salted(left, right, keys, spread or left.columns, SALT, min_rows)
    salts = [SALT]
    if right_spread:
        repeated, salted = _salted(right, left, keys, right_spread, RIGHT_SALT, min_rows, (repeated, salted))
        salts.append(RIGHT_SALT)
    return salted.join(repeated, [*keys, *salts], how).drop(*salts)


def _salted(judged, other, keys, spread, salt, min_rows, onto=None):
    """Both sides of a join with `salt`: a hash on the side judged for hot keys, every value on the other one."""
    judged_onto, other_onto = onto or (judged, other)
    hot = F.broadcast(hot_keys(judged, keys, min_rows))
    fan = F.coalesce("_fan", F.lit(1))
    place = F.when(F.col("_fan").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), fan).cast("int"))
    hashed = judged_onto.join(hot, keys, "left").withColumn(salt, place).drop("_fan")
    every = other_onto.join(hot, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
    return hashed, every


def crowded_cuts(placed: DataFrame, place, order: str, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """(place, _cuts): the quantiles of `order` at which to cut places crowded with rows; bounded as hot keys are.

    Stored, because quantiles are approximate: everything that is cut by them has to be cut at the same values.
    """
    narrow = placed.select(*place, order)
    quantiles = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    crowded = narrow.join(F.broadcast(hot_keys(narrow, place, min_rows)), list(place))
    return written(crowded.groupBy(*place).agg(F.percentile_approx(order, quantiles, 10 * (CUTS + 1)).alias("_cuts")), "cuts")


def chunk_of(order: str, width):
    return F.floor(F.col(order) / width).cast("long")


def cuts_before(order: str):
    """How many of the chunk's cuts lie before `order`; 0 where the chunk has none."""
    return F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(order))))


def in_chunks(df: DataFrame, keys, order: str, width, split_hot: bool, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Add `_chunk` (a fixed range of `order`) and `_part` (a piece of it), both increasing with `order`.

    For integer positions that are unique per key a chunk holds at most `width` rows and needs no
    splitting. For times, `split_hot` cuts hot chunks at quantiles of their own values.
    """
    chunked = df.withColumn(CHUNK, chunk_of(order, width))
    if not split_hot:
        return chunked.withColumn(PART, F.lit(0))
    cuts = F.broadcast(crowded_cuts(chunked, [*keys, CHUNK], order, min_rows))
    return chunked.join(cuts, [*keys, CHUNK], "left").withColumn(PART, cuts_before(order)).drop("_cuts")
