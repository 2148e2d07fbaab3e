"""Joining timed rows to the spans of time that contain them."""

from pyspark.sql import Column, DataFrame, functions as F

from seamline.operators.skew import HOT_MIN_ROWS, PART, crowded_cuts, cuts_before, skew_join

#: Stretches of a level are this many times as long as those of the level below.
RADIX = 8
#: The highest level with stretches of a length; above it there is one stretch without ends.
TOP = 15
LEVEL = "_level"
STRETCH = "_stretch"


def _length(level: Column, width: float) -> Column:
    return width * F.pow(F.lit(float(RADIX)), level)


def _stretch(time: Column, level: Column, width: float) -> Column:
    """The number of the stretch of `level` that holds `time`; above the top level there is only number 0."""
    return F.when(level > TOP, F.lit(0)).otherwise(F.floor(time / _length(level, width))).cast("long")


def _level(start: Column, end: Column, width: float) -> Column:
    """The lowest level at which the span touches at most RADIX + 1 stretches; spans that are open or reach very far go above the top."""
    far = width * float(RADIX) ** TOP
    steps = F.greatest((end - start) / (width * RADIX), F.lit(1.0))
    near = (F.abs(start) < far) & (F.abs(end) < far)
    return F.when(near, F.least(F.ceil(F.log(steps) / F.log(F.lit(float(RADIX)))), F.lit(TOP))).otherwise(TOP + 1).cast("int")


def interval_join(
    points: DataFrame, spans: DataFrame, keys, time, start, end, width, closed=False, spread=None, min_rows=HOT_MIN_ROWS
) -> DataFrame:
    """Pairs of a point and a span of the same key with start <= time < end (`closed`: <= end).

    Time is cut into stretches of `width` seconds, of 8 times that, 64 times, and so on; a span goes to the level at which
    it touches at most 9 of them, so its rows don't grow with its length, and a point meets only spans about as long as the
    stretch. A point looks up its stretch at every level that has spans (at most 17; one, if all last less than 8 `width`), and this is an
    equi-join on (key, level, stretch). Ends may be infinite: such spans meet all points of their key. Spans that end before they start and rows with a null or NaN
    time join nothing. Stretches crowded with points are cut at quantiles, fixed in a stored table, and spans go only to the pieces they touch. Copies of
    one instant or of one span, which no cut tells apart, are spread over several tasks.
    """
    place = [*keys, LEVEL, STRETCH]
    far = width * float(RADIX) ** TOP
    a, b, at = F.col(start).cast("double"), F.col(end).cast("double"), F.col(time).cast("double")
    leveled = spans.filter((a <= b) & ~F.isnan(a) & ~F.isnan(b)).withColumn(LEVEL, _level(a, b, width))
    used = leveled.agg(F.sort_array(F.collect_set(LEVEL))).scalar()
    known = points.filter(at.isNotNull() & ~F.isnan(at)).withColumn(LEVEL, F.explode(used))
    within_reach = (F.col(LEVEL) > TOP) | (F.abs(at) <= far)
    placed = known.filter(within_reach).withColumn(STRETCH, _stretch(at, F.col(LEVEL), width))
    touched = F.sequence(_stretch(a, F.col(LEVEL), width), _stretch(b, F.col(LEVEL), width))
    covering = leveled.withColumn(STRETCH, F.explode(touched))
    cuts = F.broadcast(crowded_cuts(placed, place, time, min_rows))
    placed = placed.join(cuts, place, "left").withColumn(PART, cuts_before(time)).drop("_cuts")
    pieces = F.sequence(cuts_before(start), cuts_before(end))
    covering = covering.join(cuts, place, "left").withColumn(PART, F.explode(pieces)).drop("_cuts")
    pairs = skew_join(placed, covering, [*place, PART], spread=spread, right_spread=spans.columns, min_rows=min_rows)
    ends = (F.col(time) <= F.col(end)) if closed else (F.col(time) < F.col(end))
    return pairs.filter((F.col(start) <= F.col(time)) & ends).drop(LEVEL, STRETCH, PART)
