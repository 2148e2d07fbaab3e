"""Array helpers built from Spark's higher-order functions."""

from pyspark.sql import Column, functions as F


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`; a lambda variable is never re-expanded per element."""
    return F.transform(F.array(value), body)[0]


def runs(ordered: Column) -> Column:
    """Run-length encode a sorted array into array<struct<value, n>> in one linear pass."""

    def encode(xs):
        last = F.size(xs)
        starts = F.filter(
            F.sequence(F.lit(1), last),
            lambda i: (i == 1) | (F.get(xs, i - 1) != F.get(xs, i - 2)),
        )
        return bind(
            starts,
            lambda at: F.transform(
                at,
                lambda i, k: F.struct(
                    F.get(xs, i - 1).alias("value"),
                    (F.coalesce(F.get(at, k + 1), last + 1) - i).alias("n"),
                ),
            ),
        )

    return bind(ordered, lambda xs: F.when(F.size(xs) > 0, encode(xs)))


def joined_in_order(pairs: Column, field: str, separator: str) -> Column:
    """Join one field of a collected array of structs after sorting the structs naturally."""
    return F.array_join(F.transform(F.sort_array(pairs), lambda p: p[field]), separator)
