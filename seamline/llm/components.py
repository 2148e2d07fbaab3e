"""Connected components of a table of links, by large and small stars; nothing is gathered on the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.tables import small_side
from seamline.session import written


def _are_stars(links: DataFrame) -> bool:
    """Whether every node of `links` (a, b) with a > b either has one smaller neighbour and no other, or no smaller one."""
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("n")), F.struct(F.col("b").alias("node"), F.lit(0).alias("n")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.sum("e.n").alias("n"), F.min("e.n").alias("least"))
    return not seen.filter("n > 1 OR n > 0 AND least = 0").take(1)


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Every node sends its smallest neighbour (or itself) to its larger (smaller) neighbours. `links`: (a, b) with a > b, some
    perhaps more than once."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("near"))
    if large:
        both = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("e")).select("e.*")
    least = both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least"))
    out = both.join(least, "node")
    if large:
        found = out.filter("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))
    else:
        found = out.select(F.explode(F.array("near", "node")).alias("a"), F.col("least").alias("b"))
    return found.filter("a <> b")


def roots(links: DataFrame) -> DataFrame:
    """(node, root): for every node of `links` (a, b) with another node smaller than it in its component, the smallest one. Each
    half of a round is stored, so a lost executor costs no more than that, and no half is worked out twice."""
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    while not _are_stars(links):
        links = written(_star(written(_star(links, True), "large-stars"), False).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def with_roots(rows: DataFrame, roots_of: DataFrame, node: str = "node") -> DataFrame:
    """`rows` plus `root`: that of its node, or the node itself."""
    side = small_side(roots_of.select(F.col("node").alias("_node"), F.col("root").alias("_root")))
    joined = rows.join(side, F.col(node) == F.col("_node"), "left")
    return joined.select(*rows.columns, F.coalesce("_root", node).alias("root"))
