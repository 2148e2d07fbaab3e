"""Exact deduplication by two Bloom passes, in DataFrame operations only.

Pass one sets the bits of every row's hash in two filters: the bits hit at all are implied by the rows themselves, the bits
hit at least twice are kept, as 64-bit words. Pass two looks every row up in the kept filter. A row with an unset bit is the
only one of its text and passes straight through; the other rows, and only those, are grouped by their SHA-256.
A false hit of the filter costs the shuffle of a row, never a wrong result.

Cases: a null text equals the empty text. Null doc_ids are smaller than any other. Of rows with equal text and equal doc_id one
stays. An empty table gives an empty result. Other columns are carried by `keep_one` and ignored by `copies`.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.tables import small_side
from seamline.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_ROW = 16
PROBES = 2


def normalised(text: Column) -> Column:
    """`text` with A-Z in lower case and nothing else changed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _probes(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)) for i in range(PROBES)]


def repeated_bits(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(word, set_bits): the bits that at least two rows of `keys` hit, 64 to a word. Hits are counted before they are sent."""
    hits = keys.select(F.explode(F.array_distinct(F.array(*_probes(key, bits)))).alias("at"))
    twice = hits.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("set_bits"))


def with_suspicion(rows: DataFrame, key: str, repeated: DataFrame, bits: int) -> DataFrame:
    """`rows` plus `suspect`: whether all bits of its key were hit at least twice. `repeated`: a stored result of `repeated_bits`."""
    side, names, found = small_side(repeated), rows.columns, []
    for i, at in enumerate(_probes(key, bits)):
        rows = rows.withColumn(f"_at{i}", at)
        own = side.select(F.col("word").alias(f"_word{i}"), F.col("set_bits").alias(f"_bits{i}"))
        rows = rows.join(own, F.shiftright(f"_at{i}", 6) == F.col(f"_word{i}"), "left")
        found.append(F.coalesce(F.expr(f"bit_get(_bits{i}, cast(_at{i} & 63 as int)) = 1"), F.lit(False)))
    suspect = found[0]
    for one in found[1:]:
        suspect = suspect & one
    return rows.select(*names, suspect.alias("suspect"))


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, tag), stored: one narrow row per document; the tag tells rows of one doc_id apart."""
    rows = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    return written(rows.withColumn("tag", F.monotonically_increasing_id()), "hashed")


def _filter(keys: DataFrame) -> tuple[DataFrame, int]:
    bits = max(64, BITS_PER_ROW * keys.count())
    return written(repeated_bits(keys, "text_sha256", bits), "repeated-bits"), bits


def copies(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of its text), group_size, kept, text_sha256."""
    keys = hashed(docs)
    rows = with_suspicion(keys, "text_sha256", *_filter(keys))
    single = rows.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    suspects = rows.filter("suspect").drop("suspect")
    groups = suspects.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "tag")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    several = suspects.join(small_side(written(groups, "groups")), "text_sha256").select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("tag") == F.col("top.tag")).alias("kept"), "text_sha256")
    return single.unionByName(several)


def repeated_texts(docs: DataFrame) -> DataFrame:
    """(text_sha256), stored: the hashes of texts that several rows have. Only hashes are looked up and only suspects are shuffled."""
    keys = hashed(docs).select("text_sha256")
    suspects = with_suspicion(keys, "text_sha256", *_filter(keys)).filter("suspect")
    return written(suspects.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_sha256"), "repeated-texts")


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` without copies: of equal texts the row with the largest doc_id. All columns of `docs`, and only those, come back. Texts meet
    the hashes found to repeat, one for each group of copies, and nothing else; what isn't among them passes straight through."""
    names = docs.columns
    several = small_side(repeated_texts(docs)).select("text_sha256", F.lit(True).alias("several"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    whole = whole.join(several, "text_sha256", "left")
    best = whole.filter("several").groupBy("text_sha256").agg(F.max_by("row", F.struct("row.doc_id", "row.text")).alias("row"))
    kept = whole.filter("several IS NULL").select("row").unionByName(best.select("row"))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
