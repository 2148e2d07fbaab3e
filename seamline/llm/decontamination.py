"""Passages of a benchmark in documents, found by a multi-pattern search over words (`word_search`).

Every 10 consecutive words of an item are a window (an item of fewer words, but not none, is one window). Windows are made on Spark
and dealt by a hash of their words into slices of a bounded number of rows (window, item). A slice is gathered, made into search tables and
sent to every task; a pass over the documents, which don't move, then searches whole texts. Nearly every benchmark is one slice:
then nothing of the documents is shuffled. With more, documents are stored with a number, each slice is a pass, and what was found is
grouped by document.

Cases: a null text has no words, like an empty one. Rows of documents, repeated ones too, stand for themselves; a null doc_id is carried
along. Rows of one item_id are one item with several texts. A text without an item_id is searched for like any other and its
words count as hit, but there is no item to name. Texts of any length are read slab by slab. Without any window, nothing is hit; no
documents give no rows. Other columns, whatever their names, are left out. The items of one document are a cell, and a window's items are
in one slice however many they are.
"""

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seamline.llm.tables import texts
from seamline.llm.word_search import WordSearch
from seamline.session import written

WINDOW = 10
#: Rows (window, item) in one slice: some 100 MB of search tables in a task.
SLICE = 100_000
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPANS = "array<struct<start:long,end:long>>"


def windows(items: DataFrame, length: int = WINDOW) -> DataFrame:
    """item_id, window (its words with blanks between): the different windows of each item."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORDS), F.lit(0))
    listed = items.select("item_id", words.alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - length + 1, F.lit(1)))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(length)), " "))
    return listed.select("item_id", F.explode(cut).alias("window")).distinct()


def _tables(rows: list) -> tuple[WordSearch, list]:
    """The search tables of a slice, and the items of each of its windows."""
    known = [(window, [r["item_id"] for r in own if r["item_id"] is not None]) for window, own in groupby(sorted(rows, key=lambda r: r["window"]), key=lambda r: r["window"])]
    return WordSearch(window.encode().split() for window, _ in known), [items for _, items in known]


def _search(tables, item_type):
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        search, items_of = tables.value
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("text"):
                n, hit, numbers = search.spans(text.as_py())
                counts.append(n)
                spans.append([{"start": a, "end": b} for a, b in hit])
                items.append(sorted({i for number in numbers for i in items_of[number]}))
            made = [pa.array(counts, pa.int64()), pa.array(spans, spans_type), pa.array(items, pa.list_(item_type))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *made], ["row", "doc_id", "n_words", "spans", "items"])

    return run


def _merged(spans: Column) -> Column:
    """Sorted spans [start, end), joined where they touch or overlap."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    longer = lambda acc, s: F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))
    joined = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer(acc, s)))
    return F.aggregate(F.sort_array(spans), F.array().cast(_SPANS), lambda acc, s: F.when(last(acc)["end"] >= s["start"], joined(acc, s)).otherwise(F.concat(acc, F.array(s))))


def contaminated(docs: DataFrame, items: DataFrame, length: int = WINDOW, slice_rows: int = SLICE) -> DataFrame:
    """Per document: doc_id, n_words, spans ([start, end) of words inside an occurrence, merged) and items (the sorted item_ids that occur)."""
    spark, item_kind = docs.sparkSession, items.schema["item_id"].dataType
    pairs = written(windows(items, length), "windows")
    slices = max(1, -(-pairs.count() // slice_rows))
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    if slices > 1:
        rows = written(rows, "documents")
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, spans {_SPANS}, items array<{item_kind.simpleString()}>"
    item_type = to_arrow_type(item_kind)
    found = None
    for at in range(slices):
        own = pairs.filter(F.pmod(F.xxhash64("window"), F.lit(slices)) == at)
        tables = spark.sparkContext.broadcast(_tables(own.collect()))
        one = rows.select("row", "doc_id", "text").mapInArrow(_search(tables, item_type), schema)
        if slices > 1:  # stored, so that the tables of one slice are gone before those of the next come
            one = written(one, "found")
            tables.destroy()
        found = one if found is None else found.unionByName(one)
    if slices > 1:
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return found.select("doc_id", "n_words", "spans", "items")


def digests(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    named = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
