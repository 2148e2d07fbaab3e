"""Stored results: documents, analysed segments, answers, stage states and thumbnail lists.

Every write is a new folder named by the caller's run id, replaced as a whole if that run is repeated,
so a job that dies halfway and runs again leaves nothing twice. Thumbnail lists change; they are rewritten by buckets.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seamline.operators.intake import not_yet_done
from seamline.session import written
from seamline.sources.transcripts import BUCKETS, bucket_of

ANALYZED = ["video_id", "segment_id"]


def save_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Results documents as JSON, one per line."""
    documents.write.mode(mode).json(path)


def load_documents(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)


def stored_or_none(spark: SparkSession, path: str, schema) -> DataFrame:
    """What is stored at `path`; no rows if nothing is yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class AnswerStore:
    """Answers to requests by the hash of their content: a request is asked once, whatever run or batch it comes from."""

    SCHEMA = "request_id string, response string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _runs(self) -> DataFrame:
        return stored_or_none(self.spark, self.path, self.SCHEMA + ", run string")

    def load(self) -> DataFrame:
        return self._runs().drop("run")

    def answer(self, requests: DataFrame, ask, run: str) -> None:
        """Have `ask` (requests -> request_id, response) answer what no other run has answered, and add its answers as run `run`."""
        open_ones = not_yet_done(requests, self._runs().filter(F.col("run") != run), ["request_id"])
        answers = ask(open_ones).select("request_id", "response").filter("response IS NOT NULL")
        answers.write.mode("overwrite").parquet(f"{self.path}/run={run}")


class StageStates:
    """Which stages each project has passed, only ever added to; the latest entry counts."""

    SCHEMA = "project string, stage int, saved_at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        return stored_or_none(self.spark, self.path, self.SCHEMA + ", entry string").drop("entry")

    def record(self, projects: DataFrame, stage: int, run: str) -> None:
        """Note that these projects have passed `stage`."""
        noted = projects.select("project", F.lit(stage).alias("stage"), F.current_timestamp().alias("saved_at")).distinct()
        noted.write.mode("overwrite").parquet(f"{self.path}/entry={run}-{stage}")


class SegmentStore:
    """Analysed segments, added to as work gets done."""

    def __init__(self, spark: SparkSession, path: str, schema, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.buckets = spark, path, schema, buckets

    def _runs(self) -> DataFrame:
        placed = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])
        return stored_or_none(self.spark, self.path, placed)

    def load(self) -> DataFrame:
        return self._runs().drop("run", "bucket")

    def append_new(self, analyzed: DataFrame, run: str) -> None:
        """Add the segments that are not stored yet, as run `run`.

        Only folders of the buckets at hand are read, and of those only the keys.
        """
        placed = analyzed.withColumn("bucket", bucket_of("video_id", self.buckets))
        # At most `buckets` rows, whatever the data.
        at_hand = F.broadcast(placed.select("bucket").distinct())
        others = self._runs().filter(F.col("run") != run).join(at_hand, "bucket", "left_semi")
        fresh = not_yet_done(placed, others, ANALYZED)
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/run={run}")


class ThumbnailStore:
    """Thumbnail lists as Parquet by bucket of videos; a change rewrites the buckets of the videos it names and reads no others.

    What a bucket is to hold is worked out and stored first and then takes the place of its folder, so a reader sees the old list or
    the new one, and a step that dies and runs again changes nothing twice (entries of the same step are replaced). Each video that was ever
    changed keeps a row without an entry that says when.
    """

    FIELDS = {"path": "string", "time": "double", "url": "string", "index": "int", "source": "string"}
    SCHEMA = "video_id string, entry boolean, step bigint, saved_at timestamp, path string, time double, url string, index int, source string"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _stored(self) -> DataFrame:
        return stored_or_none(self.spark, self.path, self.SCHEMA + ", bucket int")

    def _change(self, rows: DataFrame, step: int, adds: bool, keeps: bool) -> None:
        columns = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in self.FIELDS.items()]
        mark = [F.lit(step).cast("long").alias("step"), F.current_timestamp().alias("saved_at")]
        videos = rows.select("video_id").distinct()
        changed = videos.select("video_id", F.lit(False).alias("entry"), *mark, *[F.lit(None).cast(t).alias(c) for c, t in self.FIELDS.items()])
        if adds:
            changed = changed.unionByName(rows.select("video_id", F.lit(True).alias("entry"), *mark, *columns))
        changed = changed.withColumn("bucket", bucket_of("video_id", self.buckets))
        # At most `buckets` rows, whatever the data.
        touched = F.broadcast(videos.select(bucket_of("video_id", self.buckets).alias("bucket")).distinct())
        held = self._stored().join(touched, "bucket", "left_semi")
        others = held.filter(F.col("step") != step)
        marks = others.filter("NOT entry").join(videos, "video_id", "left_anti")
        entries = others.filter("entry") if keeps else others.filter("entry").join(videos, "video_id", "left_anti")
        new = written(marks.unionByName(entries).unionByName(changed), "thumbnails")
        new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def append(self, thumbnails: DataFrame, step: int) -> None:
        self._change(thumbnails, step, adds=True, keeps=True)

    def replace(self, thumbnails: DataFrame, step: int) -> None:
        """Make these the whole list of every video they name."""
        self._change(thumbnails, step, adds=True, keeps=False)

    def clear(self, videos: DataFrame, step: int) -> None:
        self._change(videos.select("video_id"), step, adds=False, keeps=False)

    def thumbnails(self) -> DataFrame:
        """The current entries of every video."""
        return self._stored().filter("entry").select("video_id", *self.FIELDS)

    def last_updated(self) -> DataFrame:
        return self._stored().filter("NOT entry").select("video_id", F.col("saved_at").alias("last_updated"))
