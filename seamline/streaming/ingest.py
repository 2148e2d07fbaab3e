"""Segmenting transcripts as their files arrive."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from seamline import fixed_values as fixed
from seamline.operators.annotation import native_annotation
from seamline.operators.skew import skew_join
from seamline.plans.transcript import segment_transcripts
from seamline.sources.stores import stored_or_none
from seamline.sources.transcripts import BUCKETS, LINES, TRANSCRIPTS, bucket_of, exploded

SEGMENTS = (
    "transcript_id string, segment_id int, start_time double, end_time double, duration double, dominant_topic string, "
    "top_keywords array<string>, transcript string, batch bigint, bucket int"
)
UTTERANCES = TRANSCRIPTS + ", batch bigint, bucket int"
MANIFEST = "kind string, folder string, version bigint"


class TranscriptIngest:
    """Keeps utterances and segments under `path` up to date with a stream of utterances.

    Each micro-batch writes folders named by its own number and then a manifest of the folders that count, made from the
    manifest before it; a micro-batch that is run again replaces what it wrote. A transcript that gets further utterances is
    segmented anew as a whole, because they change its last batch; readers take the newest version of each transcript.
    Once more than `most` folders of a kind count, they are merged by bucket into one that holds only what is newest, so what is read is
    bounded by the live data and not by the number of micro-batches. Replaced folders are left for those who still read them.
    """

    def __init__(
        self, spark: SparkSession, path: str, size: int = fixed.BATCH_SIZE, annotate: Callable = native_annotation, buckets: int = BUCKETS, most: int = 8
    ):
        self.spark, self.path, self.size, self.annotate, self.buckets, self.most = spark, path, size, annotate, buckets, most

    def live_folders(self, kind: str, before: int | None = None) -> list[str]:
        """Folders of `kind` that count, as of the newest manifest (older than `before`); at most `most` + 1."""
        manifests = stored_or_none(self.spark, f"{self.path}/manifest", MANIFEST)
        if before is not None:
            manifests = manifests.filter(F.col("version") < before)
        newest = manifests.agg(F.max("version")).scalar()
        return [r.folder for r in manifests.filter((F.col("version") == newest) & (F.col("kind") == kind)).orderBy("folder").collect()]

    def _read(self, kind: str, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema + ", part string").option("basePath", f"{self.path}/{kind}")
        return reader.parquet(*[f"{self.path}/{kind}/{f}" for f in folders]).drop("part")

    def _write(self, rows: DataFrame, kind: str, folder: str) -> str:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{kind}/{folder}")
        return folder

    def _merged(self, kind: str, folders: list[str], number: int, schema: str, newest) -> list[str]:
        if len(folders) <= self.most:
            return folders
        return [self._write(newest(self._read(kind, folders, schema)).hint("rebalance", "bucket"), kind, f"part=merged-{number}")]

    def on_batch(self, arrived: DataFrame, number: int) -> None:
        placed = arrived.select("transcript_id", "seq", "content", "start", "end").withColumn("bucket", bucket_of("transcript_id", self.buckets))
        here = self._write(placed.withColumn("batch", F.lit(number).cast("long")), "utterances", f"part=batch-{number}")
        utterances = [*self.live_folders("utterances", number), here]
        touched = self._read("utterances", [here], UTTERANCES).select("bucket", "transcript_id").distinct()
        # The join on the folder column lets Spark skip the folders of transcripts that did not change.
        whole = self._read("utterances", utterances, UTTERANCES).join(touched, ["bucket", "transcript_id"], "left_semi")
        newest = _newest_utterances(whole).select("transcript_id", "seq", "content", "start", "end")
        segments = segment_transcripts(newest, self.size, self.annotate).withColumn("batch", F.lit(number).cast("long"))
        made = self._write(segments.withColumn("bucket", bucket_of("transcript_id", self.buckets)), "segments", f"part=batch-{number}")
        live = {
            "utterances": self._merged("utterances", utterances, number, UTTERANCES, _newest_utterances),
            "segments": self._merged("segments", [*self.live_folders("segments", number), made], number, SEGMENTS, _newest_segments),
        }
        rows = [(kind, folder) for kind, folders in live.items() for folder in folders]
        self.spark.createDataFrame(rows, "kind string, folder string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")

    def run(self, utterances: DataFrame) -> None:
        """Take in everything that is there now and stop; started again, only what came since."""
        query = (
            utterances.writeStream.foreachBatch(self.on_batch)
            .option("checkpointLocation", f"{self.path}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def segments(self) -> DataFrame:
        """The newest segments of every transcript."""
        return _newest_segments(self._read("segments", self.live_folders("segments"), SEGMENTS)).drop("batch", "bucket")


def _newest_utterances(versions: DataFrame) -> DataFrame:
    newest = versions.groupBy("bucket", "transcript_id", "seq").agg(F.max_by(F.struct("content", "start", "end", "batch"), "batch").alias("_u"))
    return newest.select("transcript_id", "seq", "_u.*", "bucket")


def _newest_segments(versions: DataFrame) -> DataFrame:
    newest = versions.groupBy("bucket", "transcript_id").agg(F.max("batch").alias("batch"))
    return skew_join(versions, newest, ["bucket", "transcript_id", "batch"], "left_semi", spread=["segment_id"]).select(*versions.columns)


def stream_transcript_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Utterances of JSON-lines transcript files as a stream."""
    reader = spark.readStream.schema(LINES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return exploded(reader.json(path))
