"""Reading and writing transcripts and speech-recognition responses."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seamline.operators.ordered import numbered

UTTERANCE = "struct<content:string,start:double,end:double>"
ASR = "transcript_id string, results struct<utterances: array<struct<transcript:string,start:double,end:double>>>"
LINES = f"transcript_id string, first bigint, utterances array<{UTTERANCE}>"
TRANSCRIPTS = "transcript_id string, seq bigint, content string, start double, end double"
BUCKETS = 256


def bucket_of(key: str, buckets: int = BUCKETS):
    """Folder number of a key: many keys share a folder, so folders stay few however many keys there are."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def exploded(arrays: DataFrame) -> DataFrame:
    """One row per array element; its place, counted from `first` if there is such a column, becomes `seq`."""
    first = F.coalesce("first", F.lit(0)) if "first" in arrays.columns else F.lit(0)
    return arrays.select("transcript_id", first.alias("_first"), F.posexplode("utterances").alias("_at", "_u")).select(
        "transcript_id", (F.col("_first") + F.col("_at")).cast("long").alias("seq"), "_u.content", "_u.start", "_u.end"
    )


def parse_transcripts(texts: DataFrame) -> DataFrame:
    """(transcript_id, value) with a JSON array of {content, start, end} to utterances."""
    listed = texts.filter(_problem().isNull()).select("transcript_id", F.from_json("value", f"array<{UTTERANCE}>").alias("utterances"))
    return exploded(listed)


def transcript_texts(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """(transcript_id, value) of JSON files with such `names`, one transcript each, anywhere below `path`; read whole because the array's order is the time order.

    A transcript goes by the path of its file, because files of different projects have the same name.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", names).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("transcript_id"), "value")


def project_of(path: Column) -> Column:
    """The folder that holds a transcript's file: its project."""
    return F.element_at(F.split(path, "/"), -2)


def read_transcript_files(spark: SparkSession, path: str, names: str = "*.json") -> DataFrame:
    """The utterances of all files of `transcript_texts`; those it can't read are in `transcript_defects`."""
    return parse_transcripts(transcript_texts(spark, path, names))


def _problem() -> Column:
    listed = F.from_json("value", f"array<{UTTERANCE}>")
    unlike = listed.isNull() | F.exists(listed, lambda u: u.isNull() | (u["content"].isNull() & u["start"].isNull() & u["end"].isNull()))
    return F.when(F.coalesce(unlike, F.lit(True)), "not an array of utterances").when(F.size(listed) == 0, "no utterances")


def transcript_defects(texts: DataFrame) -> DataFrame:
    """(transcript_id, problem): texts that are not an array of utterances, or an empty one."""
    return texts.select("transcript_id", _problem().alias("problem")).filter(F.col("problem").isNotNull())


def read_transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """Many transcripts per file: a JSON object {transcript_id, utterances: [...]} per line.

    A transcript may come as several lines, each with the position of its `first` utterance.
    """
    return exploded(spark.read.schema(LINES).json(path))


def write_transcript_lines(utterances: DataFrame, path: str, mode: str = "errorifexists", part: int | None = None) -> None:
    """The form `read_transcript_lines` reads: a line for each transcript, or, if `part` is given, for each `part` utterances of it."""
    entry = F.struct("_rn", F.struct("content", "start", "end").alias("u"))
    place = F.expr(f"(_rn - 1) div {part}") if part else F.lit(0).cast("long")
    placed = numbered(utterances, ["transcript_id"], "seq", "_rn").withColumn("_part", place)
    listed = placed.groupBy("transcript_id", "_part").agg(F.sort_array(F.collect_list(entry)).alias("_all"))
    lines = listed.select(
        "transcript_id", (F.col("_part") * (part or 0)).alias("first"), F.transform("_all", lambda e: e["u"]).alias("utterances")
    )
    lines.write.mode(mode).json(path)


def read_asr(spark: SparkSession, path: str) -> DataFrame:
    """Raw speech-recognition responses, one JSON object per line, other fields left out."""
    return spark.read.schema(ASR).json(path)


def flatten_asr(responses: DataFrame) -> DataFrame:
    """Responses to utterances: `transcript` becomes `content`."""
    return responses.select("transcript_id", F.posexplode("results.utterances").alias("seq", "_u")).select(
        "transcript_id",
        F.col("seq").cast("long").alias("seq"),
        F.col("_u.transcript").alias("content"),
        "_u.start",
        "_u.end",
    )


def save_transcripts(utterances: DataFrame, path: str, mode: str = "overwrite", buckets: int = BUCKETS) -> None:
    """Processed transcripts as Parquet, in folders by transcript bucket."""
    utterances.withColumn("bucket", bucket_of("transcript_id", buckets)).write.mode(mode).partitionBy("bucket").parquet(path)


def save_raw_responses(responses: DataFrame, path: str, mode: str = "overwrite") -> None:
    responses.write.mode(mode).json(path)


def load_transcripts(spark: SparkSession, path: str, buckets_wanted=None) -> DataFrame:
    """Saved transcripts; `buckets_wanted` prunes the folders read."""
    stored = spark.read.schema(TRANSCRIPTS + ", bucket int").parquet(path)
    if buckets_wanted is not None:
        stored = stored.filter(F.col("bucket").isin(list(buckets_wanted)))
    return stored.drop("bucket")
