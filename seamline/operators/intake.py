"""Deciding what a given input is and which work is still to be done."""

from pyspark.sql import Column, DataFrame, functions as F

from seamline import fixed_values as fixed
from seamline.operators.skew import HOT_MIN_ROWS, skew_join


def is_video_url(path: Column) -> Column:
    return path.rlike(fixed.VIDEO_URL)


def base_name(path: Column) -> Column:
    """Project base name: `yt_` and the video id for a video URL, else the file name without its last ending."""
    short = F.substring_index(path, "youtu.be/", -1)
    long = F.substring_index(F.substring_index(path, "v=", -1), "&", 1)
    video = F.concat(F.lit("yt_"), F.when(F.contains(path, F.lit("youtu.be/")), short).otherwise(long))
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")
    return F.when(is_video_url(path), video).otherwise(stem)


def _ends(path: Column, endings) -> Column:
    found = F.lit(False)
    for ending in endings:
        found = found | F.lower(path).endswith(ending)
    return found


def route_inputs(inputs: DataFrame, listing: DataFrame, min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Kind of each input (url, image, video, transcript) or the reason it is refused.

    `inputs` has path and analyze_screenshot, `listing` the paths that exist.
    """
    path, shot = F.col("path"), F.col("analyze_screenshot")
    url = is_video_url(path)
    seen = listing.select("path").distinct().withColumn("_exists", F.lit(True))
    image, media = _ends(path, fixed.IMAGE_ENDINGS), _ends(path, fixed.MEDIA_ENDINGS)
    error = (
        F.when(url, None)
        .when(F.col("_exists").isNull(), F.concat(F.lit(fixed.NOT_FOUND), path))
        .when(shot & ~image, fixed.BAD_IMAGE)
        .when(~shot & ~media, fixed.BAD_MEDIA)
    )
    kind = (
        F.when(url, "url")
        .when(F.col("error").isNotNull(), None)
        .when(shot, "image")
        .when(_ends(path, [".json"]), "transcript")
        .otherwise("video")
    )
    joined = skew_join(inputs, seen, ["path"], "left", min_rows=min_rows)
    return joined.withColumn("error", error).withColumn("kind", kind).withColumn("is_url", url).drop("_exists")


def not_yet_done(work: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Work whose keys are not among those already done."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def projects_before_stage(projects: DataFrame, states: DataFrame, stage: int) -> DataFrame:
    """Projects whose latest saved stage is below `stage`; a project without one has done nothing."""
    latest = states.groupBy("project").agg(F.max_by("stage", F.struct("saved_at", "stage")).alias("stage"))
    return (
        projects.join(latest, "project", "left")
        .withColumn("stage", F.coalesce("stage", F.lit(-1)))
        .filter(F.col("stage") < stage)
    )


def latest_projects(bases: DataFrame, projects: DataFrame) -> DataFrame:
    """For each base_name the newest project whose name starts with it and an underscore (null if none).

    A project is filed under each of its prefixes that end before an underscore, so this is an
    equi-join and a longer base name's projects are found under the shorter one too.
    """
    parts = F.split("project", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    newest = (
        projects.filter(F.size(parts) > 1)
        .withColumn("base_name", F.explode(prefixes))
        .groupBy("base_name")
        .agg(F.max_by("project", F.struct("created", "project")).alias("project"))
    )
    return bases.join(newest, "base_name", "left")


def best_thumbnails(videos: DataFrame, availability: DataFrame) -> DataFrame:
    """URL of the best available thumbnail of each video_key, null if none is available."""
    qualities = F.array(*[F.lit(q) for q in fixed.THUMBNAIL_QUALITIES])
    ranked = availability.filter("available").withColumn("_rank", F.array_position(qualities, F.col("quality")))
    best = ranked.filter("_rank > 0").groupBy("video_key").agg(F.min("_rank").cast("int").alias("_rank"))
    head, tail = fixed.THUMBNAIL_URL
    url = F.concat(F.lit(head), F.col("video_key"), F.lit("/"), F.element_at(qualities, F.col("_rank")), F.lit(tail))
    return videos.join(best, "video_key", "left").withColumn("url", F.when(F.col("_rank").isNotNull(), url)).drop("_rank")


def with_defects(segments: DataFrame, keys) -> DataFrame:
    """Add `defect`, why a segment cannot be worked on (null: it can), so that bad rows do not stop the others."""
    missing = F.lit(False)
    for key in keys:
        missing = missing | F.col(key).isNull()
    start, end = F.col("start_time"), F.col("end_time")
    defect = (
        F.when(missing, "missing key")
        .when(start.isNull() | end.isNull(), "missing time")
        .when(end <= start, "does not end after its start")
    )
    return segments.withColumn("defect", defect)


def split_by_defect(segments: DataFrame, keys) -> tuple[DataFrame, DataFrame]:
    """(segments to work on, segments set aside with their defect)."""
    judged = with_defects(segments, keys)
    return judged.filter(F.col("defect").isNull()).drop("defect"), judged.filter(F.col("defect").isNotNull())
