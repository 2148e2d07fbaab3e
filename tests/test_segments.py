import json
import math
import random

import pytest
from pyspark.sql import functions as F

from seamline import fixed_values as fixed
from seamline.operators import annotation, batching, prompts, segmenting
from seamline.plans.transcript import annotate_from, segment_spans_of, segment_transcripts

UTT = "transcript_id string, seq long, content string, start double, end double"


def talk(spark, n, tid="a", gap=1):
    return spark.createDataFrame([(tid, i * gap, f"word{i} Topic{i // 6}", float(i), i + 0.5) for i in range(n)], UTT)


def test_batches_of_five(spark):
    got = batching.assign_batches(talk(spark, 12)).groupBy("batch_id").count().orderBy("batch_id").collect()
    assert [r["count"] for r in got] == [5, 5, 2]


def test_combined_batch(spark):
    df = spark.createDataFrame([("t", 1, "b", 1.5, 2.0), ("t", 0, "a", 0.0, 1.0)], UTT)
    r = batching.combine_batches(batching.assign_batches(df)).first()
    assert (r.start, r.end, r.content) == (0.0, 2.0, "a b")


def test_context_is_the_last_batch_of_the_group_before(spark):
    got = batching.batches_with_context(batching.assign_batches(talk(spark, 7), 1)).orderBy("batch_id").collect()
    assert [r.prev_content and r.prev_content.split()[0] for r in got] == [None, None, None, "word2", "word2", "word2", "word5"]
    text = batching.request_context(F.lit("p"), F.lit("c"))
    assert spark.range(1).select(text).first()[0] == (
        "Previous segment context:\nContent: p\nTopic: Unknown\n\nAnalyze the following segment:\nc"
    )


@pytest.mark.parametrize("lane", [1, 2, 4, 4096])
def test_previous_batch_whatever_the_lane(spark, lane):
    got = batching.batches_with_previous(batching.assign_batches(talk(spark, 9), 1), lane).orderBy("batch_id").collect()
    assert [r.prev_content and r.prev_content.split()[0] for r in got] == [None] + [f"word{i}" for i in range(8)]


def test_natural_boundaries(spark):
    texts = ["red apple"] * 5 + ["red apple"] * 5 + ["blue sky"]
    df = spark.createDataFrame([("t", i, c, float(i), i + 1.0) for i, c in enumerate(texts)], UTT)
    got = batching.natural_boundaries(batching.assign_batches(df)).orderBy("batch_id").collect()
    assert [(r.batch_id, r.sim, r.is_boundary) for r in got] == [(0, 1.0, False), (1, 0.0, True)]


def test_shared_answers_with_a_hot_request(spark):
    batches = spark.createDataFrame(
        [("t", i, "same", None) for i in range(30)] + [("u", 0, "same", ""), ("u", 1, "other", None)],
        "transcript_id string, batch_id long, content string, prev_content string",
    )
    asked = batching.distinct_requests(batches)
    assert sorted((r.content, r.prev_content or "-", r.uses) for r in asked.collect()) == [("other", "-", 1), ("same", "-", 1), ("same", "-", 30)]
    answers = asked.select("request_id", F.col("uses").alias("answer"))
    shared = batching.share_answers(batches, answers, min_rows=5).collect()
    assert sorted(r.answer for r in shared) == [1, 1] + [30] * 30


RESPONSES = [
    ('Sure! {"topic":"x","keywords":["a"],"relationship":"NEW","confidence":85} done', ("x", ["a"], "NEW", 85.0)),
    ("no json", ("Unknown", [], "NEW", 0.0)),
    ('{"topic": broken', ("Unknown", [], "NEW", 0.0)),
    ("} then {", ("Unknown", [], "NEW", 0.0)),
    ('{"topic":"x"} and {"topic":"y"}', ("Unknown", [], "NEW", 0.0)),
    ('a\n{"topic":"x",\n"confidence":71.5}\nb', ("x", [], "NEW", 71.5)),
    ("{'topic':'x'}", ("Unknown", [], "NEW", 0.0)),
    (None, ("Unknown", [], "NEW", 0.0)),
]


def test_parsed_responses(spark):
    df = spark.createDataFrame([("t", i, r) for i, (r, _) in enumerate(RESPONSES)], "transcript_id string, batch_id long, response string")
    got = annotation.annotations_from_responses(df).orderBy("batch_id").collect()
    assert [(r.topic, r.keywords, r.relationship, r.confidence) for r in got] == [want for _, want in RESPONSES]


def decided(spark):
    labels = [("CONTINUATION", 99), ("NEW", 70), ("NEW", 71), ("SHIFT", 85), ("SHIFT", 86), ("CONTINUATION", 100)]
    rows = [("a", i, f"t{i}", [f"k{i}"], r, float(c)) for i, (r, c) in enumerate(labels)]
    schema = "transcript_id string, batch_id long, topic string, keywords array<string>, relationship string, confidence double"
    return segmenting.decide_segments(spark.createDataFrame(rows, schema))


def test_decisions_and_merge(spark):
    found = decided(spark)
    assert [r.segment_id for r in found.orderBy("batch_id").collect()] == [1, 1, 2, 2, 3, 3]
    batches = batching.combine_batches(batching.assign_batches(talk(spark, 6), 1))
    metadata = segmenting.segment_metadata(segmenting.merge_segments(batches, found)).orderBy("segment_id")
    got = metadata.collect()
    assert [(r.segment_id, r.start_time, r.end_time, r.duration, r.dominant_topic) for r in got] == [
        (1, 0.0, 1.5, 1.5, "t0"), (2, 2.0, 3.5, 1.5, "t2"), (3, 4.0, 5.5, 1.5, "t4"),
    ]
    assert got[1].top_keywords == ["k2"] and got[1].transcript == "word2 Topic0 word3 Topic0"
    spans = segmenting.segment_spans(batches, found).orderBy("segment_id").collect()
    assert [(r.start, r.end, r.topic) for r in spans] == [(0.0, 1.5, "t0"), (2.0, 3.5, "t2"), (4.0, 5.5, "t4")]
    assert [r.topic_id for r in segmenting.topic_list(metadata).orderBy("topic_id").collect()] == [0, 1, 2]

    whole = segmenting.results_documents(metadata).select(F.to_json(F.struct("topics", "segments", "register"))).first()[0]
    document = json.loads(whole)
    assert [t["topic_id"] for t in document["topics"]] == [0, 1, 2] and document["register"] == "gen-ai"
    assert [s["segment_id"] for s in document["segments"]] == [1, 2, 3]

    lines = [r.text for r in segmenting.report_lines(metadata).orderBy("block", "line").collect()]
    assert lines[0] == "Topic 1: k0" and lines[3] == "Generated and analyzed 3 segments"
    assert lines[4] == "Segment 1 (0.00s - 1.50s):"


def test_prompts(spark):
    asked = spark.createDataFrame([("gen-ai",), ("unheard-of",)], "register string")
    filled = prompts.with_prompts(asked, prompts.prompt_templates(spark), "topic", F.lit("CTX")).collect()
    by_register = {r.register: r.prompt for r in filled}
    assert by_register["gen-ai"] == fixed.TOPIC_PROMPTS["gen-ai"].replace("{context}", "CTX")
    assert by_register["unheard-of"] == fixed.TOPIC_PROMPTS["it-workflow"].replace("{context}", "CTX")


def test_top_terms_prune_nothing_that_counts(spark, monkeypatch):
    from collections import Counter
    import math
    import random

    monkeypatch.setattr(annotation, "LANE_BATCHES", 4)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    texts = [[min(words, key=lambda w: rng.random() * (1 + int(w[1:]) / 4)) for _ in range(rng.randint(0, 60))] for _ in range(11)]
    df = spark.createDataFrame([("t", i, " ".join(t), 0.0, 1.0) for i, t in enumerate(texts)], UTT)
    batches = annotation.batches_with_terms(batching.assign_batches(df, 1), lane=3)
    got = {}
    for r in annotation.top_terms(batches, "batch_id", "n_batches").orderBy("batch_id", "rank").collect():
        got.setdefault(r.batch_id, []).append(r.term)
    df_ = Counter(w for t in texts for w in set(t))
    for i, text in enumerate(texts):
        n = Counter(text)
        score = {w: round(n[w] * (math.log(12 / (1 + df_[w])) + 1), 6) for w in n}
        assert got.get(i, []) == sorted(score, key=lambda w: (-score[w], w))[:5]


def test_segments_cover_transcripts_and_do_not_depend_on_partitions(spark, rows):
    # Positions with gaps, two transcripts of very different size.
    utterances = talk(spark, 60, "long", gap=7).unionByName(talk(spark, 3, "short"))
    found = segment_transcripts(utterances, 3)
    texts = {}
    for r in found.orderBy("transcript_id", "segment_id").collect():
        texts.setdefault(r.transcript_id, []).append(r.transcript)
    assert " ".join(texts["long"]) == " ".join(f"word{i} Topic{i // 6}" for i in range(60))
    assert len(texts["short"]) == 1
    assert rows(found) == rows(segment_transcripts(utterances.repartition(7), 3))


def test_no_cartesian_product_or_python_in_the_flagship(spark):
    found = segment_transcripts(talk(spark, 20), 2)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "NestedLoop" not in plan


def test_responses_that_never_came_lose_no_batch(spark):
    answer = '{"topic":"x","keywords":["k"],"relationship":"NEW","confidence":99}'
    responses = spark.createDataFrame([("a", 0, answer), ("a", 3, answer)], "transcript_id string, batch_id long, response string")
    got = segment_transcripts(talk(spark, 10), 2, annotate_from(responses)).orderBy("segment_id").collect()
    assert [(r.start_time, r.end_time, r.dominant_topic) for r in got] == [(0.0, 5.5, "x"), (6.0, 9.5, "x")]
    spans, placed = segment_spans_of(talk(spark, 10), 2, annotate_from(responses))
    assert sorted((r.start, r.end) for r in spans.collect()) == [(0.0, 5.5), (6.0, 9.5)]
    assert " ".join(r.content for r in placed.filter("segment_id = 2").orderBy("batch_id").collect()) == got[1].transcript


def test_annotation_of_transcripts_longer_than_a_lane(spark, rows, monkeypatch):
    """Totals and neighbours cross lanes; texts of stop words alone stay; what is told doesn't depend on the lanes."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["that", "it", "sail", "Sail", "mast", "keel", "oar", "hull", "rope"]) for _ in range(rng.randint(0, 9))) for _ in range(23)]
    df = spark.createDataFrame([("t", i, t, 0.0, 1.0) for i, t in enumerate(texts)] + [("u", 5, "that it", 0.0, 1.0)], UTT)
    assigned = batching.assign_batches(df, 1)
    batches = batching.combine_batches(assigned)
    whole = rows(annotation.native_annotation(batches))
    before = {r.batch_id: r.sim for r in annotation.batches_with_terms(assigned).filter("transcript_id = 't'").collect()}
    sure = {r.batch_id: r.confidence for r in annotation.native_annotation(batches).filter("transcript_id = 't'").collect()}
    assert all(sure[i] == (100 if not i else math.floor(100 * (1 - s if s < 0.3 else s) + 0.5)) for i, s in before.items()) and len(sure) == 23
    for lane in (1, 2, 5, 23):
        monkeypatch.setattr(annotation, "LANE_BATCHES", lane)
        assert rows(annotation.native_annotation(batches)) == whole


def test_texts_are_dealt_once_in_every_step(spark):
    """The plans' shuffles by hash: one of the rows themselves in each step, the others of summaries."""
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assigned = batching.assign_batches(talk(spark, 20), 2)
    assert "hashpartitioning(_hash" in assigned._jdf.queryExecution().executedPlan().toString()
    stored = spark.createDataFrame([("t", 0, 1, "a text")], "transcript_id string, batch_id long, n_batches long, content string")
    assert dealt(annotation.native_annotation(stored)) <= 3


def test_tasks_that_count_terms_grow_in_number_with_the_texts(spark, monkeypatch):
    stored = spark.createDataFrame([(f"t{i}", 0, 1, "x" * 99) for i in range(20)], "transcript_id string, batch_id long, n_batches long, content string")
    monkeypatch.setattr(annotation, "TASK_CHARS", 99)
    assert annotation._terms_by_lane(stored).rdd.getNumPartitions() == 21
