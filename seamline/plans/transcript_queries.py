"""Registered queries: transcripts, batches, annotations, segments."""

from pyspark.sql import functions as F

from seamline import fixed_values as fixed
from seamline.functions.text import cleaned, sentences, similarity
from seamline.operators import annotation, batching, prompts, segmenting, topics
from seamline.plans.adapters import RESPONSE, cte, paper, segments_cte, table, talk, with_ctes
from seamline.plans.registry import query
from seamline.plans.transcript import segment_transcripts, segment_with_answers, segments_in_pieces, stored_batches
from seamline.session import scratch_folder, written
from seamline.sources import catalogs, stores, transcripts
from seamline.sources.stores import AnswerStore

TID = "transcript_id"
UTTERANCE = '"transcript_id", seq, content, "start", "end"'
FLAT_SEGMENTS = "transcript_id, segment_id, start_time, end_time, duration, dominant_topic, top_keywords, transcript"


def flat(metadata):
    return metadata.withColumn("top_keywords", F.array_join("top_keywords", ", "))


@query("s1_transcript_files", with_ctes(["talk"], f"SELECT transcript_id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY seq) - 1 AS BIGINT) AS seq, content, \"start\", \"end\" FROM talk"))
def s1(spark, folder):
    """One folder for each transcript, as projects have them; files of different folders have equal names."""
    path = scratch_folder(spark, "transcripts")
    listed = talk(spark, folder).groupBy("transcript_id").agg(F.sort_array(F.collect_list(F.struct("seq", "content", "start", "end"))).alias("u"))
    texts = listed.select(F.col("transcript_id").alias("project"), F.to_json(F.transform("u", lambda e: F.struct(e["content"].alias("content"), e["start"].alias("start"), e["end"].alias("end")))).alias("value"))
    texts.write.partitionBy("project").text(path)
    found = transcripts.read_transcript_files(spark, path, "part-*")
    return found.withColumn("transcript_id", F.regexp_replace(transcripts.project_of(F.col("transcript_id")), "^project=", ""))


@query(
    "s1_transcript_defects",
    """SELECT CAST(conv_id AS VARCHAR) AS transcript_id, CASE conv_id % 3 WHEN 0 THEN 'no utterances' ELSE 'not an array of utterances' END AS problem
    FROM conversations WHERE conv_id % 3 < 2 GROUP BY conv_id""",
)
def s1_defects(spark, folder):
    each = table(spark, folder, "conversations").groupBy("conv_id").agg(F.min("text").alias("text"))
    value = F.expr("CASE conv_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN text ELSE to_json(array(named_struct('content', text, 'start', 0D, 'end', 1D))) END")
    return transcripts.transcript_defects(each.select(F.col("conv_id").cast("string").alias("transcript_id"), value.alias("value")))


@query(
    "s2_asr_utterances",
    with_ctes(
        ["paper"],
        """SELECT concat(transcript_id, '#', seq // 512) AS transcript_id,
          CAST(row_number() OVER (PARTITION BY transcript_id, seq // 512 ORDER BY seq) - 1 AS BIGINT) AS seq, content, "start", "end" FROM paper""",
    ),
)
def s2(spark, folder):
    # A response for every 512 lines of a document.
    entry = F.struct("seq", F.struct(F.col("content").alias("transcript"), "start", "end").alias("u"))
    listed = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["u"])
    parts = paper(spark, folder).withColumn(TID, F.expr("concat(transcript_id, '#', seq div 512)"))
    responses = parts.groupBy(TID).agg(F.struct(listed.alias("utterances")).alias("results"))
    path = scratch_folder(spark, "asr")
    transcripts.save_raw_responses(responses, path)
    return transcripts.flatten_asr(transcripts.read_asr(spark, path))


@query("s3_catalog", r"SELECT regexp_replace(line, '^\s+|\s+$', '', 'g') AS software FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE trim(line) <> ''")
def s3(spark, folder):
    path = scratch_folder(spark, "catalog")
    padded = F.concat(F.lit("  "), F.regexp_replace("text", "\n", " \n \n"), F.lit(" "))
    table(spark, folder, "benchmark").select(padded.alias("value")).write.text(path)
    return catalogs.read_catalog(spark, path)


@query("s5_saved_transcripts", with_ctes(["talk"], f"SELECT {UTTERANCE} FROM talk"))
def s5(spark, folder):
    path = scratch_folder(spark, "processed")
    transcripts.save_transcripts(talk(spark, folder), path, buckets=8)
    return transcripts.load_transcripts(spark, path)


@query("t1_batches", with_ctes(["paper5_assigned"], "SELECT transcript_id, seq, rn, batch_id, n_batches FROM paper5_assigned"))
def t1(spark, folder):
    return batching.assign_batches(paper(spark, folder)).select(TID, "seq", "rn", "batch_id", "n_batches")


@query("t2_combined", with_ctes(["paper5_batches"], 'SELECT transcript_id, batch_id, "start", "end", content FROM paper5_batches'))
def t2(spark, folder):
    return batching.combine_batches(batching.assign_batches(paper(spark, folder))).drop("n_batches")


T3_STOPS = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in fixed.STOP_WORDS) + ")"


@query(
    "t3_cleaned",
    with_ctes(
        ["paper"],
        r"SELECT transcript_id, seq, array_to_string(list_filter(regexp_split_to_array(lower(content), '[\s\p{Z}]+'), "
        f"lambda w: w <> '' AND w NOT IN {T3_STOPS}), ' ') AS cleaned FROM paper",
    ),
)
def t3(spark, folder):
    return paper(spark, folder).select(TID, "seq", cleaned("content").alias("cleaned"))


@query(
    "t4_similarity",
    with_ctes(
        ["talk1_sims", "talk1_batches"],
        "SELECT transcript_id, batch_id, coalesce(sim, 0) AS sim FROM talk1_batches LEFT JOIN talk1_sims USING (transcript_id, batch_id) WHERE batch_id > 0",
    ),
)
def t4(spark, folder):
    pairs = batching.batches_with_previous(batching.assign_batches(talk(spark, folder), 1))
    return pairs.filter("prev_content IS NOT NULL").select(TID, "batch_id", similarity("prev_content", "content").alias("sim"))


@query(
    "t5_boundaries",
    with_ctes(
        ["paper5_assigned", "paper5_tf"],
        f"""SELECT transcript_id, batch_id, coalesce(sim, 0) AS sim, coalesce(sim, 0) < 0.7 AS is_boundary FROM (
          SELECT transcript_id, batch_id - 1 AS batch_id FROM paper5_assigned WHERE batch_id > 0 AND (rn - 1) % 5 = 0) LEFT JOIN (
          SELECT transcript_id, batch_id, round(sum(a * b) / nullif(
            sqrt(sum(pow(a * (CASE WHEN a > 0 AND b > 0 THEN 1 ELSE ln(1.5::DOUBLE) + 1 END), 2)))
            * sqrt(sum(pow(b * (CASE WHEN a > 0 AND b > 0 THEN 1 ELSE ln(1.5::DOUBLE) + 1 END), 2))), 0), 6) AS sim FROM (
            SELECT transcript_id, batch_id, term, sum(a) AS a, sum(b) AS b FROM (
              SELECT transcript_id, batch_id, term, n AS a, 0 AS b FROM paper5_tf
              UNION ALL SELECT transcript_id, batch_id - 1, term, 0, count(*) FROM (
                SELECT transcript_id, batch_id, unnest(list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
                  lambda t: t NOT IN {T3_STOPS})) AS term FROM paper5_assigned WHERE batch_id > 0 AND (rn - 1) % 5 = 0)
              GROUP BY transcript_id, batch_id, term) GROUP BY transcript_id, batch_id, term
              QUALIFY row_number() OVER (PARTITION BY transcript_id, batch_id ORDER BY sum(a) + sum(b) DESC, term) <= 1000)
          GROUP BY ALL) USING (transcript_id, batch_id)""",
    ),
)
def t5(spark, folder):
    return batching.natural_boundaries(batching.assign_batches(paper(spark, folder)))


CONTEXT = """CASE WHEN prev_content IS NULL THEN '' ELSE concat('Previous segment context:', chr(10), 'Content: ', prev_content, chr(10),
  'Topic: Unknown', chr(10), chr(10)) END || 'Analyze the following segment:' || chr(10) || content"""
GROUPED = """(SELECT b.*, b.batch_id // 3 AS group_id, p.content AS prev_content FROM {0} b LEFT JOIN {0} p
  ON b.transcript_id = p.transcript_id AND p.batch_id = (b.batch_id // 3) * 3 - 1)"""


@query("t6_request_groups", with_ctes(["paper5_batches"], "SELECT transcript_id, batch_id // 3 AS group_id, count(*) AS batches, max(batch_id) AS last_batch FROM paper5_batches GROUP BY ALL"))
def t6(spark, folder):
    grouped = batching.batches_with_context(batching.assign_batches(paper(spark, folder)))
    return grouped.groupBy(TID, "group_id").agg(F.count(F.lit(1)).alias("batches"), F.max("batch_id").alias("last_batch"))


@query("t7_context", with_ctes(["paper5_batches"], f"SELECT transcript_id, batch_id, group_id, {CONTEXT} AS context FROM {GROUPED.format('paper5_batches')}"))
def t7(spark, folder):
    grouped = batching.batches_with_context(batching.assign_batches(paper(spark, folder)))
    text = batching.request_context(F.col("prev_content"), F.col("content"))
    return grouped.select(TID, "batch_id", "group_id", text.alias("context"))


REGISTER = "CASE CAST(transcript_id AS BIGINT) % 4 WHEN 0 THEN 'gen-ai' WHEN 1 THEN 'tech-support' WHEN 2 THEN 'it-workflow' ELSE 'other' END"


def _template_rows():
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [("topic", r, t) for r, t in fixed.TOPIC_PROMPTS.items()] + [("analysis", r, t) for r, t in fixed.ANALYSIS_PROMPTS.items()]
    return "(VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in rows) + ") AS templates(kind, register, template)"


@query(
    "t8_prompts",
    with_ctes(
        ["talk2_batches"],
        f"""SELECT transcript_id, batch_id, x.register, replace(template, '{{context}}', context) AS prompt FROM (
          SELECT transcript_id, batch_id, {REGISTER} AS register, {CONTEXT} AS context FROM {GROUPED.format('talk2_batches')}) x
        JOIN {_template_rows()} ON kind = 'topic' AND templates.register = CASE WHEN x.register = 'other' THEN 'it-workflow' ELSE x.register END""",
    ),
)
def t8(spark, folder):
    grouped = batching.batches_with_context(batching.assign_batches(talk(spark, folder), 2)).withColumn("register", F.expr(REGISTER))
    context = batching.request_context(F.col("prev_content"), F.col("content"))
    filled = prompts.with_prompts(grouped, prompts.prompt_templates(spark), "topic", context)
    return filled.select(TID, "batch_id", "register", "prompt")


@query(
    "t8_analysis_prompts",
    with_ctes(
        ["answered_segments"],
        f"""SELECT transcript_id, segment_id, replace(template, '{{transcript}}', transcript) AS prompt FROM (
          SELECT *, {REGISTER} AS r FROM answered_segments)
        JOIN {_template_rows()} ON kind = 'analysis' AND templates.register = CASE WHEN r = 'other' THEN 'it-workflow' ELSE r END""",
    ),
)
def t8_analysis(spark, folder):
    found = _answered_segments(spark, folder).withColumn("register", F.expr(REGISTER))
    filled = prompts.with_prompts(found, prompts.prompt_templates(spark), "analysis", F.lit(""), F.col("transcript"))
    return filled.select(TID, "segment_id", "prompt")


REQUESTS = f"(SELECT content, prev_content, count(*) AS uses FROM {GROUPED.format('paper5_batches')} GROUP BY ALL)"


@query("t9_distinct_requests", with_ctes(["paper5_batches"], f"SELECT * FROM {REQUESTS}"))
def t9(spark, folder):
    grouped = batching.batches_with_context(batching.assign_batches(paper(spark, folder)))
    return batching.distinct_requests(grouped).select("content", "prev_content", "uses")


@query(
    "t9_shared_answers",
    with_ctes(
        ["paper5_batches"],
        f"""SELECT b.transcript_id, b.batch_id, concat(r.uses, ' x ', length(r.content)) AS answer FROM {GROUPED.format('paper5_batches')} b
        JOIN {REQUESTS} r ON b.content = r.content AND b.prev_content IS NOT DISTINCT FROM r.prev_content""",
    ),
)
def t9_shared(spark, folder):
    grouped = written(batching.batches_with_context(batching.assign_batches(paper(spark, folder))), "batches")
    answers = batching.distinct_requests(grouped).selectExpr("request_id", "concat(uses, ' x ', length(content)) AS answer")
    return batching.share_answers(grouped, answers).select(TID, "batch_id", "answer")


# Answers that depend on what is asked alone.
LENGTHS = "(length(content) + 3 * coalesce(length(prev_content), 0))"
CHANGE = f"CASE {LENGTHS} % 3 WHEN 0 THEN 'NEW' WHEN 1 THEN 'SHIFT' ELSE 'CONTINUATION' END"
TOLD = f"""CASE WHEN {LENGTHS} % 9 = 0 THEN 'I cannot tell.' ELSE concat('{{"topic":"topic ', {LENGTHS} % 5, '","keywords":["k', {LENGTHS} % 11,
  '"],"relationship":"', {CHANGE}, '","confidence":', 60 + {LENGTHS} % 41, '}}') END"""
cte(
    "asked",
    f"""SELECT transcript_id, batch_id, CASE WHEN {LENGTHS} % 9 = 0 THEN 'Unknown' ELSE concat('topic ', {LENGTHS} % 5) END AS topic,
      CASE WHEN {LENGTHS} % 9 = 0 THEN '' ELSE concat('k', {LENGTHS} % 11) END AS keywords,
      CASE WHEN {LENGTHS} % 9 = 0 THEN 'NEW' ELSE {CHANGE} END AS relationship,
      CASE WHEN {LENGTHS} % 9 = 0 THEN 0.0::DOUBLE ELSE (60 + {LENGTHS} % 41)::DOUBLE END AS confidence FROM {GROUPED.format('talk2_batches')}""",
    ["talk2_batches"],
)
segments_cte("asked", "talk2_batches", "asked")


@query("t9_segments_from_answers", with_ctes(["asked_segments"], f"SELECT {FLAT_SEGMENTS} FROM asked_segments"))
def t9_segments(spark, folder):
    """Requests, answers and segments: half of the conversations first, then all, asking only what has no answer yet."""
    store = AnswerStore(spark, scratch_folder(spark, "answers"))
    ask = lambda requests: requests.selectExpr("request_id", f"{TOLD} AS response")
    said = talk(spark, folder)
    segment_with_answers(said.filter("CAST(transcript_id AS BIGINT) % 2 = 0"), store, ask, "1", 2)
    return flat(segment_with_answers(said, store, ask, "2", 2))


def _talk_batches(spark, folder):
    return batching.combine_batches(batching.assign_batches(talk(spark, folder), 2))


def _answered(batches):
    return annotation.annotations_from_responses(batches.selectExpr(TID, "batch_id", f"{RESPONSE} AS response"))


def _answered_segments(spark, folder):
    batches = written(_talk_batches(spark, folder), "batches")
    return segmenting.segment_metadata(segmenting.merge_segments(batches, segmenting.decide_segments(_answered(batches))))


@query("t10_parsed", with_ctes(["answered"], "SELECT transcript_id, batch_id, topic, keywords, relationship, confidence FROM answered"))
def t10(spark, folder):
    return _answered(_talk_batches(spark, folder)).withColumn("keywords", F.array_join("keywords", ", "))


@query("t11_decided", with_ctes(["answered_decided"], "SELECT transcript_id, batch_id, relationship, confidence, segment_id FROM answered_decided"))
def t11(spark, folder):
    decided = segmenting.decide_segments(_answered(_talk_batches(spark, folder)))
    return decided.select(TID, "batch_id", "relationship", "confidence", "segment_id")


@query("t12_segments", with_ctes(["answered_segments"], 'SELECT transcript_id, segment_id::BIGINT AS segment_id, start_time AS "start", end_time AS "end", transcript AS content, dominant_topic AS topic, top_keywords AS keywords FROM answered_segments'))
def t12(spark, folder):
    batches = written(_talk_batches(spark, folder), "batches")
    merged = segmenting.merge_segments(batches, segmenting.decide_segments(_answered(batches)))
    return merged.withColumn("keywords", F.array_join("keywords", ", "))


@query("t12_spans", with_ctes(["answered_segments"], 'SELECT transcript_id, segment_id::BIGINT AS segment_id, start_time AS "start", end_time AS "end", dominant_topic AS topic, top_keywords AS keywords FROM answered_segments'))
def t12_spans(spark, folder):
    batches = written(_talk_batches(spark, folder), "batches")
    spans = segmenting.segment_spans(batches, segmenting.decide_segments(_answered(batches)))
    return spans.withColumn("keywords", F.array_join("keywords", ", "))


@query("t13_metadata", with_ctes(["answered_segments"], f"SELECT {FLAT_SEGMENTS} FROM answered_segments"))
def t13(spark, folder):
    return flat(_answered_segments(spark, folder))


@query("t14_topics", with_ctes(["answered_segments"], "SELECT transcript_id, segment_id - 1 AS topic_id, dominant_topic AS topic, top_keywords AS words FROM answered_segments"))
def t14(spark, folder):
    return segmenting.topic_list(_answered_segments(spark, folder)).withColumn("words", F.array_join("words", ", "))


WORDS = "CASE WHEN top_keywords = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(top_keywords, ', ') END"
DOCUMENTS = f"""SELECT transcript_id, CAST(to_json({{'topics': list({{'topic_id': segment_id - 1, 'topic': dominant_topic, 'words': {WORDS}}} ORDER BY segment_id),
  'segments': list({{'segment_id': segment_id, 'start_time': start_time, 'end_time': end_time, 'duration': duration,
    'dominant_topic': dominant_topic, 'top_keywords': {WORDS}, 'transcript': transcript}} ORDER BY segment_id),
  'register': 'gen-ai'}}) AS VARCHAR) AS document FROM answered_segments GROUP BY transcript_id"""


@query("t15_documents", with_ctes(["answered_segments"], DOCUMENTS))
def t15(spark, folder):
    documents = segmenting.results_documents(_answered_segments(spark, folder))
    return documents.select(TID, F.to_json(F.struct("topics", "segments", "register")).alias("document"))


@query("s6_saved_documents", with_ctes(["answered_segments"], DOCUMENTS))
def s6(spark, folder):
    documents = segmenting.results_documents(_answered_segments(spark, folder))
    path = scratch_folder(spark, "results")
    stores.save_documents(documents, path)
    stored = stores.load_documents(spark, path, documents.schema)
    return stored.select(TID, F.to_json(F.struct("topics", "segments", "register")).alias("document"))


@query(
    "t16_report",
    with_ctes(
        ["answered_segments"],
        """SELECT transcript_id, 1 AS block, segment_id::BIGINT AS line, concat('Topic ', segment_id, ': ', top_keywords) AS text FROM answered_segments
        UNION ALL SELECT transcript_id, 3, segment_id, printf('Segment %d (%.2fs - %.2fs):', segment_id, start_time, end_time) FROM answered_segments
        UNION ALL SELECT transcript_id, 2, 1, concat('Generated and analyzed ', count(*), ' segments') FROM answered_segments GROUP BY transcript_id""",
    ),
)
def t16(spark, folder):
    return segmenting.report_lines(_answered_segments(spark, folder))


@query("t17_transcript_only", with_ctes(["talk"], f"SELECT {UTTERANCE}, true AS transcription_only FROM talk"))
def t17(spark, folder):
    return segmenting.transcript_only(talk(spark, folder))


@query("a1_native_annotation", with_ctes(["paper5_native"], "SELECT * FROM paper5_native"))
def a1(spark, folder):
    return annotation.native_annotation(stored_batches(paper(spark, folder))).withColumn("keywords", F.array_join("keywords", ", "))


@query("a2_lda_topics")
def a2(spark, folder):
    found = topics.lda_topics(table(spark, folder, "documents"), "doc_id", "text")
    return found.select("doc_id", "topic_id", F.round("weight", 6).alias("weight"), F.array_join("words", ", ").alias("words"))


A2_TOKENS = f"""list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN {T3_STOPS})"""


@query(
    "a2_topic_mixtures",
    f"""SELECT doc_id, n_tokens, CASE WHEN n_tokens > 0 THEN CAST(1 AS DOUBLE) END AS mixture, CASE WHEN n_tokens > 0 THEN true END AS known_topic,
      CASE WHEN n_tokens > 0 THEN true END AS steady, CASE WHEN n_tokens > 0 THEN true END AS fits FROM (SELECT doc_id, CAST(len({A2_TOKENS}) AS INTEGER) AS n_tokens FROM documents)""",
)
def a2_mixtures(spark, folder):
    """Whether every mixture sums to 1, names a topic, stays as it is (to 0.01) when worked out again from the stored weights, and makes the
    text no less likely than all topics in equal parts do."""
    listed = written(topics.bucketed(table(spark, folder, "documents"), "doc_id", "text"), "tokens")
    model = topics.fit_topics(listed)
    found = written(topics.named_topics(model, listed, "doc_id").select("doc_id", "n_tokens", "mix", "topic_id"), "mixtures")
    gaps = topics.fixed_point_gap(model, found, listed, "doc_id")
    told = topics.log_likelihoods(model, found, listed, "doc_id").selectExpr("doc_id", "by_topics >= by_even - 1e-6 * n_scored AS fits")
    total = F.round(F.aggregate("mix", F.lit(0.0), lambda a, x: a + x), 6)
    return found.join(gaps, "doc_id", "left").join(told, "doc_id", "left").select(
        "doc_id", "n_tokens", total.alias("mixture"), F.col("topic_id").between(0, fixed.LDA_TOPICS - 1).alias("known_topic"), (F.col("gap") < 0.01).alias("steady"), "fits"
    )


@query(
    "a2_held_out_topics",
    f"""SELECT lang, count(*) AS documents, true AS better FROM documents
    WHERE doc_id % 5 = 0 AND len({A2_TOKENS}) >= 20 GROUP BY lang""",
)
def a2_held_out(spark, folder):
    """Of documents the fit has not seen, every other token is told by topics inferred from the rest: better than by its share of all tokens?"""
    docs = table(spark, folder, "documents")
    listed = written(topics.bucketed(docs, "doc_id", "text").drop("terms"), "tokens")
    model = topics.fit_topics(listed.filter("doc_id % 5 <> 0"))
    half = lambda odd: F.filter("tokens", lambda _, i: i % 2 == odd)
    unseen = listed.filter((F.col("doc_id") % 5 == 0) & (F.size("tokens") >= 20))
    mixed = topics.mixtures(model, unseen.withColumn("tokens", half(0)), "doc_id")
    told = topics.log_likelihoods(model, mixed, unseen.withColumn("tokens", half(1)), "doc_id")
    by_lang = unseen.select("doc_id").join(told, "doc_id", "left").join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang")
    return by_lang.agg(F.count(F.lit(1)).alias("documents"), (F.sum("by_topics") > F.sum("by_shares")).alias("better"))


A3_TF = """(SELECT transcript_id, segment_id, term, count(*) AS n FROM (
  SELECT transcript_id, segment_id, unnest(list_filter(regexp_extract_all(lower(transcript), '[\\p{L}\\p{N}_]{2,}'), lambda t: t NOT IN %s)) AS term
  FROM answered_segments) GROUP BY ALL)""" % T3_STOPS


@query(
    "a3_keywords",
    with_ctes(
        ["answered_segments"],
        f"""SELECT transcript_id, segment_id, term, score, CAST(r AS INTEGER) AS rank FROM (
          SELECT *, row_number() OVER (PARTITION BY transcript_id, segment_id ORDER BY score DESC, term) AS r FROM (
            SELECT t.transcript_id, segment_id, term, round(n * (ln((1 + total) / (1 + count(*) OVER (PARTITION BY t.transcript_id, term))::DOUBLE) + 1), 6) AS score
            FROM {A3_TF} t JOIN (SELECT transcript_id, count(*) AS total FROM answered_segments GROUP BY ALL) USING (transcript_id)))
        WHERE r <= 5""",
    ),
)
def a3(spark, folder):
    return segmenting.segment_keywords(written(_answered_segments(spark, folder), "segments"))


@query(
    "a4_sentences",
    r"""SELECT doc_id, CAST(n AS INTEGER) AS n, regexp_replace(s, '^\s+|\s+$', '', 'g') AS sentence FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\s][^.!?]*[.!?]*')) AS s,
        generate_subscripts(regexp_extract_all(text, '[^.!?\s][^.!?]*[.!?]*'), 1) - 1 AS n FROM documents)""",
)
def a4(spark, folder):
    split = table(spark, folder, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("n", "sentence"))
    return split


@query("segments_of_conversations", with_ctes(["talk_segments"], f"SELECT {FLAT_SEGMENTS} FROM talk_segments"))
def segments_of_conversations(spark, folder):
    return flat(segment_transcripts(talk(spark, folder), 2))


@query("segments_of_documents", with_ctes(["paper_segments"], f"SELECT {FLAT_SEGMENTS} FROM paper_segments"))
def segments_of_documents(spark, folder):
    return flat(segment_transcripts(paper(spark, folder)))


@query(
    "t12_segments_in_pieces",
    with_ctes(
        ["paper_segments", "paper_decided", "paper5_batches"],
        """SELECT transcript_id, segment_id, batch_id, content, start_time, end_time, dominant_topic AS topic FROM paper5_batches
        JOIN paper_decided USING (transcript_id, batch_id) JOIN paper_segments USING (transcript_id, segment_id)""",
    ),
)
def t12_in_pieces(spark, folder):
    """Whole documents segmented without any text in one cell: a segment's text is its rows in order of `batch_id`."""
    return segments_in_pieces(paper(spark, folder)).select(TID, "segment_id", "batch_id", "content", "start_time", "end_time", "topic")
