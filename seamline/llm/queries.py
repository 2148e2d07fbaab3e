"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from pyspark.sql import functions as F

from seamline.llm import bpe, centroids, decontamination, exact_dedup, near_dedup, nearest, packing, personal_data, prefix_trie, quality, repeats, token_counts, toxicity
from seamline.llm.sql import CENTROIDS, DECONTAMINATION, PREFIX_TRIE
from seamline.llm.tables import table


def op1_token_counts(spark, folder):
    counts = token_counts.counted(table(spark, folder, "documents"))
    half = token_counts.tokens_within(F.size("prefix_counts") / F.lit(2))
    return counts.select(
        "doc_id", "n_bytes", F.element_at("prefix_counts", -1).cast("long").alias("n_tokens"), "over_limit",
        token_counts.longest_prefix(token_counts.OVER).cast("long").alias("longest_prefix"), half.cast("long").alias("tokens_of_first_half"),
    )


def op2_quality(spark, folder):
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op3_repeated_passages(spark, folder):
    return repeats.without_repeats(table(spark, folder, "documents"), digest=True)


def op4_best_fit_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"))


def op5_near_dedup(spark, folder):
    return near_dedup.classes(table(spark, folder, "documents"))


def op6_personal_data(spark, folder):
    return personal_data.spans(table(spark, folder, "documents"))


def op7_exact_dedup(spark, folder):
    return exact_dedup.copies(table(spark, folder, "documents"))


def op8_nearest(spark, folder):
    return nearest.nearest(table(spark, folder, "embeddings"), "id % 20 = 0")


def op9_bpe(spark, folder):
    return bpe.encoded(table(spark, folder, "documents"), digest=True)


def op10_toxicity(spark, folder):
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_prefix_trie(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


def op12_decontamination(spark, folder):
    return decontamination.digests(decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op13_centroid_clusters(spark, folder):
    return centroids.with_inertia(table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_quality, op3_repeated_passages, op4_best_fit_packing, op5_near_dedup, op6_personal_data, op7_exact_dedup, op8_nearest,
        op9_bpe, op10_toxicity, op11_prefix_trie, op12_decontamination, op13_centroid_clusters,
    )
}

ORACLES = {
    "op7_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS n FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
        FROM t
    """,
    "op11_prefix_trie": PREFIX_TRIE,
    "op12_decontamination": DECONTAMINATION,
    "op13_centroid_clusters": CENTROIDS,
}
