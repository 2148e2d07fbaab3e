"""Token counts, encoding and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, SHORT, awkward
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seamline.llm import bpe, packing, queries, token_counts

ODD = [
    "", "  ", "don't 'RE we'll'd x's <|endoftext|>foo***<|startoftext|> <|endo", "É é ﬁ ΣΑΣ straße İI ǅ", "日本語 テスト 한국어 🙂🙂 a🙂b", "\x1c\x1d a\x1fb",
    "ab̀ ḉ  x y", "٣٤ ½ Ⅷ", "a" * 3000, "ab'" * 50, "'S'T'RE a\n \nb   c\t\td",
]


def mixed_texts(n=400):
    draw = random.Random(1)
    parts = ["a", "b", "th", "in", "'", "s", "1", " ", "\n", "é", "́", "Σ", "!", "<|endoftext|>", "<|", "日", " ", "🙂", "\x1d", "ing", "ER"]
    return ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(mixed_texts())], SHORT).cache()


def test_encoding_is_the_librarys(docs, library):
    for row in bpe.encoded(docs).join(docs, "doc_id").collect():
        want = library.encode(row["text"], add_special_tokens=False).ids
        assert row["ids"] == want and row["n_tokens"] == len(want)
        assert row["decoded"] == library.decode(want, skip_special_tokens=False)


def test_digests_and_decoding_agree_with_the_outputs(docs):
    whole = bpe.encoded(docs)
    back = {r["doc_id"]: r["decoded"] for r in bpe.decoded(whole).collect()}
    digests = {r["doc_id"]: r for r in bpe.encoded(docs, digest=True).collect()}
    for row in whole.collect():
        assert back[row["doc_id"]] == row["decoded"]
        assert digests[row["doc_id"]]["ids_sha256"] == hashlib.sha256(np.array(row["ids"], "<u4").tobytes()).hexdigest()
        assert digests[row["doc_id"]]["decoded_sha256"] == hashlib.sha256(row["decoded"].encode()).hexdigest()


def test_count_of_every_prefix(docs, library):
    for row in token_counts.counted(docs).join(docs, "doc_id").filter("doc_id < 150").collect():
        text, counts = row["text"], row["prefix_counts"]
        assert row["n_tokens"] == counts[-1] == len(library.encode(text, add_special_tokens=False).ids)
        assert row["n_bytes"] == len(text.encode())
        if "<|" not in text and len(text) < 200:
            plain = library.normalizer.normalize_str(text)
            assert counts == [len(library.encode(plain[:k], add_special_tokens=False).ids) for k in range(len(plain) + 1)]


def test_budget_questions(docs):
    rows = token_counts.counted(docs).select("prefix_counts", token_counts.longest_prefix(5).alias("k"), token_counts.tokens_within(F.lit(7)).alias("t"))
    for row in rows.collect():
        counts = row["prefix_counts"]
        assert row["k"] == max(i for i, c in enumerate(counts) if c <= 5)
        assert row["t"] == counts[min(7, len(counts) - 1)]


def test_registered_budget_columns(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "OVER", 20)
    monkeypatch.setattr(token_counts, "BATCH", 300)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op1_token_counts(docs.sparkSession, str(tmp_path)).collect()}
    for row in token_counts.counted(docs).collect():
        counts, one = row["prefix_counts"], got[row["doc_id"]]
        assert one["n_tokens"] == counts[-1]
        assert one["longest_prefix"] == max(i for i, c in enumerate(counts) if c <= 20)
        assert one["tokens_of_first_half"] == counts[len(counts) // 2]


def test_limit(spark):
    rows = spark.createDataFrame([(1, "a " * 2048), (2, "a " * 2049)], SHORT)
    assert [(r["doc_id"], r["over_limit"]) for r in token_counts.counted(rows, prefixes=False).orderBy("doc_id").collect()] == [(1, False), (2, True)]


def check_packing(pieces, texts, size=2048):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    for p in pieces:
        own = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert len(own) == p["length"] <= size and zlib.crc32(own.tobytes()) == p["ids_crc32"]
        assert p["length"] == size or p["piece"] == 0
    for i, whole in ids.items():
        own = sorted((p["piece"], p["start"], p["length"]) for p in pieces if p["doc_id"] == i)
        assert [k for k, _, _ in own] == [*range(len(own))] and [s for _, s, _ in own] == [*np.cumsum([0, *[n for _, _, n in own]])[:-1]]
        assert sum(n for _, _, n in own) == len(whole)
    bins = {}
    for p in pieces:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(bins), sum(map(len, ids.values()))


def test_packing(spark):
    draw = random.Random(4)
    texts = {i: " ".join(draw.choice(["alpha", "beta", "x", "<|endoftext|>", "  \n \n", "é"]) for _ in range(draw.choice([1, 30, 400, 900, 5000]))) for i in range(60)} | {99: None, 98: ""}
    bins, tokens = check_packing(packing.packed(spark.createDataFrame([*texts.items()], SHORT)).collect(), texts)
    lengths = sorted((p["length"] for p in packing.packed(spark.createDataFrame([*texts.items()], SHORT)).collect()), reverse=True)
    rooms = []  # first fit, longest first
    for n in lengths:
        at = next((i for i, r in enumerate(rooms) if r >= n), None)
        if at is None:
            rooms.append(2048 - n)
        else:
            rooms[at] -= n
    assert -(-tokens // 2048) <= bins <= len(rooms)


def test_packing_takes_any_stretch_of_white_space():
    """The faster library gives up on these."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in ("a" + " " * 1_000_000 + "b", "a" + "\n " * 1_000_000, "\t" * 1_000_000):
        assert packing.byte_bpe(path)(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_fullest_is_the_fullest():
    draw = random.Random(5)
    for _ in range(200):
        size = draw.randint(5, 40)
        counts = {draw.randint(1, size): draw.randint(1, 4) for _ in range(draw.randint(1, 6))}
        found = packing.fullest(counts, size)
        longest = max(counts)
        sums = {longest}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1 - (n == longest)) if s + n * k <= size}
        assert sum(n * k for n, k in found.items()) == max(sums) and found[longest] >= 1
        assert all(k <= counts[n] for n, k in found.items())


def test_plan_uses_every_piece_once():
    counts = {2048: 1000, 1024: 333, 7: 10_000, 1: 5}
    plan = packing.bin_plan(counts)
    assert {n: sum(f.get(n, 0) * t for f, t in plan) for n in counts} == counts
    assert len(plan) <= sum(np.log2(2048 / n) + 2 for n in counts)


def test_awkward_rows(spark):
    texts = [t for _, t in AWKWARD]
    for n, frame in ((len(AWKWARD), awkward(spark)), (0, awkward(spark, []))):
        assert token_counts.counted(frame).count() == n
        assert bpe.encoded(frame, digest=True).count() == n
        assert packing.packed(frame).filter("piece = 0").count() == n
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(awkward(spark), prefixes=False).filter("doc_id in (4, 5, 6)").collect()}
    assert set(counts.values()) == {0} and len(texts) == len(AWKWARD)
