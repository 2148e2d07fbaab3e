"""BPE encoding and decoding of every document: a queue of merge ranks over linked symbols, see `word_bpe`.

Cases: a null text is the empty one (no ids, empty text back). Rows, repeated ones too, stand for themselves; a null doc_id is
carried along. Texts of any length are encoded whole, chunk by chunk. An empty table gives an empty result.
"""

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from seamline.llm.tables import texts
from seamline.llm.word_bpe import LATIN_PIECES, SPACES, Remembered, chunks_of, is_latin, word_bpe


class Coder:
    """Text -> (its ids as little-endian 32-bit numbers, its vocabulary strings with a space between)."""

    def __init__(self, path):
        self.bpe = word_bpe(path)
        self.pieces, self.chunks = Remembered(self.piece), Remembered(self.chunk)

    def _code(self, tokens):
        return np.array([self.bpe.token_id(t) for t in tokens], "<u4").tobytes(), " ".join(tokens)

    def piece(self, piece):
        return (b"", "") if piece.isspace() and SPACES.match(piece) else self._code(self.bpe.merge(self.bpe.spelled(piece)))

    def chunk(self, chunk):
        return self._code(self.bpe.tokens(chunk))

    def code(self, text):
        known, cut = (self.pieces, LATIN_PIECES.findall(text.lower())) if is_latin(text) else (self.chunks, chunks_of(text))
        got = [known[c] for c in cut]
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])


def encoded(docs: DataFrame, path: str | None = None, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, and ids (array) and decoded (text), or with `digest` only their SHA-256."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kinds = "ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    key = texts(docs).schema["doc_id"].dataType.simpleString()

    def encode(batches):
        coder = Coder(path)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column("text"):
                ids, back = coder.code(text.as_py())
                counts.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digest else np.frombuffer(ids, "<i4"))
                second.append(hashlib.sha256(back.encode()).hexdigest() if digest else back)
            ids_type = pa.string() if digest else pa.list_(pa.int32())
            names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(first, ids_type), pa.array(second, pa.string())], ["doc_id", "n_tokens", *names])

    return texts(docs).mapInArrow(encode, f"doc_id {key}, n_tokens long, {kinds}")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of `ids`, by concatenating vocabulary strings."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    key = rows.schema["doc_id"].dataType.simpleString()

    def decode(batches):
        bpe = word_bpe(path)
        for batch in batches:
            back = [bpe.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.string())], ["doc_id", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(decode, f"doc_id {key}, decoded string")
