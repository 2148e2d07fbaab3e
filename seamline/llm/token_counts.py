"""Exact token counts at every prefix of every text, by dynamic programming over prefixes.

The encoding of a prefix ends in one token t, and what stands before t is the encoding of a shorter prefix. So the last token
and the count of every prefix follow from those of shorter ones: t is the vocabulary entry that ends there and *fits* the last
token of the prefix before it, which means that merging the two strings by rank gives back exactly these two tokens. The state
of a prefix inside a word has no word end; the count of the text cut there closes the word with one.

Prefixes are those of the normalised text (composed, lower case, each stretch of white space one space). With the counts
stored, `tokens_within` and `longest_prefix` answer truncation and budget questions without encoding again.

Cases: a null text is the empty one (0 bytes, 0 tokens, only the empty prefix). Rows, repeated ones too, stand for themselves;
a null doc_id is carried along. Texts of any length are counted whole. An empty table gives an empty result.
"""

import array
import math

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.tables import texts
from seamline.llm.word_bpe import END, LATIN_PIECES, SPACES, Remembered, chunks_of, is_latin, word_bpe

OVER = 2048
#: Pieces that a shorter prefix splits otherwise: an apostrophe alone is a piece of its own.
CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


SPACE = b"\0\0\0\0"


class Prefixes:
    def __init__(self, path: str):
        self.bpe = word_bpe(path)
        self.bytes = {c: b for b, c in enumerate(self.bpe.byte_chars)}
        self.children = {a + b: (a, b, rank) for (a, b), rank in self.bpe.ranks.items()}
        #: Every beginning of a vocabulary entry -> (itself if it is an entry, the entry of it with a word end if there is one).
        self.starts = {}
        for token in self.bpe.ids:
            bare = token.removesuffix(END)
            if self._is_whole(token):
                for k in range(1, len(bare)):
                    self.starts.setdefault(bare[:k], (None, None))
                plain, closed = self.starts.get(bare, (None, None))
                self.starts[bare] = (plain, token) if token is not bare and token != bare else (token, closed)
        self.after = {}
        self.pieces, self.chunks = Remembered(self.piece_changes), Remembered(self.chunk_changes)

    def _is_whole(self, token: str) -> bool:
        """Whether merging the token's own string gives the token."""
        bare = token.removesuffix(END)
        return self.bpe.joined([*bare[:-1], bare[-1] + token[len(bare):]]) == [token]

    def _spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The symbols that stand at one end of `token` while it is merged, first to last, each with the rank that ends it."""
        found = [(token, math.inf)]
        while (made := self.children.get(found[-1][0])) is not None:
            found.append((made[side], made[2]))
        return found[::-1]

    def _fits(self, first: str, second: str) -> bool:
        """Whether no merge joins the two tokens: at no time do the symbols at the seam merge before either is used up."""
        left, right, i, j, ranks = self._spine(first, 1), self._spine(second, 0), 0, 0, self.bpe.ranks
        while True:
            (a, a_ends), (b, b_ends) = left[i], right[j]
            rank = ranks.get((a, b))
            if rank is not None and rank < a_ends and rank <= b_ends:
                return False
            if a_ends == b_ends == math.inf:
                return True
            if a_ends <= b_ends:
                i += 1
            else:
                j += 1

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of the first 1, 2, ... characters of a piece, each closed by a word end; characters stand for bytes."""
        size, starts = len(piece), self.starts
        last, count, closed = [None] * (size + 1), [0] * (size + 1), [0] * (size + 1)
        for j in range(size):
            before, more = last[j], count[j] + 1
            fits = self.after.setdefault(before, {}) if j else None
            for k in range(j + 1, size + 1):
                entry = starts.get(piece[j:k])
                if entry is None:
                    break
                plain, ended = entry
                if plain is not None and last[k] is None:
                    if fits is None:
                        good = True
                    elif (good := fits.get(plain)) is None:
                        good = fits[plain] = self._fits(before, plain)
                    if good:
                        last[k], count[k] = plain, more
                if ended is not None and not closed[k]:
                    if fits is None:
                        good = True
                    elif (good := fits.get(ended)) is None:
                        good = fits[ended] = self._fits(before, ended)
                    if good:
                        closed[k] = more
        return closed[1:]

    def code_point_counts(self, spelled: str, piece_is: str) -> list[int]:
        """Tokens of the first 1, 2, ... code points of a piece."""
        counts = self.piece_counts(spelled)
        if piece_is in CONTRACTIONS:
            return [*range(1, len(counts)), counts[-1]]
        if spelled.isascii():
            return counts
        return [c for c, later in zip(counts, [*map(self.bytes.get, spelled[1:]), 0]) if later & 0xC0 != 0x80]

    def piece_changes(self, piece: str) -> bytes:
        """Changes of the count from one code point of a piece to the next, as 32-bit numbers."""
        if SPACES.match(piece):
            return SPACE
        return _changes(self.code_point_counts(self.bpe.spelled(piece), piece))

    def ordinary_counts(self, text: str) -> list[int]:
        """Tokens at each code point of the normalised `text`, which holds no white space and no special token."""
        out, base = [], 0
        for piece in self.bpe.ordinary(text):
            out += [base + c for c in self.code_point_counts(piece, piece)]
            base = out[-1]
        return out

    def chunk_changes(self, chunk: str) -> bytes:
        """As `piece_changes`, of a stretch between white space. A special token that is cut short counts as ordinary text."""
        out, base, open_text, start = [], 0, "", 0
        for part, special in self.bpe.parts(chunk):
            if not special:
                start, open_text = base, part
                out += [base + c for c in self.ordinary_counts(part)]
                base = out[-1] if out else base
            else:
                out += [start + self.ordinary_counts(open_text + part[:k])[-1] for k in range(1, len(part))] + [base + 1]
                base, open_text, start = base + 1, "", base + 1
        return _changes(out)

    def changes(self, text: str) -> np.ndarray:
        """Changes of the count from each code point of the normalised text to the next; their sum is the count of the text."""
        if not text:
            return np.zeros(0, "<i4")
        if is_latin(text):
            return np.frombuffer(b"".join([self.pieces[p] for p in LATIN_PIECES.findall(text.lower())]), "<i4")
        ends = bool(SPACES.match(text[0])), bool(SPACES.match(text[-1]))
        body = SPACE.join([self.chunks[c] for c in chunks_of(text)])
        return np.frombuffer(SPACE * ends[0] + body + SPACE * (ends[1] and bool(body)), "<i4")


def _changes(counts: list[int]) -> bytes:
    return array.array("i", [b - a for a, b in zip([0, *counts], counts)]).tobytes()


#: Code points whose counts go into one batch, unless a single text has more.
BATCH = 1 << 20


def counted(docs: DataFrame, path: str | None = None, limit: int = OVER, prefixes: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit, and with `prefixes` prefix_counts: the token count of the first 0,
    1, 2, ... code points of the normalised text (array)."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    key = texts(docs).schema["doc_id"].dataType.simpleString()

    def count(batches):
        tables = _tables(path)

        def result(ids, n_bytes, n_tokens, all_counts):
            columns = [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            if prefixes:
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in all_counts])]).astype(np.int32)
                values = pa.array(np.concatenate([np.zeros(0, np.int32), *all_counts]))
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(offsets), values)], [*names, "prefix_counts"]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            first, size, held = 0, 0, ([], [], [])
            for i, text in enumerate(batch.column("text")):
                changes = tables.changes(text.as_py())
                held[0].append(text.as_buffer().size)
                held[1].append(int(changes.sum()))
                if prefixes:
                    counts = np.zeros(len(changes) + 1, np.int32)
                    np.cumsum(changes, out=counts[1:])
                    held[2].append(counts)
                    size += len(counts)
                if size >= BATCH:
                    yield result(batch.column("doc_id").slice(first, i + 1 - first), *held)
                    first, size, held = i + 1, 0, ([], [], [])
            if held[0]:
                yield result(batch.column("doc_id").slice(first), *held)

    schema = f"doc_id {key}, n_bytes long, n_tokens long, over_limit boolean" + ", prefix_counts array<int>" * prefixes
    return texts(docs).mapInArrow(count, schema)


_LOADED = {}


def _tables(path: str) -> Prefixes:
    if path not in _LOADED:
        _LOADED[path] = Prefixes(path)
    return _LOADED[path]


def tokens_within(length: Column, counts: str = "prefix_counts") -> Column:
    """Tokens of the text cut after `length` code points; a longer text than there is counts whole."""
    return F.element_at(counts, F.least(length.cast("int"), F.size(counts) - 1) + 1)


def longest_prefix(budget: int, counts: str = "prefix_counts") -> Column:
    """The largest number of code points whose encoding has at most `budget` tokens. A text that fits as a whole isn't searched."""
    within = F.array_position(F.transform(F.reverse(counts), lambda c: c <= budget), True).cast("int")
    return F.when(F.element_at(counts, -1) <= budget, F.size(counts) - 1).otherwise(F.size(counts) - within)
