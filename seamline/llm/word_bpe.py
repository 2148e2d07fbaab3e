"""Byte-pair encoding with word ends, over the vocabulary file of a public tokenizer.

A text is cut into pieces by the tokenizer's pattern; white space belongs to no piece. The pieces of a corpus repeat, so each
worker keeps the results of those it has seen, up to a bound. Texts of characters below U+0250 need no composition and are cut
here; other texts go through the tokenizer's own normaliser and splitter, chunk by chunk. Merging is always done here.
"""

import functools
import heapq
import json
import re
import unicodedata

END = "</w>"
KNOWN = 250_000
#: White space of the Unicode standard, as the tokenizer's pattern sees it; str.split() also cuts at the four control characters.
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROLS = re.compile("[\x1c-\x1f]")
#: Characters below this bound are composed already, and lower case is a matter of each alone. One exception is left to the library.
LATIN, DOTTED_I = 0x250, chr(0x130)


def _of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)


SPACE_CLASS = SPACES.pattern[1:-2]
LATIN_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^{SPACE_CLASS}{_of('L')}{_of('N')}]+|[{SPACE_CLASS}]+")
BEYOND = re.compile(f"[^\0-{chr(LATIN - 1)}]|{DOTTED_I}|<\\|")


def is_latin(text: str) -> bool:
    """Whether `LATIN_PIECES` cuts the lower-case text as the tokenizer does."""
    return BEYOND.search(text) is None


def chunks_of(text: str) -> list[str]:
    """The stretches of `text` between white space."""
    return [c for c in SPACES.split(text) if c] if CONTROLS.search(text) else text.split()


class Remembered(dict):
    """Results of `make` by argument: those of the last `limit` new arguments, and of older ones that were asked for since."""

    def __init__(self, make, limit=KNOWN):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        value = self[key] = self.make(key) if value is None else value
        return value


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.ids = whole["model"]["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(whole["model"]["merges"])}
        self.specials = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.specials.items()]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.byte_chars = byte_characters()
        self.as_bytes = {c: "".join(self.byte_chars[b] for b in chr(c).encode()) for c in range(LATIN)}

    def ordinary(self, text: str) -> list[str]:
        """The pieces of a text without white space or special tokens, as characters that stand for bytes."""
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def spelled(self, piece: str) -> str:
        """A piece of `LATIN_PIECES` as characters that stand for bytes."""
        return piece.translate(self.as_bytes)

    def parts(self, chunk: str) -> list[tuple[str, bool]]:
        """`chunk` cut at special tokens: (text, whether it is one)."""
        if "<|" not in chunk:
            return [(chunk, False)]
        return [(p, p in self.specials) for p in self.special_pattern.split(chunk) if p]

    def merge(self, piece: str) -> list[str]:
        """The tokens of one piece, whose last symbol carries the word end."""
        return self.joined([*piece[:-1], piece[-1] + END])

    def joined(self, symbols: list[str]) -> list[str]:
        """`symbols` with all merges done. A queue holds the possible merges by rank and place; symbols form a doubly linked list. An
        entry whose symbols have changed since it was queued is stale and skipped."""
        before, after, ranks = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1], self.ranks
        queue = [(rank, i, pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if j < 0 or symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue
            symbols[i], symbols[j] = pair[0] + pair[1], ""
            after[i], after[j] = after[j], -1
            if after[i] >= 0:
                before[after[i]] = i
                if (rank := ranks.get(near := (symbols[i], symbols[after[i]]))) is not None:
                    heapq.heappush(queue, (rank, i, near))
            if (k := before[i]) >= 0 and (rank := ranks.get(near := (symbols[k], symbols[i]))) is not None:
                heapq.heappush(queue, (rank, k, near))
        return [s for s in symbols if s]

    def tokens(self, chunk: str) -> list[str]:
        """The tokens of a chunk, special ones included."""
        found = []
        for part, special in self.parts(chunk):
            if special:
                found.append(part)
            else:
                for piece in self.ordinary(part):
                    found += self.merge(piece)
        return found

    def token_id(self, token: str) -> int:
        return self.specials[token] if token in self.specials else self.ids[token]

    def decode(self, ids) -> str:
        """Vocabulary strings one after the other. The file names no decoder, so a space stands between them."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def byte_characters() -> list[str]:
    """For each byte the character that stands for it: itself where it is printable, else one from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(b if b in set(shown) else rest[b]) for b in range(256)]


@functools.lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    """One loaded vocabulary per worker process."""
    return WordBpe(path)
