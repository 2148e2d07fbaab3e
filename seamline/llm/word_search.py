"""Wu-Manber search for many word sequences at once.

Symbols are words. Patterns of one length share tables: `shift` says, for a block of words, how far the window may move when
that block ends it (a block in no pattern: past itself), `buckets` holds, for blocks that end a pattern, the leading words of the
patterns that end so, by hash; the words of the text are compared with them directly. A text is read in slabs that end between words; the
last words of one are repeated in front of the next, so no occurrence is lost and memory doesn't grow with the text.
"""

BLOCK = 3
SLAB = 1 << 20
#: A-Z to a-z, digits and everything beyond ASCII as they are, all else to blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def slabs(text: str, size: int = SLAB):
    """The words of a text, as bytes, a slab at a time."""
    data, at = text.encode().translate(LETTERS), 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Length:
    """The patterns of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.shift, self.buckets = {}, {}

    def add(self, words: tuple, number: int):
        m, b = self.length, self.block
        for end in range(b, m + 1):
            block = words[end - b : end]
            self.shift[block] = min(self.shift.get(block, m), m - end)
        self.buckets.setdefault(words[m - b :], {})[words[: m - b]] = number

    def search(self, words: list, found):
        m, b, shift, n = self.length, self.block, self.shift, len(words)
        far, end = m - b + 1, m
        while end <= n:
            block = tuple(words[end - b : end])
            step = shift.get(block, far)
            if step:
                end += step
                continue
            number = self.buckets[block].get(tuple(words[end - m : end - b]))
            if number is not None:
                found(number, end - m, end)
            end += 1


class WordSearch:
    def __init__(self, patterns):
        """`patterns`: distinct sequences of at least one word, as lists of bytes; they are numbered as they come."""
        self.lengths: dict[int, _Length] = {}
        same: dict[bytes, bytes] = {}
        for number, words in enumerate(patterns):
            words = tuple(same.setdefault(w, w) for w in words)
            self.lengths.setdefault(len(words), _Length(len(words))).add(words, number)
        self.longest = max(self.lengths, default=1)

    def spans(self, text: str, size: int = SLAB):
        """(number of words, [[start, end)] of words inside an occurrence, merged, and the set of pattern numbers found)."""
        seen, spans, numbers, carried = 0, [], set(), []
        for fresh in slabs(text, size):
            words, first = carried + fresh, seen - len(carried)
            near = []

            def found(number, start, end):
                numbers.add(number)
                near.append((first + start, first + end))

            for group in self.lengths.values():
                group.search(words, found)
            if near:
                # Spans that end in the carried words may still grow; they lie at the end of the list.
                while spans and spans[-1][1] >= first:
                    near.append(tuple(spans.pop()))
                for start, end in sorted(near):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
            seen += len(fresh)
            carried = words[max(0, len(words) - self.longest + 1) :]
        return seen, spans, numbers
