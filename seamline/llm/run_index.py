"""A run-length index of many short texts, and matching statistics streamed through it.

The index is the Burrows-Wheeler transform of the texts, each closed by a separator of its own, kept as runs of equal symbols. For
each run it holds the symbol, the first row, the row that this one leads to when one symbol is added on the left, the text position
sampled at the run's end, and how far the suffix of the row led to agrees with the suffix above it. Nothing has an entry for each
symbol of the texts once the index is built. Copies lengthen runs; they hardly add any.

Streaming adds one symbol after the other on the left of every text, all texts side by side, and so passes the row of every
suffix. With the row go the length in which its suffix agrees with the one above, and that one's place. Inside a run both rows
step left together: the length grows by one, the place above moves left by one. At the head of a run another suffix lies above
after the step: it comes from the end of the run before, among runs of that symbol, so its place is the one sampled there, and the
length is the one kept for the run. Rows with a length of `least` that follow each other, and the row above the first of them, are
all the places of one long match; the first place among them is the one that isn't a repeat.
"""

import numpy as np


def suffix_order(codes: np.ndarray, most: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Rows in the order of their suffixes, by doubling; and ranks by the first 1, 2, 4, ... times some symbols, up to `most` of them.
    The last symbol is one that occurs nowhere else."""
    n = len(codes)
    bits = int(codes.max()).bit_length() + 1
    step = max(1, min(63 // bits, most))
    padded = np.concatenate([codes + 1, np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = (key << bits) | padded[i : i + n]
    covered, ranks = step, {}
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if covered <= most:
            ranks[covered] = rank
        if new[1:].all() or n == 1:
            return order, ranks
        key = rank * (n + 1) + np.concatenate([rank[covered:] + 1, np.zeros(min(covered, n), np.int64)])[:n]
        covered *= 2


def agreement(codes: np.ndarray, ranks: dict[int, np.ndarray], one: np.ndarray, other: np.ndarray, most: int) -> np.ndarray:
    """In how many symbols, `most` at most, the suffixes at the places `one` and `other` agree. No two suffixes share a separator, so
    those that agree in some symbols have at least one more."""
    reach = np.zeros(len(one), np.int64)
    for size in sorted(ranks, reverse=True):
        reach += size * (ranks[size][one + reach] == ranks[size][other + reach])
    alive = np.arange(len(one))
    for _ in range(min(ranks) - 1):  # what is left is shorter than the shortest stretch with ranks
        alive = alive[codes[one[alive] + reach[alive]] == codes[other[alive] + reach[alive]]]
        reach[alive] += 1
    return np.minimum(reach, most)


class RunIndex:
    def __init__(self, texts: list[bytes], least: int):
        self.least, self.count = least, len(texts)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.lengths + 1) - 1  # places of the separators
        codes = np.empty(int(self.ends[-1]) + 1, np.int64)
        text = np.ones(len(codes), bool)
        text[self.ends] = False
        codes[text] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + self.count
        codes[self.ends] = np.arange(self.count)
        order, ranks = suffix_order(codes, least)
        before = codes[order - 1]  # the text before the first symbol is the last one: a circle
        new = np.concatenate([[True], before[1:] != before[:-1]])
        self.starts = np.flatnonzero(new)  # first row of each run
        self.symbols = before[self.starts]
        sizes = np.diff([*self.starts, len(codes)])
        by_symbol = np.lexsort((self.starts, self.symbols))
        self.leads = np.empty(len(self.starts), np.int64)
        self.leads[by_symbol] = np.cumsum(sizes[by_symbol]) - sizes[by_symbol]
        self.samples = order[self.starts + sizes - 1]  # text positions at the run ends
        # the rows led to lie side by side: above the head of one run's is the end of the run before in this order
        self.above = np.zeros(len(self.starts), np.int64)
        self.above[by_symbol[1:]] = by_symbol[:-1]
        self.reach = np.zeros(len(self.starts), np.int64)
        heads = self.leads[by_symbol[1:]]
        self.reach[by_symbol[1:]] = agreement(codes, ranks, order[heads], order[heads - 1], least)

    def step(self, rows: np.ndarray, reach: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows one symbol further left, how far (up to `least`) each agrees with the row above it, and the place of that one."""
        run = np.searchsorted(self.starts, rows, "right") - 1
        head = rows == self.starts[run]
        reach = np.where(head, self.reach[run], np.minimum(reach + 1, self.least))
        above = (np.where(head, self.samples[self.above[run]], above) - 1) % (self.ends[-1] + 1)  # texts form a circle
        return self.leads[run] + rows - self.starts[run], reach, above

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, position, position above) of all suffixes that agree with the one above them in `least` symbols. Positions are those in
        the texts one after the other, with their separators."""
        alive = np.arange(self.count)
        # the separators are the smallest suffixes, in order, and agree in nothing
        rows, reach, above = alive, np.zeros(self.count, np.int64), np.concatenate([[0], self.ends])[: self.count]
        found = []
        for k in range(1, int(self.lengths.max(initial=0)) + 1):
            keep = self.lengths[alive] >= k
            alive, rows, reach, above = alive[keep], rows[keep], reach[keep], above[keep]
            rows, reach, above = self.step(rows, reach, above)
            long = reach >= self.least
            found.append((rows[long], self.ends[alive[long]] - k, above[long]))
        return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, np.int64),) * 3

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) of the places where a match of `least` symbols begins that also begins earlier, in order."""
        row, position, above = self.matches()
        if not len(row):
            return row, row
        order = np.argsort(row)
        row, position, above = row[order], position[order], above[order]
        new = np.flatnonzero(np.concatenate([[True], np.diff(row) != 1]))
        sizes, top = np.diff([*new, len(row)]), above[new]
        first = np.minimum(np.minimum.reduceat(position, new), top)
        again = np.sort(np.concatenate([position[position != np.repeat(first, sizes)], top[top != first]]))
        text = np.searchsorted(self.ends, again)
        return text, again - (self.ends - self.lengths)[text]
