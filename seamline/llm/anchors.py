"""Content-defined pieces of texts: every window of a text belongs to one anchor, chosen by what the window holds.

A window of `WINDOW` bytes holds `WINDOW - GRAM + 1` grams. Its anchor is the gram with the smallest hash, the leftmost of several.
Equal windows have equal anchors at equal places. The windows of one anchor are consecutive; the bytes they cover are its piece.
So equal windows meet wherever pieces of equal anchors meet, and nothing else has to be compared.
"""

import numpy as np

from seamline.llm.fast_words import stretch_hash, stretch_sums

WINDOW = 100
GRAM = 32
#: Bytes of text handled at a time: the numbers made of them, 8 bytes a place, stay in a core's cache.
SLAB = 1 << 16
#: The low bits that hold a place; the same in all slabs, so that equal windows choose alike whatever lies around them.
PLACE = np.uint64(32)


def pieces(slab, window: int = WINDOW, gram: int = GRAM):
    """(text, anchor hash, first window's start in its text, number of windows, hash of the piece) for all texts of a slab."""
    data, n = slab.data, len(slab.data)
    lengths = np.diff(slab.starts) - 1  # without the space that follows each text
    if n < window:
        return [np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64)]
    sums = stretch_sums(data)
    at = np.arange(n - gram + 1)
    grams = stretch_hash(sums, at, at + gram)
    # the hash above, the place below: the smallest value is the smallest hash, the leftmost of equal ones
    keys = (grams >> PLACE << PLACE) | at.astype(np.uint64)
    span, have, least = window - gram + 1, 1, keys
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[: len(keys) - span + 1], least[span - have : span - have + len(keys) - span + 1])
    # only windows inside one text
    inside = np.zeros(n + 1, np.int64)
    some = lengths >= window
    np.add.at(inside, slab.starts[:-1][some], 1)
    np.add.at(inside, slab.starts[:-1][some] + lengths[some] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    anchor = (least[starts] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(slab.starts, starts, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])) if len(starts) else np.zeros(0, int)
    counts = np.diff([*new, len(starts)])
    first = starts[new]
    return text[new], grams[anchor[new]], first - slab.starts[text[new]], counts, stretch_hash(sums, first, first + counts - 1 + window)
