"""Words of many texts at once, as numpy arrays: where they lie and 64-bit hashes of them."""

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text makes a slab of its own.
SLAB = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}
_KEPT: list = []

#: Kinds of bytes: 0 white space, 1 letters, digits and all beyond ASCII, 2 everything else.
BY_KIND = np.array([0 if b in b" \t\n\v\f\r" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
#: 0 white space, 1 everything else.
BY_SPACE = np.minimum(BY_KIND, 1)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all bits of the argument."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + _ODD
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def giving_back(work: Callable, keeps=None) -> Callable:
    """`work` on the batches of a task, after which Arrow's pool and the allocator return what they hold: workers are kept for later
    tasks, beside stages that need the memory elsewhere. `keeps`: the `lru_cache` that `work` shares with its next tasks; it is emptied
    when work of another kind begins in the same worker."""

    @wraps(work)
    def run(batches):
        _begin(keeps)
        yield from work(batches)
        _end()

    return run


def _begin(keeps) -> None:
    if _KEPT and _KEPT[0] is not keeps:
        _KEPT.pop().cache_clear()
        _end()
    if keeps is not None:
        _KEPT[:] = [keeps]


def _end() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers of an odd number modulo 2**64, and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        size, odd = 1 << (n - 1).bit_length(), int(_ODD)  # by doubling, so few sizes are ever made
        for name, base in (("up", odd), ("down", pow(odd, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def stretch_sums(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences, shifted to the start of a stretch, are equal for equal stretches; see `stretch_hash`."""
    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def stretch_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Slab:
    """Consecutive texts as bytes, a space after each."""

    first: int  # number of the first text in its batch
    data: np.ndarray
    starts: np.ndarray  # where each text begins, and the end of the last

    @property
    def texts(self) -> int:
        return len(self.starts) - 1


def slabs(texts: list[bytes] | pa.Array, limit: int = SLAB, lower: bool = False) -> Iterator[Slab]:
    """Slabs of a list of texts, or of a column without nulls, of whose bytes no more than a slab is copied at a time."""
    if isinstance(texts, list):
        ends, whole = np.cumsum([0, *map(len, texts)]), b"".join(texts)
    else:
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole = memoryview(data) if data is not None else b""
    first, n = 0, len(ends) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(ends, int(ends[first]) + limit, "right")) - 1)
        own = [bytes(whole[a:b]) for a, b in zip(ends[first:end].tolist(), ends[first + 1 : end + 1].tolist())]
        if lower:
            own = [t.decode().lower().encode() for t in own]
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in own])]).astype(np.int64)
        yield Slab(first, np.frombuffer(b" ".join(own) + b" ", np.uint8), starts)
        first = end


@dataclass
class Words:
    text: np.ndarray  # number of the text in its slab
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    kinds: np.ndarray


def words(slab: Slab, kinds: np.ndarray = BY_KIND) -> Words:
    """The maximal stretches of one kind of bytes, white space left out."""
    kind = kinds[slab.data]
    starts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(kind)]])
    kind = kind[starts]
    keep = kind != 0
    starts, ends, kind = starts[keep], ends[keep], kind[keep]
    text = np.searchsorted(slab.starts, starts, "right") - 1
    return Words(text, starts, ends, stretch_hash(stretch_sums(slab.data), starts, ends), kind)
