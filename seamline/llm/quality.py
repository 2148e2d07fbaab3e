"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Random indexing: every word has a sparse index vector of `NONZERO` +1 and -1, drawn by its hash. The context vector of a word is the
sum of the index vectors of its neighbours, and of their shapes, over all documents. Words share `BUCKETS` buckets by hash, so
the table of vectors has one size whatever the corpus. Each task adds up the table of its documents; slices of the tables
are summed in a shuffle, and the finished table (a few MB) goes to the driver and to all tasks.

The word `shape` (letter case, digits, punctuation, length) is indexed like a word of its own, so words never seen say something.
A document is the mean and spread of its word and shape vectors and of the steps between neighbours. The network is fitted on at most
`FIT_ROWS` labelled ids, drawn by hash, with one text each; a fifth of them is kept from the fit to calibrate the temperature.

Cases: a null text is the empty one and gets a score like any other. Labels that are null, or whose doc_id is null or absent from the
documents, teach nothing; without labels of both kinds the score is the share of label 1 (0.5 without any). Rows, repeated ones too,
are scored one by one; a null doc_id is carried along and is not held out. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seamline.llm.fast_words import giving_back, mixed, slabs, words
from seamline.llm.tables import texts
from seamline.session import written

BUCKETS = 1 << 16
DIMS = 32
NONZERO = 2
SLICE = 1024  # buckets in one row of a partial table
SLAB = 1 << 17  # bytes of text worked on at a time: the vectors of all its words lie in memory at once
FIT_ROWS = 16_000
HIDDEN = 32
THRESHOLD = 0.3
SHAPES = 256
_PIECE = "slice int, sums binary"


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder `fold`; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def shapes(slab, w) -> np.ndarray:
    """A small number for the look of each word: what kinds of characters it has, and its length."""
    data, counts = slab.data, []
    for low, high in ((65, 90), (97, 122), (48, 57), (128, 255)):
        sums = np.concatenate([[0], np.cumsum((data >= low) & (data <= high))])
        counts.append(sums[w.ends] - sums[w.starts])
    upper, lower, digits, beyond = counts
    length = w.ends - w.starts
    first_upper = (data[w.starts] >= 65) & (data[w.starts] <= 90)
    look = np.select(
        [w.kinds == 2, digits == length, (upper > 1) & (lower == 0), first_upper & (upper == 1), digits > 0, upper > 0],
        [1, 2, 3, 4, 5, 6], 0,
    )
    # marks are told apart by their character
    return np.where(look == 1, 128 + data[w.starts] % 128, np.minimum(look, 7) * 16 + np.minimum(length, 15)).astype(np.int64)


class Cut:
    """Words of a slab with their buckets: the first SHAPES buckets belong to shapes."""

    def __init__(self, slab):
        w = words(slab)
        self.text = w.text
        self.word = (SHAPES + w.hashes % np.uint64(BUCKETS - SHAPES)).astype(np.int64)
        self.shape = shapes(slab, w)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its nonzero components and their signs."""
    draws = mixed(np.arange(BUCKETS * NONZERO, dtype=np.uint64)).reshape(BUCKETS, NONZERO)
    return (draws % np.uint64(DIMS)).astype(np.int64), np.where(draws >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


@giving_back
def _count(batches):
    places, signs = index_vectors()
    sums = None
    for batch in batches:
        for slab in slabs(batch.column("text"), SLAB):
            cut = Cut(slab)
            if sums is None:
                sums = np.zeros(BUCKETS * DIMS)
            near = np.flatnonzero(cut.text[1:] == cut.text[:-1])
            for a, b in ((near, near + 1), (near + 1, near)):
                for other in (cut.word[b], cut.shape[b]):
                    for k in range(NONZERO):
                        place, sign = places[other, k], signs[other, k]
                        for at in (cut.word[a], cut.shape[a]):
                            np.add.at(sums, at * DIMS + place, sign)  # in place: no second table beside `sums`
    if sums is not None:
        for i, own in enumerate(sums.reshape(-1, SLICE * DIMS)):
            if own.any():
                yield pa.RecordBatch.from_pylist([{"slice": i, "sums": own.astype("<i8").tobytes()}], pa.schema([("slice", pa.int32()), ("sums", pa.binary())]))


@giving_back
def _add_up(batches):
    """The sum of the pieces of each slice that lies in this task."""
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, piece in zip(batch.column("slice").to_pylist(), batch.column("sums")):
            numbers = np.frombuffer(piece.as_py(), "<i8")
            totals[i] = totals[i] + numbers if i in totals else numbers
    for i, own in totals.items():
        yield pa.RecordBatch.from_pylist([{"slice": i, "sums": own.tobytes()}], pa.schema([("slice", pa.int32()), ("sums", pa.binary())]))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors of all buckets over all of `docs`, of length 1 (0 where nothing was seen). Counts are whole numbers, so
    the order in which they are added changes nothing."""
    pieces = texts(docs).select("text").mapInArrow(_count, _PIECE)
    rows = pieces.repartition(BUCKETS // SLICE, "slice").mapInArrow(_add_up, _PIECE).collect()
    sums = np.zeros((BUCKETS // SLICE, SLICE * DIMS))
    for row in rows:
        sums[row["slice"]] = np.frombuffer(row["sums"], "<i8")
    vectors = sums.reshape(BUCKETS, DIMS)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1.0)).astype(np.float32)


def _mean(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Means of the rows of `values` by text; `text` is sorted."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(text):
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])
        out[text[cuts]] = np.add.reduceat(values, cuts, axis=0) / np.diff([*cuts, len(text)])[:, None]
    return out


def pooled(slab, vectors: np.ndarray) -> np.ndarray:
    cut, n = Cut(slab), slab.texts
    word, shape = vectors[cut.word], vectors[cut.shape]
    near = np.flatnonzero(cut.text[1:] == cut.text[:-1])
    steps = np.abs(word[near + 1] - word[near])
    means = [_mean(word, cut.text, n), _mean(shape, cut.text, n)]
    spreads = [np.sqrt(np.maximum(_mean(v * v, cut.text, n) - m * m, 0)) for v, m in zip((word, shape), means)]
    count = np.bincount(cut.text, minlength=n).astype(np.float32)
    same = np.bincount(cut.text[near], cut.word[near] == cut.word[near + 1], minlength=n) / np.maximum(count, 1)
    return np.hstack([*means, *spreads, _mean(steps, cut.text[near], n), np.log1p(count)[:, None], same[:, None].astype(np.float32)])


FEATURES = 5 * DIMS + 2


class Network:
    """tanh layer, then a logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7, epochs: int = 60):
        draw = np.random.default_rng(seed)
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        check = draw.random(len(y)) < 0.2
        if len(np.unique(y[check])) < 2 or len(np.unique(y[~check])) < 2:
            check[:] = False
        z = (x - self.middle) / self.spread
        own, target = z[~check], y[~check].astype(np.float64)
        self.weights = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(own))
            for at in range(0, len(own), 256):
                rows = order[at : at + 256]
                step += 1
                for i, g in enumerate(self._gradients(own[rows], target[rows])):
                    first[i] += 0.1 * (g - first[i])
                    second[i] += 0.001 * (g * g - second[i])
                    self.weights[i] -= 2e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        if check.any():
            self.temperature = calibrated(self._logits(z[check]), y[check])

    def _gradients(self, z, y):
        hidden = np.tanh(z @ self.weights[0] + self.weights[1])
        error = (_logistic(hidden @ self.weights[2] + self.weights[3]) - y) / len(y)
        back = error[:, None] * self.weights[2] * (1 - hidden**2)
        return z.T @ back + 1e-4 * self.weights[0], back.sum(axis=0), hidden.T @ error, error.sum(keepdims=True)

    def _logits(self, z):
        return np.tanh(z @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self._logits((x - self.middle) / self.spread) / self.temperature)


def _logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def calibrated(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature under which the labels are likeliest."""
    tries = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
    loss = [np.mean(np.logaddexp(0, -np.where(y == 1, logits, -logits) / t)) for t in tries]
    return float(tries[int(np.argmin(loss))])


class Share:
    """The score where labels of one kind, or none, were given."""

    def __init__(self, y):
        self.share = float(np.mean(y)) if len(y) else 0.5

    def score(self, x):
        return np.full(len(x), self.share)


def labelled_sample(labels: DataFrame, label: str, folds: int, fold: int, rows: int) -> DataFrame:
    """At most `rows` labelled ids outside the held-out fold, drawn by hash: (doc_id, label). Its size is bounded by `rows`."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(text, label), stored: one text for each sampled id, so never more rows than `sample` has. Where an id has several texts, their
    hashes choose; they are reduced before they are sent."""
    found = texts(docs).join(F.broadcast(sample), "doc_id")
    chosen = found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return written(chosen.select("text", "label"), "labelled-texts")


def fit(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality", folds: int = 5, fold: int = 0, rows: int = FIT_ROWS):
    @giving_back
    def features(batches):
        table = vectors.value
        for batch in batches:
            for slab in slabs(batch.column("text"), SLAB):
                x = pooled(slab, table).astype("<f4")
                own = batch.slice(slab.first, slab.texts)
                yield pa.RecordBatch.from_arrays([own.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    found = labelled_texts(docs, labelled_sample(labels, label, folds, fold, rows))
    taken = found.mapInArrow(features, "label int, x binary").collect()
    y = np.array([r["label"] for r in taken], int)
    x = np.array([np.frombuffer(r["x"], "<f4") for r in taken], np.float64).reshape(-1, FEATURES)
    order = np.lexsort((*x.T[:3], y))  # the order of arrival must not matter
    return Network(x[order], y[order]) if len(np.unique(y)) == 2 else Share(y)


def with_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """`row` (all columns of `docs`) and `score`."""
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    model = context.broadcast(fit(docs, labels, vectors, folds=folds, fold=fold))

    @giving_back
    def score(batches):
        for batch in batches:
            text = pc.fill_null(batch.column("row").field("text"), "")
            found = [model.value.score(pooled(slab, vectors.value)) for slab in slabs(text, SLAB)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(found) if found else np.zeros(0))], ["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(score, StructType([StructField("row", docs.schema), StructField("score", DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5, fold: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    rows = with_scores(docs.select("doc_id", "text"), labels, folds, fold).select("row.doc_id", "score")
    return rows.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that the classifier rejects. All columns of `docs`, and only those, come back."""
    rows = with_scores(docs, labels).filter(F.col("score") >= threshold)
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
