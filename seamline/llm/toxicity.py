"""Toxicity scores by weak supervision: many voters, a generative label model over their votes, a linear classifier on its posteriors.

Terms are whole words and word beginnings of several lengths, in lower case, hashed to `TERMS` buckets. Term statistics of the
labelled sample name the terms that stand out. Those nearly confined to toxic texts form the strong lexicons, one for each kind of
term and `PARTS` parts of it; those that are only more frequent there form the weak lexicons, one for each kind. Voters:
  * a strong lexicon part votes "toxic" on a text with a term of it, and abstains otherwise;
  * pattern voters vote "toxic" on texts that hold terms of a weak lexicon densely or often;
  * clean voters vote "clean" on texts without strong terms, without terms of any lexicon, or with weak terms at most sparsely.
The label model is a mixture of two classes in which each voter has its own rates of votes (its accuracy), fitted by expectation
maximisation. Voters that agree more than the classes explain are correlated; what they say is divided by the size of their
crowd. The posteriors, not the labels, train the classifier: logistic regression over the terms that stand out and the densities.

Everything is fitted on at most `FIT_ROWS` labelled ids, drawn by hash, with one text each, stored once; every text is scored whole.

Cases: a null text is the empty one and gets a score like any other. Labels that are null, or whose doc_id is null or absent from
the documents, teach nothing; without labels of both kinds the score is the share of label 1 (0.5 without any). Rows, repeated
ones too, are scored one by one; a null doc_id is carried along and is not held out. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.fast_words import mixed, slabs, stretch_hash, stretch_sums, words
from seamline.llm.quality import FIT_ROWS, Share, _add_up, _logistic, held_out, labelled_sample, labelled_texts
from seamline.llm.tables import texts

TERMS = 1 << 20
SLICE = 1 << 13
#: Bytes of a word's beginning that make a term; the last kind is the whole word.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
KINDS = len(BEGINNINGS) + 1
PARTS = 3
THRESHOLD = 0.7
#: A term stands out if its log odds are this many standard errors from the sample's, and it is in so many texts.
ERRORS, SUPPORT = 3.5, 4
#: Share of toxic texts among those with a strong term (less one standard error), and odds of a weak term against the sample's.
PURE, LIFT = 0.85, 8.0
DENSE, OFTEN, SPARSE = (0.01, 0.03), 4, 0.003
_PIECE = "slice int, sums binary"


def terms(slab):
    """(text, term bucket, kind) of every word and its beginnings, and the number of words of each text."""
    w = words(slab)
    keep = w.kinds == 1
    text, starts, ends = w.text[keep], w.starts[keep], w.ends[keep]
    sums = stretch_sums(slab.data)
    found = []
    for kind, length in enumerate((*BEGINNINGS, None)):
        own = np.arange(len(text)) if length is None else np.flatnonzero(ends - starts > length)
        until = ends[own] if length is None else starts[own] + length
        hashes = mixed(stretch_hash(sums, starts[own], until) + np.uint64(kind))
        found.append((text[own], (hashes % np.uint64(TERMS)).astype(np.int64), np.full(len(own), kind, np.int8)))
    return *[np.concatenate(x) for x in zip(*found)], np.bincount(text, minlength=slab.texts)


def _distinct(text, term, kind=None):
    """Distinct (text, term) pairs with their counts, and the kind of each."""
    pairs, first, counts = np.unique(text * TERMS + term, return_index=True, return_counts=True)
    return pairs // TERMS, pairs % TERMS, counts, None if kind is None else kind[first]


def term_counts(sample: DataFrame) -> np.ndarray:
    """How many texts of each label hold each term; `sample`: (text, label). Counted where the texts are, summed by slices."""

    def count(batches):
        sums = None
        for batch in batches:
            labels = batch.column("label").to_numpy()
            for slab in slabs(batch.column("text"), lower=True):
                text, term, _, _ = _distinct(*terms(slab)[:2])
                if sums is None:
                    sums = np.zeros(2 * TERMS, np.int64)
                sums += np.bincount(term * 2 + labels[slab.first + text], minlength=2 * TERMS)
        for i, own in enumerate(sums.reshape(-1, SLICE * 2) if sums is not None else ()):
            if own.any():
                yield pa.RecordBatch.from_pylist([{"slice": i, "sums": own.astype("<i8").tobytes()}], pa.schema([("slice", pa.int32()), ("sums", pa.binary())]))

    rows = sample.mapInArrow(count, _PIECE).repartition(TERMS // SLICE, "slice").mapInArrow(_add_up, _PIECE).collect()
    out = np.zeros((TERMS // SLICE, SLICE * 2), np.int64)
    for row in rows:
        out[row["slice"]] = np.frombuffer(row["sums"], "<i8")
    return out.reshape(TERMS, 2)


class Lexicon:
    """The terms that stand out, and the part of the lexicon that each belongs to (-1: none)."""

    def __init__(self, counts: np.ndarray, texts_by_label: np.ndarray):
        with np.errstate(divide="ignore"):
            odds = np.log((counts[:, 1] + 0.5) / (texts_by_label[1] + 1)) - np.log((counts[:, 0] + 0.5) / (texts_by_label[0] + 1))
        error = np.sqrt(1 / (counts[:, 0] + 0.5) + 1 / (counts[:, 1] + 0.5))
        self.terms = np.flatnonzero((counts.sum(axis=1) >= SUPPORT) & (np.abs(odds) >= ERRORS * error))
        self.place = np.full(TERMS, -1, np.int32)
        self.place[self.terms] = np.arange(len(self.terms))
        n0, n1 = counts[self.terms, 0] + 0.5, counts[self.terms, 1] + 0.5
        pure = n1 / (n0 + n1)
        self.strong = pure - np.sqrt(pure * (1 - pure) / (n0 + n1)) >= PURE
        self.weak = ~self.strong & (odds[self.terms] >= np.log(LIFT))
        self.part = (mixed(self.terms.astype(np.uint64)) % np.uint64(PARTS)).astype(np.int64)

    @property
    def size(self) -> int:
        return len(self.terms) + 4 * KINDS

    def look(self, slab):
        """(text, feature, value) of the terms that stand out and of counts and densities of the lexicons; and the votes on each text:
        1 toxic, 0 clean, -1 none."""
        text, term, kind, n_words = terms(slab)
        place = self.place[term]
        hit = place >= 0
        pair_text, pair_place, counts, kinds = _distinct(text[hit], place[hit].astype(np.int64), kind[hit])
        strong, weak = self.strong[pair_place], self.weak[pair_place]
        held = [np.bincount(pair_text[own] * KINDS + kinds[own], counts[own], slab.texts * KINDS).reshape(-1, KINDS) for own in (strong, weak)]
        density = [x / np.maximum(n_words, 1)[:, None] for x in held]
        parts = np.full((slab.texts, KINDS * PARTS), -1, np.int8)
        parts[pair_text[strong], kinds[strong] * PARTS + self.part[pair_place[strong]]] = 1
        patterns = [*[density[1] >= level for level in DENSE], held[1] >= OFTEN]
        none = held[0].sum(axis=1) == 0
        cleans = [none, none & (held[1].sum(axis=1) == 0), none & (density[1].max(axis=1) < SPARSE)]
        votes = [parts, *[np.where(p, 1, -1).astype(np.int8) for p in patterns], *[np.where(c, 0, -1).astype(np.int8)[:, None] for c in cleans]]
        dense = np.hstack([*[np.log1p(x) for x in held], *[np.minimum(x * 30, 3) for x in density]])
        rows, cols = np.nonzero(dense)
        features = np.concatenate([pair_text, rows]), np.concatenate([pair_place, len(self.terms) + cols]), np.concatenate([np.log1p(counts), dense[rows, cols]])
        return features, np.hstack(votes)


class LabelModel:
    """P(class | votes): each voter's rates of its three votes by class, and a weight below 1 for correlated voters."""

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 60):
        n, voters = votes.shape
        self.prior = prior
        self.weight = np.ones(voters)
        is_vote = [(votes == v).astype(float) for v in (-1, 0, 1)]
        toxic, clean = is_vote[2].sum(axis=1), is_vote[1].sum(axis=1)
        posterior = np.where(toxic > clean, 0.9, 0.1 * prior)
        for step in range(rounds):
            by_class = np.stack([posterior, 1 - posterior])
            mass = by_class.sum(axis=1)[:, None]
            self.rates = np.stack([(by_class @ x + 0.5) / (mass + 1.5) for x in is_vote])  # vote, class, voter
            if step in (10, 30):
                self.weight = self._weights(is_vote, by_class)
            posterior = self.posterior(votes)

    @staticmethod
    def _weights(is_vote, by_class):
        """1 / (1 + how much each voter agrees with all others beyond what the classes explain)."""
        signed = is_vote[2] - is_vote[1]
        left = np.zeros_like(signed)
        for c in by_class:
            left += c[:, None] * (signed - (c @ signed) / max(c.sum(), 1e-9))
        spread = left.std(axis=0) + 0.02  # what the classes explain all but wholly isn't correlated
        agree = np.clip((left / spread).T @ (left / spread) / len(left), 0, 1)
        np.fill_diagonal(agree, 0)
        return 1 / (1 + agree.sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log(self.rates[:, 0]) - np.log(self.rates[:, 1])  # vote, voter
        said = sum((votes == v) @ (logs[v + 1] * self.weight) for v in (0, 1))  # to abstain says nothing
        return _logistic(said + np.log(self.prior / (1 - self.prior)))


class Linear:
    def __init__(self, lexicon: Lexicon, rows, cols, values, target: np.ndarray, rounds: int = 1200):
        self.lexicon, self.weights, self.base = lexicon, np.zeros(lexicon.size), 0.0
        first, second = np.zeros(lexicon.size + 1), np.zeros(lexicon.size + 1)
        for step in range(1, rounds + 1):
            error = (self._of(rows, cols, values, len(target)) - target) / len(target)
            slope = np.append(np.bincount(cols, error[rows] * values, lexicon.size) + 5e-4 * self.weights, error.sum())
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
            self.weights, self.base = self.weights - move[:-1], self.base - move[-1]

    def _of(self, rows, cols, values, n):
        return _logistic(np.bincount(rows, self.weights[cols] * values, n) + self.base)

    def score(self, slab) -> np.ndarray:
        (rows, cols, values), _ = self.lexicon.look(slab)
        return self._of(rows, cols, values, slab.texts)


class Even:
    def __init__(self, y):
        self.share = Share(y)

    def score(self, slab):
        return self.share.score(range(slab.texts))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, fold: int = 1, rows: int = FIT_ROWS):
    found = labelled_texts(docs, labelled_sample(labels, label, folds, fold, rows))
    by_label = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(by_label) < 2:
        return Even([k for k, n in by_label.items() for _ in range(n)])
    lexicon = Lexicon(term_counts(found), np.array([by_label[0], by_label[1]]))
    sent = found.sparkSession.sparkContext.broadcast(lexicon)

    def look(batches):
        for batch in batches:
            for slab in slabs(batch.column("text"), lower=True):
                (text, feature, value), votes = sent.value.look(slab)
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(slab.texts + 1))
                feature, value = feature[order].astype("<i4"), value[order].astype("<f4")
                own = [(feature[a:b].tobytes(), value[a:b].tobytes(), v.tobytes()) for a, b, v in zip(cuts, cuts[1:], votes)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], pa.binary()) for i in range(3)], ["features", "values", "votes"])

    taken = sorted(tuple(map(bytes, r)) for r in found.mapInArrow(look, "features binary, values binary, votes binary").collect())
    votes = np.array([np.frombuffer(r[2], np.int8) for r in taken])
    target = LabelModel(votes, by_label[1] / (by_label[0] + by_label[1])).posterior(votes)
    counts = [len(r[0]) // 4 for r in taken]
    cols = np.concatenate([np.frombuffer(r[0], "<i4") for r in taken])
    values = np.concatenate([np.frombuffer(r[1], "<f4") for r in taken]).astype(float)
    return Linear(lexicon, np.repeat(np.arange(len(taken)), counts), cols, values, target)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 3, fold: int = 1) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, folds=folds, fold=fold))
    key = docs.schema["doc_id"].dataType.simpleString()

    def score(batches):
        for batch in batches:
            found = [model.value.score(slab) for slab in slabs(batch.column("text"), lower=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else np.zeros(0))], ["doc_id", "score"])

    rows = texts(docs).mapInArrow(score, f"doc_id {key}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
