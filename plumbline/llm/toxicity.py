"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic documents, the rest of the evidence is unlabelled
text: a sample of the corpus whatever its labels.  With class prior p the risk is

    p * E_P[l(g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

for the logistic loss l, so a sigmoid of g estimates P(toxic | text).  When the
second term of a batch turns negative its gradient is reversed, which keeps the
risk from going below zero by over-fitting.  Several linear models over the
presence of words and of word beginnings are trained in numpy from different
seeds and averaged.

Both samples are bounded: ``POSITIVES`` and ``UNLABELLED`` are the expected
numbers of documents, picked by a hash of the id with a threshold set from the
counts.  Features are all words and beginnings of ``LEAST_DOCS`` or more sampled
documents whose shares in the two samples differ by ``LEAST_Z`` standard errors;
there is no cap on their number.  Scoring covers all documents, whole texts, once.

Defined cases: null and empty texts get the score of a text without any feature.
Equal texts get equal scores, so repeated rows too.  Without any positive every
score is 0.  A null id is not held out and nothing is learned from its row; of
several labels of one id any 1 counts.  Texts of any length are scored whole.
Other columns are ignored (``keep`` returns them), whatever their names; an empty
table has no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vec
from plumbline.llm.bpe import text_slices

POSITIVES, UNLABELLED, LEAST_DOCS, LEAST_Z = 2500, 7500, 4, 4.0
EPOCHS, STEP_POSITIVES, RATE, DECAY, SEEDS = 250, 512, 0.05, 3e-4, (1, 2, 3)
#: Size of the strongest feature in training; weaker ones are smaller, so decay holds them closer to zero.
STRONGEST = 2.0
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def marks(word: str) -> list[str]:
    """A lower-case word and its beginnings, which catch inflected and compound forms."""
    return [word, *(word[:k] + "~" for k in STEMS if len(word) > k)]


def words(text: str) -> set[str]:
    return {m for w in set(_WORD.findall(text.lower())) for m in marks(w)}


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray
    bias: float

    def score(self, hits: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.weights[hits].sum() + self.bias))))


def risk_slope(theta: np.ndarray, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """(positive part, negative part, gradient) of the risk of one batch.

    The risk is the positive part plus the negative one.  While the negative part is
    at least 0 the gradient is that of the risk, else that of minus the negative part.
    """
    w = theta[:-1].astype(np.float32)
    z_p, z_u = x_p @ w + theta[-1], x_u @ w + theta[-1]

    def slope(x: np.ndarray, z: np.ndarray, sign: float) -> tuple[float, np.ndarray]:
        """Mean logistic loss of sign * g and its gradient."""
        d = (-sign / (1 + np.exp(np.clip(sign * z, -50, 50)))).astype(np.float32)
        return float(np.logaddexp(0, -sign * z).mean()), np.append(d @ x, d.sum()) / len(x)

    loss, pull = slope(x_p, z_p, 1)
    loss_p, push_p = slope(x_p, z_p, -1)
    loss_u, push_u = slope(x_u, z_u, -1)
    negative, rest = loss_u - prior * loss_p, push_u - prior * push_p
    return prior * loss, negative, prior * pull + rest if negative >= 0 else -rest


def train(x_p: np.ndarray, x_u: np.ndarray, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear model; absent features are 0."""
    rng = np.random.default_rng(seed)
    n = x_p.shape[1]
    theta, m, v, step = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0
    theta[-1] = np.log(prior / (1 - prior))
    decay = max(DECAY, 0.12 / len(x_p))  # a small sample is held closer to zero
    batches = max(1, len(x_p) // STEP_POSITIVES)
    for _ in range(EPOCHS // batches + 1):
        for p, u in zip(np.array_split(rng.permutation(len(x_p)), batches), np.array_split(rng.permutation(len(x_u)), batches)):
            if not len(p) or not len(u):
                continue
            *_, grad = risk_slope(theta, x_p[p], x_u[u], prior)
            grad[:-1] += decay * theta[:-1]
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def _picked(df: DataFrame, id_col: str, want: int, count: int, salt: int) -> DataFrame:
    bound = min(1 << 30, int(want / max(count, 1) * (1 << 30)))
    return df.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(salt)), F.lit(1 << 30)) < bound)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> Model:
    """Learn from the usable rows; ``usable`` is a condition on the id column."""
    labels = labels.select(id_col, label_col).where(F.col(id_col).isNotNull())
    docs = docs.select(id_col, F.col(text_col).alias("text")).where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    if usable is not None:
        labels, docs = labels.where(usable), docs.where(usable)
    n_pos, n_all = labels.agg(F.sum((F.col(label_col) == 1).cast("long")), F.count(label_col)).first()
    if not n_pos:
        return Model([], np.zeros(0), -50.0)
    prior = min(max(n_pos / n_all, 1e-4), 0.9)
    ids = _picked(labels.where(F.col(label_col) == 1), id_col, POSITIVES, n_pos, 11).select(id_col).distinct()
    positive = docs.join(F.broadcast(ids), id_col, "left_semi")  # about POSITIVES ids
    unlabelled = _picked(docs, id_col, UNLABELLED, docs.select(id_col).count(), 13)
    sample = positive.select(F.lit(1).alias("p"), "text").unionAll(unlabelled.select(F.lit(0).alias("p"), "text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([sorted(words(t)) for t in texts], pa.list_(pa.string()))], ["p", "words"])

    bags = sample.mapInArrow(vec.lean(split), "p int, words array<string>").persist()
    try:
        n_p, n_u = bags.agg(F.sum("p"), F.sum(1 - F.col("p"))).first()
        if not n_p or not n_u:
            return Model([], np.zeros(0), -50.0)
        seen = bags.select("p", F.explode("words").alias("w")).groupBy("w").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b"))
        share = (F.col("a") + F.col("b") + 1) / F.lit(float(n_p + n_u + 2))
        strength = F.abs(F.col("a") / F.lit(float(n_p)) - F.col("b") / F.lit(float(n_u))) / F.sqrt(share * (1 - share) + 1e-9)
        z = F.col("s") / F.lit((1 / n_p + 1 / n_u) ** 0.5)
        rows = seen.where(F.col("a") + F.col("b") >= LEAST_DOCS).select("w", strength.alias("s")).where(z >= LEAST_Z).collect()
        rows.sort(key=lambda r: (-r[1], r[0]))
        features = [r[0] for r in rows]
        size = STRONGEST * np.array([r[1] for r in rows], np.float32) / max(rows[0][1], 1e-9) if rows else np.zeros(0, np.float32)
        index = {w: i for i, w in enumerate(features)}

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [sorted(index[w] for w in x.as_py() if w in index) for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], ["p", "hits"])

        placed = sorted((r.p, list(r.hits)) for r in bags.mapInArrow(vec.lean(place), "p int, hits array<int>").collect())
    finally:
        bags.unpersist()
    x = np.zeros((len(placed), len(features)), np.float32)
    for i, (_, hits) in enumerate(placed):
        x[i, hits] = size[hits]
    is_p = np.array([p for p, _ in placed], bool)
    made = [train(x[is_p], x[~is_p], prior, seed) for seed in SEEDS]
    return Model(features, size * np.mean([w for w, _ in made], axis=0), float(np.mean([b for _, b in made])))


class Scorer:
    """Scores texts, with a bounded cache of what each chunk of text holds."""

    def __init__(self, model: Model, cap: int = 400_000):
        self.model, self.cap = model, cap
        self.index = {w: i for i, w in enumerate(model.features)}
        self.seen: set[str] = set()
        self.useful: dict[str, list[int]] = {}

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.seen) > self.cap:
            self.seen, self.useful = set(), {}
        out, index, useful = [], self.index, self.useful
        for t in texts:
            chunks = set(t.split())
            for c in chunks - self.seen:
                hits = [index[m] for w in _WORD.findall(c.lower()) for m in marks(w) if m in index]
                if hits:
                    useful[c] = hits
            self.seen |= chunks
            hit = sorted({i for c in chunks & useful.keys() for i in useful[c]})
            out.append(self.model.score(np.array(hit, np.int64)))
        return out


def held_out(id_col: str) -> Column:
    """Whether a row is kept for tests; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, score, predicted.  The model is broadcast."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for first, texts in text_slices(batch, text_col):
                out = scorer.scores(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], [id_col, "score", "predicted"])

    return df.select(id_col, text_col).mapInArrow(vec.lean(run), f"`{id_col}` {kind}, score double, predicted int")


def keep(df: DataFrame, model: Model, *, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the bound, all columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for first, texts in text_slices(batch, text_col):
                yield batch.slice(first, len(texts)).filter(pa.array([s < below for s in scorer.scores(texts)]))

    return df.mapInArrow(vec.lean(run), df.schema)
