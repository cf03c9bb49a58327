"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled documents of quality 1; everything else the model sees is
unlabelled text (negative labels are not used). The class prior is estimated from the two
samples: a first classifier separates positives from unlabelled texts, and on rows it was
not fitted to the prior is the smallest ratio between the shares of unlabelled and positive
texts above a score, with both shares moved by their sampling error (best bin). The second
classifier minimises the unbiased risk with a logistic loss, whose negative part is held at
zero or above, so its sigmoid is the probability of quality 1.

The text is turned into measures of its shape (lengths, repetition, symbols, case), each cut
into quantile bins, and the classifier is linear in the bins. Measures are computed over whole
texts, wherever they are long.

Fitting takes at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` rows, chosen by hash and never
from held-out rows; scoring takes every row. Nulls: a null text counts as empty and gets the
score of a text without words; null labels are no labels; a null id is scored. Repeated rows
get equal scores. With no positive or no unlabelled text every score is 0.5. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import bounded, held_out, learning_rows, modest_batches
from barspan.llm.textops import Words, text_chunks, tidy, windows

#: Rows that are fitted at most.
MAX_POSITIVE, MAX_UNLABELLED = 4000, 8000
BINS = 16
STEPS = 400
#: Parts of the samples that the first classifier leaves out in turn.
FOLDS = 5
#: Weight decay of the classifier that the prior comes from, and of the final one.
FIRST_DECAY, DECAY = 2e-3, 3e-4

_BYTES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "pipe": b"|",
    "symbol": b"#$%&*@^~=+<>{}[]_\\/",
    "shout": b"!?",
    "point": b".,;:'\"()-",
    "line": b"\n",
    "high": range(128, 256),
}
MEASURES = (
    "words", "word_length", "distinct", "same_as_previous", "repeated_pairs", "top_word",
    "single", "upper", "digit", "pipe", "symbol", "shout", "point", "line", "high",
)


def measures(column: pa.Array) -> np.ndarray:
    """Rows of ``MEASURES`` for a column of texts."""
    out = [np.zeros((0, len(MEASURES)))]
    for _, raw, offsets in text_chunks(column):
        count = {}
        for name, values in _BYTES.items():
            table = np.zeros(256, bool)
            table[list(values)] = True
            count[name] = np.diff(np.append(0, np.cumsum(table[raw]))[offsets])
        size = np.maximum(np.diff(offsets), 1)
        letters = np.maximum(count["upper"] + count["lower"], 1)
        words = Words(raw, offsets)
        h, n = words.hashes(), np.diff(words.of_doc)
        pairs = windows(h, 2)
        rows = np.zeros((len(n), len(MEASURES)))
        total, single = np.append(0, np.cumsum(words.length)), np.append(0, np.cumsum(words.length == 1))
        at, many = words.of_doc, np.maximum(n, 1)
        rows[:, 0] = np.log1p(n)
        rows[:, 1] = np.diff(total[at]) / many
        rows[:, 6] = np.diff(single[at]) / many
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if b - a > 1:
                own = np.sort(h[a:b])
                new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                two = np.sort(pairs[a : b - 1])
                rows[i, 2] = np.log(len(new)) / np.log(b - a)
                rows[i, 3] = np.mean(h[a + 1 : b] == h[a : b - 1])
                rows[i, 4] = np.mean(two[1:] == two[:-1]) if len(two) > 1 else 0
                rows[i, 5] = np.diff(np.append(new, b - a)).max() / (b - a)
        rows[:, 7] = count["upper"] / letters
        for k, name in enumerate(("digit", "pipe", "symbol", "shout", "point", "line", "high"), start=8):
            rows[:, k] = count[name] / size
        out.append(rows)
    return np.concatenate(out)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class ShapeModel:
    """Linear scores over binned measures."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray):
        self.cuts, self.weights = cuts, weights

    @staticmethod
    def bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        """Column of each measure's bin; the constant is column 0."""
        place = [np.searchsorted(c, x[:, i], side="right") + 1 + i * (BINS + 1) for i, c in enumerate(cuts)]
        return np.stack([np.zeros(len(x), np.int64), *place], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(x, self.cuts)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))


def _fit(rows_p, rows_u, width, gradient, decay):
    """Adam over the gradients that ``gradient(f_p, f_u)`` gives for the two samples."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, STEPS + 1):
        gp, gu = gradient(w[rows_p].sum(axis=1), w[rows_u].sum(axis=1))
        g = np.bincount(rows_p.ravel(), np.repeat(gp, rows_p.shape[1]), width)
        g += np.bincount(rows_u.ravel(), np.repeat(gu, rows_u.shape[1]), width)
        penalty = decay * w
        penalty[0] = 0
        g += penalty
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def estimate_prior(score_p: np.ndarray, score_u: np.ndarray, slack: float = 1.36) -> float:
    """Share of positives among the unlabelled texts, from scores of rows not fitted."""
    score_p, score_u = np.sort(score_p), np.sort(score_u)
    cuts = np.unique(score_p)
    above_p = 1 - np.searchsorted(score_p, cuts) / len(score_p)
    above_u = 1 - np.searchsorted(score_u, cuts) / len(score_u)
    error = slack * (1 / np.sqrt(len(score_p)) + 1 / np.sqrt(len(score_u)))
    best = np.argmin((above_u + error) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[ShapeModel, float]:
    """The model and the estimated prior."""
    qs = np.linspace(0, 1, BINS + 1)[1:-1]
    both = np.concatenate([positive, unlabelled])
    cuts = [np.unique(np.quantile(both[:, i], qs)) for i in range(both.shape[1])]
    width = 1 + len(cuts) * (BINS + 1)
    p, u = ShapeModel.bins(positive, cuts), ShapeModel.bins(unlabelled, cuts)

    def apart(fp, fu):
        return -_sigmoid(-fp) / len(fp), _sigmoid(fu) / len(fu)

    score_p, score_u = np.zeros(len(p)), np.zeros(len(u))
    of_p, of_u = np.arange(len(p)) % FOLDS, np.arange(len(u)) % FOLDS
    for k in range(FOLDS):  # every row is scored by a classifier that was not fitted to it
        rest_p, rest_u = (of_p != k, of_u != k) if min(len(p), len(u)) > FOLDS else (of_p >= 0, of_u >= 0)
        w = _fit(p[rest_p], u[rest_u], width, apart, FIRST_DECAY)
        score_p[of_p == k], score_u[of_u == k] = w[p[of_p == k]].sum(axis=1), w[u[of_u == k]].sum(axis=1)
    prior = estimate_prior(score_p, score_u)

    def risk(fp, fu):
        """Gradient of ``prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)])``."""
        as_negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp_pos, gp_neg, gu = -prior * _sigmoid(-fp) / len(fp), -prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)
        if as_negative < 0:  # over-fitted: step back on the negative part alone
            return -gp_neg, -gu
        return gp_pos + gp_neg, gu

    return ShapeModel(cuts, _fit(p, u, width, risk, DECAY)), prior


def _measured(rows: DataFrame, bound: int) -> np.ndarray:
    def run(batches):
        for b in batches:
            x = pa.array(list(measures(b.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("pick"), x], ["pick", "x"])

    found = bounded(rows.select("text", "pick").mapInArrow(tidy(run), "pick long, x array<double>"), bound)
    return np.array([r.x for r in found]).reshape(-1, len(MEASURES))


def train(docs: DataFrame, labels: DataFrame) -> tuple[ShapeModel, float] | None:
    """Model and prior, fitted on bounded samples of rows that are not held out; None without a sample."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long"))
    positive = _measured(learning_rows(docs, good, MAX_POSITIVE), MAX_POSITIVE)
    unlabelled = _measured(learning_rows(docs, None, MAX_UNLABELLED), MAX_UNLABELLED)
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else None


def score(docs: DataFrame, model: ShapeModel | None) -> DataFrame:
    """Add ``score`` to the (doc_id, text) rows; ``text`` is not returned."""

    def run(batches):
        for b in batches:
            s = np.full(b.num_rows, 0.5) if model is None else model.score(measures(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(s)], ["doc_id", "key", "score"])

    modest_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.withColumn("key", F.xxhash64("doc_id", "text"))
    return src.mapInArrow(tidy(run), "doc_id long, key long, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs, fitted(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fitted(docs: DataFrame, labels: DataFrame) -> ShapeModel | None:
    found = train(docs, labels)
    return found[0] if found else None


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns; all of them if nothing can be fitted."""
    modest_batches(docs.sparkSession)
    model, names = fitted(docs, labels), docs.columns
    if model is None:
        return docs

    def run(batches):
        for b in batches:
            good = model.score(measures(b.column("_quality_text"))) >= threshold
            yield b.select(names).filter(pa.array(good))

    return docs.withColumn("_quality_text", F.col("text").cast("string")).mapInArrow(tidy(run), docs.schema)
