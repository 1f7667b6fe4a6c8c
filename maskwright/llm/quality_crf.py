"""Document quality by a linear-chain conditional random field over lines.

Every line gets a state, bad or good.  Node scores are linear in the line's own
statistics and its neighbours'; a 2 x 2 matrix scores consecutive states.
Forward-backward gives each line's probability of good, and a document's
quality is the mean of these, weighted by line length and then mapped by a
monotone logistic curve that puts the best cut on the training rows at 0.7.

Training takes at most ``max_docs`` labelled documents (by hash order of their
ids, one row for each id) of at most ``max_lines`` lines together, whole texts; a document's label stands for its lines at first, and lines
of bad documents that look good are relabelled once.  Scores depend on the text
alone.  Null and empty texts are scored as one empty line; repeated rows get
equal scores; other columns are left as they are.  If the labels hold a single
class, all documents get its score, 1 or 0; with no labels at all, 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import small_batches
from .tokens import Words, groups

CUT = 0.7
MAX_DOCS = 3000
#: Lines of all training documents together; their features, 92 bytes a line, are what the driver gets.
MAX_LINES = 500_000
#: Lines that are gone through one after the other.
STRETCH = 1024

_CLASSES = {"symbol": b"#*$%&|<>~^=_\\", "pipe": b"|", "exclaim": b"!?", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)), "tail": bytes(range(0x80, 0xC0)), "lead": bytes(range(0xC0, 256))}
_SELF = ("symbol", "pipe", "exclaim", "upper", "repeat", "words", "width", "digit", "again", "empty")
_NEAR = ("symbol", "pipe", "exclaim", "upper", "repeat", "width")
N_FEATURES = 1 + len(_SELF) + 2 * len(_NEAR)


def _class_tables() -> dict[str, np.ndarray]:
    out = {}
    for name, members in _CLASSES.items():
        out[name] = np.zeros(256, np.int32)
        out[name][list(members)] = 1
    return out


_TABLES = _class_tables()


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths, and the bounds of each text's lines."""
    w = Words(texts)
    data = w.data
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    bounds = np.searchsorted(starts, w.places[:-1])
    bounds = np.append(bounds, len(starts))

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (sums[ends] - sums[starts]).astype(np.float64)

    count = {name: per_line(table[data]) for name, table in _TABLES.items()}
    latin_upper = np.zeros(len(data), bool)
    latin_upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = count["upper"] + per_line(latin_upper)
    length = (ends - starts) - count["tail"]
    letters = count["upper"] + count["lower"] + count["lead"]
    line_of = np.searchsorted(starts, w.starts, "right") - 1
    n_words = np.bincount(line_of, minlength=len(starts)).astype(np.float64)
    same = np.zeros(len(line_of), bool)
    if len(line_of) > 1:
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (line_of[1:] == line_of[:-1])
    repeats = np.bincount(line_of[same], minlength=len(starts))
    some, words = np.maximum(length, 1), np.maximum(n_words, 1)
    # a line equal to an earlier one of its text, told by its words in order
    with np.errstate(over="ignore"):
        rank = np.arange(len(line_of)) - np.searchsorted(line_of, line_of)
        value = w.hashes * (rank.astype(np.uint64) * np.uint64(2) + np.uint64(1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        first = np.searchsorted(line_of, np.arange(len(starts) + 1))
        key = sums[first[1:]] - sums[first[:-1]]
        key += np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(bounds)) * np.uint64(0x9E3779B97F4A7C15)
    again = np.ones(len(starts), bool)
    again[np.unique(key, return_index=True)[1]] = False
    own = {
        "symbol": np.minimum(4 * count["symbol"] / some, 1), "pipe": np.minimum(count["pipe"] / words, 1), "exclaim": np.minimum(4 * count["exclaim"] / words, 4) / 4,
        "upper": upper / np.maximum(letters, 1), "repeat": repeats / words, "words": np.minimum(np.log1p(n_words) / 5, 2),
        "width": np.minimum(length / words / 20, 2), "digit": np.minimum(4 * count["digit"] / some, 1), "again": (again & (n_words > 0)).astype(float),
        "empty": (n_words == 0).astype(float),
    }
    inner = np.ones(len(starts), bool)
    inner[bounds[:-1]] = False
    columns = [np.ones(len(starts)), *(own[c] for c in _SELF)]
    for c in _NEAR:
        before, after = np.zeros(len(starts)), np.zeros(len(starts))
        before[1:] = own[c][:-1]
        after[:-1] = own[c][1:]
        columns += [before * inner, after * np.append(inner[1:], False)]
    return np.stack(columns, 1), length, bounds


def _cut(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the texts' stretches of at most ``STRETCH`` lines, and the text of each."""
    n = np.diff(bounds)
    many = -(-n // STRETCH)
    of = np.repeat(np.arange(len(n)), many)
    at = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * STRETCH
    return bounds[:-1][of] + at, np.minimum(STRETCH, n[of] - at), of


def _scaled(v: np.ndarray) -> np.ndarray:
    return v / v.reshape(len(v), -1).sum(1).reshape(-1, *[1] * (v.ndim - 1))


def _ends(node: np.ndarray, m: np.ndarray, first: np.ndarray, n: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each stretch gets from the stretches of its text before and after it.

    The passage through a stretch is a 2 x 2 matrix; all are multiplied up side
    by side, then the stretches of a text are gone through one by one.
    """
    opens = np.append(True, of[1:] != of[:-1])
    # a text begins with its first node, without a passage to it
    through = np.where(opens[:, None, None], np.eye(2), m) * node[first][:, None, :]
    for t in range(1, int(n.max())):
        on = np.flatnonzero(n > t)
        through[on] = _scaled(through[on] @ (m * node[first[on] + t][:, None, :]))
    before, after = np.ones((len(first), 2)), np.ones((len(first), 2))
    rank = np.arange(len(of)) - np.flatnonzero(opens)[of]
    for k in range(int(rank.max())):
        on = np.flatnonzero(rank == k + 1)  # stretches that have k + 1 before them
        before[on] = _scaled(np.einsum("ij,ijk->ik", before[on - 1], through[on - 1]))
    left = np.bincount(of)[of] - 1 - rank
    for k in range(int(left.max())):
        on = np.flatnonzero(left == k + 1)
        after[on] = _scaled(np.einsum("ijk,ik->ij", through[on + 1], after[on + 1]))
    return before, after


def forward_backward(score: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good for each line, and the summed pair marginals (2 x 2).

    Lines are gone through side by side for all stretches, so the number of
    steps is bounded for texts of any length.
    """
    node = np.exp(np.stack([-score / 2, score / 2], 1).clip(-30, 30))
    alpha, beta, pairs = np.empty_like(node), np.ones_like(node), np.zeros((2, 2))
    if not len(node):
        return score[:0], pairs
    m = np.exp(trans)
    first, n, of = _cut(bounds)
    opens = np.append(True, of[1:] != of[:-1])
    before, after = _ends(node, m, first, n, of) if len(first) > len(bounds) - 1 else (None, None)
    order = np.argsort(-n, kind="stable")
    first, n, opens = first[order], n[order], opens[order]
    steps = int(n[0])
    active = np.searchsorted(-n, -np.arange(steps), "left")  # stretches with more than t lines
    for t in range(steps):
        at = first[: active[t]] + t
        if t:
            a = (alpha[at - 1] @ m) * node[at]
        else:
            a = node[at] if before is None else np.where(opens[:, None], node[at], (before[order] @ m) * node[at])
        alpha[at] = a / a.sum(1, keepdims=True)
    if after is not None:
        beta[first + n - 1] = after[order]
    for t in range(steps - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = (node[at + 1] * beta[at + 1]) @ m.T
        beta[at] = b / b.sum(1, keepdims=True)
    inner = np.ones(len(node), bool)
    inner[bounds[:-1]] = False
    inner = np.flatnonzero(inner)
    for lo in range(0, len(inner), 1 << 16):
        at = inner[lo : lo + (1 << 16)]
        joint = alpha[at - 1][:, :, None] * m * (node[at] * beta[at])[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs


class Model:
    """Weights of the field and of the curve from the weighted mean to the score."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, slope: float = 1.0, centre: float = 0.0, constant: float | None = None):
        self.weights, self.trans, self.slope, self.centre, self.constant = weights, trans, slope, centre, constant

    def means(self, features: np.ndarray, length: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        good, _ = forward_backward(features @ self.weights, bounds, self.trans)
        weight = length + 1e-6
        return np.add.reduceat(good * weight, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not len(texts):
            return np.full(len(texts), self.constant if self.constant is not None else 0.0)
        x = _logit(self.means(*line_features(texts)))
        return 1 / (1 + np.exp(-(self.slope * (x - self.centre) + _logit(np.array([CUT]))[0])))


def _logit(p: np.ndarray) -> np.ndarray:
    p = p.clip(1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _climb(features: np.ndarray, bounds: np.ndarray, state: np.ndarray, line_weight: np.ndarray, start: Model | None, steps: int, l2: float) -> Model:
    """Gradient ascent (Adam) on the log-likelihood of the given line states."""
    w = np.zeros(features.shape[1] + 4)
    if start is not None:
        w[:] = np.concatenate([start.weights, start.trans.ravel()])
    inner = np.ones(len(state), bool)
    inner[bounds[:-1]] = False
    pair = np.zeros((2, 2))
    np.add.at(pair, (state[:-1][inner[1:]], state[1:][inner[1:]]), 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = line_weight.sum()
    for i in range(1, steps + 1):
        good, pairs = forward_backward(features @ w[:-4], bounds, w[-4:].reshape(2, 2))
        grad = np.concatenate([features.T @ ((state - good) * line_weight), (pair - pairs).ravel()]) / total - l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w = w + 0.3 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return Model(w[:-4], w[-4:].reshape(2, 2))


def fit(features: np.ndarray, length: np.ndarray, bounds: np.ndarray, quality: np.ndarray, steps: int = 60, l2: float = 1e-4) -> Model:
    """Fit on the lines of labelled documents."""
    if len(set(quality.tolist())) < 2:
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), constant=float(quality[0]) if len(quality) else 1.0)
    state = np.repeat(quality, np.diff(bounds))
    weight = np.ones(len(state))
    model = _climb(features, bounds, state, weight, None, steps, l2)
    good, _ = forward_backward(features @ model.weights, bounds, model.trans)
    worst = np.repeat(np.minimum.reduceat(good, bounds[:-1]), np.diff(bounds))
    state = np.where((state == 0) & (good > 0.5) & (good > worst), 1, state)
    model = _climb(features, bounds, state, weight, model, steps, l2)
    x = _logit(model.means(features, length, bounds))
    # the cut with the fewest errors, each class weighing the same, in the widest gap
    order = np.argsort(x, kind="stable")
    bad = np.cumsum(quality[order] == 0) / (quality == 0).sum()
    lost = np.cumsum(quality[order] == 1) / (quality == 1).sum()
    gain = bad - lost
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    ahead = np.append(x[order][1:], x[order][-1])
    k = best[np.argmax((ahead - x[order])[best])]
    model.centre = float((x[order][k] + ahead[k]) / 2)
    slopes = np.array([0.25, 0.5, 1.0, 2.0])
    sign = np.where(quality == 1, 1, -1)
    loss = [np.log1p(np.exp(-sign * (s * (x - model.centre)))).mean() for s in slopes]
    model.slope = float(slopes[int(np.argmin(loss))])
    return model


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, quality, texts = (batch.column(i).to_pylist() for i in range(3))
        for a, b in groups([len(t or "") for t in texts]):
            f, length, bounds = line_features(texts[a:b])
            f, length = f.astype(np.float32), length.astype(np.float32)
            cut = list(zip(bounds[:-1], bounds[1:], strict=True))
            blobs = [pa.array([x[i:j].tobytes() for i, j in cut], pa.binary()) for x in (f, length)]
            n = pa.array([j - i for i, j in cut], pa.int64())
            yield pa.record_batch([pa.array(keys[a:b], pa.int64()), pa.array(quality[a:b], pa.int32()), n, *blobs], ["doc_id", "quality", "n", "f", "length"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Model:
    """Fit on at most ``max_docs`` labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    sample = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    )
    # of rows that share an id one stands for all, by hash of the text
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
    found = chosen.select("doc_id", "quality", "row.text").mapInArrow(_feature_rows, "doc_id long, quality int, n long, f binary, length binary").filter(F.col("n") <= max_lines)
    # at most max_docs rows: the first of them, by the same order, that have no more lines together
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    rows = found.withColumn("so_far", so_far).filter(F.col("so_far") <= max_lines).collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.f))
    if not rows:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0), np.zeros(1, int), np.zeros(0, int))
    length = [np.frombuffer(r.length, np.float32) for r in rows]
    features = np.concatenate([np.frombuffer(r.f, np.float32).reshape(-1, N_FEATURES) for r in rows]).astype(np.float64)
    return fit(features, np.concatenate(length).astype(np.float64), np.concatenate([[0], np.cumsum([len(x) for x in length])]), np.array([r.quality for r in rows]))


def scorer(model: Model):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        values = [v if isinstance(v, str) else None for v in values]
        parts = [model.score(values[a:b]) for a, b in groups([len(v or "") for v in values])]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    score = scorer(train(docs, labels, max_docs))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The documents predicted good, columns unchanged."""
    score = scorer(train(docs, labels, max_docs))
    return docs.filter(score("text") >= CUT)
