"""Quality scores learned from pairs of documents (Bradley-Terry).

Each preference pair is a labelled good and a labelled bad document; the score
is linear in figures of the whole text (shares of kinds of letters, of repeated
words and lines, and square roots of the shares of its words in ``HASHED``
classes by hash), and its weights minimise the logistic loss on the pairs'
feature differences, with a penalty on their squares.  The cut between good and bad
is the quantile of the training scores that separates the labels best, and the
score a document gets is a logistic curve that is 0.3 at that cut.

Fitting takes a bounded sample of the labelled rows (``SAMPLE`` rows, the
smallest by a hash of the key) and ``PAIRS`` pairs for each document of the
rarer label; features and scores are computed for every row.

Defined results: null and empty texts are scored like any other, from figures
that are all zero; labels without a document, null labels and null keys teach
nothing; without a pair every score is 0.5; other columns stay, and columns
named like an added one are replaced.
"""

from __future__ import annotations

import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, block_words, held_out, mix, small_batches

SAMPLE = 20_000
PAIRS = 8
CUT = 0.3
#: Classes of words, and the penalties on the weights of figures and of classes.
HASHED = 128
PENALTY = (1e-2, 0.3)
#: Pairs that a step of the fit takes at a time.
AT_ONCE = 4096
FEATURES = ("upper_share", "digit_share", "mark_share", "odd_mark_share", "high_share", "distinct_share", "adjacent_share", "lone_mark_share", "marked_end_share", "word_length", "log_words", "line_share")
_BYTES = np.zeros((256, 5))
_BYTES[ord("A") : ord("Z") + 1, 0] = 1
_BYTES[ord("0") : ord("9") + 1, 1] = 1
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _BYTES[_c, 2 if chr(_c) in ".,;:'\"-()?" else 3] = 1
_BYTES[128:, 4] = 1
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_ODD_ENDS = frozenset(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?")


def figures(body: bytes) -> np.ndarray:
    """Figures of a whole text, none of which grows with its length but by logarithm."""
    words = body.split()
    if not words:
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(body, np.uint8), minlength=256) @ _BYTES / sum(map(len, words))
    n, distinct = len(words), len(set(words))
    adjacent = sum(map(operator.eq, words, words[1:])) / n
    lone = sum(not w.strip(_MARKS) for w in words) / n
    ends = sum(w[-1] in _ODD_ENDS for w in words) / n
    lines = body.splitlines()
    return np.array([*counts, np.log1p(distinct) / np.log1p(n), adjacent, lone, ends, sum(map(len, words)) / n, np.log1p(n), len(set(lines)) / len(lines)])


def features(bodies: list[bytes]) -> np.ndarray:
    """A row for each text: its figures, and the square roots of the shares of its words in each class."""
    if not bodies:
        return np.zeros((0, len(FEATURES) + HASHED))
    h, starts = block_words(bodies)
    sizes = np.diff(starts)
    place = np.repeat(np.arange(len(bodies)), sizes) * HASHED + (mix(h, 601) % U64(HASHED)).astype(np.int64)
    counts = np.bincount(place, minlength=len(bodies) * HASHED).reshape(len(bodies), HASHED)
    return np.hstack([np.array([figures(b) for b in bodies]), np.sqrt(counts / np.maximum(sizes, 1)[:, None])])


def _mapped(df: DataFrame, of, name: str, kind: str, pa_kind) -> DataFrame:
    """``df`` with a column of what ``of`` makes of a list of texts."""
    df = small_batches(df).drop(name)
    columns = df.columns
    at = columns.index("text")

    def mapper(batches):
        for batch in batches:
            made = of([(t or "").encode() for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa_kind)], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(mapper, f"{schema}, {name} {kind}")


class Ranking:
    """Weights of standardised features, the score at the cut and the steepness around it."""

    def __init__(self, mean, scale, weights, cut, spread):
        self.mean, self.scale, self.weights, self.cut, self.spread = mean, scale, weights, cut, spread

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((self.raw(x) - self.cut) / self.spread, -30, 30) + np.log(CUT / (1 - CUT)) * (self.weights != 0).any()
        return 1 / (1 + np.exp(-z))


def gradient(diff: np.ndarray, w: np.ndarray, penalty: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised logistic loss of pairs (rows of ``diff`` should score above 0), its gradient and its second derivatives."""
    n, d = diff.shape
    loss, first, second = 0.5 * float(penalty @ (w * w)), penalty * w, np.diag(penalty)
    for at in range(0, n, AT_ONCE):
        x = diff[at : at + AT_ONCE].astype(float)
        z = x @ w
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss += float(np.logaddexp(0, -z).sum()) / n
        first = first - x.T @ (1 - p) / n
        second = second + (x * (p * (1 - p))[:, None]).T @ x / n
    return loss, first, second


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ranking:
    """Bradley-Terry weights from pairs of rows of ``x`` labelled 1 and 0."""
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(d), np.ones(d), np.zeros(d), 0.0, 1.0)
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.clip((x - mean) / scale, -6, 6).astype(np.float32)
    n = PAIRS * min(len(good), len(bad))
    n = max(n, len(good), len(bad))
    over = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    diff = z[over(good)] - z[over(bad)]
    penalty = np.where(np.arange(d) < len(FEATURES), *PENALTY)
    w = np.zeros(d)
    for _ in range(25):  # Newton steps
        _, first, second = gradient(diff, w, penalty)
        step = np.linalg.solve(second, first)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    s, label = s[order], y[order]
    below_bad = np.cumsum(label == 0) / len(bad)
    below_good = np.cumsum(label == 1) / len(good)
    quantile = int(np.argmax(np.where(np.r_[np.diff(s) > 0, True], below_bad - below_good, -1)))
    cut = (s[quantile] + s[min(quantile + 1, len(s) - 1)]) / 2
    return Ranking(mean, scale, w, cut, max(s.std(), 1e-9) / 4)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """A ranking fitted on labelled rows whose crc32 of the key leaves anything but 0 by 5."""
    teach = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(5, 0)).select(F.col("doc_id").alias("__of"), F.col("quality").cast("int").alias("__label"))
    teach = teach.orderBy(F.xxhash64("__of"), "__of").limit(sample)
    known = docs.select("doc_id", "text").join(F.broadcast(teach), F.col("doc_id") == F.col("__of"))  # SAMPLE small rows at most
    rows = _mapped(known, lambda texts: features(texts).astype(np.float32).tolist(), "x", "array<float>", pa.list_(pa.float32())).select("doc_id", "__label", "x").distinct().toArrow()
    x = np.array(rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(rows.num_rows, len(FEATURES) + HASHED)
    y, key = (rows.column(c).to_numpy() for c in ("__label", "doc_id"))
    order = np.lexsort((*x.T[:3], y, key))
    return fit(x[order], y[order].astype(int))


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``CUT`` on)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)

    def of(texts):
        return shared.value.score(features(texts)) if texts else []

    return _mapped(docs.drop("predicted"), of, "score", "double", pa.float64()).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
