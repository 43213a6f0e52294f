"""A hidden Markov language model of words, trained and applied over partitions.

Tokens are words (cut at ASCII white space, A-Z in lower case) and one end a
text.  Their counts over all training texts are taken exactly, by 64-bit word
hashes.  The model emits classes: the ``TOP`` commonest words are one each, all
other words fall into ``TAILS`` classes by their last two bytes, and the end is
one.  A word's probability is its class's under the hidden Markov model times
``(c + 1) / (N + V + 1)`` within the class (``c`` its count, ``N`` tokens and
``V`` distinct words of the class in training; what was never seen shares the
last part).

Baum-Welch starts from the class counts of all training texts, which each state
weighs in its own way, and takes rounds over all training texts until a round
gains less than ``SETTLED`` a token, ``ROUNDS`` at most: each task sums its
expected counts, Spark adds the tasks' sums.  Training reads long texts in
stretches of ``STRETCH`` tokens, of which all but the first begin with the
states' overall shares.  Scores come from the scaled forward recursion over
whole texts, however long; texts of a task advance side by side.

Counts of the ``KNOWN`` commonest words at most are broadcast; those of all
other words reach the texts by a join on the word's hash.

Defined results: a null or empty text is its end alone; without training texts
every word is unknown and classes are equally likely; rows with a null key
belong to the training texts; repeated rows count as often as they occur; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, as_long, block_words, blocks, materialize, mix, small_batches, word_hashes

STATES = 8
TOP, TAILS = 4096, 128
END = TOP + TAILS
SYMBOLS = END + 1
KNOWN = 1 << 18
#: Rounds at most, and the gain in log10 a token below which training has settled.
ROUNDS, SETTLED = 6, 0.003
STRETCH = 512
#: Tokens that a task holds side by side, in training and in scoring.
TRAINED, SCORED = 400_000, 3_000_000


def _tail_class(words: list[bytes]) -> np.ndarray:
    return (mix(word_hashes([w[-2:] for w in words]), 501) >> U64(57)).astype(np.int64)


def _distinct(bodies: list[bytes]):
    """Distinct words of a block: hashes, tail classes, counts, the number of each token, where texts begin."""
    words = [w for b in bodies for w in b.split()]
    h = word_hashes(words)
    u, first, back, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    sizes = np.array([len(b.split()) for b in bodies])
    return u, _tail_class([words[i] for i in first]), n, back, np.r_[0, np.cumsum(sizes)]


def _source(docs: DataFrame, held) -> DataFrame:
    return small_batches(docs).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("body"))


def word_counts(source: DataFrame) -> DataFrame:
    """``h, tail, c``: how often each word occurs in the texts that aren't held out."""

    def mapper(batches):
        held: list[tuple] = []

        def sent():
            h, tail, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, back = np.unique(h, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(as_long(u)), pa.array(tail[first].astype(np.int32)), pa.array(np.bincount(back, n, len(u)).astype(np.int64))], names=["h", "tail", "c"])

        for (bodies,) in blocks(batches, 0):
            u, tail, n, _, _ = _distinct([b.lower() for b in bodies])
            held.append((u, tail, n))
            if sum(len(x[0]) for x in held) >= 2_000_000:
                yield sent()
                held.clear()
        if held:
            yield sent()

    teach = source.where(~F.col("held_out")).select("body")
    return teach.mapInArrow(mapper, "h long, tail int, c long").groupBy("h", "tail").agg(F.sum("c").alias("c"))


class Lexicon:
    """Counts of the commonest words and of the classes."""

    def __init__(self, counts: DataFrame, ends: int):
        size = F.floor(F.log2("c") * 8).cast("int")
        steps = sorted(((r["s"], r["n"]) for r in counts.groupBy(size.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
        least, room = None, KNOWN
        for step, n in steps:  # a few hundred steps, however many words
            if n > room:
                break
            least, room = step, room - n
        known = counts.where(size >= F.lit(least if least is not None else 1 << 20)).toArrow()
        h, tail, c = (known.column(x).to_numpy() for x in ("h", "tail", "c"))
        h = h.view(U64)
        order = np.argsort(h)
        self.h, self.tail, self.c = h[order], tail[order].astype(np.int64), c[order].astype(np.int64)
        top = np.lexsort((self.h, -self.c))[:TOP]
        self.symbol = TOP + self.tail
        self.symbol[top] = np.arange(len(top))
        n, v = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
        for r in counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
            n[TOP + r["tail"]], v[TOP + r["tail"]] = r["c"], r["v"]
        self.tokens, self.words = int(n.sum()) + ends, int(v.sum()) + (ends > 0)
        np.subtract.at(n, TOP + self.tail[top], self.c[top])
        np.subtract.at(v, TOP + self.tail[top], 1)
        self.ends = ends
        self.classes = n.copy()
        self.classes[: len(top)] = self.c[top]
        self.classes[END] = ends
        self.within = np.zeros(SYMBOLS)
        self.within[TOP:END] = -np.log10(n[TOP:END] + v[TOP:END] + 1)

    def find(self, h: np.ndarray):
        """Where each hash stands, -1 for those that aren't here."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        return np.where(self.h[at] == h, at, -1) if len(self.h) else np.full(len(h), -1)


def _coded(source: DataFrame, lexicon) -> DataFrame:
    """Each text as symbols, with what the lexicon says of it and the hashes of the words that it lacks."""
    names = ["doc_id", "held_out", "n_tokens", "known", "logs", "within", "others", "symbols"]

    def mapper(batches):
        x = lexicon.value
        for ids, held, bodies in blocks(batches, 0, 1, 2):
            u, tail, _, back, edges = _distinct([b.lower() for b in bodies])
            at = x.find(u)
            symbol = np.where(at >= 0, x.symbol[at] if len(x.h) else 0, TOP + tail)
            count = np.where(at >= 0, x.c[at] if len(x.h) else 0, 0)
            top = symbol < TOP
            logs, within = np.log10(count + 1.0), np.where(top, 0.0, np.log10(count + 1.0)) + x.within[symbol]
            sums = lambda v: np.diff(np.r_[0.0, np.cumsum(v[back])][edges])
            sym = symbol[back].astype("<u2")
            lost = at[back] < 0
            hashes = as_long(u)[back]
            others = [hashes[a:b][lost[a:b]] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            symbols = [sym[a:b].tobytes() + END.to_bytes(2, "little") for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(held), pa.array(np.diff(edges) + 1), pa.array(sums(at >= 0).astype(np.int64) + (x.ends > 0)), pa.array(sums(logs) + np.log10(x.ends + 1)), pa.array(sums(within)), pa.array(others, pa.list_(pa.int64())), pa.array(symbols, pa.binary())], names=names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(mapper, f"doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, within double, others array<long>, symbols binary")


class Model:
    """Start, transition and emission probabilities; ``later`` is the start of a stretch inside a text."""

    def __init__(self, start, move, emit, later):
        self.start, self.move, self.emit, self.later = start, move, emit, later

    @classmethod
    def of_counts(cls, start, move, emit):
        emit = emit + 0.02
        later = emit.sum(1) / emit.sum()
        share = lambda x: x / x.sum(-1, keepdims=True)
        return cls(share(start + 1.0), share(move + 1.0), share(emit), later)


def started(classes: np.ndarray, seed: int = 11) -> Model:
    """States that stay as they are nine times of ten and weigh the class counts by chance."""
    emit = classes * np.exp(np.random.default_rng(seed).normal(size=(STATES, SYMBOLS)))
    share = emit.sum(1, keepdims=True)
    return Model.of_counts(share[:, 0], np.diag(share[:, 0]) * 0.9 + share * 0.1 / STATES, emit)


def _side_by_side(texts: list[np.ndarray]):
    """Texts by falling length in one array: (symbols, begin of each, length of each, texts alive at each step, order)."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.concatenate([texts[i] for i in order]).astype(np.int64)
    alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    return flat, np.cumsum(sizes) - sizes, alive, order


def forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of the probability of each text's symbols, by the scaled forward recursion."""
    flat, begin, alive, order = _side_by_side(texts)
    emit = np.ascontiguousarray(model.emit.T)
    alpha = np.repeat(model.start[None], len(texts), 0)
    total = np.zeros(len(texts))
    for step, n in enumerate(alive):
        now = alpha[:n] @ model.move if step else alpha[:n]
        now = now * emit[flat[begin[:n] + step]]
        scale = now.sum(1)
        alpha[:n] = now / scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(texts))
    out[order] = total
    return out


def expected(model: Model, texts: list[np.ndarray], first: np.ndarray):
    """Expected start, transition and emission counts of stretches, and log10 of their probability; ``first``: which of them begin a text."""
    flat, begin, alive, order = _side_by_side(texts)
    first = first[order]
    emit = np.ascontiguousarray(model.emit.T)
    steps, m = len(alive), len(texts)
    alphas, scales, seen = [], [], []
    alpha = np.where(first[:, None], model.start, model.later)
    for step, n in enumerate(alive):
        b = emit[flat[begin[:n] + step]]
        now = (alpha[:n] @ model.move if step else alpha) * b
        scale = now.sum(1, keepdims=True)
        alpha = now / scale
        alphas.append(alpha)
        scales.append(scale)
        seen.append(b)
    move, emission = np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
    gammas, at = [], []
    beta = np.ones((m, STATES))
    for step in range(steps - 1, -1, -1):
        n = alive[step]
        gammas.append(alphas[step] * beta[:n])
        at.append(flat[begin[:n] + step])
        if step:
            ahead = beta[:n] * seen[step] / scales[step]
            move += alphas[step - 1][:n].T @ ahead
            beta[:n] = ahead @ model.move.T
    start = gammas[-1][first].sum(0)
    gamma, at = np.concatenate(gammas), np.concatenate(at)
    for k in range(STATES):
        emission[k] = np.bincount(at, gamma[:, k], SYMBOLS)
    return start, move * model.move, emission, float(sum(np.log10(x).sum() for x in scales))


def _baum_welch(coded: DataFrame, model: Model) -> tuple[Model, float]:
    """One round over all training texts: the model after it, and log10 a token before it."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    states = [f"s{k}" for k in range(STATES)]

    def mapper(batches):
        m = shared.value
        start, move, emission = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, SYMBOLS))
        texts, first, n = [], [], 0
        told = np.zeros(STATES)

        def add():
            a, b, c, log = expected(m, texts, np.array(first))
            start.__iadd__(a)
            move.__iadd__(b)
            emission.__iadd__(c)
            told[:2] += log, n

        for batch in batches:
            for body in batch.column(0).to_pylist():
                t = np.frombuffer(body, "<u2")
                for i in range(0, len(t), STRETCH):
                    texts.append(t[i : i + STRETCH])
                    first.append(i == 0)
                    n += len(texts[-1])
                if n >= TRAINED:
                    add()
                    texts, first, n = [], [], 0
        if n:
            add()
        rows = np.vstack([start[None], move, emission.T, told[None]])
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(rows[some, k]) for k in range(STATES))], names=["row", *states])

    schema = "row int, " + ", ".join(f"{s} double" for s in states)
    summed = coded.where(~F.col("held_out")).select("symbols").mapInArrow(mapper, schema).groupBy("row").agg(*(F.sum(s).alias(s) for s in states))
    rows = np.zeros((2 + STATES + SYMBOLS, STATES))
    for r in summed.collect():  # as many rows as classes and states
        rows[r["row"]] = [r[s] for s in states]
    return Model.of_counts(rows[0], rows[1 : 1 + STATES], rows[1 + STATES : -1].T), rows[-1, 0] / max(rows[-1, 1], 1)


def score_texts(docs: DataFrame, held) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every text; ``held``: those that teach nothing."""
    sc = docs.sparkSession.sparkContext
    source = _source(docs, held)
    counts = materialize(word_counts(source), "words")
    ends = source.where(~F.col("held_out")).count()
    lexicon = Lexicon(counts, ends)
    coded = materialize(_coded(source, sc.broadcast(lexicon)).withColumn("row", F.monotonically_increasing_id()), "coded")
    model, before = started(lexicon.classes), -np.inf
    for _ in range(ROUNDS):
        model, now = _baum_welch(coded, model)
        if now - before < SETTLED:
            break
        before = now
    shared = sc.broadcast(model)

    def mapper(batches):
        m = shared.value
        for batch in batches:
            texts = [np.frombuffer(b, "<u2") for b in batch.column(batch.num_columns - 1).to_pylist()]
            scores, begin, n = [], 0, 0
            for i, t in enumerate(texts):
                n += len(t)
                if n >= SCORED or i == len(texts) - 1:
                    scores.append(forward(m, texts[begin : i + 1]))
                    begin, n = i + 1, 0
            made = np.concatenate([*scores, np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], names=[*batch.schema.names[:-1], "classes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = coded.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "within", "symbols").mapInArrow(mapper, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, within double, classes double")
    rare = coded.select("row", F.explode("others").alias("h")).join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("more"), F.count("*").alias("also"))
    joined = scored.join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    total = float(np.log10(lexicon.tokens + lexicon.words + 1))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("classes") + F.col("within") + more).alias("score"),
    )
