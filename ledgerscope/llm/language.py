"""Language identification by cross-parsing.

For each language the automaton of all substrings of a bounded sample of its
labelled texts is built (a suffix automaton).  A text is parsed into phrases,
each the longest match of what follows that the language's sample has; the
fewer phrases, the closer the language.  Phrases are normalised as
``log2(sample length) * phrases / symbols``, the cross entropy estimate in bits
a symbol, and the language of the smallest one wins (ties: the first by name).

Texts are parsed whole.  So that long ones don't go symbol by symbol alone, all
texts are cut into pieces of ``PIECE`` symbols that are parsed side by side, and
each piece then is parsed anew from the state that the one before ended in,
until a phrase begins where one began before: from there on nothing changes.  A
piece that ends without such a place hands its new state on.  Phrases are those
of an unbroken parse (a test compares them).

An automaton's transitions stand in one array each, every state's row shifted
so that rows interlock (``Rows``): its size follows the sample, whatever the
alphabet.

Symbols are letters in lower case; whatever stands between letters is one
space; letters that a language's sample lacks match nothing there.  Learning
takes rows whose crc32 of the key doesn't leave 1 by 3 and whose text and
language aren't null: of each language the ``4 * ROWS`` distinct texts with the
smallest hashes, cut into passages of ``PASSAGE`` characters all through; the
sample is a passage of each text by hash, then a second one of each, and so on:
``SYMBOLS`` characters, or the language's part of ``ALL_SYMBOLS`` where there
are many languages, one passage at least.

Defined results: ``und`` and score 0 for a null text or one without a letter,
or if nothing could be learned; the score of a text is the winner's share of
``2 ** -phrases`` over all languages; other columns stay.
"""

from __future__ import annotations

import functools
import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, materialize, small_batches

ROWS = 64
SYMBOLS = 40_000
#: Symbols of all languages together: it bounds what is broadcast, not which languages are learned.
ALL_SYMBOLS = 640_000
PIECE = 1024
#: Characters of a passage, of which samples are made.
PASSAGE = 1000
#: Rows (language and hash, some 30 bytes) that are broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Symbols that a task parses side by side.
BLOCK = 4_000_000
OTHER = "�"


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter's code point, 0 for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        letter = chr(c)
        if letter.isalpha():
            low = letter.lower()
            table[c] = ord(low[0])
    return table


def letters(text: str | None) -> np.ndarray:
    """Code points of the letters in lower case, with one 32 for each gap between them."""
    points = _folded()[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    gap = points == 0
    keep = ~gap
    keep[1:] |= gap[1:] & ~gap[:-1]
    points = np.where(gap, 32, points)[keep]
    return points[:-1] if len(points) and points[-1] == 32 else points


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``symbols``; state 0 is the empty match."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


class Rows:
    """Transitions in interlocking rows: that of state ``s`` by ``c`` is at ``base[s] + c``, if that place is owned by ``s``.

    Rows of many symbols are placed first, each in one of the first gaps that
    it fits, or one tried by chance, or else at the end; the many rows of one
    symbol fill what is left.
    """

    TRIES = 16

    def __init__(self, follow: list[dict[int, int]], width: int):
        base, owner, target = [0] * len(follow), [-1] * (2 * width), [-1] * (2 * width)
        gap, end, chance = 0, 0, random.Random(0)
        for state in sorted((s for s in range(len(follow)) if follow[s]), key=lambda s: -len(follow[s])):
            row = follow[state]
            least = min(row)
            while gap < len(owner) and owner[gap] >= 0:
                gap += 1
            near = max(gap, least)
            places = itertools.chain(range(near, near + self.TRIES), (chance.randint(near, max(near, end)) for _ in range(self.TRIES)), itertools.count(max(near, end)))
            for at in places:
                if at + width >= len(owner):
                    owner += [-1] * (len(owner) + width)
                    target += [-1] * (len(target) + width)
                if all(owner[at - least + c] < 0 for c in row):
                    break
            base[state] = at - least
            for c, to in row.items():
                owner[at - least + c], target[at - least + c] = state, to
            end = max(end, at - least + max(row) + 1)
        size = end + width + 1
        pad = lambda x: np.array((x + [-1] * size)[:size], np.int32)
        self.base, self.owner, self.target = np.array(base, np.int32), pad(owner), pad(target)
        self.root = np.array([follow[0].get(c, 0) for c in range(width + 1)], np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol each, and where a phrase begins with it."""
        at = self.base[state] + c
        goes_on = self.owner[at] == state
        return np.where(goes_on, self.target[at], self.root[c]), ~goes_on | (state == 0)


class Parser:
    """Automata of all languages, each over its own letters."""

    def __init__(self, samples: dict[str, list[np.ndarray]]):
        self.names = sorted(samples)
        self.alphabet = np.unique(np.concatenate([np.array([32], np.int32), *(t for texts in samples.values() for t in texts)]))
        self.rows, self.codes, self.bits = [], [], []
        for name in self.names:
            joined = np.concatenate([np.r_[t, 32] for t in samples[name]])
            own = np.unique(joined)
            width = len(own)
            self.rows.append(Rows(automaton(np.searchsorted(own, joined).tolist()), width))
            code = np.full(len(self.alphabet) + 1, width, np.int32)  # the width is a symbol that the sample lacks
            code[np.searchsorted(self.alphabet, own)] = np.arange(width)
            self.codes.append(code)
            self.bits.append(np.log2(max(2, len(joined))))

    def _coded(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)).astype(np.int32)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        flat = self._coded(np.concatenate([*texts, np.empty(0, np.int32)]))
        sizes = np.array([len(t) for t in texts])
        begins = np.cumsum(sizes) - sizes
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = begins[owner] + nth * PIECE
        size = np.minimum(PIECE, sizes[owner] - nth * PIECE)
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        for k, (rows, code) in enumerate(zip(self.rows, self.codes, strict=True)):
            starts = _starts(rows, code[flat], begin, size, nth)
            total = np.concatenate([[0], np.cumsum(starts)])
            counts[:, k] = total[begins + sizes] - total[begins]
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        coded = [letters(t) for t in texts]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not self.names:
            return names, scores
        begin = total = 0
        for i in range(len(coded)):
            total += len(coded[i])
            if total >= BLOCK or i == len(coded) - 1:
                part = coded[begin : i + 1]
                cost = self.phrases(part) * np.array(self.bits)
                best = cost.argmin(1)
                share = 1 / np.exp2(np.maximum(cost.min(1, keepdims=True) - cost, -60)).sum(1)
                for j, text in enumerate(part):
                    if len(text):
                        names[begin + j], scores[begin + j] = self.names[best[j]], float(share[j])
                begin, total = i + 1, 0
        return names, scores


def _starts(rows: Rows, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Where phrases begin in symbols that lie in pieces (``begin``, ``size``, number in their text)."""
    starts = np.zeros(len(flat), bool)
    ends = np.zeros(len(begin), np.int32)
    order = np.argsort(-size, kind="stable")
    first, longest = begin[order], size[order]
    state = np.zeros(len(order), np.int32)
    for step in range(int(longest[0]) if len(order) else 0):
        n = int(np.searchsorted(-longest, -step, side="left"))  # pieces longer than this
        state[:n], new = rows.step(state[:n], flat[first[:n] + step])
        starts[first[:n] + step] = new
    ends[order] = state
    redo = np.flatnonzero(nth > 0)  # the pieces that another one runs into
    while len(redo):
        lane, at, state = redo, begin[redo].copy(), ends[redo - 1]
        going = state > 0
        lane, at, state = lane[going], at[going], state[going]
        changed = []
        while len(lane):
            over = at == begin[lane] + size[lane]
            if over.any():
                ends[lane[over]] = state[over]
                changed.append(lane[over])
                lane, at, state = lane[~over], at[~over], state[~over]
                continue
            state, new = rows.step(state, flat[at])
            met = new & starts[at]
            starts[at] = new
            lane, at, state = lane[~met], at[~met] + 1, state[~met]
        after = np.concatenate([*changed, np.empty(0, np.int64)]) + 1
        after = after[after < len(nth)]
        redo = np.sort(after[nth[after] > 0])
    return starts


def train(docs: DataFrame, rows: int = ROWS, symbols: int = SYMBOLS, all_symbols: int = ALL_SYMBOLS) -> Parser:
    """Automata from a bounded sample of passages of the labelled rows."""
    labelled = docs.where(~held_out(3, 1) & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    hashed = labelled.withColumn("drawn", F.xxhash64("text", F.lit(3)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("drawn"))
    least = materialize(hashed.select("lang", "drawn").distinct().withColumn("nth", rank).where(F.col("nth") <= 4 * rows).drop("nth"), "drawn")
    languages = max(1, least.select("lang").distinct().count())
    wanted = F.broadcast(least) if 4 * rows * languages <= MOST_BROADCAST else least  # rows have a bound a language
    few = hashed.join(wanted, ["lang", "drawn"], "left_semi").groupBy("lang", "drawn").agg(F.min("text").alias("text"))  # 4 * rows texts a language
    passages = few.select("lang", "drawn", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE}}}"), 0)).alias("i", "passage"))
    each = max(1, min(symbols, all_symbols // languages) // PASSAGE)
    by_chance = (F.xxhash64("drawn", "i"), F.col("drawn"), F.col("i"))
    order = Window.partitionBy("lang").orderBy("nth", *by_chance)
    before = F.sum(F.length("passage")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = passages.where(F.regexp_like("passage", F.lit(r"\p{L}"))).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "drawn").orderBy(*by_chance)))
    told = numbered.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < each * PASSAGE)
    samples: dict[str, list[np.ndarray]] = {}
    for r in told.orderBy("lang", "drawn", "i").collect():
        found = letters(r["passage"])
        if len(found):
            samples.setdefault(r["lang"], []).append(found)
    return Parser(samples)


def identify(docs: DataFrame, parser: Parser) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    df = small_batches(docs).drop("lang_pred", "score")
    columns = df.columns
    at = columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def mapper(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(mapper, f"{schema}, lang_pred string, score double")
