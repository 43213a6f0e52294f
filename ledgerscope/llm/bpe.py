"""BPE encoding and decoding with a public vocabulary of lower-case words.

A word's symbols stand in one list and the ranks of adjacent pairs in another;
the smallest rank is looked for again and again, its boundary deleted, and the
two neighbouring ranks refreshed.  Words of more than ``SHORT`` symbols take
the same merges in the same order from a heap.  Ids are kept as little-endian
unsigned 32-bit integers.

The vocabulary file's path is a parameter; executors read the file where the
library that brings it is installed, at the same path.

Defined results: a null or empty text has no ids and decodes to an empty text;
special tokens written in a text are those tokens; other columns stay, and
columns named like an added one are replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

SHORT = 128
#: Words whose ids a worker remembers, and the letters of the longest of them.
REMEMBERED, LETTERS = 100_000, 64
NONE = 1 << 30
#: White space as the vocabulary's normaliser takes it.
SPACE = regex.compile(r"[\t-\r\x20\x85\xa0  -     　]+")

#: What Python's split() takes for white space and the normaliser doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """A vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, vocab = made["model"], made["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        letters = _byte_letters()
        self.inner, self.last = [vocab.get(c) for c in letters], [vocab.get(c + end) for c in letters]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _merged(self, ids: list[int]) -> list[int]:
        get, made = self.ranks.get, self.made
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        get, n = self.ranks.get, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 20 | ids[j], NONE) != rank:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(ids[a] << 20 | ids[b], NONE)) != NONE:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> bytes:
        data = word.encode()
        inner = self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if None in ids:
            ids = [x for x in ids if x is not None]
        ids = self._merged(ids) if len(ids) <= SHORT else self._merged_long(ids)
        found = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LETTERS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of what stands between two spaces; no word reaches over a space."""
        known, word = self.known, self.word
        found = b"".join([known.get(w) or word(w) for w in self.words.findall(text)])
        if len(text) <= LETTERS:
            if len(self.chunks) >= REMEMBERED:
                self.chunks.clear()
            self.chunks[text] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        known, chunk = self.chunks, self.chunk
        parts = SPACE.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join([known.get(c) or chunk(c) for c in parts if c])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, four bytes each."""
        if not text:
            return b""
        if self.cut is None or "<|" not in text:
            return self._plain(text)
        parts = self.cut.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes | None) -> bytes:
        """The tokens' own spelling, joined by spaces: the vocabulary names no decoder."""
        names = self.names
        return b" ".join([names[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> WordBpe:
    return WordBpe(path)


def _with_column(df: DataFrame, source: str, name: str, kind: str, pa_kind, of) -> DataFrame:
    df = small_batches(df).drop(name)
    columns = df.columns
    at = columns.index(source)

    def mapper(batches):
        for batch in batches:
            step = max(1, batch.num_rows * 4_000_000 // max(1, batch.column(at).nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                made = pa.array([of(x) for x in part.column(at).to_pylist()], pa_kind)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(mapper, (schema + ", " if schema else "") + f"`{name}` {kind}")


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (binary, four bytes a token)."""
    path = path or default_path()
    return _with_column(docs, text, "ids", "binary", pa.binary(), lambda x: vocabulary(path).encode(x))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text that its ids spell."""
    path = path or default_path()
    return _with_column(df, ids, "decoded", "string", pa.string(), lambda x: vocabulary(path).decode(x).decode())


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and what they decode to (``decoded``) in place of the text, by one vocabulary a worker."""
    path = path or default_path()
    df = small_batches(docs).drop("ids", "decoded")
    columns = df.columns
    at = columns.index(text)
    others = [i for i in range(len(columns)) if i != at]

    def mapper(batches):
        own = vocabulary(path)
        for batch in batches:
            step = max(1, batch.num_rows * 1_000_000 // max(1, batch.column(at).nbytes))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                ids = [own.encode(x) for x in part.column(at).to_pylist()]
                made = [pa.array(ids, pa.binary()), pa.array([own.decode(x).decode() for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *made], names=[*(columns[i] for i in others), "ids", "decoded"])

    schema = "".join(f"`{columns[i]}` {df.schema[columns[i]].dataType.simpleString()}, " for i in others)
    return df.mapInArrow(mapper, f"{schema}ids binary, decoded string")
