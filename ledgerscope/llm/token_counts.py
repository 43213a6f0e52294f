"""Token counts of texts with a public vocabulary, by the tokenizers library.

An Arrow function takes texts and gives numbers: ids never leave the worker.
Texts are cut where the vocabulary's words always end: before white space that
follows something else.  No word of the byte-level pattern holds white space
after another sign, and none looks back, so both sides are cut as the whole
text would be.  Where there is no white space for ``UNIT`` characters, a cut
lies between a letter and a digit or a sign, or between a sign and a digit, if
no special string reaches across; a longer run of letters, digits or signs
alone stays whole.  The parts of many texts, or of one long one, are taken
``BATCH`` bytes at a time: different parts that the worker doesn't know yet go
to the library together, and short ones are remembered by their counts.

Defined results: a null or empty text has no tokens and no bytes; special
strings in a text are the library's special tokens; truncation and padding
that a file asks for are switched off; other columns stay, and columns named
like an added one are replaced.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes of parts that are counted at a time, and characters beyond which a part without white space is cut.
BATCH, UNIT = 1 << 20, 16_384
#: Parts whose counts a worker remembers, and the characters of the longest of them.
REMEMBERED, SHORT = 400_000, 32
#: Tokens beyond which a text is over the limit.
LIMIT = 512
ADDED = ("n_bytes", "n_tokens", "over_limit")
#: A word's end for sure: white space of ASCII after what neither Python nor Unicode takes for white space.
SPACE = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")
#: Other ends for sure, of which no word reaches over.
CHANGE = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Counter:
    """A vocabulary file whose encoder counts tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.special = [t.content for t in self.encoder.get_added_tokens_decoder().values()]
        self.reach = max(map(len, self.special), default=0)
        self.spaced = [s for s in self.special if re.search(r"\s", s)]
        self.known: dict[str, int] = {}

    def _splits_special(self, text: str, at: int) -> bool:
        around, here = text[max(0, at - self.reach) : at + self.reach], min(at, self.reach)
        return any(found < here < found + len(s) for s in self.special for found in _places(around, s))

    def _cut(self, text: str, near: int, ends) -> int:
        """The first safe end from ``near`` on, or the text's."""
        return next((m.start() for m in ends.finditer(text, near) if not self._splits_special(text, m.start())), len(text))

    def _cuts(self, text: str, size: int, ends) -> Iterator[str]:
        start = 0
        while start < len(text):
            end = self._cut(text, start + size, ends) if start + size < len(text) else len(text)
            yield text[start:end]
            start = end

    def parts(self, text: str) -> Iterator[list[str]]:
        """A text's parts, those of at most about ``BATCH`` characters at a time."""
        for piece in self._cuts(text, BATCH, SPACE):
            if any(s in piece for s in self.spaced):
                yield [piece]
                continue
            parts = SPACE.split(piece)
            if any(len(p) > UNIT for p in parts):
                parts = [c for p in parts for c in self._cuts(p, UNIT, CHANGE)]
            yield parts

    def _count(self, texts: list[list[str]]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        fresh = list({p: None for parts in texts for p in parts if p not in known})
        known.update(zip(fresh, map(len, self._encoded(fresh)), strict=True))
        total = [sum(map(known.__getitem__, parts)) for parts in texts]
        for part in fresh:
            if len(part) > SHORT:
                del known[part]
        return total

    def _encoded(self, parts: list[str]):
        start = size = 0
        for i, part in enumerate(parts):
            size += len(part)
            if size >= BATCH // 4 or i == len(parts) - 1:
                yield from self.encoder.encode_batch_fast(parts[start : i + 1], add_special_tokens=False)
                start, size = i + 1, 0

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        owners, batch, held = [], [], 0
        for i, text in enumerate(texts):
            for parts in self.parts(text or ""):
                owners.append(i)
                batch.append(parts)
                held += sum(map(len, parts))
                if held >= BATCH:
                    np.add.at(total, owners, self._count(batch))
                    owners, batch, held = [], [], 0
        if batch:
            np.add.at(total, owners, self._count(batch))
        return total


def _places(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_count(path: str | None = None):
    """A column function: the number of tokens of a text."""
    path = path or default_path()

    @F.arrow_udf("long")
    def n_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(path)
        for texts in batches:
            yield pa.array(own.counts(texts.to_pylist()))

    return n_tokens


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and whether they are more than ``limit``."""
    docs = small_batches(docs).drop(*ADDED)
    counted = docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn("n_tokens", token_count(path)(F.col(text)))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
