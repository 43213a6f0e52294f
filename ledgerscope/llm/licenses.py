"""License scans: which documents carry which license notice, in DataFrame functions alone.

Texts are words (runs of ASCII letters, digits and anything beyond ASCII, in
lower case) and shingles of ``SHINGLE`` words.  A text is covered by
overlapping windows of ``m`` shingles, one every ``s``; templates are grouped
by size such that a window holds the whole of a template wherever it begins
(``m >= t + s - 1`` for ``t`` shingles).  MinHash bands of one row each
retrieve templates for windows: a window and a template that it contains to
0.8 agree in a band with probability ``J``, their Jaccard index, which size
group and window bound from below; the number of bands is the least for which
``1 - (1 - J) ** bands`` is ``COLLIDE`` or more for every template.  Shingles
that no template has can't be a template's smallest, so they are left out of
windows before the bands: ``J`` is then 0.8 at least wherever a window has no
shingles of other templates.  Templates of so few shingles
that 0.8 means all are retrieved by windows of one shingle, which can't miss
their smallest shingle; those of fewer than five words are one shingle of as
many words.  Retrieved templates are then verified: in some window the exact
share of the template's shingles is ``CONTAINMENT`` or more.

Defined results: null or empty texts carry nothing; rows with a null ``doc_id``
are left out; repeated rows count once; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
COLLIDE = 0.999
#: Templates that a scan takes at most: they are part of the plan.
MOST = 500
#: Short notices of common licenses, whole texts of short licenses, and the opening words of long ones.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd-redistribution", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"),
    ("mit", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-3-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("mpl-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
)
#: Sizes of templates in shingles: up to (the first), windows of (m) every (s).
GROUPS = ((4, 8, 4), (9, 12, 4), (28, 35, 8), (48, 59, 12))


def group_of(size: int) -> tuple[int, int, int]:
    """A template's group; those beyond ``GROUPS`` are twice as large each."""
    for group in GROUPS:
        if size <= group[0]:
            return group
    largest = 96
    while largest < size:
        largest *= 2
    return largest, largest + largest // 4 - 1, largest // 4


def jaccard(size: int) -> float:
    """The least Jaccard index of a template of ``size`` shingles and a window that contains it to ``CONTAINMENT``."""
    shared = math.ceil(CONTAINMENT * size - 1e-9)
    return shared / (group_of(size)[1] + size - shared)


def bands_of(size: int) -> int:
    return 1 if size <= 4 else max(1, math.ceil(math.log(1 - COLLIDE) / math.log(1 - jaccard(size))))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9\\x{80}-\\x{10FFFF}]+"), "")


def shingles_of(words: Column, n: int) -> Column:
    """64-bit hashes of each ``n`` words in a row."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, hashed).otherwise(F.array().cast("array<bigint>"))


def _salts(n: int) -> list[int]:
    """Odd multiples of the golden ratio, as signed 64-bit numbers: their leading bits differ evenly."""
    values = [(i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for i in range(n)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


_SALTS = _salts(256)


def _templates(spark, templates) -> tuple[list, DataFrame]:
    """Templates with their shingles on the driver, and as a DataFrame with their windows."""
    if len(templates) > MOST:
        raise ValueError(f"more than {MOST} templates")
    df = spark.createDataFrame([tuple(t) for t in templates], "license_id string, notice string").withColumn("words", words_of(F.col("notice"))).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(SHINGLE))
    hashed = F.when(n == SHINGLE, shingles_of(F.col("words"), SHINGLE))
    for k in range(1, SHINGLE):
        hashed = hashed.when(n == k, shingles_of(F.col("words"), k))
    found = df.select("license_id", n.alias("n"), F.array_distinct(hashed).alias("shingles")).collect()  # MOST rows at most
    rows = [(r["license_id"], r["n"], r["shingles"], *group_of(len(r["shingles"]))[1:]) for r in found]
    return rows, spark.createDataFrame(rows, "license_id string, n int, shingles array<bigint>, m int, s int")


def _short(words: Column, n: int, templates) -> Column:
    """Shingles of ``n`` words; those of fewer than ``SHINGLE`` only where a text has all words of such a template."""
    if n == SHINGLE:
        return shingles_of(words, n)
    has = F.lit(False)
    for _, notice in templates:
        own = [w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", notice.lower()) if w]
        if len(own) == n:
            every = F.lit(True)
            for w in own:
                every = every & F.array_contains(words, w)
            has = has | every
    return F.when(has, shingles_of(words, n)).otherwise(F.array().cast("array<bigint>"))


def _mins(hashes: Column, group: tuple[int, int, int], bands: int) -> Column:
    """For each band the smallest shingle of each window, as an array of arrays."""
    _, m, s = group

    def of(ordered):
        starts = F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1)), F.lit(s))
        return F.transform(starts, lambda at: F.array_min(F.slice(ordered, at, m)))

    return F.transform(F.slice(hashes, 1, bands), of)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """``doc_id, license_id, containment, first_window, n_windows`` of each notice that a document carries."""
    spark = docs.sparkSession
    rows, known = _templates(spark, templates)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    lengths = sorted({r[1] for r in rows})
    most = max([bands_of(len(r[2])) for r in rows], default=1)
    flip = lambda x, band: signed((x ^ _SALTS[band]) & 0xFFFFFFFFFFFFFFFF)

    words = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", words_of(F.col("text")).alias("words"))
    hashed = words.select("doc_id", *(_short(F.col("words"), n, templates).alias(f"h{n}") for n in lengths))
    # the row number keeps what stands above from being evaluated again with each use
    known_to = {n: F.array(*(F.lit(x) for x in sorted({x for r in rows if r[1] == n for x in r[2]}))) for n in lengths}
    met = hashed.select("doc_id", F.monotonically_increasing_id().alias("row"), *(f"h{n}" for n in lengths), *(F.array_intersect(f"h{n}", known_to[n]).alias(f"k{n}") for n in lengths))
    some = met.where(functools.reduce(lambda a, b: a | b, (F.size(f"k{n}") > 0 for n in lengths), F.lit(False)))
    five = F.transform(f"h{SHINGLE}", lambda x: F.when(F.array_contains(f"k{SHINGLE}", x), x)) if SHINGLE in lengths else F.array().cast("array<bigint>")
    salts = F.array(*(F.lit(_SALTS[b]) for b in range(most)))
    masked = some.select("doc_id", "row", *(f"h{n}" for n in lengths), five.alias("five"))
    ordered = masked.select("doc_id", "row", *(f"h{n}" for n in lengths), F.transform(salts, lambda salt: F.transform("five", lambda x: x.bitwiseXOR(salt))).alias("ordered"))

    keys: list[tuple[int, str]] = []
    hits = []
    for n in lengths:
        few = [r for r in rows if r[1] == n and len(r[2]) <= 4]
        if few:
            keys += [(min(r[2]), r[0]) for r in few]
            hits.append(F.array_intersect(f"h{n}", F.array(*(F.lit(min(r[2])) for r in few))))
    for group in sorted({group_of(len(r[2])) for r in rows if len(r[2]) > 4}):
        many = [r for r in rows if len(r[2]) > 4 and group_of(len(r[2])) == group]
        if many:
            bands = most
            table = [[min(flip(x, b) for x in r[2]) for r in many] for b in range(bands)]
            keys += [(k, r[0]) for line in table for k, r in zip(line, many, strict=True)]
            wanted = F.array(*(F.array(*map(F.lit, line)) for line in table))
            hits.append(F.flatten(F.zip_with(_mins(F.col("ordered"), group, bands), wanted, lambda mins, want: F.array_intersect(mins, want))))
    if not keys:
        return spark.createDataFrame([], "doc_id bigint, license_id string, containment double, first_window int, n_windows bigint")
    named = F.broadcast(spark.createDataFrame(keys, "key bigint, license_id string"))  # MOST times a few bands
    found = ordered.select("doc_id", "row", *(f"h{n}" for n in lengths), F.explode(F.array_distinct(F.concat(*hits))).alias("key"))
    retrieved = found.join(named, "key").dropDuplicates(["row", "license_id"])
    own = F.col(f"h{lengths[-1]}")
    for n in lengths[:-1]:
        own = F.when(F.col("n") == n, F.col(f"h{n}")).otherwise(own)
    facing = retrieved.join(F.broadcast(known), "license_id").select("doc_id", "row", "license_id", own.alias("h"), "shingles", "m", "s")
    places = facing.select("doc_id", "row", "license_id", F.size("shingles").alias("t"), "m", "s", "shingles", F.posexplode("h").alias("pos", "shingle")).where(F.array_contains("shingles", F.col("shingle")))
    last = F.col("pos") - F.col("pos") % F.col("s")
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - F.col("m") + 1) / F.col("s")).cast("int") * F.col("s"))
    windows = places.select("doc_id", "row", "license_id", "t", "shingle", F.explode(F.sequence(first, last, F.col("s"))).alias("window"))
    shared = windows.groupBy("doc_id", "row", "license_id", "t", "window").agg(F.count_distinct("shingle").alias("shared"))
    share = F.col("shared") / F.col("t")
    return shared.where(share >= CONTAINMENT).groupBy("doc_id", "license_id").agg(F.max(share).alias("containment"), F.min("window").alias("first_window"), F.count_distinct("window").alias("n_windows"))


def scan_sql(templates=TEMPLATES) -> str:
    """The same rows by exact comparison of all windows."""
    quoted = ", ".join("('{}', '{}')".format(a.replace("'", "''"), b.replace("'", "''")) for a, b in templates)
    words = r"regexp_extract_all(lower({}), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
    shingles = "list_transform(range(0, len(w) - n + 1), lambda i: list_aggregate(w[i + 1:i + n], 'string_agg', ' '))"
    groups = sorted({group_of(n + 1) for n in range(max(len(notice.split()) * 3 for _, notice in templates) if templates else 1)})
    cases = lambda k: " ".join(f"WHEN t <= {g[0]} THEN {g[k]}" for g in groups)
    return f"""
WITH notices AS (SELECT license_id, {words.format('notice')} AS w FROM (VALUES {quoted}) v(license_id, notice)),
sized AS (SELECT license_id, least(len(w), {SHINGLE}) AS n, w FROM notices),
cut AS (SELECT license_id, n, list_distinct({shingles}) AS shingles FROM sized),
template AS (SELECT *, CASE {cases(1)} END AS m, CASE {cases(2)} END AS s FROM (SELECT *, len(shingles) AS t FROM cut)),
wanted AS (SELECT license_id, n, t, m, s, unnest(shingles) AS shingle FROM template),
texts AS (SELECT DISTINCT doc_id, {words.format('text')} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
lengths AS (SELECT DISTINCT n FROM template),
listed AS (SELECT doc_id, n, {shingles} AS h FROM texts, lengths WHERE len(w) >= n),
placed AS (SELECT doc_id, n, unnest(h) AS shingle, unnest(range(0, len(h))) AS pos FROM listed),
met AS (SELECT doc_id, license_id, t, m, s, pos, p.shingle FROM placed p JOIN wanted USING (n, shingle)),
windows AS (SELECT doc_id, license_id, t, shingle, unnest(range(CAST(greatest(0, ceil((pos - m + 1) / s) * s) AS BIGINT), pos - pos % s + 1, s)) AS win FROM met),
shared AS (SELECT doc_id, license_id, t, win, count(DISTINCT shingle) AS k FROM windows GROUP BY ALL)
SELECT doc_id, license_id, max(k / t) AS containment, CAST(min(win) AS INTEGER) AS first_window, count(DISTINCT win) AS n_windows
FROM shared WHERE k / t >= {CONTAINMENT} GROUP BY doc_id, license_id"""
