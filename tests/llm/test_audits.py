"""Audits of whole tables: divergence of sources, token counts, Merkle manifests."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import divergence, manifest, token_counts

ROW = "doc_id long, source string, lang string, n_chars long, text string"


# divergence


def brute_audit(rows, top):
    tokens = [(lang or "", source or "", [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in tokens:
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    found = set()
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = sorted({s for g, s, _ in tokens if g == lang}, key=str.encode)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o, "pair") for o in sources if o != s]
            terms = [((p[s][t] - whole[t]) ** 2 // whole[t], t, "term") for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]
            for part, limit in ((pairs, None), (terms, top)):
                for i, (value, item, name) in enumerate(sorted(part, key=lambda x: (-x[0], x[1].encode()))[:limit]):
                    found.add((lang, s, name, item, value, i + 1))
    return found


@pytest.fixture(scope="module")
def uneven(spark):
    """A hot source, a source without kept terms, a language without any, nulls, ties and repeated rows."""
    r = random.Random(4)
    words = ["Ärger", "ÄRGER", "a", "B", "naïve", "x9y", "don't", "z" * 50, *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))]
    rows = [(" ".join(r.choice(words[: 8 + 7 * (i % 12)]) for _ in range(r.randint(0, 40))), "en" if i % 5 else None, "hot" if i % 3 == 0 else f"s{r.randrange(7)}") for i in range(400)]
    rows += [("nur einmal hier", "de", "s1"), ("anderes", "de", "s2"), ("allein " * 3, "fr", "s1"), ("allein", "fr", "s1"), ("allein", "fr", "s1"), (None, "en", "empty"), ("", "en", None), ("q", None, None)] + [("gleich oft", "pt", s) for s in "abcd"]
    return [*rows, *rows[:30]]


@pytest.mark.parametrize("entries,tile", [(4096, 64), (3, 2)])
def test_audit_equals_brute_force(spark, uneven, entries, tile):
    df = spark.createDataFrame(uneven, "text string, lang string, source string").withColumn("term", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = divergence.audit(df, top=20, entries=entries, tile=tile).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_audit(uneven, 20)


def test_runs_and_shares_are_exact():
    r = random.Random(2)
    for _ in range(40):
        n = r.randint(1, 60)
        a, b, w = ([r.randrange(3) for _ in range(n)] for _ in range(3))
        weights = np.array([x + 1 for x in w])
        whole = lambda c: np.repeat(np.array(c), weights)
        values, lengths = divergence.runs(np.array(a), weights)
        assert np.repeat(values, lengths).tolist() == whole(a).tolist() and (values[1:] != values[:-1]).all()
        p, q = ([5 + 100 * x for x in whole(c).tolist()] for c in (a, b))
        sides = [(5 + 100 * v, np.cumsum(m)) for v, m in (divergence.runs(np.array(c), weights) for c in (a, b))]
        assert divergence.divergence(*sides) == (sum((x - y) ** 2 // y for x, y in zip(p, q, strict=True)), sum((x - y) ** 2 // x for x, y in zip(p, q, strict=True)))
    big = np.array([0, 1, 10**13, 8 * 10**13], np.int64)
    assert divergence.shares(big, 9 * 10**13, 10**9).tolist() == [1 + 10**9 * (int(c) + 1) // (9 * 10**13 + 10**9) for c in big]


def test_shares_of_columns_are_exact(spark):
    rows = [(0, 0, 1), (7, 90, 11), (8 * 10**13, 9 * 10**13, 10**9), (10**12, 10**12, 1)]
    got = spark.createDataFrame(rows, "n long, of long, kept long").select(divergence.share("n", "of", "kept")).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 1) // (of + kept) for n, of, kept in rows]


def test_audit_of_odd_rows(odd_table, empty_table):
    assert divergence.audit(empty_table).count() == 0
    got = {tuple(r) for r in divergence.audit(odd_table).collect()}
    assert got == brute_audit([(r["text"], r["lang"], r["source"]) for r in odd_table.collect()], 200)


# token counts


def library(texts, path=None):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path or token_counts.default_path())
    return [len(x.ids) for x in encoder.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("unit,batch", [(1, 40), (5, 300), (16_384, 1 << 20)])
def test_token_counts_equal_the_library(monkeypatch, unit, batch):
    monkeypatch.setattr(token_counts, "UNIT", unit)
    monkeypatch.setattr(token_counts, "BATCH", batch)
    monkeypatch.setattr(token_counts, "REMEMBERED", 60)
    r = random.Random(unit)
    signs = ["a", "b", "é", "'", "s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "1", "²", "٣", "中", "文", "!", "<", "|", ">", "endoftext", "<|endoftext|>", "́", "😀", "_", "\x00", "ᵃ", "Ⅷ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)] + [None, "", "x" * 5000, "中" * 700, "1a" * 900, " " * 900, "<|endoftext|>" * 90]
    assert token_counts.Counter(token_counts.default_path()).counts(texts).tolist() == library(texts)


def test_token_counts_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = token_counts.count_tokens(docs.select("doc_id", "text")).collect()
    assert [r["n_tokens"] for r in got] == library([r["text"] for r in got])
    assert all(r["n_bytes"] == len(r["text"].encode()) and r["over_limit"] == (r["n_tokens"] > 512) for r in got)


def test_token_counts_of_odd_rows(odd_table, empty_table):
    clash = odd_table.withColumn("n_tokens", F.lit("clash")).withColumn("over_limit", F.lit("clash"))
    got = token_counts.count_tokens(clash).collect()
    assert len(got) == 7 and [r["n_tokens"] for r in got] == library([r["text"] for r in got])
    assert [(r["n_bytes"], r["over_limit"]) for r in got if r["doc_id"] in (1, 2)] == [(0, False)] * 2 and got[0]["score"] == "clash"
    assert token_counts.count_tokens(empty_table).count() == 0


def test_long_texts_are_cut_in_pieces_of_bounded_size():
    own = token_counts.Counter(token_counts.default_path())
    text = "wort " * 500_000 + "1a" * 40_000
    pieces = list(own.parts(text))
    assert "".join(p for parts in pieces for p in parts) == text and max(sum(map(len, p)) for p in pieces) <= token_counts.BATCH + 40_000
    assert max(len(p) for parts in pieces for p in parts) <= token_counts.UNIT + 1


# manifests


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """Rows ``doc_id, source, lang, n_chars, text`` as the multiset of what the manifest says of them."""
    leaf = lambda row: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))
    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + 16])) for i in range(0, len(found[-1]), 16)])
        return found

    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in own[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    found = Counter()
    for k, s in enumerate(sources):
        for i, row in enumerate(own[s]):
            path = []
            for tree, x in ((trees[s], i), (top, k)):
                for nodes in tree[:-1]:
                    first = x - x % 16
                    path.append(("".join(nodes[first:x]), "".join(nodes[x + 1 : first + 16])))
                    x //= 16
            node = leaf(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf((*row[:4], row[4].translate({c: c + 32 for c in range(65, 91)})))
            for a, b in path:
                node = sha(a + node + b)
            found[row[0], leaf(row), trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), node, node == top[-1][0]] += 1
    return found


def told(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("tall", [1, 2, 3])
def test_manifest_equals_brute_force(spark, tall):
    r = random.Random(tall)
    sizes = {None: 1, "": 2, "é": 16, "z": 17, "hot": 700, "a": 256, "b": 257, **{f"s{i}": 1 + i % 3 for i in range(30)}}
    rows = [(i, s, r.choice(["en", None]), r.choice([3, None]), r.choice(["Ab", "ab", "", None, "É x"])) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rows += [rows[5], rows[40], rows[40], (None, "z", None, None, "Null"), (None, None, None, None, None), (41, "hot", "en", 1, "Other row")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, ROW).withColumn("leaf", F.lit("clash")).withColumn("tree", F.lit("clash")).repartition(5)
    assert told(manifest.tampered_rows(df, tall)) == brute_manifest(rows)


@pytest.mark.parametrize("n", [1, 16, 17, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "s", "en", 1, f"Text {i}") for i in range(n)]
    assert told(manifest.tampered_rows(spark.createDataFrame(rows, ROW))) == brute_manifest(rows)


def test_manifest_of_odd_rows(odd_table, empty_table):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd_table.collect()]
    assert told(manifest.tampered_rows(odd_table)) == brute_manifest(rows)
    assert manifest.tampered_rows(empty_table).count() == 0


def test_addresses_fill_the_layout():
    for levels in range(1, 6):
        at = [manifest.address(levels, d, np.arange(16**d)) for d in range(levels)]
        assert sorted(np.concatenate(at).tolist()) == list(range(manifest.nodes_of(levels)))
    low = manifest.address(4, 2, np.array([16, 17]))  # a lower subtree's root stands just before its leaves
    assert manifest.address(4, 3, np.array([16 * 16])) == low[0] + 1 and low[1] - low[0] == 17


def test_a_source_over_many_tasks_is_numbered_without_gaps(spark):
    rows = [("hot", k, bytes([k % 7]), k) for k in range(500)] + [(s, 1, b"x", 900) for s in (None, "", "a", "z")]
    df = spark.createDataFrame(rows, "source string, key long, leaf binary, nth long").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = manifest.numbered(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted((r["tree"], r["i"]) for r in got) == [(0, 0), (1, 0), (2, 0), *((3, i) for i in range(500)), (4, 0)]
    assert all(r["i"] == r["key"] for r in got if r["source"] == "hot")


