"""Operators that compare documents, against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerscope.llm import contamination, licenses, ngram_join, sketch, substring_dedup


def brute_cut(rows, window=13):
    first, words = {}, {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                keep[p : p + window] = [False] * window
        out[i] = (len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep, strict=True) if k).decode())
    return out


def brute_components(rows, n=4, percent=85):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[p : p + n]) for p in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_substring_dedup(near_table, near_copies):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(near_table).collect()}
    assert got == brute_cut(near_copies)


def test_substring_dedup_settles_in_and_across_groups(near_table, near_copies, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 3000)
    monkeypatch.setattr(substring_dedup, "BUCKET", 9000)
    monkeypatch.setattr(sketch, "SHARD", 100)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(near_table.repartition(5)).collect()}
    assert got == {i: x[1] for i, x in brute_cut(near_copies).items()}


def test_a_full_sketch_loses_nothing(near_table, near_copies, monkeypatch):
    monkeypatch.setattr(sketch, "WIDTH", 4)
    monkeypatch.setattr(substring_dedup, "GROUP", 3000)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(near_table).collect()}
    assert got == {i: x[1] for i, x in brute_cut(near_copies).items()}


def test_the_sketch_lets_as_many_single_hashes_through_at_every_size():
    rates = []
    for times in (1, 4, 16):
        n, width, shard = 20_000 * times, 1 << 15, 1 << 12
        rng = np.random.default_rng(times)
        hashes = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        twice = hashes[:1000]
        own = [np.unique(np.r_[hashes[: n // 2], twice]), np.unique(np.r_[hashes[n // 2 :], twice])]
        shards = max(1, -(-n // shard))
        tables = [sketch.part(g, h, shards).to_pylist() for g, h in enumerate(own)]
        bits = {}
        for s in range(shards):
            here = [(g, r["prints"]) for g, rows in enumerate(tables) for r in rows if r["shard"] == s]
            for (g, _), x in zip(here, sketch.answered([p for _, p in here], width), strict=True):
                bits.setdefault(g, []).append((s, x))
        hit = 0
        for g, h in enumerate(own):
            answer = pa.table({"shard": [s for s, _ in bits[g]], "bits": [x for _, x in bits[g]]})
            seen = sketch.repeated(answer, h, shards)
            assert seen[np.isin(h, twice)].all()
            hit += seen[~np.isin(h, twice)].sum()
        rates.append(hit / n)
    assert max(rates) < 0.06 and max(rates) < 1.5 * min(rates)


def test_rows_that_repeat_a_document_lose_their_own_words_alone(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP", 40)
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (2, f"{two} {one}"), (2, "short text"), (2, two), (3, f"x {two}"), (None, one)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in got) == [(0, 40, 0), (1, 40, 0), (2, 2, 0), (2, 60, 0), (2, 100, 40), (3, 61, 60)]


def test_ngram_join(near_table, near_copies):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(near_table).collect()}
    assert got == brute_components(near_copies)


def test_ngram_join_with_costly_keys_and_small_slots(near_table, near_copies, monkeypatch):
    monkeypatch.setattr(ngram_join, "BALANCE", 0)
    monkeypatch.setattr(ngram_join, "SLOT", 500)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(near_table.repartition(3)).collect()}
    assert got == brute_components(near_copies)


def test_linked_sets_lie_in_one_band_or_neighbours():
    edges = ngram_join.band_edges(85, 10_000)
    band = lambda s: next(i for i in range(len(edges) - 1) if edges[i] <= s < edges[i + 1])
    for s in range(1, 3000):
        assert band(s * 100 // 85) - band(s) <= 1
    for s in range(1, 200):
        for t in range(s, s * 100 // 85 + 1):
            shared = next(i for i in range(t + 1) if 100 * i >= 85 * (s + t - i))
            assert s + t - 2 * shared <= ngram_join.differences(85, t)


def test_containment(spark, near_table, near_copies):
    texts = dict(near_copies)
    passage = " ".join(texts[45].split()[12:72])
    items = spark.createDataFrame([(1, passage.upper()), (2, passage.replace(" ", ", ", 5)), (3, "a b c d"), (4, None), (5, "nothing of this stands in any text here"), (None, passage)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["containment"]) for r in contamination.contained_items(near_table, items).collect())
    assert got == [(i, k, 1.0) for i in range(40, 60) for k in (1, 2)]
    assert {r["doc_id"] for r in contamination.decontaminate(near_table, items).collect()} == {i for i, _ in near_copies} - set(range(40, 60))


def test_containment_of_partial_items(spark):
    item = " ".join(f"w{i}" for i in range(54))
    docs = [(i, "start " * 3 + " ".join(f"w{k}" if k < 54 - i else f"z{k}" for k in range(54)) + " end" * i) for i in range(20)]
    got = {r["doc_id"]: r["n_shared"] for r in contamination.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}
    assert got == {i: 50 - i for i in range(11)}


def test_items_of_fewer_words_than_a_shingle_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "gamma"), (3, "Delta, epsilon!"), (4, "beta alpha"), (5, None), (6, "one two three four five"), (6, "six seven eight nine ten eleven")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "gamma"), (2, "delta epsilon"), (3, "alpha beta gamma delta"), (4, ""), (5, None), (6, "one two three four five"), (6, "six seven eight nine ten")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in contamination.contained_items(docs, items).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 2), (6, 6)]


def test_short_items_are_never_missed(spark):
    r = random.Random(11)
    items = {k: [f"i{k}x{j}" for j in range(5 + k % 5)] for k in range(60)}  # 1 to 5 shingles
    items |= {k: [f"i{k}x{j}" for j in range(n)] for k, n in ((60, 14), (61, 29), (62, 30), (63, 31), (64, 60))}
    docs = {}
    for i in range(400):
        words = [f"d{i}x{j}" for j in range(r.choice((20, 36, 68, 131, 260)))]
        for k in r.sample(sorted(items), 6):
            own = list(items[k])
            if r.random() < 0.4:
                own[r.choice((0, -1))] = "edited"
            at = r.randrange(len(words))
            words[at:at] = own
        docs[i] = words
    grams = lambda w: {tuple(w[p : p + 5]) for p in range(len(w) - 4)}
    asked, having = {k: grams(w) for k, w in items.items()}, {i: grams(w) for i, w in docs.items()}
    truth = {(i, k): len(g & h) for i, h in having.items() for k, g in asked.items() if len(g & h) >= 0.8 * len(g)}
    table = lambda rows, key: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], f"{key} long, text string")
    got = {(x["doc_id"], x["item_id"]): x["n_shared"] for x in contamination.contained_items(table(docs, "doc_id"), table(items, "item_id")).collect()}
    assert got == truth


def test_licenses(spark):
    fill = " ".join(f"f{i}" for i in range(40))
    docs = [(i, f"{fill} {notice} {fill}") for i, (_, notice) in enumerate(licenses.TEMPLATES)] + [(99, fill), (98, "licensed under the apache something version 2 0")]
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).where("containment = 1").collect()}
    assert {(i, name) for i, (name, _) in enumerate(licenses.TEMPLATES)} <= got and not {d for d, _ in got} & {98, 99}


def test_edited_licenses_are_found(spark):
    """Notices of which just 0.8 stands, among strange words; brute force over the same windows."""
    r = random.Random(21)
    plain = lambda t: [w for w in re.split("[^a-z0-9]+", t.lower()) if w]
    grams = lambda w: [tuple(w[p : p + 5]) for p in range(len(w) - 4)]
    long = {name: plain(t) for name, t in licenses.TEMPLATES if len(plain(t)) >= 14}
    docs = {}
    for name, own in long.items():
        size = len(set(grams(own)))
        assert 1 - (1 - licenses.jaccard(size)) ** licenses.bands_of(size) >= 0.999
        for _ in range(500):
            cut = size - math.ceil(0.8 * size - 1e-9)
            ends = r.randint(0, cut)
            words = [f"f{r.randrange(10**9)}" for _ in range(140)]
            at = r.randrange(60, 80)
            words[at:at] = own[ends : len(own) - (cut - ends)]
            docs[len(docs)] = (name, words)
    truth = set()
    for i, (name, words) in docs.items():
        asked, h = set(grams(long[name])), grams(words)
        _, m, s = licenses.group_of(len(asked))
        if any(len(asked & set(h[p : p + m])) >= 0.8 * len(asked) for p in range(0, len(h), s)):
            truth.add((i, name))
    table = spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in docs.items()], "doc_id long, text string")
    got = {(x["doc_id"], x["license_id"]) for x in licenses.scan(table).collect() if docs[x["doc_id"]][0] == x["license_id"]}
    assert len(truth) == len(docs) and got == truth


def test_license_scan_runs_no_python(spark, near_table):
    plan = licenses.scan(near_table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_license_bands_keep_their_promise():
    for size in [*range(5, 200), 1000, 6000]:
        assert 1 - (1 - licenses.jaccard(size)) ** licenses.bands_of(size) >= licenses.COLLIDE
        assert licenses.group_of(size)[1] >= size + licenses.group_of(size)[2] - 1


def test_odd_rows(spark, odd_table, empty_table):
    items = spark.createDataFrame([(1, "sem chave alguma aqui e agora")], "item_id long, text string")
    cut = substring_dedup.remove_repeats(odd_table)
    assert sorted(cut.columns) == sorted({*odd_table.columns, *substring_dedup.ADDED}) and cut.count() == odd_table.count()
    assert {r["n_removed"] for r in cut.collect()} == {0}
    comps = sorted((r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(odd_table).collect())
    assert comps == [(1, 1), (2, 2), (3, 3), (3, 3), (4, 4), (5, 5)]
    assert ngram_join.one_of_each(odd_table).count() == odd_table.count()
    assert contamination.contained_items(odd_table, items).count() == 0 and contamination.decontaminate(odd_table, items).count() == odd_table.count()
    assert licenses.scan(odd_table).count() == 0
    assert substring_dedup.remove_repeats(empty_table).count() == 0 and ngram_join.ngram_components(empty_table).count() == 0
    assert contamination.contained_items(empty_table, items).count() == 0 and licenses.scan(empty_table).count() == 0
    assert contamination.contained_items(odd_table, items.limit(0)).count() == 0


def test_digest_of_kept_words(spark, near_table, near_copies):
    got = {r["doc_id"]: r["d"] for r in substring_dedup.remove_repeats(near_table).select("doc_id", F.sha2("kept_text", 256).alias("d")).collect()}
    assert got[41] == hashlib.sha256(brute_cut(near_copies)[41][2].encode()).hexdigest()


def test_shared_keys_over_batches(spark, monkeypatch):
    r = random.Random(8)
    rows = list({(k, s): (k, s, r.randrange(2)) for k, s in ((r.randrange(40), r.randrange(60)) for _ in range(400))}.values()) + [(99, 1, 1), (98, 1, 0), (98, 2, 0), (97, 3, 0), (97, 4, 1)]
    df = spark.createDataFrame(rows + rows[:50], "key long, set_id long, about long").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "3", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for whole in (False, True):
            got = sorted(tuple(x)[:2] for x in ngram_join._shared(df, whole).collect())
            held = {}
            for k, s, a in rows:
                held.setdefault(k, []).append((s, a))
            want = sorted((k, s) for k, m in held.items() if len(m) > 1 and (not whole or any(a for _, a in m)) for s, _ in m)
            assert got == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_partners_are_allocated_where_keys_cost_more(spark, near_table, near_copies, monkeypatch):
    seen = []
    partners = ngram_join._partners
    monkeypatch.setattr(ngram_join, "_partners", lambda costly, *rest: seen.append(costly.count()) or partners(costly, *rest))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(near_table).collect()}
    assert got == brute_components(near_copies) and seen[0] > 0


def test_few_buckets_change_no_result(near_table):
    docs = near_table.select("doc_id", "text")
    size = 6 * substring_dedup.BUCKET  # as if the texts were larger: six buckets, if two weren't the most
    runs = [{tuple(r) for r in substring_dedup.repeated_runs(substring_dedup._dealt(docs, size, 12, most=most), size, 12).groupBy("row").agg(F.sum("n")).collect()} for most in (2, 100)]
    assert [len(r) for r in runs] == [len(runs[0])] * 2 and len(runs[0]) > 0
