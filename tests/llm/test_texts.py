"""Operators on single texts: languages, quality, media, pages, tokens, language model."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import bpe, hmm, html_text, language, media, quality
from ledgerscope.llm.common import held_out, mix, word_hashes


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# languages


def test_automaton_knows_all_substrings():
    text = [random.Random(3).randrange(3) for _ in range(60)]
    rows = language.Rows(language.automaton(text), 3)
    known = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    for n in range(1, 6):
        for word in itertools.product(range(3), repeat=n):
            state, whole = np.zeros(1, np.int32), True
            for i, c in enumerate(word):
                state, new = rows.step(state, np.array([c]))
                whole &= bool(new[0]) == (i == 0) and state[0] > 0
            assert whole == (word in known)


def test_rows_hold_all_transitions_whatever_the_alphabet():
    r = random.Random(8)
    text = [r.randrange(3000) if r.random() < 0.5 else r.randrange(20) for _ in range(20_000)]
    follow = language.automaton(text)
    rows = language.Rows(follow, 3000)
    for s in r.sample(range(len(follow)), 3000):
        for c in [*follow[s], *(r.randrange(3001) for _ in range(5))]:
            at = rows.base[s] + c
            assert (rows.target[at] if rows.owner[at] == s else -1) == follow[s].get(c, -1)
    assert len(rows.owner) < 5 * sum(map(len, follow))


def brute_phrases(text, sample):
    i = count = 0
    while i < len(text):
        n = 1
        while i + n <= len(text) and text[i : i + n] in sample:
            n += 1
        i += max(1, n - 1)
        count += 1
    return count


def test_phrases_are_longest_matches():
    r = random.Random(5)
    sample = "".join(r.choice("abc ") for _ in range(400))
    parser = language.Parser({"x": [language.letters(sample)]})
    known = "".join(map(chr, language.letters(sample))) + " "
    texts = ["".join(r.choice("abcd ") for _ in range(n)) for n in (1, 5, 90, 900)]
    coded = [language.letters(t) for t in texts]
    assert parser.phrases(coded)[:, 0].tolist() == [brute_phrases("".join(map(chr, c)), known) for c in coded]


@pytest.mark.parametrize("kind", ["random", "period", "unknown"])
def test_pieces_make_the_parse_of_the_whole(monkeypatch, kind):
    monkeypatch.setattr(language, "PIECE", 16)
    r = random.Random(7)
    sample = "".join(r.choice("abc") for _ in range(60)) + "abcabcabcabd" * 4
    make = {"random": lambda n: "".join(r.choice("abc") for _ in range(n)), "period": lambda n: ("abcabcabcabd" * n)[:n], "unknown": lambda n: "".join(r.choice("abcx") for _ in range(n))}[kind]
    parser = language.Parser({"x": [language.letters(sample)], "y": [language.letters("bca" * 30)]})
    texts = [make(n) for n in (0, 1, 15, 16, 17, 32, 33, 200, 333, 1000)]
    coded = [language.letters(t) for t in texts]
    for k, own in enumerate((sample, "bca" * 30)):
        assert parser.phrases(coded)[:, k].tolist() == [brute_phrases(t, own + " ") for t in texts]


def test_many_letters_and_languages_stay_small():
    r = random.Random(1)
    wide = np.array([r.randrange(0x4E00, 0x4E00 + 3000) for _ in range(language.SYMBOLS)], np.int32)
    parsers = [language.Parser({"zh": [wide], "en": [language.letters("the quick brown fox " * 100)]})]
    each = language.ALL_SYMBOLS // 500
    parsers.append(language.Parser({f"l{i}": [np.array([r.randrange(97, 123) for _ in range(each)], np.int32)] for i in range(500)}))
    for parser in parsers:
        assert sum(a.nbytes for rows in parser.rows for a in (rows.base, rows.owner, rows.target, rows.root)) + sum(c.nbytes for c in parser.codes) < 200 << 20


def test_languages_held_out(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text", F.col("lang").alias("truth")), language.train(docs)).where(held_out(3, 1)).collect()
    assert np.mean([r["lang_pred"] == r["truth"] for r in found]) > 0.95 and all(0 <= r["score"] <= 1 for r in found)


def test_languages_of_odd_rows(odd_table, empty_table, spark, sf_dir):
    parser = language.train(read(spark, sf_dir, "documents"))
    rows = language.identify(odd_table, parser).collect()
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (1, 2)] == ["und", "und"] and len(rows) == odd_table.count()
    assert language.identify(empty_table, language.train(empty_table)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_table, language.train(empty_table)).collect()} == {"und"}


def test_samples_are_drawn_from_distinct_texts(spark):
    r = random.Random(6)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    few = [" ".join(word("abcd") for _ in range(40)) for _ in range(3)]
    rows = [(i, few[i % 3], "aa") for i in range(30_000)]  # 3 texts of 20,000 training rows
    rows += [(30_000 + i, " ".join(word("pqrs") for _ in range(40)), "bb") for i in range(300)]
    parser = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert parser.names == ["aa", "bb"]
    assert all(n == 1 for n in parser.phrases([language.letters(t) for t in few])[:, 0])


def test_symbols_are_shared_and_languages_are_not_dropped(spark):
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(learned[i], "x" * 60_000 if i == 0 else f"{chr(97 + i)}{chr(98 + i)} " * 20, "aa") for i in range(20)]
    parser = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(map(chr, parser.alphabet)) >= set("bcdefghijklmnopqrst")
    late = language.train(spark.createDataFrame([(learned[0], "a" * 5000 + "z" * 200_000, "aa")], "doc_id long, text string, lang string"))
    assert ord("z") in late.alphabet  # passages are drawn from all of a text
    many = [(i, f"texto {i}", f"l{i % 65}") for i in range(650)]
    assert len(language.train(spark.createDataFrame(many, "doc_id long, text string, lang string")).names) == 65


# quality


def test_quality_held_out(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).join(labels, "doc_id").where(held_out(5, 0)).collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.9 and all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in scored)


def test_features_are_shares_of_figures_and_classes():
    texts = [b"", b"one two  two", b"A1! ?? x\nA1! ?? x"]
    rows = quality.features(texts)
    assert rows.shape == (3, len(quality.FEATURES) + quality.HASHED) and not rows[0].any()
    for text, row in zip(texts, rows, strict=True):
        words = text.split()
        classes = Counter(int(mix(word_hashes([w]), 601)[0] % np.uint64(quality.HASHED)) for w in words)
        want = np.array([math.sqrt(classes[k] / len(words)) if words else 0 for k in range(quality.HASHED)])
        assert np.allclose(row[len(quality.FEATURES) :], want)
    assert rows[1][quality.FEATURES.index("adjacent_share")] == 1 / 3


def test_fit_minimises_the_pairwise_loss():
    r = np.random.default_rng(4)
    diff, penalty = r.normal(size=(300, 5)) + 0.3, np.array([1e-3, 1e-3, 1e-2, 1e-2, 0.1])
    brute = lambda w: sum(math.log1p(math.exp(-float(d @ w))) for d in diff) / len(diff) + sum(p * x * x for p, x in zip(penalty, w, strict=True)) / 2
    w = r.normal(size=5)
    loss, first, second = quality.gradient(diff, w, penalty)
    assert math.isclose(loss, brute(w), rel_tol=1e-9)
    for k in range(5):
        e = np.eye(5)[k] * 1e-5
        assert math.isclose(first[k], (brute(w + e) - brute(w - e)) / 2e-5, rel_tol=1e-4, abs_tol=1e-7)
        assert np.allclose(second[k], (quality.gradient(diff, w + e, penalty)[1] - quality.gradient(diff, w - e, penalty)[1]) / 2e-5, atol=1e-5)
    x = np.vstack([r.normal(size=(30, len(quality.FEATURES))) + 0.5, r.normal(size=(30, len(quality.FEATURES)))])
    ranking = quality.fit(x, np.r_[np.ones(30), np.zeros(30)].astype(int))
    z = np.clip((x - ranking.mean) / ranking.scale, -6, 6)
    # the same pairs as the fit takes: no small step lowers their loss
    rng = np.random.default_rng(7)
    over = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(8)])
    pairs = z[over(np.arange(30))] - z[over(np.arange(30, 60))]
    fine = np.full(len(quality.FEATURES), quality.PENALTY[0])
    best = quality.gradient(pairs, ranking.weights, fine)[0]
    assert all(quality.gradient(pairs, ranking.weights + r.normal(size=len(fine)) * 0.01, fine)[0] > best for _ in range(20))


def test_rows_that_repeat_a_document_all_teach(spark):
    docs = spark.createDataFrame([(2, "good words here"), (2, "!!! ### 111"), (2, "good words here"), (3, "also fine text")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    assert np.array_equal(quality.train(docs, labels).weights, quality.train(docs.repartition(4), labels.repartition(3)).weights)


def test_weights_order_pairs():
    x = np.zeros((40, len(quality.FEATURES)))
    x[:, 0] = np.r_[np.linspace(0, 1, 20), np.linspace(2, 3, 20)]
    ranking = quality.fit(x, np.r_[np.zeros(20), np.ones(20)].astype(int))
    scores = ranking.score(x)
    assert (np.diff(scores) > 0).all() and (scores[:20] < 0.3).all() and (scores[20:] >= 0.3).all()


def test_quality_of_odd_rows(spark, odd_table, empty_table):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (4, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(odd_table, quality.train(odd_table, labels)).collect()
    assert len(rows) == odd_table.count() and all(r["score"] is not None for r in rows)
    assert {r["score"] for r in quality.score(odd_table, quality.train(empty_table, labels)).collect()} == {0.5}


# media


@pytest.mark.parametrize("body", [b"", b"a", bytes([0, 255] * 600), b"\0\xff\xff\0" * 400, random.Random(1).randbytes(5000), b"\xff" * 576])
def test_media_round_trip(body):
    images, fps = media.read_avi(media.pack(body))
    payload = media.decode_frames(images).tobytes()
    assert fps == 25 and payload == body + b"\xff" * (576 * max(1, -(-len(body) // 576)) - len(body))


def test_other_huffman_tables_are_read():
    """The same samples under a table whose codes differ in length from sample to sample."""
    samples = np.frombuffer(random.Random(2).randbytes(576), np.uint8).reshape(24, 24)
    d = np.diff(samples.astype(int), axis=1, prepend=0)
    d[:, 0] = np.diff(samples[:, 0].astype(int), prepend=128)
    counts, categories = [0, 2, 2, 2, 2, 1] + [0] * 10, [0, 1, 2, 3, 4, 5, 6, 7, 8]
    codes, bits = media._huffman(counts, categories), ""
    for x in d.ravel().tolist():
        size = abs(x).bit_length()
        code, length = codes[size]
        bits += f"{code:0{length}b}" + (f"{x if x >= 0 else x + (1 << size) - 1:0{size}b}" if size else "")
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    head = media._head()
    own = bytes([0, *media._own_table()[0], *media._own_table()[1]])
    image = head.replace(own, bytes([0, *counts, *categories])) + scan + b"\xff\xd9"
    assert (media.decode_frames([image])[0] == samples).all()


def test_shots_at_cuts():
    dark, light = np.full((30, 24, 24), 20, np.uint8), np.full((20, 24, 24), 200, np.uint8)
    assert media.shot_starts(np.concatenate([dark, light, dark])) == [0, 30, 50]
    assert media.shot_starts(dark) == [0] and media.shot_starts(dark[:0]) == []


def test_clips_and_broken_files(spark):
    frames = np.concatenate([np.full((25, 24, 24), 10, np.uint8), np.full((25, 24, 24), 240, np.uint8)])
    avi = media.write_avi(media.encode_frames(frames.tobytes()))
    rows = media.clips(spark.createDataFrame([(1, bytearray(avi)), (2, None)], "doc_id long, media binary")).orderBy("clip").collect()
    assert [(r["doc_id"], r["first_frame"], r["n_frames"], r["start_s"], r["end_s"]) for r in rows] == [(1, 0, 25, 0.0, 1.0), (1, 25, 25, 1.0, 2.0)]
    with pytest.raises(ValueError):
        media.read_avi(b"RIFF0000WAVE")
    with pytest.raises(ValueError):
        media.read_avi(avi[:-20])


def test_media_of_odd_rows(odd_table, empty_table):
    rows = {r["doc_id"]: r for r in media.digests(media.stored(odd_table)).collect()}
    assert rows[1]["n_bytes"] == 0 and rows[1]["payload_bytes"] == 576 and rows[1]["payload_sha256"] == rows[2]["payload_sha256"]
    assert rows[2]["tail_crc32"] == zlib.crc32(b"\xff" * 32) and media.digests(media.stored(empty_table)).count() == 0


# pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Um</a></li></ul></nav><div class="ad">Compre agora este produto maravilhoso sem demora</div>
<article><h1>Título &eacute; este</h1><p><b>Texto  com
quebra &lt;b&gt; e <a href="#">link</a>.<br><p>Fim.</p><!-- nada --></article>
<section id="comments"><p>Que artigo ruim, não gostei de nada que você escreveu aqui hoje.</p></section>
<form><label>Busca</label><textarea>x</textarea></form><aside>Lado com muitas palavras para parecer um artigo de verdade</aside><footer>&copy; 2024</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Título é este\nTexto com quebra <b> e link.\nFim."
    assert html_text.main_text(PAGE[: PAGE.index("Fim") + 5]).endswith("Fim.")
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    words = "palavra " * 30
    assert html_text.main_text(f"<div><p>{words}</p></div><ul><li><a href='x'>a b</a></li></ul>") == words.strip()


@pytest.mark.parametrize("holder", ['body class="has-sidebar"', 'article class="post no-comments"', 'div class="content share-enabled"', 'main class="page-header-fixed"', 'body class="sidebar"', 'div id="x" class="ad-free main"'])
def test_names_of_state_are_no_furniture(holder):
    words = "palavra " * 60
    tag = holder.split()[0]
    page = f"<html><{holder}><article><h1>Um título</h1><p>{words}</p><p>{words}</p></article></{tag}></html>"
    assert html_text.main_text(page) == f"Um título\n{words.strip()}\n{words.strip()}"


@pytest.mark.parametrize("name", ["sidebar", "comments-area", "site-footer", "cookie-banner", "related-posts", "share_buttons", "post-comments", "ADS", "x sidebar"])
def test_names_of_furniture_still_are(name):
    words = "palavra " * 60
    assert html_text.main_text(f"<body><article><p>{words}</p></article><div class='{name}'><p>Outro {words}</p></div></body>") == words.strip()


def test_tree_fits_its_table():
    assert all(html_text.kept(row[:-1]) == bool(row[-1]) for row in html_text.TAUGHT)


def test_pages(spark, sf_dir):
    rows = html_text.extract(read(spark, sf_dir, "pages").unionByName(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string"))).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and sum(r["text"] == "" for r in rows) == 1


# tokens


def test_bpe_equals_the_library(spark, sf_dir):
    tokenizers = pytest.importorskip("tokenizers")
    own, theirs = bpe.vocabulary(bpe.default_path()), tokenizers.Tokenizer.from_file(bpe.default_path())
    pool = "aAbBzZ \t\n\x0b\x1c\x85\xa0'stvemld<|startoftext|>0129éÉñßİıΣς́ 　中हिन्दी²Ⅷ😀!?.,*"
    r = random.Random(4)
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|>a<|startoftext|>", "a" * 2000, "thehellothe" * 300]
    texts += [row["text"] or "" for row in read(spark, sf_dir, "documents").collect()]
    for text in texts:
        ids = theirs.encode(text, add_special_tokens=False).ids
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert own.decode(packed).decode() == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_of_odd_rows(odd_table, empty_table):
    rows = bpe.decode(bpe.encode(odd_table)).collect()
    assert [r["ids"] for r in rows if r["doc_id"] in (1, 2)] == [b"", b""] and len(rows) == odd_table.count()
    assert bpe.decode(bpe.encode(empty_table)).count() == 0 and bpe.round_trip(empty_table).count() == 0
    both = lambda df: sorted((bytes(r["ids"]), r["decoded"]) for r in df.collect())
    assert both(bpe.round_trip(odd_table)) == both(bpe.decode(bpe.encode(odd_table)))


# language model


def test_forward_is_the_sum_over_paths():
    r = np.random.default_rng(1)
    model = hmm.Model.of_counts(r.random(hmm.STATES), r.random((hmm.STATES, hmm.STATES)), r.random((hmm.STATES, hmm.SYMBOLS)))
    texts = [np.array([5, 9, 4000, hmm.END], np.uint16), np.array([hmm.END], np.uint16), np.array([1, hmm.END], np.uint16)]
    for text, got in zip(texts, hmm.forward(model, texts), strict=True):
        total = 0.0
        for path in itertools.product(range(hmm.STATES), repeat=len(text)):
            p = model.start[path[0]]
            for k, (s, c) in enumerate(zip(path, text, strict=True)):
                p *= (model.move[path[k - 1], s] if k else 1) * model.emit[s, c]
            total += p
        assert math.isclose(got, math.log10(total), rel_tol=1e-9)


def test_expected_counts_add_up_and_rounds_never_lose():
    r = np.random.default_rng(2)
    texts = [np.r_[r.integers(0, 6, n), hmm.END].astype(np.uint16) for n in (3, 40, 17, 0)]
    model = hmm.Model.of_counts(r.random(hmm.STATES), r.random((hmm.STATES, hmm.STATES)), r.random((hmm.STATES, hmm.SYMBOLS)))
    start, move, emission, log = hmm.expected(model, texts, np.ones(len(texts), bool))
    assert math.isclose(log, hmm.forward(model, texts).sum())
    assert math.isclose(start.sum(), len(texts)) and math.isclose(emission.sum(), sum(map(len, texts))) and math.isclose(move.sum(), sum(len(t) - 1 for t in texts))
    share = lambda x: x / x.sum(-1, keepdims=True)
    better = hmm.Model(share(start), share(move), share(emission), model.later)
    assert hmm.forward(better, texts).sum() >= hmm.forward(model, texts).sum()


def brute_base(rows):
    texts = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for i, t in texts.items()}


@pytest.mark.parametrize("known", [1 << 18, 3])
def test_base_scores(near_table, near_copies, monkeypatch, known):
    monkeypatch.setattr(hmm, "KNOWN", known)
    truth = brute_base(near_copies)
    for r in hmm.score_texts(near_table, held_out(7, 2)).collect():
        held, n, k, total, base = truth[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, k, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_the_model_beats_counts_on_held_out_texts(spark, sf_dir):
    rows = hmm.score_texts(read(spark, sf_dir, "documents"), held_out(7, 2)).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_of_odd_rows(odd_table, empty_table):
    rows = hmm.score_texts(odd_table, held_out(7, 2)).collect()
    assert len(rows) == odd_table.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert all(math.isfinite(r["score"]) for r in rows) and hmm.score_texts(empty_table, held_out(7, 2)).count() == 0


def _figures_used(node):
    return set() if isinstance(node, int) else {node[0]} | _figures_used(node[2]) | _figures_used(node[3])


def test_the_tree_looks_at_neighbours():
    assert _figures_used(html_text.tree()) & {2, 3, 4, 5}
    plain = lambda *blocks: "<html><body>" + "".join(blocks) + "</body></html>"
    long = f"<p>{'word ' * 40}</p>"
    assert "Sub title" in html_text.main_text(plain(long, "<h2>Sub title</h2>", long))
    assert "Sub title" not in html_text.main_text(plain(f"<section>{long}</section>", "<section><p>Next</p><p>Sub title</p><p>Other</p></section>"))


def test_neighbours_decide_on_the_given_pages(spark, sf_dir):
    ways = list(itertools.product((0, 100), (0, 1), (0, 3, 100), (0, 1)))
    seen = [f for r in read(spark, sf_dir, "pages").collect() for f in html_text.features(html_text.blocks_of(r["html"]))]
    moved = sum(any(html_text.kept((*f[:2], *way, *f[6:])) != html_text.kept(f) for way in ways) for f in seen)
    assert 50 * moved >= len(seen)


WORDS = "palavra " * 60
ARTICLE_OF = f"<h1>Um título</h1><p>{WORDS}</p><p>Sim.</p><p>{WORDS}</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form action=x>{ARTICLE_OF}</form></body>",
        f'<body><div class="content share">{ARTICLE_OF}</div></body>',
        f'<body><div class="article-body search">{ARTICLE_OF}</div></body>',
        f'<div class="login article">{ARTICLE_OF}</div>',
        f"<body><nav><a href=x>Home</a> <a href=y>Mais</a><main>{ARTICLE_OF}</main></body>",
        f'<article><div id="related">{ARTICLE_OF}</div></article>',
        f'<body><form><nav><a href=x>Home</a></nav><article>{ARTICLE_OF}</article><aside><p>Outra coisa ao lado do texto</p></aside></form></body>',
    ],
)
def test_what_encloses_the_page_hides_no_article(page):
    assert html_text.main_text(page).split("\n") == ["Um título", WORDS.strip(), "Sim.", WORDS.strip()]


def test_a_short_note_is_a_text():
    assert html_text.main_text("<body><h1>Uma nota</h1><p>Tres palavras aqui</p><p>Mais quatro palavras agora</p><p>E o fim dela</p></body>").count("\n") == 3


def test_golden_pages_of_many_layouts():
    r = random.Random(12)
    say = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 8))) for _ in range(n))
    for _ in range(40):
        parts = [say(r.randint(3, 9)), *(say(r.choice((2, 5, 20, 60, 120))) for _ in range(r.randint(3, 9)))]
        body = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{x}</p>" for x in parts[1:])
        holder = r.choice(("<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<div id="content"><section>{}</section></div>'))
        menu = r.choice(("<nav><ul>{}</ul></nav>", '<div class="menu">{}</div>', "<ul>{}</ul>")).format("".join(f"<li><a href=x>{say(2)}</a></li>" for _ in range(8)))
        side = r.choice(("", '<aside><p>{}</p></aside>', '<div class="sidebar"><p>{}</p></div>', '<div class="ad">{}</div>')).format(say(15))
        foot = r.choice(("<footer>{}</footer>", '<div class="site-footer"><p>{}</p></div>')).format(say(12))
        comments = r.choice(("", f'<section class="comments"><p>{say(30)}</p><p>{say(4)}</p></section>'))
        page = f"<html><head><title>t</title></head><body>{menu}{side}{holder.format(body)}{comments}{foot}</body></html>"
        if sum(len(x.split()) for x in parts) > 60:
            assert html_text.main_text(page).split("\n") == parts


def test_repeated_and_very_long_pages(spark):
    long = "<article>" + "<p>uma linha de texto com algumas palavras</p>" * 40_000 + "</article>"
    rows = [(1, "u", long), (1, "u", long), (2, "u", "<div>" * 5000 + "<p>fundo da pagina com muitas palavras de texto</p>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["text"].count("\n") for r in got) == [0, 39_999, 39_999] and len(got) == 3


@pytest.mark.parametrize("body", ['<body class="has-sidebar">', '<body class="no-sidebar post">', '<body class="comments-open single">', '<body id="page"><main class="page-header-fixed">', '<body><article class="post no-comments">'])
def test_names_of_the_page_hide_no_article(body):
    long = f"<p>{'word ' * 40}</p>"
    text = html_text.main_text(f"<html>{body}<nav><a href=x>Home</a></nav><h1>The title</h1>{long}<svg viewBox='0 0 1 1'/>{long}<footer>Copyright</footer></html>")
    assert text.count("word") == 80 and "The title" in text and "Home" not in text and "Copyright" not in text
