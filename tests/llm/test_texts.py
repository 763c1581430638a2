"""Odd inputs of the row-wise operators, and exactness against the libraries they stand on."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import exact_topk, html_text, language, piece_codec, quality, token_ids, toxicity
from lodestone.llm.common import shared_dir

ODD = ["", "  a  b", " x", "x ", "a\n \nb", "a\n\n  b", "x   y", "don't  'll I'm", "é\t é  \n\n x", "a ▁ b", "▁x", " ", "日本 語", "a.b,c!! d", "w" * 5000, "a " * 3000, None]


def test_pieces(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in piece_codec.encode_pieces(df, public_tokenizers.path("piece_bpe_32k.model")).collect():
        text = ODD[r.doc_id] or ""
        assert list(r.ids) == sp.encode(text) and r.decoded == sp.decode(sp.encode(text))
        assert b"".join(text.encode()[a:b] for a, b in zip(r.starts, r.ends)) == text.encode()


def test_character_map():
    # a map of two keys, built by hand: "ab" -> "x", "a" -> "yz"
    pool = b"x\0yz\0"
    units = [0] * 512
    leaf = lambda v: v | 1 << 31
    units[0] = 256 << 10  # root: children at 256 ^ byte
    at_a = 256 ^ ord("a")
    units[at_a] = ord("a") | 1 << 8 | (at_a ^ 100) << 10
    units[100] = leaf(2)
    at_b = 100 ^ ord("b")
    units[at_b] = ord("b") | 1 << 8 | (at_b ^ 200) << 10
    units[200] = leaf(0)
    m = piece_codec.CharacterMap(np.array([len(units) * 4], "<u4").tobytes() + np.array(units, "<u4").tobytes() + pool)
    assert m.longest(b"abc", 0) == (2, b"x") and m.longest(b"ac", 0) == (1, b"yz") and m.longest(b"c", 0) is None


def test_token_files(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i * 7 % 17, t) for i, t in enumerate(ODD)]
    path = shared_dir(spark)
    token_ids.write_tokens(token_ids.encode_sorted(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), partitions=3), path)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_ids.with_crc(token_ids.read_tokens(spark, path)).collect())) == want
    assert sorted((r.doc_id, r.start) for r in token_ids.read_metadata(spark, path).collect()) == [w[:2] for w in want]


def test_pages(spark):
    html = "<html><head><title>no</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>A&amp;B</h1><p>one<br>two <b>x</b><p>three</article><div id=comments><p>hi</p></div><footer>f</footer>"
    rows = [(1, "u", html, "z"), (2, None, None, "z"), (3, "u", "", "z"), (3, "u", "<p", "z")]
    got = {(r.page_id, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string")).collect()}
    assert got == {(1, "A&B\none two x\nthree", 19), (2, "", 0), (3, "", 0)}


def test_top_k(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (100, [-1.0, 0.1]), (7, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(map(tuple, exact_topk.top_k(df, k=2, fan_in=2).collect()))
    assert got == [(0, 1, 2, 524288), (0, 2, 2, 524288), (100, 1, 0, -498176), (100, 2, 1, -498176)]
    assert exact_topk.top_k(df.limit(0)).count() == 0


def test_top_k_tiles(spark):
    v = np.random.default_rng(3).integers(-8, 9, (12, 4)) / 8
    scores = (v * exact_topk.SCALE) @ (v * exact_topk.SCALE).T
    want = []
    for q in range(len(v)):
        order = sorted((-int(scores[q, c]), c) for c in range(len(v)) if c != q)[:3]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(order)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, exact_topk.top_k(df, k=3, query_every=1, tile_rows=2, fan_in=2).collect())) == want


def test_models_on_little(spark):
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.keep for r in quality.score(docs, quality.train(docs, none)).collect()} == {True}
    model = toxicity.train(toxicity.labelled(docs, none))
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect())
    assert language.identify(language.prepared(docs, None), language.train(docs)).count() == len(ODD)
    assert language.identify(language.prepared(docs.limit(0), None), language.train(docs)).count() == 0


def test_toxicity_keeps_all_words(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join([f"plain{x}" for x in rng.integers(0, 200, 12)] + [f"vile{x}" for x in rng.integers(0, 60, 3)] * (i % 4 == 0)) for i in range(160)]
    docs = spark.createDataFrame([*enumerate(texts), (500, None), (500, "unknown plainly plain1")], "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id long, toxic int")
    rows = toxicity.labelled(docs, marks)
    model = toxicity.train(rows)
    want = {w for r in rows.collect() for w in toxicity.words_of(r.text)}
    assert {r.word for r in model.table.collect()} == want
    assert set(model.words) == want and min(n0 for n0, _ in model.words.values()) == 0
    got = [sorted((r.doc_id, round(r.score, 9), r.predicted) for r in toxicity.score(docs, model, local_rows=n).collect()) for n in (5, toxicity.LOCAL_ROWS)]
    assert got[0] == got[1] and len(got[0]) == 162


@pytest.mark.parametrize("n", [2, 3])
def test_ordinal_grades(n):
    rng = np.random.default_rng(1)
    z = rng.integers(0, n, 300)
    m = quality.fit(np.arange(300), 1 + z, np.ones(300), z.astype(float))
    expected = m.expected(m.weights[1 + z])
    assert (np.diff(m.cuts) > 0).all() and np.corrcoef(expected, z)[0, 1] > 0.9


