"""Token files, packing, neighbours, pages: odd rows, exact round trips and brute force."""

import functools
import html as entities
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from pixelweave.llm import ann, html, packing, shards
from pixelweave.llm.common import fresh_path
from pixelweave.llm.tokens import Encoder, vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [(5, "b c"), (3, None), (1, ""), (None, "null id"), (9, "x" * 50_000), (2, "a  b \n c\t"), (2, "a  b \n c\t"), (4, " lead and trail "), (-7, "don't STOP*** it's <|endoftext|> é́  z\0"), (8, "word " * 9000), (None, None)]
SCHEMA = "doc_id long, text string, shard string, again int, h binary"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s", None, None) for i, t in ODD], SCHEMA).repartition(3).cache()


tokenizer = functools.cache(Tokenizer.from_file)


def plain(path, text, end):
    return [*tokenizer(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_are_encoded_as_in_their_text(path):
    enc = Encoder(path)
    texts = [t or "" for _, t in ODD] + ["a,\nb. c!\nd", "a,b;c é. x\u0130, ok", "x", "\nx", "x\n", "e\u0301. \u1e9e, y", "", "one two"] + ["a b c", "a   b", "\x1c a", "\x85b \x85", "x !? y", "12 34.5 6,7", "Ünï cödé Straße 'll we'll"]
    assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)] == [plain(path, t, 0)[:-1] for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_are_encoded_as_in_their_text_whatever_they_are_made_of(path):
    parts = ["a", "Abc", "don't", "'s", "é", "e\u0301", "Ö", "İ", "ß", "ΑΣ", "日本", "\u0300", "42", "½", ".", ",", "!!", "\n", "\n\n", " ", "  ", "\t", "\u3000", "\0", "<|endoftext|>", "_", "😀", "ǅ", "ª", "\x85", ";|?"]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]
    enc = Encoder(path)
    for at in range(0, len(texts), 50):
        own = texts[at : at + 50]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(own)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in own]


def test_perfect_hash_gives_each_key_its_own_slot():
    for n in (1, 2, 3, 17, 5000):
        h = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
        seed, displaced, slots = shards.perfect_hash(h)
        assert sorted(slots) == list(range(n))
        assert (shards.slots_of(h, seed, displaced, n) == slots).all()


def test_token_store_round_trip(spark, odd):
    store = shards.TokenStore.write(odd, BYTES, end=2)
    found = sorted((tuple(r) for r in store.read(shards.keys_of(odd)).collect()), key=lambda r: r[1])
    start, expected = 0, []
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, 0)):
        ids = plain(BYTES, t, 2)
        expected.append((i, len(ids), crc(ids)))
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in found) == sorted((e[0] is not None, e[0] or 0, e[1], e[2]) for e in expected)
    assert [r[0] for r in found] == [e[0] for e in expected]
    for r in found:
        assert r[1] == start
        start += r[2]
    absent = spark.createDataFrame([(12345, 0), (5, 1)], "doc_id long, again long")
    assert store.locate(absent).count() == 0
    none = shards.TokenStore.write(odd.where("false"), BYTES)
    assert none.read(shards.keys_of(odd.where("false"))).count() == 0


def test_token_store_tells_keys_of_one_hash_apart(spark, odd, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(shards, "_hash", lambda: F.coalesce(F.pmod(F.col("doc_id"), F.lit(3)), F.lit(1)))
    store = shards.TokenStore.write(odd, BYTES, end=2)
    assert store.index.selectExpr("sum(size(side))").first()[0] == len(ODD) - 3
    found = [tuple(r) for r in store.read(shards.keys_of(odd)).collect()]
    lengths = [(i, len(plain(BYTES, t, 2)), crc(plain(BYTES, t, 2))) for i, t in ODD]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r[0], *r[2:]) for r in found), key=key) == sorted(lengths, key=key)


def test_an_id_whose_rows_go_on_through_many_shards(spark):
    big = (1 << 60) + 1
    rows = [(big, f"text {i}") for i in range(3000)] + [(None, f"null {i}") for i in range(500)] + [(big + i, "x") for i in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = shards.TokenStore.write(docs, BYTES, end=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(store.before) > 1
    found = sorted((tuple(r) for r in store.read(shards.keys_of(docs)).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None] * 500 + [big] * 3000 + [big + i for i in range(1, 9)]
    assert all(a[1] + a[2] == b[1] for a, b in zip(found, found[1:]))
    assert sorted(r[3] for r in found) == sorted(crc(plain(BYTES, t, 2)) for _, t in rows)


@pytest.mark.parametrize("block_bytes", [8, 4 << 20])
def test_separator_scan(spark, odd, block_bytes):
    few = odd.where("length(text) < 1000 or text is null")
    folder = fresh_path(spark, "flat")
    order = shards.write_flat(few, BYTES, 50_257, folder)
    found = shards.scan_counts(spark, folder, 50_257, "<u2", block_bytes)
    rows = order.join(found, ["shard", "ordinal"]).select("doc_id", "n_tokens").collect()
    expected = [(i, len(plain(BYTES, t, 0))) for i, t in ODD if t is None or len(t) < 1000]
    assert sorted((r[0] or -1, r[1]) for r in rows) == sorted((i or -1, n) for i, n in expected)
    folder = fresh_path(spark, "flat")
    shards.write_flat(odd.where("false"), BYTES, 50_257, folder)
    assert shards.scan_counts(spark, folder, 50_257, "<u2").count() == 0


def test_nnls_is_least_squares_without_negatives():
    r = np.random.default_rng(0)
    for _ in range(10):
        a, b = r.random((12, 30)), r.random(12) * 5
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_places_every_piece():
    r = random.Random(2)
    for histogram in ({}, {64: 3}, {40: 10}, {k: r.randint(0, 300) for k in range(1, 65)}):
        used = Counter()
        for combination, times in packing.plan(histogram, 64):
            assert sum(combination) <= 64 and times > 0
            for k in combination:
                used[k] += times
        assert used == Counter({k: n for k, n in histogram.items() if n})


def test_combinations():
    found = packing.combinations(12, set(range(1, 13)))
    assert len(found) == len(set(found)) == 1 + 6 + 12 and all(sum(c) == 12 for c in found)


def test_packing_keeps_every_id(odd):
    rows = packing.pack(odd, WORDS, window=256, unit=8).collect()
    whole = Counter()
    for i, t in ODD:
        ids = plain(WORDS, t, 2)
        for s in range(0, len(ids), 256):
            whole[i, s, min(256, len(ids) - s), crc(ids[s : s + 256]), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in rows) == whole
    for sequence in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == sequence), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack(odd.where("false"), WORDS).count() == 0


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, WORDS).agg({"length": "sum", "sequence_id": "max"}).first()
    total, last = (rows["sum(length)"], rows["max(sequence_id)"])
    assert total / ((last + 1) * 4096) > 0.97


def test_neighbours(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8)) * 4
    rows = [(i, (centres[i % 6] + r.normal(size=8)).tolist()) for i in range(3000)]
    rows[300:900] = [(i, rows[300][1]) for i in range(300, 900)]  # one very common vector
    odd = [(None, rows[0][1]), (10_000, None), (10_100, [0.0] * 8), (10_200, [None] + [1.0] * 7), (10_300, [float("nan")] * 8), (10_400, [1.0]), (10_500, [float("inf")] + [0.0] * 7), (100, rows[100][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<double>, leaf int")
    found = {}
    for x in ann.search(df).collect():
        found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    x, hits = np.array([v for _, v in rows]), 0
    assert sorted(found) == list(range(0, 3000, 100))
    for q, got in found.items():
        got.sort()
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        true = [i for i in np.lexsort((np.arange(len(d)), d)) if i != q][:10]
        assert [g[0] for g in got] == list(range(1, 11)) and [g[2] for g in got] == sorted(g[2] for g in got)
        assert np.allclose([g[2] for g in got], d[[g[1] for g in got]], rtol=1e-12)
        hits += len({g[1] for g in got} & set(true))
        if 300 <= q < 900:
            assert [g[1] for g in got] == true
    assert hits >= 0.9 * 10 * len(found)
    few = ann.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in few) == [(1, 1, 0.0), (2, 2, 2.0)]
    assert ann.search(df.where("false")).count() == 0


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><a href='/a'>menu</a></nav><div class=\"ad\">buy</div><article><h1>{0}</h1>{1}<div class='comments'>me too</div></article><aside>more</aside><form>mail</form><footer>&copy; us</footer></body></html>"


def test_main_text():
    page = PAGE.format("A &amp; B", "<p><b>one<br><p>two &lt;3&#233;\n  x</p><!-- no --><ul><li>l1<li>l2</ul>tail")
    assert html.main_text(page) == "A & B\n\none\n\ntwo <3é x\n\nl1\n\nl2\n\ntail"
    assert html.main_text("") == "" and html.main_text("plain <i>text</i>") == "plain text"


@pytest.mark.parametrize(("page", "text"), [
    ('<article class="post social-science"><p>x</p></article>', "x"),
    ('<article><section class=share-prices>a</section><section id="related-work">b</section><div class="notice-board">c</div><div class="comments">no</div><div class=\'ad-slot\'>no</div></article>', "a\n\nb\n\nc"),
    ("<article class=a>one</article><article class=b>two</article>", "one\n\ntwo"),
    ("<body class=widget><div><p>x</p></div></body>", "x"),
    ("<div class=widget><p>all there is</p></div>", "all there is"),
    ("a < b <p>c <a d</p>", "a < b\n\nc <a d"),
    ("<p title='a>b'>x</p><p title=\"it's\">y", "x\n\ny"),
    ("<script>if (a<b) '</p>'</script ><style>p</style>z<!-- <p>", "z"),
])
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 100_000 + "x", "<a \"'" * 200_000, "<script " * 100_000, "<!" * 200_000, "<!--" * 200_000, "<b>x" * 50_000])
def test_pages_are_read_in_linear_time(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 20


def test_wrapper_of_a_host():
    wrapper, rules = html.infer([PAGE.format("x", "<p>a b</p>"), PAGE.format("y", "<p>c d</p><p>e</p><p>f</p>"), PAGE.format("z", "<p>g</p><table></table>")])
    assert "<article><h1>#TEXT</h1>(<p>#TEXT</p>)+(<table></table>)?<div.comments>me too</div></article>" in str(wrapper)
    assert html.main_text(PAGE.format("v", "<p>w"), rules) == "v\n\nw"
    mixed, _ = html.infer(["<p>a<h2>b</h2><p>c", "<h2>d</h2><p>e<h2>f</h2><ul><li>g</ul>"])
    assert str(mixed) == "((<h2>#TEXT</h2>)?(<p>#TEXT</p>)?)+(<ul><li>g</li></ul>)?"


def test_what_all_pages_of_a_host_share_is_no_content():
    pages = [f"<body><div class=x>Join us</div><div class=y><h2>title {i}</h2><div>See our terms</div><p>text {i}</p></div></body>" for i in range(5)]
    _, rules = html.infer(pages)
    assert html.main_text(pages[1], rules) == "title 1\n\ntext 1"
    assert html.main_text(pages[1].replace("our", "their"), rules) == "title 1\n\nSee their terms\n\ntext 1"
    # of two templates each has its own main element; copies of one page share all and lose nothing
    other = [f"<body><nav>menu {i}</nav><section><p>other {i} and more</p></section></body>" for i in range(5)]
    _, rules = html.infer(pages + other)
    assert [html.main_text(x, rules) for x in (pages[2], other[3])] == ["title 2\n\ntext 2", "other 3 and more"]
    copies = [PAGE.format("same", "<p>all the same</p>") + " " * i for i in range(6)]
    assert html.main_text(copies[0], html.infer(copies)[1]) == "same\n\nall the same"


def test_extract(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i}", PAGE.format(f"t{i}", f"<p>b{i}</p>" * (i % 4)), "x") for i in range(200)]
    rows += [(None, None, None, None), (500, "http://H0.example", "", "x"), (7, rows[7][1], rows[7][2], "x"), (501, "no url", "<article>" + "<p>w</p>" * 20_000, "x")]
    rows += [(1000 + i, "http://one.example", PAGE.format("same", "<p>page</p>"), "x") for i in range(600)] + [((1 << 60) + 1, "http://one.example", PAGE.format("u", ""), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for bound in (html.BROADCAST_BYTES, 0):
        monkeypatch.setattr(html, "BROADCAST_BYTES", bound)
        monkeypatch.setattr(html, "PART_PAGES", 50)
        found = html.extract(df).collect()
        assert len(found) == len(rows)
        texts = {r["page_id"]: r["text"] for r in found}
        for i in range(200):
            assert texts[i] == "\n\n".join([f"t{i}", *[f"b{i}"] * (i % 4)])
        assert texts[None] == texts[500] == "" and texts[501].count("w") == 20_000
        assert all(texts[1000 + i] == "same\n\npage" for i in range(600)) and texts[(1 << 60) + 1] == "u"
        assert all(r["n_chars"] == len(r["text"]) for r in found)
    known = {r["host"]: r for r in html.wrappers(df).collect()}
    assert known["one.example"]["n_pages"] == 601 and all(r["wrapper"] for h, r in known.items() if h)
    assert html.extract(df.where("false")).count() == 0


def test_html_query_against_plain_patterns(spark):
    """Every page of the given table has one article, whose blocks a few patterns can cut out."""
    from pixelweave.llm import queries

    def plain_text(page):
        inner = re.sub(r"(?s)<!--.*?-->", "", re.search(r"(?s)<article>(.*)</article>", page)[1])
        blocks = re.split(r"</?(?:h1|p|ul|li|div)\b[^>]*>", inner)
        found = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
        return "\n\n".join(b for b in found if b)

    data = "/root/testdata/sf0.01"
    found = {r["page_id"]: r["text"] for r in queries.op5_html(spark, data).collect()}
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert len(found) == len(pages) > 200
    assert all(found[r["page_id"]] == plain_text(r["html"]) for r in pages)
