"""Hard negatives, MinHash near-duplicates and phrases: odd rows, and brute force on small tables."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import collocations, minhash, negatives, queries, sql

DATA = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, v string, anchor string, place string"


def mined(rows, every=3, **k):
    """Anchor by anchor over all rows."""
    out = set()
    rows = sorted({(i, tuple(v), l) for i, v, l in rows}, key=lambda r: (r[0], r[2], r[1]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, v, l in rows:
        if i % every:
            continue
        scored = sorted(((-dot(v, w), j, m) for j, w, m in rows if j != i), key=lambda s: s[:2])
        for p, j, m in [s for s in scored if s[2] == l][: k.get("positives", 5)]:
            good = [(n, o) for n, o, q in scored if q != l and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out |= {(i, j, r, o, -p, -n) for r, (n, o) in enumerate(good, 1)}
    return out


def test_hard_negatives_against_all_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 15)
    monkeypatch.setattr(negatives, "SCORES", 64)
    r = random.Random(3)
    # few values, so scores tie; one vector very often
    rows = [(i, [r.randint(-2, 3) / 256 for _ in range(4)] if i % 4 else [2 / 256] * 4, r.choice([0, 0, 0, 1, 2])) for i in range(200)]
    df = spark.createDataFrame([(i, v, l, "x", "y", None) for i, v, l in rows + rows[:20]], VECTORS)
    found = [tuple(x) for x in negatives.mine(negatives.vectors(df), F.col("vec_id") % 3 == 0).collect()]
    assert len(found) == len(set(found)) and set(found) == mined([(i, [256 * x for x in v], l) for i, v, l in rows])


def test_hard_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.8, 0.0], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (None, [0.7, 0.0], 2), (7, [0.7, 0.0], None), (8, [0.9], 2), (9, [], 2)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS)
    assert [tuple(r) for r in negatives.mine(negatives.vectors(df), F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 65536, 256 * 204)]
    assert negatives.mine(negatives.vectors(df.where("false")), F.col("vec_id") == 0).count() == 0


def test_exact_scores_beyond_doubles():
    a, b = np.array([[2.0**30 + 1, 1.0]]), np.array([[2.0**30, 3.0]])
    assert negatives._scores(a, b).tolist() == [[(2**30 + 1) * 2**30 + 3]]
    with pytest.raises(OverflowError):
        negatives._scores(a * 2.0**10, b * 2.0**10)


def words(r, n, of="abcdefghij"):
    return ["".join(r.choice(of) for _ in range(3)) for _ in range(n)]


def linked(texts):
    """Components by the similarity of all pairs, and set sizes."""
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return [(i, len(sets[i]), root[i], root[i] == i) for i in range(len(texts))]


def test_minhash_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "COMPARED", 16)
    monkeypatch.setattr(minhash, "VERIFIED", 16)
    r = random.Random(8)
    texts = [" ".join(words(r, r.randint(5, 60))) for _ in range(60)]
    base = words(r, 80)
    for _ in range(120):  # copies, and copies of copies, about the bound
        copy = list(r.choice([base, texts[-1].split()]))
        for _ in range(r.randint(0, 3)):
            copy[r.randrange(len(copy))] = "zz" + str(r.randrange(1000))
        texts.append(" ".join(copy))
    texts += [texts[3], texts[3], "one two", "one two", "one", "", None, " \t", "one two three four", "One TWO three four"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(t if t is None else t for t in texts)], "doc_id long, text string, key string, n string")
    expect = linked([None if t is None else t.lower() for t in texts])
    assert sorted(tuple(x) for x in minhash.near_duplicates(df).collect()) == expect
    assert sum(1 for x in expect if not x[3]) > 20


def test_minhash_of_odd_rows(spark):
    long = " ".join(words(random.Random(1), 30_000))
    rows = [(5, long), (None, long), (3, long + " tail"), (None, "a b c d e"), (7, None), (7, None), (8, ""), (9, "x y z w v"), (9, "x y z w v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(df).collect())
    assert found == Counter({(5, 3, False): 1, (None, 3, False): 1, (3, 3, True): 1, (None, None, False): 1, (7, 7, True): 2, (8, 8, True): 1, (9, 9, True): 2})
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_sketches_fill_and_agree_as_sets_do():
    r = np.random.default_rng(4)
    for n in (1, 3, 40, 5000):
        both = r.integers(0, 1 << 63, n * 9, dtype=np.uint64)
        a, b = minhash.sketch(both[: n * 8 or 1]), minhash.sketch(both[n:])
        assert (a != minhash._FULL).all()
        share = (a == b).mean()
        assert abs(share - 7 / 9) < (0.1 if n > 3 else 0.5)
    assert minhash.banding(0.8) == 31 and minhash.least_agreement(0.8) < 0.8 * minhash.SIZE


def counted(docs, least, top):
    """All grams by counting, for each language."""
    import re

    out = {}
    for lang in {lang or "und" for _, lang in docs}:
        f, n = Counter(), 0
        for text, other in docs:
            if (other or "und") != lang:
                continue
            for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
                w = re.findall("[^ \t]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
        c = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        inside = lambda g: any(c[o] >= c[g] and any(o[i : i + len(g)] == g for i in range(len(o) - len(g) + 1)) for o in c if len(o) > len(g))
        rows = []
        for g, a in c.items():
            if not inside(g):
                score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((" ".join(g), a, f[g[:k]], f[g[k:]], n, score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out |= {(lang, i): x for i, x in enumerate(rows[:top], 1)}
    return out


@pytest.mark.parametrize("bits", [1 << 24, 1 << 19])
def test_phrases_against_counting(spark, monkeypatch, bits):
    monkeypatch.setattr(collocations, "TEXT_BYTES", 2000)
    monkeypatch.setattr(collocations, "PART_WORDS", 500)
    r = random.Random(6)
    vocabulary = [chr(97 + i) * 2 for i in range(12)] + ["É", "x.y", " "]
    passage = " ".join(words(r, 40))
    docs = []
    for i in range(150):
        t = " ".join(r.choices(vocabulary, weights=range(1, 16), k=r.randint(0, 60)))
        docs.append((t + r.choice(["", ". ", ", ", "\n", "\t"]) + (passage if i % 3 == 0 else "") + r.choice([" Aa aa aa aa aa aa aa", "!", ""]), r.choice(["en", "fr", None])))
    docs += [(None, "en"), ("", None), (" .;\t", "de"), ("only rare words", "de")]
    df = spark.createDataFrame([(t, lang, "x", "y") for t, lang in docs], "text string, lang string, phrase string, n string")
    found = {(x["lang"], x["rank"]): tuple(x)[2:] for x in collocations.phrases(df, least=8, top=50, word_bits=bits, pair_bits=bits).collect()}
    expect = counted(docs, 8, 50)
    assert found == expect and len({k[0] for k in expect}) == 3
    assert collocations.phrases(df.where("false")).count() == 0


def test_paths_hold_a_shared_passage_as_one_row(spark):
    passage = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(" ".join(passage), "en")] * 9, "text string, lang string")
    _, found = collocations.edges(df, 5)
    assert [(r["words"], r["n"]) for r in collocations.paths(found, 5).collect()] == [(passage, 9)]


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_minhash", "op13_phrases"])
def test_queries_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    theirs = db.execute(sql.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    ours = queries.QUERIES[name](spark, DATA).select(*columns)
    assert sorted(map(repr, map(tuple, ours.collect()))) == sorted(map(repr, theirs.fetchall()))
