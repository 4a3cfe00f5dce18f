"""SimHash, decontamination, personal data, quality, context trees: odd rows and brute force."""

import itertools
import random
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelweave.llm import ctw, decontaminate, pii, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, copy string, kind string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns whose names the operators use themselves."""
    long = words(30_000, 1)
    rows = [(1, words(60, 2)), (2, words(60, 2)), (2, words(60, 2)), (3, None), (4, ""), (None, words(60, 2)), (None, None), (5, long), (6, "one"), (7, " \t\n "), (8, words(60, 3) + " tail")]
    return spark.createDataFrame([(i, t, None if i == 1 else "en", None, None if t is None else len(t), "x", "y", None) for i, t in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def test_simhash_of_one_text_is_the_bitwise_majority():
    def plain(text, k):
        ws = text.encode().lower().split()
        if not ws:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + k]), 42) for i in range(max(1, len(ws) - k + 1))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for text in ("", "a", "A b c", "a b c d", "x y z x y z x y z x y z", words(300, 4), "é è ü   z q r"):
        assert simhash.simhash(text.encode(), 4) == plain(text, 4)


def test_covering_masks_separate_no_pair_within_the_radius():
    r = random.Random(0)
    for radius in (2, 4):
        masks = simhash.covering_masks(list(range(64)), radius)
        for _ in range(500):
            differ = sum(1 << p for p in r.sample(range(64), radius))
            assert any(not differ & m for m in masks)


def test_covering_masks_keep_about_half_of_few_positions_too():
    for radius in (2, 4):
        for n in range(radius + 1, 65):
            kept = [m.bit_count() for m in simhash.covering_masks(list(range(64 - n, 64)), radius)]
            assert min(kept) >= max(1, n // 3 - 1), (radius, n)
    first = simhash.covering_masks(list(range(64)), 4)
    for m in first:
        for k in simhash.covering_masks([p for p in range(64) if not m >> p & 1], 4):
            free = [p for p in range(64) if not (m | k) >> p & 1]
            # a third level ends it
            assert all(len(free) - x.bit_count() <= 10 for x in simhash.covering_masks(free, 4))


def near(fps, radius):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize(("bucket_rows", "bases"), [(1024, 20), (6, 2)])
def test_links_connect_what_all_pairs_connect(spark, bucket_rows, bases):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(bases)]
    fps = {b ^ sum(1 << p for p in r.sample(range(64), r.randint(0, 6))) for b in base for _ in range(12)}
    fps = {x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from pixelweave.llm.common import components

    found = dict(components(simhash.links(df, 4, bucket_rows)).collect())
    expected = {f: x for f, x in near(fps, 4).items()}
    groups = lambda m: sorted(sorted(f for f in fps if m.get(f, f) == x) for x in {m.get(f, f) for f in fps})
    assert groups(found) == groups(expected)


def test_a_crowd_within_the_positions_that_two_levels_leave(spark):
    r = random.Random(5)
    first = simhash.covering_masks(list(range(64)), 4)[3]
    second = simhash.covering_masks([p for p in range(64) if not first >> p & 1], 4)[7]
    free = [p for p in range(64) if not (first | second) >> p & 1]
    fps = {sum(1 << p for p in free if r.random() < 0.5) for _ in range(1500)}
    fps = {x - (1 << 64) if x >> 63 else x for x in fps}
    assert 14 <= len(free) <= 18 and len(fps) > 1024
    from pixelweave.llm.common import components

    found = dict(components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)).collect())
    assert {f: found.get(f, f) for f in fps} == near(fps, 4)


def test_near_duplicates_of_odd_rows(odd, empty):
    found = [tuple(r) for r in simhash.near_duplicates(odd).select("doc_id", "component_id").collect()]
    assert len(found) == odd.count()
    assert sorted(x for x in found if x[0] in (1, 2)) == [(1, 1), (2, 1), (2, 1)]
    assert sorted(x[0] for x in found if x[1] == 3 and x[0]) == [3, 4, 7]
    assert sorted(x[1] for x in found if x[0] is None) == [1, 3]
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one_of_odd_rows(spark, odd, empty):
    kept = simhash.keep_one(odd.withColumn("node", F.lit(1)).withColumn("key", F.lit(2)))
    assert kept.columns == [*odd.columns, "node", "key"]
    # null and empty texts are one group; rows without an id go with their text
    assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == [1, 3, 5, 6, 8]
    assert simhash.keep_one(empty).count() == 0
    # of rows that share an id only those of one text or group go
    rows = [(1, words(50, 50)), (1, words(50, 51)), (1, words(50, 51)), (None, words(50, 52)), (None, words(50, 52)), (None, words(50, 53))]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] or 0, r[1]) for r in kept) == sorted({(i or 0, t) for i, t in rows})


def edited(text, n, r):
    ws = text.split()
    for i in r.sample(range(len(ws)), n):
        ws[i] = "".join(r.choice("xyz") for _ in range(5))
    return " ".join(ws)


def jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def connected(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in sorted(pairs):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_keep_one_against_all_pairs(spark):
    """Texts that all pairs of five-word similarity of 0.8 or more connect: every drop is one of these, and nearly all are found."""
    r = random.Random(9)
    docs = []
    for g in range(40):
        base = words(150, 1000 + g)
        docs += [base, *(edited(base, r.randint(1, 4), r) for _ in range(r.randint(1, 6))), edited(base, 30, r)]
    near = {(i, j) for i, j in itertools.combinations(range(len(docs)), 2) if jaccard(docs[i], docs[j]) >= 0.8}
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = {x[0] for x in simhash.keep_one(table).collect()}
    expected = set(connected(len(docs), near))
    assert kept >= expected  # nothing goes without a verified link
    assert len(kept - expected) <= 0.1 * (len(docs) - len(expected))
    rows, edges, _ = simhash.similar_texts(table)
    named = {bytes(x["key"]): x["doc_id"] for x in rows.collect()}
    assert {tuple(sorted((named[bytes(x["a"])], named[bytes(x["b"])]))) for x in edges.collect()} <= near


@pytest.mark.parametrize("compared", [1024, 16])
def test_keep_one_of_a_large_family_of_copies_of_copies(spark, monkeypatch, compared):
    """300 texts, each an edited copy of an earlier one: exactly what the pairs connect that are alike and whose fingerprints under some seed are within the radius, whatever the blocks."""
    from pixelweave.llm import minhash

    monkeypatch.setattr(minhash, "COMPARED", compared)
    r = random.Random(31)
    docs = [words(300, 77)]
    while len(docs) < 300:
        docs.append(edited(r.choice(docs), r.randint(1, 3), r))
    r.shuffle(docs)
    fps = [simhash.simhashes(d.encode(), simhash.FINGERPRINT_WORDS, simhash.SEEDS) for d in docs]
    near = {
        (i, j)
        for i, j in itertools.combinations(range(len(docs)), 2)
        if min((a ^ b).bit_count() for a, b in zip(fps[i], fps[j], strict=True)) <= simhash.RADIUS and jaccard(docs[i], docs[j]) >= 0.8
    }
    kept = {x[0] for x in simhash.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert len(near) > 300 and kept == set(connected(len(docs), near))


@pytest.mark.parametrize("compared", [1024, 32])
def test_bands_of_one_block_are_compared_by_a_row_for_each_text(spark, monkeypatch, compared):
    """40 bands of the same 100 texts, 60 of one class: nothing is joined to their rows or made of them, and the same pairs are found as by blocks."""
    from pixelweave.llm import minhash

    monkeypatch.setattr(minhash, "COMPARED", compared)
    r = random.Random(4)
    keys, base = [bytes([i]) for i in range(100)], r.getrandbits(64)
    fps = [(base ^ sum(1 << p for p in r.sample(range(64), 3))).to_bytes(8, "little") for _ in keys]
    size = [r.randint(70, 130) for _ in keys]
    sketched = spark.createDataFrame(list(zip(keys, size, fps, strict=True)), "key binary, n long, sketch binary")
    shared = sketched.crossJoin(spark.range(40).select(F.col("id").alias("band"))).withColumn("in_band", F.lit(100))
    roots = spark.createDataFrame([(k, keys[0]) for k in keys[1:60]], "key binary, root binary")
    if compared == 1024:
        rows, n = minhash._rows_compared(shared, roots, sketched)
        assert n == rows.count() == 4000
    alike = minhash.Alike("<u8", 1, simhash._nearness, -5)
    pairs = lambda own: {tuple(sorted((bytes(x["one"]), bytes(o)))) for x in minhash._compared(own, roots, sketched, 7, 0.8, alike, None).collect() for o in x["others"]}
    bits = lambda i, j: (int.from_bytes(fps[i]) ^ int.from_bytes(fps[j])).bit_count()
    near = {(keys[i], keys[j]) for i, j in itertools.combinations(range(100), 2) if j >= 60 and bits(i, j) <= 5 and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])}
    assert near and pairs(shared) == pairs(shared.select("band", "key")) == near


def test_contained_matches_counting_all_shingles(spark, odd, empty):
    item = words(40, 9).split()
    docs, r = [], random.Random(3)
    for i in range(60):
        cut = [w if r.random() > 0.02 * (i % 5) else "zz" for w in item]
        docs.append((i, words(r.randint(0, 400), 100 + i) + " " + " ".join(cut if i % 3 else item[: 40 - i % 20]) + " " + words(5, i)))
    items = [(0, " ".join(item)), (1, "short one"), (2, None), (None, "x y z"), (3, words(12, 77).upper()), (3, words(12, 78))]
    docs += [(100, words(12, 77) + " " + words(12, 78)), (101, "Short\tONE"), (101, "other")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def shingles(text):
        ws = [w.decode() for w in (text or "").encode().lower().split()]
        return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    own = {}
    for i, t in items:
        if i is not None:
            own.setdefault(i, set()).update(shingles(t))
    expected = set()
    for i, t in docs:
        for j, s in own.items():
            n = len(s & shingles(t))
            if s and n >= 0.8 * len(s) - 1e-9:
                expected.add((i, j, len(s), n))
    found = {tuple(x)[:4] for x in decontaminate.contained(d, b).collect()}
    assert expected and found == expected
    assert decontaminate.contained(empty, b).count() == decontaminate.contained(d, b.where("false")).count() == 0
    assert decontaminate.contained(odd, b).count() == 0
    kept = decontaminate.decontaminate(odd, spark.createDataFrame([(1, words(60, 2))], "item_id long, text string"))
    assert kept.columns == odd.columns
    # the row without an id whose text is the item goes too
    assert sorted(x[0] or 0 for x in kept.select("doc_id").collect()) == [0, 3, 4, 5, 6, 7, 8]


def test_pii_spans(spark, odd, empty):
    card, bad = "4539578763621486", "4539578763621487"
    text = f"é😀 a.b+c@x-y.co.uk.d_e@f.gh, 1.2.3.4 300.1.1.1 0255.0.0.09 {card} {bad} +1 (555) 010-9999 +12 iban DE89370400440532013000 ssn 123-45-6789 9 123-45-6780 amex 378282246310005"
    long = "a" * 200_000 + "@" + "1" * 200_000 + " 1.1.1.1"
    docs = spark.createDataFrame([(1, text), (2, long), (3, None), (3, None), (None, card)], "doc_id long, text string")
    found = {(r[0], r[1]): [text[int(a) : int(b)] if r[0] == 1 else (k, int(a), int(b)) for k, a, b in (s.split(":") for s in r[2].split(",") if s)] for r in pii.find_spans(docs).select("doc_id", F.length("text"), pii.listed(pii.BASE + pii.SCORED)).collect()}
    assert found[1, len(text)] == ["a.b+c@x-y.co.uk.d_e", "1.2.3.4", "0255.0.0.09", card, "+1 (555) 010-9999", "DE89370400440532013000", "378282246310005", "123-45-6789"] or found[1, len(text)][0].startswith("a.b+c@")
    assert found[2, len(long)] == [("ip", 400_002, 400_009)]
    assert found[None, 16] == [("card", 0, 16)]
    assert pii.find_spans(odd).count() == odd.count() and pii.find_spans(empty).count() == 0


def test_texts_of_very_many_matches(spark):
    """Folds by blocks: positions go on from block to block, in time that isn't quadratic."""
    n = 200_000
    texts = [" ".join(["é12 a.b@c.de"] * 20_000), " ".join(["4539578763621486x"] * 5000), " ".join(map(str, range(n))), "1.2.3.4 " * 30_000, "ssn 123-45-6789 " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    found = {r["doc_id"]: r for r in pii.find_spans(df).select("doc_id", pii.listed(pii.BASE + pii.SCORED).alias("s"), *[F.size(k).alias(k) for k in pii.BASE]).collect()}
    masked = dict(pii.mask(df).collect())
    assert time.time() - began < 60
    assert found[0]["s"] == ",".join(f"email:{13 * i + 4}:{13 * i + 12}" for i in range(20_000))
    assert found[1]["s"] == ",".join(f"card:{18 * i}:{18 * i + 16}" for i in range(5000))
    assert found[2]["s"] == "" and found[3]["ip"] == 30_000
    assert found[4]["s"] == ",".join(f"ssn:{16 * i + 4}:{16 * i + 15}" for i in range(500))
    assert masked == {0: " ".join(["é12 [EMAIL]"] * 20_000), 1: " ".join(["[CARD]x"] * 5000), 2: texts[2], 3: "[IP] " * 30_000, 4: "ssn [SSN] " * 500}


def test_digit_runs_are_proposed_as_by_the_plain_pattern(spark):
    import re

    r = random.Random(8)
    texts = ["".join(r.choice("0123456789 -x") if r.random() < 0.3 else r.choice("0123456789") for _ in range(60)) for _ in range(400)]

    def luhn(d):
        ds = [int(c) for c in reversed(d)]
        return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(ds)) % 10 == 0

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: [(s["start"], s["end"]) for s in x["card"]] for x in pii.find_spans(df, kinds=("card",)).collect()}
    for i, t in enumerate(texts):
        runs = [(m.start(), m.end(), re.sub("[^0-9]", "", m[0])) for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", t)]
        assert found[i] == [(a, b) for a, b, d in runs if 16 <= len(d) <= 19 and luhn(d)]


def test_ibans_end_where_their_checksum_says(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    texts = {
        f"{de.replace(' ', '')} Konto": [de.replace(" ", "")], f"{de} BIC COBADEFF": [de], f"{de} {gb}": [de, gb], f"{de} {no} {gb} 7 A": [de, no, gb],
        f"AB12 {de} Konto": [de], f"{de}x": [], f"{de}9": [], f"x{de}": [], f"{de}": [de], f"{de.replace('89', '88')} Konto": [], f"😀 {gb}, {de}.": [gb, de], "DE89 " + "A" * 60: [],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find_spans(df).collect():
        assert [x["found"] for x in row["iban"]] == texts[row["text"]], row["text"]
        assert all(row["text"][x["start"] : x["end"]] == x["found"] for x in row["iban"])
    masked = {r[0]: r[1] for r in pii.mask(df).collect()}
    assert masked[0] == "[IBAN] Konto" and masked[1] == "[IBAN] BIC COBADEFF" and masked[2] == "[IBAN] [IBAN]"


def test_mask_replaces_spans_and_keeps_columns(spark, odd):
    docs = spark.createDataFrame([(1, "to a@b.co now +1 555 010 9999.", 30, "x"), (2, None, None, "x"), (3, "plain", 5, None)], "doc_id long, text string, n_chars long, found string")
    assert [tuple(r) for r in pii.mask(docs).orderBy("doc_id").collect()] == [(1, "to [EMAIL] now [PHONE].", 23, "x"), (2, None, None, "x"), (3, "plain", 5, None)]
    assert pii.mask(odd).count() == odd.count()


def test_isotonic_is_the_least_squares_rising_fit():
    x, y = np.array([1.0, 2, 2, 3, 4, 5]), np.array([0.0, 1, 1, 0, 1, 1])
    at, value = quality.isotonic(x, y)
    assert np.allclose(np.interp([1, 2, 3, 4, 5], at, value), [0, 2 / 3, 2 / 3, 1, 1])


def test_quality_separates_held_out_rows(spark, odd, empty):
    docs = [(i, words(80, i) if i % 3 else " ".join(w.upper() + "!!" for w in words(20, i).split()) * 4) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i, _ in docs] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    scores = dict(quality.score(d, model).collect())
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(scores[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.98
    assert quality.score(odd, model).count() == odd.count() and quality.score(empty, model).count() == 0
    assert quality.keep_good(odd, labels.where("false")).count() == odd.count()  # no labels: a score of 0.5 keeps
    assert quality.keep_good(empty, labels).columns == odd.columns


def test_ridge_weights_solve_the_plain_normal_equations(spark):
    docs = [(i, words(30 + i % 50, i) if i % 2 else words(20, i).upper() + " !!" * (i % 7)) for i in range(150)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    model = quality.fit(d, labels)
    learn = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.array([quality.statistics(docs[i][1].encode()) for i in learn])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1))
    apart = {r[0] for r in labels.where(F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(quality.CALIBRATE_ONE_IN)) == 0).collect()}
    y, keep = np.array([i % 2 for i in learn], dtype=float), np.array([i not in apart for i in learn])
    z = np.cos(np.clip((x - model.mean) / model.scale, -quality.CLIP, quality.CLIP) @ model.frequencies + model.phases) * np.sqrt(2 / quality.N_FOURIER)
    z = np.hstack([np.ones((len(z), 1)), z])[keep]
    n, weigh = len(learn), np.where(y > 0, len(learn) / 2 / y.sum(), len(learn) / 2 / (len(learn) - y.sum()))[keep]
    a = (z * weigh[:, None]).T @ z + quality.RIDGE * n / z.shape[1] * np.eye(z.shape[1])
    assert np.allclose(a @ model.weights, (z * weigh[:, None]).T @ y[keep], atol=1e-6)


def test_quality_never_learns_from_held_out_rows(spark):
    d = spark.createDataFrame([(i, words(40, i)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(d, labels), quality.fit(d, other)
    assert np.array_equal(a.weights, b.weights) and np.array_equal(a.values, b.values)


def test_log_gamma():
    import math

    x = np.array([0.5, 1, 1.5, 7.9, 8, 100, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12)


def stream(text):
    """The bytes that are coded: each word and a space, then an end."""
    return b"".join(w + b" " for w in (text or "").encode().lower().split()) + b"\n"


def brute_context_tree(train, texts, depth):
    """Probabilities by the definition: weighted nodes over dictionaries."""
    import math
    from collections import defaultdict

    counts = defaultdict(lambda: [0, 0])

    def steps(whole):
        for i, byte in enumerate(whole):
            past = (b"\n" * depth + whole[:i])[-depth:]
            for level in range(8):
                yield past, (1 << level) | (byte >> (8 - level)), (byte >> (7 - level)) & 1

    for text in train:
        for past, node, bit in steps(stream(text)):
            for d in range(depth + 1):
                counts[past[depth - d :], node][bit] += 1
    children = defaultdict(list)
    for past, node in list(counts):
        if past:
            children[past[1:], node].append((past, node))

    def kt(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(c[0] + c[1] + 1) - math.log(math.pi)

    memo = {}

    def weighted(s):
        if s not in memo:
            below = [weighted(c) for c in children[s]]
            memo[s] = kt(counts[s]) if len(s[0]) == depth else np.logaddexp(kt(counts[s]), sum(below)) - math.log(2)
        return memo[s]

    def p(past, node, bit, d):
        s = (past[depth - d :], node)
        c = counts.get(s, (0, 0))
        own = (c[bit] + 0.5) / (sum(c) + 1)
        deeper = (past[depth - d - 1 :], node)
        if d == depth or sum(counts.get(deeper, (0, 0))) == 0:
            return own
        w = math.exp(min(0, kt(c) - math.log(2) - weighted(s)))
        return w * own + (1 - w) * p(past, node, bit, d + 1)

    return [sum(math.log(p(past, node, bit, 0)) for past, node, bit in steps(stream(t))) for t in texts]


@pytest.mark.parametrize("shard_grams", [ctw.SHARD_GRAMS, 40])
def test_context_trees_match_brute_force(spark, monkeypatch, shard_grams):
    monkeypatch.setattr(ctw, "SLICE_BYTES", 97)
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(ctw, "PART_BYTES", 400)
    docs = [(i, words(25, i % 17) + (" Rare" if i % 5 == 0 else "")) for i in range(40)] + [(None, "a b a"), (40, None), (41, ""), ((1 << 60) + 1, " é\t\x0bÉ "), (42, " \n ")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    found = {(r["doc_id"], r["n_tokens"]): r for r in ctw.score(d, shard_grams=shard_grams).collect()}
    train = [t for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    total = {}
    for t in train:
        for w in [*(t or "").encode().lower().split(), "end"]:
            total[w] = total.get(w, 0) + 1
    n, v = sum(total.values()), len(total)
    expected = brute_context_tree(train, [t for _, t in docs], ctw.DEPTH)
    for (i, t), lp in zip(docs, expected, strict=True):
        tokens = [*(t or "").encode().lower().split(), "end"]
        r = found[i, len(tokens)]
        assert r["score"] == pytest.approx(lp / np.log(10), rel=1e-9)
        assert r["bits_per_byte"] == pytest.approx(-lp / np.log(2) / len(stream(t)), rel=1e-9)
        assert r["base_score"] == pytest.approx(sum(np.log10((total.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
        assert (r["n_known"], r["train_tokens"]) == (sum(w in total for w in tokens), n)


def test_order_of_words_counts_and_odd_rows_are_scored(spark, odd, empty):
    r = random.Random(3)
    sentence = "the cat sat on the mat and then the dog ran off to the sea"
    mixed = sentence.split()
    r.shuffle(mixed)
    d = spark.createDataFrame([(i, sentence) for i in range(30)] + [(36, sentence), (40, " ".join(mixed))], "doc_id long, text string")
    found = {x["doc_id"]: x["score"] for x in ctw.score(d).collect()}
    assert found[36] > found[40] + 3
    assert ctw.score(odd).count() == odd.count()
    assert ctw.score(empty).count() == 0
    assert ctw.score(odd.where("doc_id is null")).count() == 2


def test_blocks_are_small_whatever_the_partition(spark):
    """90 MB of text in one partition: the last step holds a block whole, so a block has 64 MB at most."""
    d = spark.range(0, 900, 1, 1).select(F.col("id").alias("doc_id"), F.lit(False).alias("held_out"), F.repeat(F.lit("some text "), 10_000).alias("text"))
    found = ctw._blocks(d).groupBy("block").agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).collect()
    assert sum(r["rows"] for r in found) == 900 and max(r["n"] for r in found) <= 64 << 20


def test_context_tree_reads_a_block_in_several_tasks(spark):
    """Blocks are stored as rows; a file of a block that several tasks read asks for some grams twice."""
    d = spark.createDataFrame([(i, f"some words of text {i % 37} and more {i * 7919}") for i in range(1500)], "doc_id long, text string").coalesce(1)
    expected = {r["doc_id"]: r["score"] for r in ctw.score(d).collect()}
    blocks = ctw._blocks(d.select("doc_id", ctw.held_out(F.col("doc_id")).alias("held_out"), "text"))
    assert blocks.columns == ["block", "doc_id", "held_out", "text"] and blocks.count() == 1500
    own = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1", "parquet.block.size": "4000"}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        found = {r["doc_id"]: r["score"] for r in ctw.score(d).collect()}
    finally:
        for k in own:
            spark.conf.unset(k)
    assert found.keys() == expected.keys() and all(abs(found[i] - expected[i]) < 1e-9 for i in expected)
