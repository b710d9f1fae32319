"""Vector codes, spelling variants and shards against plain loops, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from boxwright.llm import sharding, spelling, vector_codes

VECTORS = "vec_id long, embedding array<double>, label string, code string, _q string"


def brute_codes(rows, parts=8, k=16, rounds=6, scale=4096):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * dim : (p + 1) * dim]
    books = [[list(cut(v, p)) for _, v in kept[:k]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((far(cut(v, p), c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = defaultdict(list)
            for _, v in kept:
                own[nearest(v, p)[1]].append(cut(v, p))
            for e, some in own.items():
                new[p][e] = [sum(c) // len(some) for c in zip(*some, strict=True)]
        books = new
    found = []
    for i, v in kept:
        best = [nearest(v, p) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), min(sum(d for d, _ in best), 2**63 - 1)))
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def told(df):
    return [(r["vec_id"], r["code"], r["error"]) for r in df.collect()]


@pytest.mark.parametrize("size", [0.2, 3.0, 1e6, 1e30])
def test_codes_equal_plain_lloyd_rounds(spark, size):
    rng = random.Random(int(size))
    centres = [[rng.uniform(-size, size) for _ in range(16)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, size / 9) for x in centres[rng.randrange(9)]]) for i in range(240)]
    rows += [(1000 + i, list(rows[i % 3][1])) for i in range(80)]  # a third are copies
    df = spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], VECTORS).repartition(4)
    coded, books = vector_codes.product_codes(df, parts=8, entries=16)
    expected, digest = brute_codes(rows)
    assert sorted(told(coded)) == sorted(expected)
    assert books.digest() == digest
    assert books.scans[0] <= 8 * len(rows)
    assert books.scans[-1] < books.scans[0] / 2  # bounds spare most scans once entries settle


def test_codes_with_ties_and_few_vectors(spark):
    rng = random.Random(5)
    for n in (1, 2, 5, 60):
        rows = [(i % 7, [float(rng.randint(0, 1)) for _ in range(8)]) for i in range(n)]
        df = spark.createDataFrame([(i, v, "a", None, None) for i, v in rows], VECTORS).repartition(3)
        coded, books = vector_codes.product_codes(df, carry=("label",))
        expected, digest = brute_codes(rows)
        assert sorted(told(coded)) == sorted(expected)
        assert books.digest() == digest


def test_codes_of_awkward_vectors(spark):
    good = [0.5] * 8
    rows = [(1, good), (None, good), (1, good), (2, None), (3, [float("nan")] + good[1:]), (4, [float("inf")] + good[1:]), (5, [None] + good[1:]), (6, []), (7, [1.0] * 16), (8, [1.0] * 5), (9, [1e308] * 8)]
    df = spark.createDataFrame([(i, v, None, "x", "y") for i, v in rows], VECTORS)
    coded, _ = vector_codes.product_codes(df, carry=("label", "_q"))
    assert coded.columns == ["vec_id", "label", "_q", "code", "error"]
    found = sorted(told(coded), key=str)
    assert found == sorted([(1, "00" * 8, 0), (1, "00" * 8, 0), (None, "00" * 8, 0), (6, None, None), (7, None, None), (8, None, None)], key=str)
    none, books = vector_codes.product_codes(df.where("vec_id in (6, 8)"))
    assert sorted(told(none)) == [(6, None, None), (8, None, None)]
    assert books.digest() == hashlib.sha256(b"").hexdigest()
    assert vector_codes.product_codes(df.limit(0))[0].count() == 0


def test_label_errors_sum_equal_labels_nulls_together(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(16)], None if i % 5 == 0 else i % 3) for i in range(90)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    labels = {i: label for i, _, label in rows}
    sums = Counter()
    for r in found:
        sums[labels[r["vec_id"]]] += r["error"]
    assert len(found) == 90
    assert all(r["label_error"] == sums[labels[r["vec_id"]]] for r in found)


def brute_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(docs):
    n = brute_words(docs)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] and max(n[v] for v in near[w]) >= 2 * n[w] else None for w in n}
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_spelling_groups_equal_brute_force(spark):
    rng = random.Random(3)
    letters = "abéÿ×"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(150)]
    words += [w[:i] + w[i + 1 :] for w in words for i in (0, len(w) // 2)]
    docs = [(i if i % 9 else None, rng.choice(" \n.-5").join(rng.choice(words[: 1 + int(len(words) * rng.random() ** 3)]) for _ in range(120))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.spelling_groups(df).collect()}
    assert found == brute_groups(docs)


def test_roots_end_chains_of_forms(spark):
    chain = ["abcdefghijk"[: 5 + i] for i in range(7)]
    docs = [(7, " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2 ** (6 - i))))]
    n = brute_words(docs)
    found = {tuple(r) for r in spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == brute_groups(docs)
    assert {r[2] for r in found} == {"abcde"} and len(n) == 7


def test_one_word_may_be_a_third_of_all(spark):
    docs = [(i, "xylophone " * 50 + f"xylophon{'aeiouy'[i % 6]} " * 3 + "other words arrive here now") for i in range(60)]
    found = {r["word"]: r for r in spelling.spelling_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.values()} == brute_groups(docs)


def test_spelling_of_awkward_rows(spark):
    docs = [(None, None), (1, ""), (2, "1234 -- \x00"), (3, "word " * 5000 + "Hello hello HELLO Ünder ünder"), (3, "abcde" * 4000), (4, "abc d e")]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    found = {tuple(r) for r in spelling.spelling_groups(df).collect()}
    assert found == brute_groups(docs)
    assert spelling.spelling_groups(df.limit(0)).count() == 0


def hilbert_point(index, bits, n):
    """The cell at a place of the curve, by the recursive construction."""
    x = [sum((index >> (b * n + n - 1 - i) & 1) << b for b in range(bits)) for i in range(n)]
    t = x[n - 1] >> 1
    for i in range(n - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = 2
    while q < 1 << bits:
        for i in range(n - 1, -1, -1):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q <<= 1
    return x


@pytest.mark.parametrize(("bits", "n"), [(1, 2), (4, 2), (3, 3), (2, 4), (8, 1)])
def test_curve_visits_every_cell_by_single_steps(bits, n):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * n)).reshape(n, -1).T
    places = sharding.hilbert(cells, bits)
    assert sorted(places.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(places)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    assert all(hilbert_point(i, bits, n) == c for i, c in enumerate(path.tolist()))


DOCS = "doc_id long, text string, lang string, source string, shard string, size string, _id int"


def some_docs(n, seed=1):
    rng = random.Random(seed)
    return [(i, "é" * rng.randint(0, 3) + "word " * int(rng.paretovariate(1.0)), rng.choice(["en", "de", None]), f"s{0 if rng.random() < 0.35 else rng.randint(1, 9)}", "x", "y", 1) for i in range(n)]


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_hold_their_law_and_follow_the_curve(spark, law):
    docs = some_docs(700)
    rows = sharding.sharded(spark.createDataFrame(docs, DOCS).repartition(5), law=law).collect()
    texts = {d[0]: (d[1] or "").encode() for d in docs}
    assert sorted(r["doc_id"] for r in rows) == list(range(700))
    assert all(r["size"] == len(texts[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]]) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(16))
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in by.values())
    if law == "rows":
        assert {len(own) for own in by.values()} <= {700 // 16, 700 // 16 + 1}
    else:
        total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        assert all(abs(sum(r["size"] for r in by[s]) - total / 16) <= largest for s in range(16))
    ordered = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["curve"], r["text_crc32"], r["doc_id"]) for r in ordered]
    assert keys == sorted(keys)


def test_shards_let_a_reader_skip_more_than_a_hash_does(spark):
    docs = spark.createDataFrame(some_docs(900, 4), DOCS)
    shards = sharding.sharded(docs)
    skipped = lambda b: sum(not r["min_source"] <= s <= r["max_source"] for r in b for s in (f"s{k}" for k in range(10)))
    by_curve = skipped(sharding.bounds(shards).collect())
    by_hash = skipped(sharding.bounds(shards.withColumn("shard", shards["doc_id"] % 16)).collect())
    assert by_curve > 60 > by_hash


def test_shards_are_written_as_runs(spark, tmp_path):
    docs = spark.createDataFrame(some_docs(300, 7), DOCS)
    sharding.write_shards(docs.drop("shard"), f"{tmp_path}/out", files=24)
    back = spark.read.parquet(f"{tmp_path}/out")
    expected = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs).collect()}
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == expected
    assert sorted(map(str, back.drop("shard").collect())) == sorted(map(str, docs.drop("shard").collect()))


def test_shards_of_awkward_rows(spark):
    docs = [(None, None, None, None, None, None, 1), (1, "", "en", "s", None, None, 1), (1, "same", "en", "s", None, None, 1), (1, "same", "en", "s", None, None, 1), (-5, "日本\x00 " * 9000, "ja", "t", None, None, 1)]
    rows = sharding.sharded(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 5, 5, len(("日本\x00 " * 9000).encode()) + 1]
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, 0) for s in (0, 3, 6, 9, 12)]
    assert sharding.sharded(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError, match="law"):
        sharding.sharded(spark.createDataFrame(docs, DOCS), law="other")
