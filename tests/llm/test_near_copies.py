"""Near copies against brute force: op4's links and five-word sets of a similarity of 0.8 or more."""

import random

import numpy as np

from boxwright.llm import near_copies, simhash

DOCUMENTS = "doc_id long, text string, lang string"


def five_words(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(rows, five=True):
    """The smallest place that each row reaches by op4's links and, if five, by similar sets."""
    fps = np.array([simhash.fingerprint((t or "").encode()) for _, t, *_ in rows], np.uint64)
    sets = [five_words(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    similar = 0
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= simhash.MOST) + i + 1:
            parent[max(root(i), root(j))] = min(root(i), root(j))
    for i in range(len(rows) * five):
        for j in range(i + 1, len(rows)):
            a, b = sets[i], sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                similar += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))], similar


def planted(seed, texts=40, copies=5):
    """Texts and copies with 0 to 4 % of the words replaced; half of the texts share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    passage = [word() for _ in range(120)]
    rows = []
    for k in range(texts):
        words = [word() for _ in range(rng.randint(40, 400))]
        words += passage * (k % 2)
        rows.append(words)
        for _ in range(copies):
            rows.append([word() if rng.random() < 0.04 * rng.random() else w for w in words])
    rng.shuffle(rows)
    return [(i, " ".join(w), "en") for i, w in enumerate(rows)]


def test_similar_texts_are_linked(spark):
    rows = planted(7)
    roots, similar = brute_roots(rows)
    before = len(set(brute_roots(rows, five=False)[0]))
    got = {r["doc_id"] for r in near_copies.keep_one(spark.createDataFrame(rows, DOCUMENTS).repartition(4)).collect()}
    print(f"{similar} similar pairs, {before} components by op4's links, {len(set(roots))} by both, {len(got)} kept")
    assert got == set(roots) and len(set(roots)) < 0.7 * before and similar > 150


def test_components_are_those_of_brute_force(spark):
    """Recall of whole links: pairs of similar texts that are in one component, at least 0.99 of them; and no component goes beyond brute force's."""
    rows = planted(8, texts=30, copies=8)
    roots, _ = brute_roots(rows)
    got = {r["doc_id"]: r["root"] for r in near_copies.rooted(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    pairs = {(i, j) for i in range(len(rows)) for j in range(i) if roots[i] == roots[j]}
    mine = {(i, j) for i in range(len(rows)) for j in range(i) if got[i] == got[j]}
    assert mine <= pairs and len(mine) >= 0.99 * len(pairs)


def test_awkward_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [None, "", " \t ", "one", "one", "ONE", "one two three", "one two three four five", "one two three four five six", long, long + " end", "é ÿ \U0001f600 x y z", "é ÿ \U0001f600 x y z"]
    rows = [(None if i == 5 else i % 11, t, None) for i, t in enumerate(texts)]
    roots, _ = brute_roots(rows)
    df = spark.createDataFrame(rows, DOCUMENTS)
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(roots))
    assert near_copies.keep_one(df.where("false")).count() == 0


def test_clashing_names(spark):
    names = "tag fp size coarse keys key root u v _tag low high other".split()
    rows = [(i, f"some english words of document number {i} and the rest", *range(i, i + len(names))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert sorted(map(tuple, near_copies.keep_one(df).collect())) == sorted(rows)


def test_a_large_group_is_compared_a_few_times_a_row(spark):
    """Texts that share most of their words but for op4's links: candidates grow with the rows."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(f"x{i}" if rng.random() < 0.015 else w for w in base), "en") for i in range(300)]
    sketched = near_copies.sketches(spark.createDataFrame(rows, DOCUMENTS), "doc_id", "text")
    pairs = near_copies.candidates(sketched.selectExpr("tag", "doc_id as root", "size", "coarse", "keys")).count()
    assert pairs <= near_copies.PARTNERS * near_copies.BANDS * len(rows)
    # most pairs lie just under the similarity, so that a text has few partners in a bucket of many
    roots = brute_roots(rows)[0]
    got = {r["doc_id"]: r["root"] for r in near_copies.rooted(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if roots[i] == roots[j]]
    found = sum(got[i] == got[j] for i, j in linked)
    print(f"{found} of {len(linked)} connected pairs, {len(set(got.values()))} components of {len(set(roots))}")
    assert found >= 0.95 * len(linked)
    assert all(roots[i] == roots[j] for i in range(len(rows)) for j in range(i) if got[i] == got[j])


def test_what_the_likely_pairs_leave_is_compared_too(spark, monkeypatch):
    """One partner and one try: every pair that meets in a bucket is still compared, in tiles of a few texts."""
    for name, value in (("PARTNERS", 1), ("TRIES", 1), ("CHUNK", 16)):
        monkeypatch.setattr(near_copies, name, value)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(f"x{i}" if rng.random() < 0.018 else w for w in base), "en") for i in range(150)]
    roots = brute_roots(rows)[0]
    got = {r["doc_id"]: r["root"] for r in near_copies.rooted(spark.createDataFrame(rows, DOCUMENTS)).collect()}
    keys = [set(near_copies.band_keys(near_copies.shingle_set(t.encode()))) for _, t, _ in rows]
    sets = [five_words(t) for _, t, _ in rows]
    met = [(i, j) for i in range(len(rows)) for j in range(i) if keys[i] & keys[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(met) > 50 and all(got[i] == got[j] for i, j in met)
    assert all(roots[i] == roots[j] for i in range(len(rows)) for j in range(i) if got[i] == got[j])


def test_bitmaps_leave_out_no_similar_pair():
    """Sets of 1 to 3000 shingles, also where one bitmap is twice as long as the other, and of the longest bitmaps."""
    rng = np.random.default_rng(5)
    sets = []
    for n in (1, 2, 5, 9, 60, 120, 128, 129, 140, 250, 256, 270, 500, 3000, 12_000):
        base = rng.integers(0, 1 << 63, n, np.uint64)
        for change in (0, 0.02, 0.05, 0.1, 0.11, 0.12, 0.2):
            k = int(change * n)
            sets += [np.unique(np.r_[base[k:], rng.integers(0, 1 << 63, k // 2, np.uint64)]), np.unique(np.r_[base, rng.integers(0, 1 << 63, 2 * k, np.uint64)])]
    size, bits = np.array([len(s) for s in sets]), [near_copies.bitmap(s) for s in sets]
    i, j = near_copies.near_pairs(size, bits, np.arange(len(sets)))
    got = {(min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) for both in [len(np.intersect1d(sets[a], sets[b]))] if 5 * both >= 4 * (size[a] + size[b] - both)}
    assert similar <= got and len(got) == len(i) and len({len(b) for b in bits}) > 5 and len(got) < 1.6 * len(similar)
    side = np.arange(len(sets)) % 2
    i, j = near_copies.near_pairs(size, bits, np.arange(len(sets)), side)
    assert {(min(x), max(x)) for x in zip(i.tolist(), j.tolist(), strict=True)} == {(a, b) for a, b in got if side[a] != side[b]}


def test_the_rest_of_a_large_group_is_no_square(spark, monkeypatch):
    """Texts that meet in the buckets without being similar: nearly all of their pairs are left out before their sets are compared, in one tile and in many."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(300)]
    rows = [(i, " ".join(f"x{i}_{k}" if rng.random() < 0.04 else w for k, w in enumerate(base)), "en") for i in range(200)]
    texts = near_copies.sketches(spark.createDataFrame(rows, DOCUMENTS), "doc_id", "text").selectExpr("tag", "doc_id as root", "size", "keys", "bits").cache()
    keys = [set(near_copies.band_keys(near_copies.shingle_set(t.encode()))) for _, t, _ in rows]
    sets = [five_words(t) for _, t, _ in rows]
    met = [(i, j) for i in range(len(rows)) for j in range(i) if keys[i] & keys[j]]
    similar = {(j, i) for i, j in met if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    for chunk in (512, 16):
        monkeypatch.setattr(near_copies, "CHUNK", chunk)
        got = [(min(r["root_u"], r["root_v"]), max(r["root_u"], r["root_v"])) for r in near_copies.rest(texts, spark.createDataFrame([], "u long, v long")).collect()]
        print(f"{len(met)} pairs meet, {len(similar)} are similar, {len(got)} are left")
        assert len(met) > 3000 and similar <= set(got) and len(got) == len(set(got)) and len(got) < 0.05 * len(met)
