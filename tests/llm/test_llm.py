"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.llm import decontamination, language_id, license_scan, packing, simhash, suffix_dedup, topk, url_filter, warc, wfst

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tag string, fp long, h long"
#: Null id and text, empty and white texts, a very long one, repeated rows, columns with clashing names.
AWKWARD = [(0, None, "en", "s", 1, "t", 1, 1), (1, "", None, None, None, None, None, None), (2, " \n\t ", "en", "s", 3, "t", 1, 1), (3, "the cat sat on the mat " * 3000, "en", "s", 1, "t", 1, 1), (4, "same words here now", "en", "s", 1, "t", 1, 1), (4, "same words here now", "en", "s", 1, "t", 1, 1), (None, "die Katze saß auf der Matte", "de", "s", 1, "t", 1, 1), (5, "\x00\x01 ß é 日本", "de", "s", 1, "t", 1, 1), (6, "12345 --- 678", "de", "s", 1, "t", 1, 1)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# 1


def test_decontamination_finds_planted_and_paraphrased_passages(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    common = [word() for _ in range(40)]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n)]
    items = [prose(rng.randint(15, 60)) for _ in range(60)]
    docs, planted = [], set()
    for d in range(300):
        words = prose(rng.randint(5, 400))
        if d % 3 == 0:
            i = rng.randrange(60)
            own = [w if d % 2 or rng.random() > 0.15 else word() for w in items[i]]
            at = rng.randint(0, len(words))
            words[at:at] = own
            planted.add((d, i))
        docs.append((d, " ".join(words).capitalize() + "."))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()}
    assert found == planted


def test_candidates_reach_the_recall_of_whole_tfidf_cosines(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    passages = next(decontamination.passes(documents, benchmark)).value
    weight = lambda words: {w: n**2 * passages.square[w & (decontamination.DIMENSIONS - 1)] for w, n in Counter(words).items()}
    hits = total = 0
    for text in texts_of(documents).values():
        words = decontamination.word_hashes((text or "").encode())
        found = {(p, s) for p, s, _ in passages.candidates(words)}
        for size, own in passages.by_size.items():
            for start in range(0, max(1, len(words) - size + decontamination.STEP), decontamination.STEP):
                window = Counter(words[start : start + size].tolist())
                norm = sum(weight(window.elements()).values())
                for p in own.tolist():
                    item = Counter(passages.words[p])
                    inner = sum(n * window[w] * passages.square[w & (decontamination.DIMENSIONS - 1)] for w, n in item.items() if w in window)
                    if norm and inner / np.sqrt(norm * sum(weight(item.elements()).values())) >= decontamination.LEAST_COSINE:
                        total += 1
                        hits += (p, start) in found
    assert total and hits >= 0.9 * total


def test_exact_copies_of_every_item_of_a_large_benchmark_are_found(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(800)]
    docs = [(i, " ".join([*rng.choices(vocabulary, k=rng.randrange(30)), text, *rng.choices(vocabulary, k=40)])) for i, text in items]
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(i, i) for i, _ in items}


def test_matches_reach_the_recall_of_an_exhaustive_search(spark):
    """Paraphrases with a quarter of the words replaced, dropped or moved, against every window's longest common subsequence."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    vocabulary = [word() for _ in range(600)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 50))] for _ in range(80)]

    def changed(words):
        out = []
        for w in words:
            x = rng.random()
            out += [] if x < 0.08 else [rng.choice(vocabulary)] if x < 0.2 else [w, rng.choice(vocabulary)] if x < 0.25 else [w]
        return out

    docs = [(d, " ".join([*rng.choices(vocabulary, k=rng.randrange(60)), *changed(rng.choice(items)), *rng.choices(vocabulary, k=rng.randrange(60))])) for d in range(150)]
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    documents = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(documents, benchmark).collect()}
    passages = next(decontamination.passes(documents, benchmark)).value
    truth = set()
    for d, text in docs:
        words = decontamination.word_hashes(text.encode()).tolist()
        for p, size in enumerate(passages.size):
            for start in range(0, len(words), decontamination.STEP):
                window = words[max(0, start - decontamination.STEP) : start + size + decontamination.STEP]
                if passages.check(p, window, set(window)):
                    truth.add((d, passages.ids[p]))
                    break
    assert len(truth) > 100 and found <= truth and len(found) >= 0.9 * len(truth)


def test_a_benchmark_dealt_into_passes_gives_what_one_pass_gives(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(900)]
    items = [(i, "-".join(rng.choices(vocabulary, k=20))) for i in range(40)]
    docs = [(i, " ".join([*rng.choices(vocabulary, k=rng.randrange(30)), text, *rng.choices(vocabulary, k=40)]), "e") for i, text in items] + [(99, " ".join(rng.choices(vocabulary, k=50)), "e")]
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string, extra string"), spark.createDataFrame(items, "item_id long, text string")
    assert benchmark.select(F.sum(decontamination._n_words(F.col("text")))).first()[0] == 800
    monkeypatch.setattr(decontamination, "PASS_WORDS", 300)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(documents, benchmark).collect()} == {(i, i) for i, _ in items}
    kept = decontamination.clean(documents, benchmark)
    assert [r["doc_id"] for r in kept.collect()] == [99] and kept.columns == documents.columns


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(20))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_decontamination_of_awkward_rows(spark, awkward, empty):
    bench = spark.createDataFrame([(0, None), (1, ""), (2, "..."), (3, "the cat sat on the mat the cat sat"), (4, "same words")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(awkward, bench).collect()} == {(3, 3), (4, 4)}
    assert decontamination.clean(awkward, bench).count() == 6 and decontamination.clean(empty, bench).count() == 0
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(awkward, bench.limit(0)).count() == 0


# 2


def test_template_join_is_exact(spark):
    rng = random.Random(3)
    vocabulary = [w for _, t in license_scan.TEMPLATES for w in t.split()] + ["x", "y"]
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, Counter({w: rng.randrange(50) for w in vocabulary}))
    for _ in range(2000):
        base = rng.choice(license_scan.TEMPLATES)[1].split()
        block = {w for w in base if rng.random() < 0.85} | {rng.choice(vocabulary) for _ in range(rng.randrange(12))}
        found = dict(index.matches(sorted(index.rank[w.encode()] for w in block if w.encode() in index.rank)))
        for t, (_, text) in enumerate(license_scan.TEMPLATES):
            own = set(text.split())
            n = len(own & block)
            assert found.get(t) == (n if n >= license_scan.overlap_needed(len(own)) else None)


def test_long_templates_are_met_wherever_they_stand(spark, monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    templates = [("long", " ".join(words[:120])), ("longer", " ".join(words[200:1300])), ("short", " ".join(words[1500:1506]))]
    docs = []
    for d in range(40):
        label, text = templates[d % 3]
        docs.append((d, " ".join([*(rng.choice(words) + "x" for _ in range(rng.randrange(300))), text, *(rng.choice(words) + "y" for _ in range(rng.randrange(300)))]), label))
    rows = spark.createDataFrame(docs, "doc_id long, text string, label string").repartition(3)
    for most in (license_scan.PASS_WORDS, 130):  # in one pass, and in one for each template
        monkeypatch.setattr(license_scan, "PASS_WORDS", most)
        got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(rows, "doc_id", "text", license_scan.PHRASES, templates).collect()}
        assert got == {d: (label, 1.0) for d, _, label in docs}


def test_license_scan_of_awkward_rows(spark, awkward, empty):
    rows = awkward.select("doc_id", "text", "lang").union(spark.createDataFrame([(9, "x CC-BY y. cc by", "en"), (10, "Released under MIT license", "en")], "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(rows, "doc_id", "text", license_scan.PHRASES, license_scan.TEMPLATES).collect()}
    assert (got[9]["n_base"], got[9]["first_word"], got[9]["last_word"], got[9]["base_labels"], got[9]["score"]) == (2, 1, 4, "cc-by", 1.0)
    assert (got[10]["n_base"], got[10]["labels"], got[10]["score"]) == (0, "mit", 0.8)
    assert got[0]["n_words"] == got[1]["n_words"] == got[2]["n_words"] == 0 and got[3]["n_words"] == 18000
    assert license_scan.scan_licenses(empty, "doc_id", "text", license_scan.PHRASES, license_scan.TEMPLATES).count() == 0


# 3


PAGES = "page_id long, url string, html string, sha string, id long"


def test_warc_round_trip(spark):
    big = "ü" * 300_000
    rows = [(1, "http://a", "x", "c", 1), (2, "http://b\r\nX: y", "x", "c", 1), (3, None, None, "c", 1), (4, "u", "", "c", 1), (None, "u", "x", "c", 1), (5, "u", big, "c", 1), (6, "u", big, "c", 1), (7, "u", "lone", None, None), (7, "u", "lone", None, None)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages, "page_id", "url", "html")).collect()), key=repr)
    d = lambda s: warc.base32_sha1(s.encode())
    want = [(0, 1, d("x"), "response", None), (1, 1, d("x"), "response", None), (2, 1, d("x"), "revisit", 1), (3, 0, d(""), "response", None), (4, 0, d(""), "revisit", 3), (5, 600_000, d(big), "response", None), (6, 600_000, d(big), "revisit", 5), (7, 4, d("lone"), "response", None), (7, 4, d("lone"), "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.read_archives(warc.write_archives(pages.limit(0), "page_id", "url", "html")).count() == 0


def test_warc_reader_works_in_pieces_and_verifies():
    members = [warc.record(i, "http://a", bytes([i]) * 70_000 * i, None) for i in range(4)]
    for size in (97, 1 << 16):
        assert [n for _, n, _ in warc.Reader(warc.pieces(b"".join(members), size))] == [0, 70_000, 140_000, 210_000]
    with pytest.raises(warc.WarcError):
        list(warc.Reader([b"".join(members)[:-9]]))
    plain = zlib.decompress(members[1], 31).replace(b"\x01\x01", b"\x01\x02", 1)
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError, match="digest"):
        list(warc.Reader([z.compress(plain) + z.flush()]))


def test_warc_files_are_read_where_they_lie(spark, tmp_path):
    members = [warc.record(i, "http://a", bytes([65 + i]) * 50_000, None) for i in range(5)]
    for k in range(2):
        (tmp_path / f"{k}.warc.gz").write_bytes(b"".join(members[k::2]))
    paths = spark.createDataFrame([(f"file://{tmp_path}/{k}.warc.gz",) for k in range(2)] + [(None,)], "path string")
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archive_files(paths).collect())
    assert got == [(i, 50_000, warc.base32_sha1(bytes([65 + i]) * 50_000)) for i in range(5)]


# 4


def brute_components(fps):
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= simhash.MOST
    label = np.arange(len(a))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(a))])
        if (new == label).all():
            return label
        label = new


def slow_fingerprint(text):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, documents, monkeypatch):
    texts = texts_of(documents)
    ids = sorted(texts)
    fps = [slow_fingerprint(texts[i]) for i in ids]
    label = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    assert got == {i: (f"{f:016x}", ids[k]) for i, f, k in zip(ids, fps, label.tolist(), strict=True)}


def test_links_are_whole_over_split_buckets(spark, monkeypatch):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centres for _ in range(60)} | {rng.getrandbits(64) for _ in range(50)}
    values = sorted(fps)
    label = brute_components(values)
    monkeypatch.setattr(simhash, "CHUNK", 16)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    edges = simhash.linked(spark.createDataFrame(signed, "fp long")).collect()
    parent = {v[0]: v[0] for v in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[root(e["u"])] = root(e["v"])
    groups = {}
    for (v,), k in zip(signed, label.tolist(), strict=True):
        groups.setdefault(k, set()).add(root(v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_chains(spark):
    from boxwright.operators.components import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_simhash_of_awkward_rows(awkward, empty):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect()]
    assert len(got) == len(AWKWARD) and {c for i, f, c in got if i in (0, 1, 2)} == {0} and {f for i, f, _ in got if i == 0} == {"0" * 16}
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({c for _, _, c in got})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("stage", [simhash.keep_one, suffix_dedup.cleaned, language_id.keep_languages, lambda d: decontamination.clean(d, d.selectExpr("doc_id as item_id", "'zzz' as text").limit(1))])
def test_stages_keep_columns_with_clashing_names(spark, stage):
    names = "_tag _doc _spans kept_id kept_tag _kept_id _kept_tag tag fp doc h text_ spans".split()
    rows = [(i, f"some english words of document number {i} and the rest", "en", *range(i, i + len(names))) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    assert sorted(map(tuple, stage(df).collect())) == sorted(rows) and stage(df).columns == df.columns


# 5


def test_topk_of_repeated_ids(spark):
    """Each distinct vector of a query's id is a query, and every row but one copy of itself is a candidate."""
    rng = np.random.default_rng(3)
    vector = lambda: rng.integers(-2, 3, 4).astype(float).tolist()
    rows = [(i, vector()) for i in range(1, 60)] + [(50, vector()) for _ in range(3)] + [(100, [2.0] * 4)] * 3 + [(7, [2.0] * 4)]
    want = []
    for i, q in {(i, tuple(v)) for i, v in rows if i % 50 == 0}:
        others = list(rows)
        others.remove((i, list(q)))
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(q, v, strict=True)), j) for j, v in others)[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


def brute_topk(rows, k):
    good = {i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q % 50 == 0:
            held = lambda x: max(-(2**63), min(2**63 - 1, x))
            scores = sorted((-held(sum(a * b for a, b in zip(good[q], v, strict=True))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e12])
def test_topk(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-2, 3, 6) * scale).tolist()) for i in range(220)]
    rows += [(300, None), (350, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (500, [1.0, 2.0]), (None, [1.0] * 6), (550, []), (551, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(5)
    for block, tile in ((topk.BLOCK_BYTES, topk.TILE_BYTES), (200, topk.TILE_BYTES), (200, 900)):
        got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 50 == 0, block_bytes=block, tile_bytes=tile).collect())
        assert got == brute_topk(rows, 5)
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# 6


def test_encoding_equals_the_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=wfst.model_path())
    machine = wfst.compile_model(wfst.model_path())
    rng = random.Random(6)
    letters = "abcdefgh ABC  éß日本語\n\t.,12'😀▁"
    for text in [t[1] or "" for t in AWKWARD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(500)]:
        assert np.frombuffer(machine.encode(text), "<u4").tolist() == library.encode(text), text


def _varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + _varint(n >> 7)


def _field(number, value):
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def charsmap(rules):
    """A compiled map of rewriting rules: a double-array trie with a block of 256 units for each node, then the replacements."""
    if not rules:
        return b""
    tree, texts, bases = {}, b"", {(): 256}
    for source, new in rules.items():
        key = tuple(source.encode())
        for k in range(len(key) + 1):
            bases.setdefault(key[:k], 256 * (len(bases) + 1))
        tree[key] = len(texts)
        texts += new.encode() + b"\0"
    units = [0] * (256 * (len(bases) + 1))
    units[0] = bases[()] << 10
    for key, base in bases.items():
        if key:
            at = bases[key[:-1]] ^ key[-1]
            units[at] = (at ^ base) << 10 | (key in tree) << 8 | key[-1]
        if key in tree:
            units[base] = tree[key] | 1 << 31
    blob = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(blob)) + blob + texts


def model(pieces, kind, rules=None, dummy=True, squeeze=False, fallback=False):
    every = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    every += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    every += [(p, s, 1) for p, s in pieces]
    body = b"".join(_field(1, _field(1, p.encode()) + _field(2, float(s)) + _field(3, t)) for p, s, t in every)
    trainer = _field(3, kind) + _field(35, int(fallback))
    return body + _field(2, trainer) + _field(3, _field(1, b"own") + _field(2, charsmap(rules)) + _field(3, int(dummy)) + _field(4, int(squeeze)) + _field(5, 1))


@pytest.mark.parametrize("kind", [wfst.UNIGRAM, wfst.BPE])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize(("rules", "squeeze", "dummy"), [(None, False, True), (None, True, False), ({"Ａ": "a", "ﬁ": "bi", "ﬁé": "c", "é": "e", "\t": " ", "x": ""}, True, True)])
def test_models_of_all_kinds_equal_the_library(kind, fallback, rules, squeeze, dummy):
    import sentencepiece

    rng = random.Random(f"{kind}{fallback}{squeeze}")
    for ordered in (True, False):
        if kind == wfst.BPE and ordered:  # a real merge list: every piece is made of two earlier ones
            names = ["▁", *"abcde"]
            while len(names) < 60:
                new = rng.choice(names) + rng.choice(names)
                if new not in names and "▁" not in new[1:] and len(new) < 9:
                    names.append(new)
            pieces = [(p, -1.0 * i) for i, p in enumerate(names)]
        else:
            names = {"▁", *"abcde"} | {"".join([rng.choice(["▁", ""]), *(rng.choice("abcde") for _ in range(rng.randint(2, 5)))]) for _ in range(60)}
            scores = rng.sample(range(1000), len(names))
            pieces = [(p, -s / 100) for p, s in zip(sorted(names), scores, strict=True)]
        data = model(pieces, kind, rules, dummy, squeeze, fallback)
        library, machine = sentencepiece.SentencePieceProcessor(model_proto=data), wfst.compile_bytes(data)
        texts = ["", " ", "  a  b ", "aaaaaaaaaaaaaaaa"] + ["".join(rng.choice("aabbccddee   zéＡﬁx\t日") for _ in range(rng.randrange(40))) for _ in range(300)]
        got = [np.frombuffer(p, "<u4").tolist() for p in machine.encode_all(texts)]
        other = 0
        for text, own in zip(texts, got, strict=True):
            theirs = library.encode(text)
            if own != theirs:  # paths of equal weight: the same pieces in another order, up to rounding
                assert kind == wfst.UNIGRAM and library.decode(own) == library.decode(theirs), (text, ordered)
                assert machine.weight[own].sum() == pytest.approx(machine.weight[theirs].sum(), abs=1e-3)
                other += 1
        assert other < 0.2 * len(texts)


def test_paths_are_the_lightest_of_all():
    """Against an enumeration of all segmentations."""
    rng = random.Random(13)
    names = {"▁", *"abc"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(25)}
    score = {p: round(-rng.random() * 10, 3) for p in names}
    machine = wfst.compile_bytes(model(sorted(score.items()), wfst.UNIGRAM))
    name = [p for p, _, _ in machine.pieces]

    def every(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if text[:k] in score:
                yield from ([text[:k], *rest] for rest in every(text[k:]))

    for _ in range(40):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 10)))
        found = [name[i] for i in np.frombuffer(machine.encode(text), "<u4").tolist()]
        assert "".join(found) == "▁" + text
        assert sum(map(score.get, found)) == pytest.approx(max(sum(map(score.get, p)) for p in every("▁" + text)), abs=1e-4)


def test_encode_documents(spark, documents, awkward, empty):
    got = wfst.encode_documents(documents, wfst.model_path(), with_ids=True).collect()
    assert len(got) == documents.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)
    rows = {r["doc_id"]: r for r in wfst.encode_documents(awkward, wfst.model_path()).collect()}
    assert rows[0]["n_tokens"] == rows[1]["n_tokens"] == 0 and rows[5]["n_fallback"] > 0 and all(r["round_trip"] for r in rows.values())
    assert wfst.encode_documents(empty, wfst.model_path()).count() == 0


def test_query_and_last_stage_return_the_ids_of_every_document(spark, documents, awkward, empty):
    import corpus_pipeline

    whole = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for encoded in (wfst.op6_sentencepiece(spark, "/root/testdata/sf0.001"), corpus_pipeline.token_ids(spark, documents, "")):
        assert texts_of(wfst.decode_documents(encoded, wfst.model_path())) == whole
        assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in encoded.collect())
    again = wfst.decode_documents(wfst.encode_documents(awkward, wfst.model_path(), with_ids=True), wfst.model_path())
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in again.collect()) == sorted((t[0] is None, t[0], t[1] or "") for t in AWKWARD)
    assert wfst.decode_documents(wfst.encode_documents(empty, wfst.model_path(), with_ids=True), wfst.model_path()).count() == 0


# 7


def test_language_id_is_right_on_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)


def test_language_id_of_awkward_rows(spark, awkward, empty):
    more = spark.createDataFrame([(i, t, lang, "s", 1, "t", 1, 1) for i in range(20, 40, 2) for i, t, lang in ((i, "the dog and the cat were here", "en"), (i + 1, "der Hund und die Katze waren hier", "de"))], DOCS)
    got = {r["doc_id"]: r for r in language_id.identify(awkward.union(more)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2, 6)) and got[3]["lang_pred"] == "en"
    assert language_id.keep_languages(awkward.union(more)).count() == 25 and language_id.keep_languages(empty).count() == 0
    german = language_id.keep_languages(awkward.union(more), frozenset({"de"})).collect()
    assert all(r["lang"] == "de" for r in german) and {r["doc_id"] for r in german} >= {21, 23, 39}
    assert language_id.identify(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(awkward.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_languages_of_any_code_are_kept(spark):
    rng = random.Random(8)
    alphabet = {"ja": "あいうえおかきくけこ", "ko": "가나다라마바사아자차", "eng": "abcdefghij"}
    docs = [(i, " ".join("".join(rng.choice(alphabet[c]) for _ in range(4)) for _ in range(30)), c) for i, c in enumerate(["ja", "ko", "eng"] * 20)]
    df = spark.createDataFrame([*docs, (100, "123", "ja"), (101, None, "ko")], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language_id.keep_languages(df).collect()) == list(range(60))
    assert {r["lang"] for r in language_id.keep_languages(df, frozenset({"ko"})).collect()} == {"ko"}


def test_documents_without_labels_keep_their_place(awkward):
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] or 0 for r in language_id.keep_languages(unlabelled).collect()) == [0, 3, 4, 4, 5]


def test_machines_meet_the_exact_optimum():
    """The squared hinge loss is smooth and convex: Newton steps on the active rows find its only minimum."""
    rng = np.random.default_rng(8)
    for n, d in ((40, 6), (200, 20)):
        x = rng.standard_normal((n, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = np.where(x[:, 0] + 0.3 * rng.standard_normal(n) > 0.1, 1.0, -1.0)
        a = np.hstack([x, np.ones((n, 1))])
        c = 20 * np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        w = np.zeros(d + 1)
        for _ in range(100):
            act = y * (a @ w) < 1
            w = np.linalg.solve(np.eye(d + 1) + 2 * (a[act].T * c[act]) @ a[act], 2 * a[act].T @ (c[act] * y[act]))
        assert np.abs(language_id.fit_svm(x, y) - w).max() < 1e-3 * np.abs(w).max()


def test_votes_equal_a_count_by_hand():
    rng = np.random.default_rng(9)
    x, labels = rng.standard_normal((60, 5)), np.array(list("abc") * 20, object)
    votes = language_id.Votes(["a", "b", "c"], x, labels)
    for row in x:
        won = Counter({name: 0 for name in "abc"})
        margin = Counter()
        for (a, b), w in zip(votes.pairs, votes.weights, strict=True):
            m = float(row @ w[:-1] + w[-1])
            won["abc"[a] if m >= 0 else "abc"[b]] += 1
            margin["abc"[a]] += m
            margin["abc"[b]] -= m
        assert votes.best(row)[0] == min("abc", key=lambda v: (-won[v], -margin[v], v))


def test_labels_learned_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(i, t, lang) for i in range(60) for t, lang in [(("the dog and the cat", "en"), ("der Hund und die Katze", "de"), (f"zq{i} xv", f"dirty{i}"))[i % 3]]]
    got = {r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {"en", "de"}


# 8


def test_rows_of_one_id_are_dealt_over_tasks(spark):
    import public_tokenizers

    rows = spark.range(4000).selectExpr("cast(null as long) as doc_id", "if(id % 3 = 0, 'same text', concat('word ', id)) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ones would be joined
    try:
        shards = packing.write_shards(rows, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert shards.select("part").distinct().count() == 4 and shards.selectExpr("max(n_ids) < 2 * min(n_ids) as even").first()["even"]
    assert packing.read_documents(shards).count() == 4000


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    lengths = [0, 5, 0, 300, 1]
    ids = rng.integers(0, 2**bits, sum(lengths), dtype=np.uint64).astype("<u4")
    shard = packing.Shard(packing.write_shard([None, 3, 4, 4, 9], lengths, ids, bits, block=64))
    starts = np.cumsum([0, *lengths])
    assert shard.doc_ids == [None, 3, 4, 4, 9] and all((shard.document(i) == ids[starts[i] : starts[i + 1]]).all() for i in range(5))
    assert (shard.ids(60, 70) == ids[60:70]).all()
    assert [x.tolist() for x in shard.documents()] == [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def test_packed_documents(spark, documents, awkward, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    odd = [(1000 + i, t, None, None, None) for i, t in enumerate(["don't it's", "  two  spaces ", "<|endoftext|> a <|endoftext|>", "a.\nB, c\n\nd", "x\x1c y\x1cz", "word!? (y) 'c d'", "é\u00a0b c\u2003d"])]
    rows = documents.union(spark.createDataFrame(odd, documents.schema))
    texts, start, want = texts_of(rows), 0, []
    for i in sorted(texts):
        ids = [*model.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = packing.read_documents(packing.write_shards(rows, "doc_id", "text", path, 2)).drop("bits").collect()
    assert sorted(map(tuple, got)) == want
    got = packing.read_documents(packing.write_shards(awkward, "doc_id", "text", path, 2)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 4, 4, 5, 6] and got[1]["n_tokens"] == 1
    assert packing.read_documents(packing.write_shards(empty, "doc_id", "text", path, 2)).count() == 0


# 9


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), len(t) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "batch"), [(1024, 32768), (3, 32768), (0, 32768), (1024, 40)])
def test_suffix_dedup(spark, monkeypatch, group, batch):
    rng = random.Random(9)
    prose = lambda n, letters="abcdefgh": "".join(rng.choice(letters) for _ in range(n))
    shared = [prose(k) for k in (150, 199, 200, 201, 230, 400, 1000)]
    texts = ["".join(rng.choice([prose(rng.randint(0, 200)), rng.choice(shared)[rng.randint(0, 40) :]]) for _ in range(4)) for _ in range(150)]
    texts += ["", "a" * 1000, "ab" * 400, "x" * 199, "y" * 200, "z" * 201, texts[0], texts[1], prose(3000, "a\x00b"), None, "\x00" * 500, "é" * 150]
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    if batch != suffix_dedup.BATCH:
        monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = sorted(suffix_dedup.remove_repeats(rows).collect())
    assert [tuple(r)[1:] for r in got] == brute_removed([(t or "").encode() for t in texts], suffix_dedup.LENGTH)


def test_texts_without_id_are_told_apart(spark):
    text = F.concat(*[F.sha2(F.concat(F.lit(f"{k} "), F.col("id")), 512) for k in range(3)])
    pair = spark.range(300_000).select(text.alias("text")).groupBy(F.hash("text")).agg(F.collect_list("text").alias("t")).where("size(t) > 1").first()["t"][:2]
    other = hashlib.sha512(b"other").hexdigest() + pair[0][100:350]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame([(None, pair[0]), (None, pair[1]), (1, other)], "doc_id long, text string")).collect()
    want = brute_removed([t.encode() for t in (*pair, other)], suffix_dedup.LENGTH)
    assert sorted(r["kept_sha256"] for r in rows) == sorted(w[3] for w in want)


def test_suffix_dedup_of_awkward_rows(spark, awkward, empty):
    got = suffix_dedup.remove_repeats(awkward).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got) == sorted((len((t[1] or "").encode()), len((t[1] or "").encode()) if t[0] == 3 else 0) for t in AWKWARD)
    assert suffix_dedup.cleaned(awkward).columns == awkward.columns and suffix_dedup.cleaned(awkward).count() == len(AWKWARD)
    assert suffix_dedup.remove_repeats(empty).count() == 0 and suffix_dedup.cleaned(empty).count() == 0


# 10


def brute_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/x?y#z", "http://www.example.com/en/", "https://a.b.net/fr/1", "x://net/es/", "x://net", "x://..com//", "x://com/", "http://a://b.com/", "http://Ünï.com/é\n/x", "http://m.example.com/enx", "http://example.com/en", "http://" + "a." * 500 + "net/fr/"]


def test_url_filter(spark):
    rows = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string, key string").repartition(3)
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(rows, rules, "page_id", "url").collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(URLS)}
    assert url_filter.judge_urls(rows.limit(0), rules, "page_id", "url").count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(rows, rules.limit(0), "page_id", "url").collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FIRST", (2, 1))
    monkeypatch.setattr(url_filter, "LATER", (3, 2))
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    cascade = url_filter.build_cascade(universe.where("crc32(key) % 7 = 0"), universe)
    assert len(cascade.levels) > 2
    assert universe.where(f"({cascade.contains('key')}) <> (crc32(key) % 7 = 0)").count() == 0


def test_a_list_dealt_into_parts_gives_what_one_cascade_gives(spark):
    urls = [*URLS, None, "http://www.example.com/en/2", "http://www.example.com/en/2"]
    rows = spark.createDataFrame([(None if i == 3 else i % 17, u, None) for i, u in enumerate(urls)], "page_id long, url string, best string").repartition(2)
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    got = sorted(map(str, url_filter.judge_urls(rows, rules, "page_id", "url", max_bits=50).collect()))
    assert got == sorted(map(str, url_filter.judge_urls(rows, rules, "page_id", "url").collect())) and len(got) == len(urls)


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.llm.test_near_copies import brute_roots

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    now = documents.union(spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, "", "en", "s", 0)], documents.schema))
    benchmark = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = texts_of(now)
        now = stage(spark, now, sf)
        assert now.columns == documents.columns
        after = texts_of(now)
        if name == "language":
            assert set(after) == set(texts_of(documents))
        elif name == "near_duplicates":
            ids = sorted(before)
            assert set(after) == {ids[k] for k in brute_roots([(i, before[i]) for i in ids])[0]}
        elif name == "repeated_strings":
            ids = sorted(before)
            want = brute_removed([before[i].encode() for i in ids], suffix_dedup.LENGTH)
            assert {i: hashlib.sha256(after[i].encode()).hexdigest() for i in ids if after[i].isascii()} == {i: w[3] for i, w in zip(ids, want, strict=True) if after[i].isascii()}
        else:
            words = lambda t: " ".join(w.decode() for w in license_scan.words_of(t.encode()))
            assert set(before) - set(after) >= {i for i, t in before.items() if any(words(b) in words(t) for b in benchmark)} and len(after) > 0.8 * len(before)
    assert corpus_pipeline.STAGES[-1][1](spark, now, sf).count() == now.count()
