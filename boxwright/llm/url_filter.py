"""URL filter by a Bloom filter cascade (DataFrame functions only).

Listed keys are hosts with a path prefix. A url's candidate keys are every suffix of its host's labels with every
prefix of its path that is as long as some listed path; the candidate keys of all urls are the key universe. Level 1
of the cascade encodes the listed keys, level 2 those other keys of the universe that level 1 lets pass, level 3 the
listed keys that level 2 lets pass, and so on until none are left. Within the universe membership is then exact, and
a url is judged by bit tests alone, without a join.

A null url or one without "://" has an empty host and path, fits no rule and gets the default verdict; so does a host
without a listed suffix. Repeated rows are judged one by one. An empty list gives every url the default verdict. A key
that is on both lists is blocked. Very long urls have as many candidate keys as labels. Null and repeated ids are passed
through. Columns of the input other than id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import LOWER, UPPER, stored, table

#: Fixed by the query's contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Bits a key and hash functions, of the first level (false positives of about 4e-5 of the universe) and of the others.
FIRST, LATER = (24, 8), (10, 6)
#: A cascade is part of the plan; a list whose first level would need more bits is split by a hash of the key.
MAX_BITS = 1 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: str, path: str, lengths: list[int]) -> Column:
    """Suffixes of the host's labels, each with the path's prefixes of the given lengths. host, path: names of columns."""
    prefixes = ", ".join(f"if(length({path}) >= {n}, substring({path}, 1, {n}), null)" for n in lengths)
    return F.expr(f"""if({host} = '', cast(array() as array<string>), flatten(transform(sequence(1, size(split({host}, '[.]'))), i ->
        transform(filter(array({prefixes}), p -> p is not null), p -> concat(substring_index({host}, '.', i - 1 - size(split({host}, '[.]'))), p)))))""")


def _place(key: str, level: int, bits: int, i: str) -> str:
    a, b = (f"pmod(xxhash64({key}, {2 * level + j}), {bits}L)" for j in (0, 1))
    return f"pmod({a} + {i} * {b}, {bits}L)"


def part_of(key: str, parts: int) -> str:
    """Which of the parts a key belongs to."""
    return f"pmod(xxhash64({key}, -1), {parts}L)"


class Cascade:
    """Levels (bits, hashes, words): words is a level's bit array as 64-bit integers. Tests are SQL over a column or lambda variable."""

    def __init__(self, levels: list[tuple[int, int, list[int]]]):
        self.levels = levels

    def passes(self, key: str, level: int) -> str:
        bits, hashes, words = self.levels[level]
        array = "array(" + ", ".join(f"{w}L" if w > -(2**63) else "-9223372036854775807L - 1L" for w in words) + ")"  # folded to one literal
        places = (_place(key, level, bits, f"{i}L") for i in range(hashes))
        return "(" + " and ".join(f"getbit(get({array}, cast(shiftright({p}, 6) as int)), cast({p} & 63 as int)) = 1" for p in places) + ")"

    def contains(self, key: str) -> str:
        """Exact for keys of the universe: levels encode listed keys and false positives in turn."""
        found = "true" if len(self.levels) % 2 else "false"
        for level in reversed(range(len(self.levels))):
            found = f"if({self.passes(key, level)}, {found}, {'true' if level % 2 else 'false'})"
        return found


def _bit_array(keys: DataFrame, level: int, bits: int, hashes: int) -> list[int]:
    words = [0] * ((bits + 63) // 64)
    ones = keys.selectExpr(f"explode(transform(sequence(0L, {hashes - 1}L), i -> {_place('key', level, bits, 'i')})) as p").selectExpr("shiftright(p, 6) as word", "shiftleft(1L, cast(p & 63 as int)) as one")
    for row in ones.groupBy("word").agg(F.bit_or("one").alias("value")).collect():  # at most bits / 64 rows, bits checked before
        words[row["word"]] = row["value"]
    return words


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """listed, universe: a column key each. One pass over the universe; later levels see only what level 1 let pass."""
    members = stored(listed.select("key").where("key is not null").distinct(), "listed")
    cascade, inside, outside = Cascade([]), members, None
    while True:
        level = len(cascade.levels)
        keys = inside if level % 2 == 0 else outside
        n = keys.count()
        if n == 0:
            return cascade
        per_key, hashes = FIRST if level == 0 else LATER
        bits = max(64, n * per_key)
        cascade.levels.append((bits, hashes, _bit_array(keys, level, bits, hashes)))
        passes = F.expr(cascade.passes("key", level))
        if level == 0:  # the members that occur in the universe are taken out of the few keys that pass
            outside = stored(universe.select("key").where(passes).distinct().join(members, "key", "left_anti"), "passed")
        elif level % 2:
            inside = inside.where(passes)
        else:
            outside = outside.where(passes)


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str = "allow", max_bits: int = MAX_BITS) -> DataFrame:
    """id, host, path, rule (the longest listed key that fits, else null), verdict. rules: verdict, host, path.

    Lists of over max_bits are dealt into parts by a hash of the key, each with cascades and a pass of its own over the
    candidate keys, so neither the plan nor the driver holds more than a part's bits at a time.
    """
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").where("host is not null and path is not null and host <> ''")
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]  # a few: lengths of listed paths
    host, path = url_parts(F.col(url_col))
    parsed = urls.select(F.col(id_col), host.alias("host"), path.alias("path"))
    if not lengths:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    listed = rules.select("verdict", F.concat("host", "path").alias("key"))
    parts = -(-listed.count() * FIRST[0] // max_bits)
    keys = parsed.withColumn("keys", candidate_keys("host", "path", lengths))
    universe = keys.select(F.explode("keys").alias("key"))
    # the longest key that fits so far, and whether it is blocked
    best = keys.withColumn("best", F.lit(None).cast("struct<n: int, key: string, blocked: boolean>"))
    for p in range(parts):
        own = (lambda df: df.where(f"{part_of('key', parts)} = {p}")) if parts > 1 else (lambda df: df)  # noqa: B023
        allow, block = (build_cascade(own(listed.where(F.col("verdict") == v).select("key")), own(universe)) for v in ("allow", "block"))
        mine = f"{part_of('k', parts)} = {p} and " if parts > 1 else ""
        fits = f"transform(filter(keys, k -> {mine}({allow.contains('k')} or {block.contains('k')})), k -> struct(length(k) as n, k as key))"
        longest = best.withColumn("found", F.expr(f"array_max({fits})"))
        blocked = F.expr(block.contains("found.key"))
        found = F.when(F.col("found").isNotNull(), F.struct("found.n", "found.key", blocked.alias("blocked")))
        best = longest.withColumn("best", F.greatest("best", found)).drop("found")
        if p < parts - 1:
            best = stored(best, "judged")
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocked"), "block").otherwise("allow")
    return best.select(id_col, "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, "page_id", "url")


SQL = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fitting AS (SELECT p.page_id, r.verdict, r.host || r.path AS rule, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC) AS n
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parsed p LEFT JOIN fitting f ON p.page_id = f.page_id AND f.n = 1
"""
