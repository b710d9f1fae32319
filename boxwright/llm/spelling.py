"""Spelling variant grouping: words one edit apart, found by an even-partition pigeonhole join.

A word of length l is cut into two even segments, whose lengths depend on l alone. One edit leaves one of them whole: a
word of the same length shares the first or the last segment in place, and one that is longer by one shares the first in
place or the last shifted by one. The words of a segment are many where it is short (all that begin alike), so its list is
dealt once more by the same rule: what is left of the word beside the shared segment is one edit apart too, so one of its
two even halves is whole. A word is thus listed under four keys of its length and asks for four keys of its length and
four of the next shorter one; about three quarters of its letters are fixed by a key, so candidates grow with the words.
Candidates are verified by their edit distance, and pairs found under several keys are one.

Counting, the join and the roots are DataFrame operations. Words are counted in the task before they are shuffled, and a
key's rows are words, not occurrences: a word that makes a third of a corpus is one row. Tables of words are joined by
sorting both: stored they are a few bytes a word, so below Spark's threshold millions of words would still be broadcast,
and the driver would hold them many times as large. Roots are found by pointer doubling, each round a table in the shared folder; a form has at least twice the word's count, so there are no cycles.

Null texts have no words, and a null id is an empty string in the hash. Repeated rows count as often as they occur. Very
long texts are read whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import LOWER, UPPER, crc32_sql, discard, stored, table

#: Fixed values of the task: letters, the shortest word, the least count, one in so many words loses a letter.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, DAMAGED = 5, 3, 97
#: A form occurs so many times as often as its word at least.
RATIO = 2


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: the distinct words of at least so many letters and occurrences."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    run = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGED == 0, damaged).otherwise(F.col("run"))
    return run.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keys(word: str, length: Column) -> Column:
    """The keys under which a word meets words of that length: it has that length itself or one letter more."""
    text = F.col(word)
    head, tail = F.floor(length / 2).cast("int"), length - F.floor(length / 2).cast("int")
    first = lambda s, n: F.substring(s, F.lit(1), n)
    last = lambda s, n: F.substring(s, F.length(s) - n + 1, n)
    keys = []
    for segment, rest, left in ((first(text, head), F.substring(text, head + 1, F.length(text)), tail), (last(text, tail), first(text, F.length(text) - tail), head)):
        half = F.floor(left / 2).cast("int")
        keys += [(segment, first(rest, half)), (segment, last(rest, left - half))]
    return F.array(*[F.xxhash64(length, F.lit(i), a, b) for i, (a, b) in enumerate(keys)])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """a, a_n, b, b_n of the words (word, n; distinct) that one inserted, deleted or replaced code point sets apart, each pair once."""
    size = F.length("word").cast("int")
    index = vocabulary.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys("word", size)).alias("key"))
    asked = F.concat(_keys("word", size), _keys("word", size - 1))
    probe = vocabulary.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(asked).alias("probe"))
    longer = F.length("b") - F.length("a")
    met = index.join(probe.hint("merge"), (F.col("key") == F.col("probe")) & ((longer == 1) | ((longer == 0) & (F.col("a") < F.col("b")))))
    return met.where(F.levenshtein("a", "b", 1) == 1).groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))


def forms(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form (the commonest near word, of equal ones the first, if it is common enough), n_near, form_n."""
    pairs = near_pairs(vocabulary)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    joined = vocabulary.join(best.hint("merge"), "word", "left")
    common = -F.col("best.minus") >= F.col("n") * ratio
    return joined.select("word", "n", F.when(common, F.col("best.near")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, -F.col("best.minus")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """found (word, form: no cycles) as word, root for the words with a form: the last that their forms lead to."""
    now = stored(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("ahead"))
        done = stored(now.join(ahead.hint("merge"), F.col("root") == F.col("at"), "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        discard(now)
        now, any_moved = done.select("word", "root"), done.where("moved").limit(1).count()
        now._stored_at = done._stored_at
        if not any_moved:
            return now


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    vocabulary = stored(words(docs, id_col, text_col, shortest, least), "vocabulary")
    found = stored(forms(vocabulary, ratio), "forms")
    discard(vocabulary)
    return found.join(roots(found).hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


# Single-letter deletions find the pairs.
SQL = r"""
WITH RECURSIVE run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{5,}')) AS w FROM documents) GROUP BY ALL),
bytes AS (SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM run),
hashed AS (SELECT w, n, CRC AS h FROM bytes),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
shorter AS (SELECT DISTINCT less.word, less.n, v.word AS near, v.n AS near_n FROM less JOIN v ON v.word = less.d),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT word, near, near_n FROM shorter UNION SELECT near, word, n FROM shorter),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
form AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * v.n THEN b.top END AS form_n,
  CASE WHEN b.top >= 2 * v.n THEN (SELECT min(near) FROM near x WHERE x.word = v.word AND x.near_n = b.top) END AS form FROM v LEFT JOIN best b ON b.word = v.word),
walk AS (SELECT word, word AS reached, 0 AS steps FROM form UNION ALL SELECT walk.word, form.form, steps + 1 FROM walk JOIN form ON form.word = walk.reached WHERE form.form IS NOT NULL)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM form f JOIN (SELECT word, arg_max(reached, steps) AS root FROM walk GROUP BY word) w ON w.word = f.word
""".replace("CRC", crc32_sql("b"))
