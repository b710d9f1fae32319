"""Joins of tables that grow with the words are sorted on both sides, however small they are when stored."""

from boxwright.llm import spelling


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_words_are_not_broadcast(spark):
    rows = [(i, w) for i, w in enumerate(["window", "window", "windows", "windoww"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = spelling.stored(spelling.words(docs, least=1), "vocabulary")  # a few bytes: far below any threshold
    for made in (spelling.near_pairs(vocabulary), spelling.forms(vocabulary), spelling.spelling_groups(docs, least=1)):
        assert "Broadcast" not in _plan(made)
    found = {r.word: r.root for r in spelling.spelling_groups(docs, least=1).collect()}
    assert found["windows"] == "window" and found["windoww"] == "window"
