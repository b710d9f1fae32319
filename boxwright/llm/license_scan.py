"""License scan: places of fixed phrases, and an exact set-similarity join of text blocks with license templates.

Words are runs of bytes that are neither ASCII punctuation, white space nor control characters, after lower-casing A-Z.
A block is a window of words, one every half window. Its length goes with the template: BLOCK_WORDS, doubled until half a
window is as long as the template, so every copy of a template lies whole in some block of its size. A block meets a
template if it holds at least THRESHOLD of the template's distinct words. The join finds every such pair: tokens are
ordered by their frequency over the whole corpus (rarest first), a template is looked up by its prefix alone, and the
length and positional filters discard pairs that cannot reach the overlap before it is counted. Templates of over
PASS_WORDS distinct words in all are dealt into parts, with a pass over the documents for each; documents are never
shuffled.

A null text is empty: no words, no places, score 0. Very long texts are scanned whole, block by block. Repeated rows are
scanned one by one; an empty table gives no rows. A template without a word is met by nothing. Other columns of the input
are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import LOWER, UPPER, map_batches, table, utf8

#: Fixed by the query's contract: phrase, label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Notices and first sentences of common licenses: label, text.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
]

#: Words of the shortest blocks.
BLOCK_WORDS = 64
#: In tenths: containment of at least 0.8.
THRESHOLD = 8
#: Distinct words of the templates of a pass.
PASS_WORDS = 100_000

_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_SPACES = bytes(b if b in _KEEP else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPACES).split()


def overlap_needed(size: int) -> int:
    return (THRESHOLD * size + 9) // 10


def count_tokens(texts: DataFrame, vocabulary: frozenset[bytes]) -> Counter:
    """Occurrences of the templates' words over all texts: a row for each word and batch, summed by Spark."""

    def run(column: list[bytes]) -> dict[str, list]:
        found: Counter = Counter()
        for text in column:
            found.update(vocabulary.intersection(words_of(text)))
        return {"word": list(found), "n": list(found.values())}

    counted = map_batches(texts, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({bytes(r["word"]): r["n"] for r in counted.collect()})  # at most the templates' words


def block_words(size: int) -> int:
    """Words of the blocks that a template of that many words is compared with."""
    block = BLOCK_WORDS
    while block < 2 * size:
        block *= 2
    return block


class TemplateIndex:
    """Templates of one block size as ordered token lists, found by the tokens of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: Counter, block: int = BLOCK_WORDS):
        self.block, self.step = block, block // 2
        sets = [(label, frozenset(words_of(text.encode()))) for label, text in templates]
        vocabulary = sorted(frozenset().union(*(s for _, s in sets)), key=lambda w: (frequency[w], w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.templates = [(label, sorted(self.rank[w] for w in s), overlap_needed(len(s))) for label, s in sets]
        self.least = min((o for _, _, o in self.templates), default=1)
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for t, (_, tokens, needed) in enumerate(self.templates):
            for i, token in enumerate(tokens[: len(tokens) - needed + 1]):
                self.prefixes.setdefault(token, []).append((t, i))
        self.rare = frozenset(w for w, r in self.rank.items() if r in self.prefixes)

    def matches(self, block: list[int]) -> list[tuple[int, int]]:
        """(template, overlap) of those that the block (distinct ranks in ascending order) meets."""
        size, seen, found = len(block), set(), []
        for j, token in enumerate(block[: size - self.least + 1]):
            for t, i in self.prefixes.get(token, ()):
                _, tokens, needed = self.templates[t]
                if t in seen or size < needed or 1 + min(len(tokens) - i - 1, size - j - 1) < needed:
                    continue
                seen.add(t)
                overlap = len(set(block).intersection(tokens))
                if overlap >= needed:
                    found.append((t, overlap))
        return found

    def scan(self, words: list[bytes], best: dict[str, float]) -> None:
        """Best containment by label, over all blocks."""
        rare, step = self.rare, self.step
        at = [i for i, w in enumerate(words) if w in rare]
        for b in sorted({k for i in at for k in (i // step - 1, i // step) if k >= 0}):
            window = words[b * step : b * step + self.block]
            for t, overlap in self.matches(sorted({self.rank[w] for w in window if w in self.rank})):
                label, tokens, _ = self.templates[t]
                best[label] = max(best.get(label, 0.0), overlap / len(tokens))


def indexes(templates: list[tuple[str, str]], frequency: Counter) -> list[TemplateIndex]:
    by: dict[int, list] = {}
    for label, text in templates:
        if size := len(words_of(text.encode())):
            by.setdefault(block_words(size), []).append((label, text))
    return [TemplateIndex(some, frequency, block) for block, some in sorted(by.items())]


def parts_of(templates: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Templates in parts of up to PASS_WORDS distinct words (or one template)."""
    parts: list[list] = [[]]
    held: set[bytes] = set()
    for label, text in templates:
        words = set(words_of(text.encode()))
        if parts[-1] and len(held | words) > PASS_WORDS:
            parts.append([])
            held = set()
        parts[-1].append((label, text))
        held |= words
    return parts


def places(words: list[bytes], phrases: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """(start, label) of all places of the phrases."""
    text, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        mark = b" " + phrase.encode() + b" "
        at = text.find(mark)
        while at >= 0:
            found.append((text.count(b" ", 0, at), label))
            at = text.find(mark, at + 1)
    return found


def scan_licenses(documents: DataFrame, id_col: str, text_col: str, phrases: list[tuple[str, str]], templates: list[tuple[str, str]]) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    parts = parts_of(templates)
    texts = rows.select("text")
    for n, part in enumerate(parts):
        frequency = count_tokens(texts, frozenset(w for _, text in part for w in words_of(text.encode())))
        rows = _scanned(rows, indexes(part, frequency), phrases, n == len(parts) - 1)
    return rows


def _scanned(rows: DataFrame, found_by: list[TemplateIndex], phrases: list[tuple[str, str]], last: bool) -> DataFrame:
    """A pass over the texts (and the labels met before); the last one gives the result."""

    def run(ids: list[int], texts: list[bytes], before: list | None = None) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in (("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") if last else ("doc_id", "text", "met"))}
        for i, text, held in zip(ids, texts, before or [None] * len(ids), strict=True):
            words, met = words_of(text), dict(held or [])
            for index in found_by:
                index.scan(words, met)
            if last:
                base = places(words, phrases)
                starts, labels = [s for s, _ in base], {label for _, label in base}
                row = (i, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | met.keys())), 1.0 if base else max(met.values(), default=0.0))
            else:
                row = i, text, list(met.items())
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
        return out

    return map_batches(rows, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double" if last else "doc_id long, text binary, met map<string, double>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), "doc_id", "text", PHRASES, TEMPLATES)


#: No template of the query has over BLOCK_WORDS / 2 words, so all blocks have the same length there.
_LIST = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
phrases(p, label) AS (VALUES {", ".join(f"({_LIST(p)}, '{label}')" for p, label in PHRASES)}),
templates(label, t) AS (VALUES {", ".join(f"('{label}', {_LIST(text)})" for label, text in TEMPLATES)}),
sized AS (SELECT row_number() OVER () AS id, label, list_distinct(t) AS t FROM templates),
tokens AS (SELECT id, label, len(t) AS size, unnest(t) AS token FROM sized),
starts AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1:i + len(p)] = p)) AS start FROM w CROSS JOIN phrases WHERE len(w) >= len(p)),
base AS (SELECT doc_id, count(*) AS n, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM starts GROUP BY doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM w),
hits AS (SELECT doc_id, i // {BLOCK_WORDS // 2} - k AS block, word FROM placed CROSS JOIN (VALUES (0), (1)) x(k) WHERE word IN (SELECT token FROM tokens) AND i // {BLOCK_WORDS // 2} >= k),
met AS (SELECT h.doc_id, t.label, count(DISTINCT h.word) / t.size AS c FROM hits h JOIN tokens t ON h.word = t.token GROUP BY h.doc_id, h.block, t.id, t.label, t.size HAVING count(DISTINCT h.word) * 10 >= {THRESHOLD} * t.size),
method AS (SELECT doc_id, max(c) AS score FROM met GROUP BY doc_id),
labelled AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM met UNION ALL SELECT doc_id, label FROM starts) GROUP BY doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.score, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base b USING (doc_id) LEFT JOIN method m USING (doc_id) LEFT JOIN labelled l USING (doc_id)
"""
