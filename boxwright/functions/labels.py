"""Labels, names and paths as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Working labels, labels that mean reject, and alias words in their order of precedence.
DAMAGE = ["crack", "mold", "spall"]
REJECT = ["other", "shadow", "edge", "background", "object", "unknown", "reject"]
ALIASES_SOURCE = [("crack", ["crack", "fracture", "fissure"]), ("spall", ["spall", "spalling", "delamination", "flaking", "broken", "chipped"]), ("mold", ["mold", "mould", "mildew", "moss", "stain"])]
ALIASES_ENSEMBLE = [("crack", ["crack", "fracture", "fissure"]), ("spall", ["spall", "spalling", "delamination", "flaking", "broken", "chipped"]), ("mold", ["mold", "mould", "mildew", "moss"])]
ALIASES_SEED = [("spall", ["spall", "spalling", "delamination", "flaking"]), ("mold", ["mold", "mould", "stain", "moisture", "dirty"]), ("crack", ["crack", "fracture", "fissure"])]
#: Words that tell a prompt group by themselves.
KEYWORDS = {"crack": ["crack", "cracks", "cracking", "fracture", "fissure", "hairline"], "mold": ["mold", "mould", "mildew", "moss", "algae", "fungal", "fungus", "lichen", "biological"], "stain": ["stain", "stains", "discoloration", "discolouration", "damp", "rust", "contamination"], "spall": ["spall", "spalling", "flaked", "chipped", "delamination"]}


def normalise(label: Column) -> Column:
    """Trimmed and lower-cased; what is no damage is reject."""
    plain = F.lower(F.trim(label))
    return F.when(plain.isin(DAMAGE), plain).otherwise("reject")


def by_alias(text: Column, aliases: list[tuple[str, list[str]]], otherwise: Column | None = None) -> Column:
    """The first label with a word that stands anywhere in the lower-cased text."""
    low = F.lower(text)
    found = [F.when(reduce(Column.__or__, (low.contains(w) for w in words)), label) for label, words in aliases]
    return F.coalesce(*found, otherwise if otherwise is not None else F.lit(None).cast("string"))


def canonical(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.translate(label, "_-", "  ")), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def _stripped(name: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that fits, else the name."""
    return F.coalesce(*[F.when(name.rlike(p), F.regexp_extract(name, p, 1)) for p in patterns], name)


_NUMBERS = [r"^(.*)_\d+_\d+_\d+_\d+$", r"^(.*)_\d+_\d+$"]


def source_id(path: Column) -> Column:
    """The stem without a copy number and then a region, or four or two trailing numbers."""
    return _stripped(F.regexp_replace(stem(path), r"_dup\d+$", ""), [r"(?i)^(.+?)__roi\d+$", r"(?i)^(.+?)[_-]roi\d+$", *_NUMBERS])


def image_source_id(name: Column) -> Column:
    """As source_id() of a stem, without regions."""
    return _stripped(F.regexp_replace(name, r"_dup\d+$", ""), _NUMBERS)


def roi_source_id(path: Column) -> Column:
    """Regions first, then as image_source_id()."""
    return image_source_id(F.regexp_replace(stem(path), r"(__roi|_roi)\d+$", ""))


def canonical_image(path: Column) -> Column:
    """One id for the names that models give an image: ti_ and tr_ prefixes and the test_img and train_img folders are the same."""
    p = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    head = F.regexp_extract(p, "^([^/]*)/", 1)
    folder = F.when(head.isin("test_img", "train_img"), head).when(~p.contains("/") & p.startswith("ti_"), "test_img").when(~p.contains("/") & p.startswith("tr_"), "train_img")
    rest = F.when(p.contains("/"), p).otherwise(F.regexp_replace(p, "^t[ir]_", ""))
    return F.concat(F.when(folder.isNotNull(), F.concat(folder, F.lit("__"))).otherwise(""), stem(rest))


def prompt_group(text: Column, index: Column) -> Column:
    """struct(name, queries) of "name=q1, q2", "name::q1" or "q1, q2" (named by its index)."""
    t = F.trim(text)
    cut = F.when(t.contains("="), F.instr(t, "=")).when(t.contains("::"), F.instr(t, "::"))
    width = F.when(t.contains("="), 1).otherwise(2)
    auto = F.format_string("group_%02d", index)
    name = F.coalesce(F.nullif(F.trim(F.substring(t, F.lit(1), cut - 1)), F.lit("")), auto)
    queries = F.split(F.when(cut.isNull(), t).otherwise(F.substring(t, cut + width, F.length(t))), ",")
    return F.struct(name.alias("name"), F.filter(F.transform(queries, lambda q: F.trim(q)), lambda q: q != "").alias("queries"))


def matched_group(label: Column, groups: list[tuple[str, list[str]]], keywords: dict[str, list[str]] = KEYWORDS) -> Column:
    """The group with the longest query that the label holds (the first of equals); else one with a keyword in a word of the label; else one whose name it holds; else null."""
    text = F.lower(F.trim(label))
    queries = [(q.strip().lower(), g) for g, qs in groups for q in qs if q.strip()]
    longest = sorted(range(len(queries)), key=lambda i: (-len(queries[i][0]), i))
    words = [(g, w) for g, _ in groups for w in keywords.get(g.strip().lower(), [g.strip().lower()])]
    tests = [F.when(text.contains(queries[i][0]), queries[i][1]) for i in longest] + [F.when(text.contains(w), g) for g, w in words] + [F.when(text.contains(g.strip().lower()), g) for g, _ in groups]
    return F.coalesce(*tests)


def mask_path(path: Column) -> Column:
    return F.replace(F.replace(path, F.lit("/images/"), F.lit("/masks/")), F.lit(".jpg"), F.lit(".png"))
