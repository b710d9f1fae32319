"""The subpackage's queries and SQL, for __spark_entry__.py."""

from __future__ import annotations

import importlib

#: Query: module, SQL's name in it (None: no SQL).
QUERIES = {
    "op1_decontamination": ("decontamination", None),
    "op2_license_scan": ("license_scan", "SQL"),
    "op3_warc": ("warc", "SQL"),
    "op4_simhash": ("simhash", None),
    "op5_topk": ("topk", "SQL"),
    "op6_sentencepiece": ("wfst", None),
    "op7_language_id": ("language_id", None),
    "op8_packed_ids": ("packing", None),
    "op9_suffix_dedup": ("suffix_dedup", None),
    "op10_url_filter": ("url_filter", "SQL"),
    "op11_vector_codes": ("vector_codes", "SQL"),
    "op12_spelling_variants": ("spelling", "SQL"),
    "op13_hilbert_shards": ("sharding", "SQL"),
}


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": _pipeline} | {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, (module, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), sql) for name, (module, sql) in QUERIES.items() if sql}
