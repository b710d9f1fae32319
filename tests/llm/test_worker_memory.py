"""What a task holds, and what its worker still holds when it has ended."""

import tracemalloc

import numpy as np
import pyarrow as pa

from boxwright.llm import suffix_dedup, wfst


def test_worker_forgets_cuts_and_pairs_after_encoding(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i} and {i * 7919}") for i in range(400)], "doc_id long, text string").repartition(4)
    model = wfst.model_path()
    assert wfst.encode_documents(docs, model).where("round_trip").count() == 400

    def remembered(batches):
        for batch in batches:
            machine = wfst.compile_model(model)
            yield pa.RecordBatch.from_arrays([pa.array([len(machine.known) + len(machine.older) + machine.merges.known.n] * batch.num_rows)], names=["n"])

    assert docs.select("doc_id").mapInArrow(remembered, "n long").agg({"n": "max"}).first()[0] == 0


def test_suffixes_of_a_batch_take_little_more_than_their_bytes():
    n, d = 16384, 100
    rng = np.random.default_rng(3)
    contexts = [x.tobytes() for x in rng.integers(97, 101, (n, d + suffix_dedup.LENGTH)).astype(np.uint8)]
    group, low, high = np.arange(n) // 4, np.zeros(n, np.int64), np.full(n, d)
    tracemalloc.start()
    try:
        queue = suffix_dedup.InductionQueue(group, contexts, low, high)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 6 * sum(map(len, contexts))
    for i in (0, 5000, n - 1):
        assert bytes(queue.before[i]) == contexts[i][:d][::-1]
