"""Job states of tables and streams, and the log sink, against loops over the events."""

import datetime
import json
import os
import random

import pytest

from boxwright.functions.stored import own_tables, stored
from boxwright.streaming import states
from boxwright.streaming.sinks import BufferedSink

EVENTS = "job long, event_id long, ts timestamp, event string"
NAMES = ["queued", "started", "done", "failed", "cancelled", "drained"]


def some_events(seed, jobs=40, n=400):
    r = random.Random(seed)
    start = datetime.datetime(2026, 1, 1)
    return [(r.randrange(jobs) if k % 3 else 0, k, start + datetime.timedelta(seconds=k // 3), r.choices(NAMES, [3, 4, 2, 1, 1, 2])[0]) for k in range(n)]


def walked(events):
    now, out = {}, []
    for job, event_id, ts, event in sorted(events, key=lambda e: (e[2], e[1])):
        before = now.get(job)
        moves = event in states.LEGAL and before in states.LEGAL[event]
        after = states.TARGET[event] if moves else before
        now[job] = after
        out.append((job, event_id, event, before, after, moves or event not in states.LEGAL))
    return sorted(out)


def told(df):
    return sorted((r["job"], r["event_id"], r["event"], r["from_status"], r["to_status"], r["legal"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_transitions_meet_a_walk(spark, seed):
    events = some_events(seed)
    random.Random(seed).shuffle(events)
    awkward = [*events, events[0], (None, 1, events[0][2], "queued"), (1, None, events[0][2], "queued"), (1, 10**6, None, "queued"), (1, 10**6, events[0][2], None)]
    df = spark.createDataFrame(awkward, EVENTS).repartition(3)
    assert told(states.transitions(df)) == walked(events)
    assert states.transitions(df.limit(0)).count() == 0


def test_finished_jobs_are_kept_in_number_or_undrained(spark):
    start = datetime.datetime(2026, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    events = []
    for job in range(9):
        names = ["queued", "started"] + ([] if job == 0 else ["done"]) + (["drained"] if job != 7 else [])
        events += [(job, 10 * job + k, at(100 * job + k), name) for k, name in enumerate(names)]
    jobs = states.statuses(states.transitions(spark.createDataFrame(events, EVENTS)))
    assert {r["job"] for r in states.retained(jobs, most=3).collect()} == {0, 1, 2, 3, 7}
    found = {r["job"]: (r["status"], r["illegal"], r["undrained"]) for r in jobs.collect()}
    assert found[0] == ("running", 0, False) and found[7] == ("done", 0, True)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(df, place, name, once=True):
    q = df.writeStream.format("parquet").option("path", f"{place}/{name}").option("checkpointLocation", f"{place}/{name}-at").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return q


def files(folder, batches):
    folder.mkdir(exist_ok=True)
    done = len(list(folder.iterdir()))
    for k, batch in enumerate(batches):
        file = folder / f"{done + k:03d}.json"
        file.write_text("\n".join(json.dumps({"job": j, "event_id": i, "ts": t.isoformat(), "event": e}) for j, i, t, e in batch))
        os.utime(file, (1_700_000_000 + done + k,) * 2)  # files come in the order of their times


def test_a_stream_tells_what_a_table_tells(rocks, tmp_path):
    events = some_events(5, 20, 150)
    files(tmp_path / "in", [events[:60], events[60:100]])
    read = lambda: rocks.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    run(states.streamed(read()), tmp_path, "out")
    files(tmp_path / "in", [events[100:]])
    run(states.streamed(read()), tmp_path, "out")  # goes on where it was
    found = rocks.read.parquet(f"{tmp_path}/out")
    assert told(found) == walked(events) == told(states.transitions(rocks.createDataFrame(events, EVENTS)))


def test_silent_jobs_fail_by_a_timer(rocks, tmp_path):
    start = datetime.datetime(2026, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    files(tmp_path / "in", [[(1, 1, at(0), "queued"), (1, 2, at(1), "started"), (2, 3, at(1), "queued"), (2, 4, at(2), "started"), (2, 5, at(3), "done")], [(3, 6, at(500), "queued")], [(3, 7, at(501), "drained")]])
    read = rocks.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    run(states.streamed(read, silent_ms=60_000), tmp_path, "out")
    found = [(r["job"], r["event"], r["from_status"], r["to_status"]) for r in rocks.read.parquet(f"{tmp_path}/out").where("event = 'timeout'").collect()]
    assert found == [(1, "timeout", "running", "failed")]


def test_the_sink_takes_each_row_once_over_restarts(spark, tmp_path, monkeypatch):
    rows = lambda k: spark.range(k * 10, k * 10 + 7).withColumnRenamed("id", "n")
    path = f"file://{tmp_path}/log"
    expected = lambda n: sorted(i for k in range(n) for i in range(k * 10, k * 10 + 7))
    read = lambda: sorted(r["n"] for r in BufferedSink(path, 20).rows(spark).collect())
    assert BufferedSink(path).rows(spark) is None
    for k in (0, 1):
        BufferedSink(path, 20)(rows(k), k)
    assert read() == expected(2) and not (tmp_path / "log/flushed").exists()

    class Cut(Exception):
        pass

    def cut(*_):
        raise Cut

    with monkeypatch.context() as m:  # stopped between the flush and the end of the batch
        m.setattr(BufferedSink, "_delete", cut)
        with pytest.raises(Cut):
            BufferedSink(path, 20)(rows(2), 2)
    assert read() == expected(3)
    BufferedSink(path, 20)(rows(2), 2)  # the restarted stream runs the batch again
    assert read() == expected(3)
    with monkeypatch.context() as m:  # stopped between the batch's write and the flush
        m.setattr(BufferedSink, "flush", cut)
        BufferedSink(path, 20)(rows(3), 3)
        BufferedSink(path, 20)(rows(4), 4)
        with pytest.raises(Cut):
            BufferedSink(path, 20)(rows(5), 5)
    for k in (5, 6):
        BufferedSink(path, 20)(rows(k), k)
    assert read() == expected(7)
    assert len(list((tmp_path / "log/flushed").iterdir())) == 2


def test_the_sink_of_a_stream_that_is_restarted(spark, tmp_path):
    files(tmp_path / "in", [some_events(7, 5, 30)])
    sink = BufferedSink(f"file://{tmp_path}/log", 25)
    go = lambda: spark.readStream.schema(EVENTS).json(f"{tmp_path}/in").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination(120)
    go()
    files(tmp_path / "in", [some_events(8, 5, 40)])
    go()
    go()
    assert sink.rows(spark).count() == 70


def test_two_runs_own_their_tables(spark):
    with own_tables() as one:
        a = stored(spark.range(3), "a")
        with own_tables() as two:
            b, c = stored(spark.range(4), "b"), stored(spark.range(5), "c")
            two.discard_all_but(c)
        kept = stored(a, "kept")
        assert sorted(one.paths) == sorted([a._stored_at, c._stored_at, kept._stored_at])
        one.discard_all_but(kept, c)
    elsewhere = stored(spark.range(6), "other")
    with own_tables() as three:
        stored(spark.range(1), "d")
        three.discard_all_but(stored(spark.range(2), "e"))
    assert (kept.count(), c.count(), elsewhere.count()) == (3, 5, 6)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        b.count()
