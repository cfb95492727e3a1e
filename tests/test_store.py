"""The keyed table behind the ledger, and the watched folder: what is written, what survives, and who wins."""

from __future__ import annotations

import os
import threading

from pyspark.sql import functions as F

from emulsia.sources import ledger
from emulsia.sources.store import Store
from emulsia.streaming.inbox import Inbox

SCHEMA = "k string, v long"


def content(store):
    return {r["k"]: r["v"] for r in store.read().collect()}


def rows(spark, **kv):
    return spark.createDataFrame(list(kv.items()), SCHEMA).coalesce(1)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


def test_changes_lie_over_the_base_and_survive_compaction(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), SCHEMA, ["k"], buckets=4) as s:
        assert content(s) == {} and not s.compact()
        s.record(rows(spark, a=1, b=1))
        s.record(rows(spark, b=2, c=1))
        assert content(s) == {"a": 1, "b": 2, "c": 1}
        assert s.compact() and content(s) == {"a": 1, "b": 2, "c": 1} and not s.compact()
        s.record(rows(spark, c=5))
        s.record(spark.createDataFrame([(None, 7)], SCHEMA))
        s.record(spark.createDataFrame([(None, 8)], SCHEMA))
        assert content(s) == {"a": 1, "b": 2, "c": 5, None: 8}
        assert s.compact() and content(s) == {"a": 1, "b": 2, "c": 5, None: 8}
    left = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("rows")}
    base, changes = s._state()
    assert left == set(base.values()) and not changes and content(s) == {"a": 1, "b": 2, "c": 5, None: 8}
    wider = Store(spark, str(tmp_path / "s"), SCHEMA + ", note string", ["k"], buckets=4)
    assert wider.read().filter("note IS NULL").count() == 4


def test_what_is_written_follows_the_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), SCHEMA, ["k"])
    s.record(spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.col("id").alias("v")))
    s.compact()
    s.close()
    whole = size(tmp_path / "s")
    s.record(rows(spark, new=1))
    assert size(tmp_path / "s") - whole < whole / 20 and s.read().count() == 20_001
    before = {p.name for p in (tmp_path / "s").iterdir()}
    assert s.compact()
    (folder,) = {p.name for p in (tmp_path / "s").iterdir()} - before
    assert size(tmp_path / "s" / folder) < whole / 16  # one bucket of 64
    assert s.read().count() == 20_001
    found = s.read().filter("k = 'new'")
    assert found.count() == 1 and "PushedFilters: [IsNotNull(k), EqualTo(k,new)]" in found._jdf.queryExecution().toString()


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    writers = [threading.Thread(target=lambda i=i: [Store(spark, path, SCHEMA, ["k"]).record(rows(spark, **{f"w{i}x{j}": i})) for j in range(3)]) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    s = Store(spark, path, SCHEMA, ["k"])
    assert len(content(s)) == 12 and len(s.commits()) == 12 and len({c["number"] for c in s.commits()}) == 12


def test_a_change_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    a, b = (Store(spark, path, SCHEMA, ["k"], buckets=2) for _ in range(2))
    a.record(rows(spark, x=1, y=1))
    write = a._write

    def interrupted(df):
        folder = write(df)
        b.record(rows(spark, x=9))
        return folder

    monkeypatch.setattr(a, "_write", interrupted)
    assert a.compact() and content(a) == content(b) == {"x": 9, "y": 1}

    def overtaken(df):
        folder = write(df)
        assert b.compact()
        return folder

    monkeypatch.setattr(a, "_write", overtaken)
    assert not a.compact() and content(a) == content(b) == {"x": 9, "y": 1}


def test_what_broke_off_is_not_read(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), SCHEMA, ["k"])
    s.record(rows(spark, a=1))
    s._write(rows(spark, a=2))  # no commit
    (tmp_path / "s" / "commits" / "000000002.json").write_text('{"kind": "chan')  # a commit that isn't whole
    assert content(s) == {"a": 1}
    assert s.record(rows(spark, a=3)) == 3 and content(s) == {"a": 3}


def test_many_records_compact_by_themselves(spark, tmp_path, monkeypatch):
    from emulsia.sources import store

    monkeypatch.setattr(store, "COMPACT_AFTER", 3)
    s = Store(spark, str(tmp_path / "s"), SCHEMA, ["k"], buckets=2)
    for i in range(7):
        s.record(rows(spark, **{f"k{i % 3}": i}))
    assert content(s) == {"k0": 6, "k1": 4, "k2": 5} and len(s._state()[1]) < 3


def test_the_ledger_and_the_memo(spark, tmp_path):
    with ledger.processed(spark, str(tmp_path / "l")) as t:
        t.record(spark.createDataFrame([("p", "h", "f", "o", 1, 2, "faithful", "ok")], ledger.PROCESSED))
        assert t.read().first()["content_hash"] == "h"
    with ledger.detected(spark, str(tmp_path / "d")) as t:
        t.record(spark.createDataFrame([("h", "f", "[]"), ("h", "g", "[1]")], ledger.DETECTED))
        t.record(spark.createDataFrame([("h", "f", "[2]")], ledger.DETECTED))
        assert {(r["fingerprint"], r["boxes"]) for r in t.read().collect()} == {("f", "[2]"), ("g", "[1]")}


def test_an_inbox_gives_each_stable_file_out_once(spark, tmp_path):
    inbox = Inbox(spark, str(tmp_path / "w"))
    scan = lambda *r: spark.createDataFrame(list(r), "path string, size long, mtime long")
    take = lambda box, *r: sorted(x["path"] for x in box.cycle(scan(*r))[1].collect())
    settle = lambda box, verdict, *r: box.settle(scan(*r).withColumn("verdict", F.lit(verdict)))
    assert take(inbox, ("a", 1, 1), ("b", 1, 1)) == []
    assert take(inbox, ("a", 1, 1), ("b", 2, 2)) == ["a"]
    settle(inbox, "done", ("a", 1, 1))
    assert take(inbox, ("a", 1, 1), ("b", 2, 2)) == ["b"]
    settle(inbox, "failed", ("b", 2, 2))
    again = Inbox(spark, str(tmp_path / "w"))  # a restart
    assert take(again, ("a", 1, 1), ("b", 2, 2)) == []
    assert take(again, ("a", 1, 1)) == []  # b is gone, which ends its block
    assert take(again, ("a", 3, 3), ("b", 2, 2)) == []
    assert take(again, ("a", 3, 3), ("b", 2, 2)) == ["a", "b"]
    assert len(again.scans()) <= 2
