"""Containers by the data source: what a schema reads, and what a write that fails leaves."""

from __future__ import annotations

import io
import os
import pickle

import pytest
from pyspark.sql import functions as F

from emulsia.sources import container, container_source

BIG = os.urandom(3 << 20)


class Counted(io.BytesIO):
    """A file that counts the bytes that are read."""

    total = 0

    def read(self, size=-1):
        data = super().read(size)
        self.total += len(data)
        return data


def test_a_schema_without_members_reads_a_bounded_part():
    data = container.pack(container.manifest_text("a.jpg", 4, 4, []), {"background.jpg": BIG, "faces/000.png": BIG})
    for columns, least, most in ((["names"], 1, 70_000), (["manifest", "error"], 1, 80_000), (["members"], len(BIG), 3 * len(BIG))):
        file = Counted(data)
        row = container_source.looked_up(file, columns)
        assert least <= file.total <= most and "error" not in row
    assert container_source.looked_up(io.BytesIO(data), ["names"])["names"] == ["manifest.json", "background.jpg", "faces/000.png"]
    assert container_source.looked_up(io.BytesIO(b"junk"), ["names"]) == {"error": "unreadable: BadZipFile"}


@pytest.fixture
def folder(spark, tmp_path):
    container_source.register(spark)
    rows = [(f"in/{k}.zip", container.manifest_text(f"{k}.jpg", 4, k, []), {"background.jpg": b"x" * k}) for k in range(1, 8)]
    spark.createDataFrame(rows, "path string, manifest string, members map<string,binary>").repartition(3).write.format(container_source.NAME).mode("append").save(str(tmp_path / "c"))
    return str(tmp_path / "c")


def test_written_and_read_back(spark, folder):
    assert sorted(os.listdir(folder)) == [f"{k}.zip" for k in range(1, 8)]
    got = spark.read.format(container_source.NAME).load(folder).collect()
    assert len(got) == 7 and all(r["error"] is None and r["size"] == os.path.getsize(r["path"]) and r["names"] == ["manifest.json", "background.jpg"] for r in got)
    assert {os.path.basename(r["path"]): bytes(r["members"]["background.jpg"]) for r in got} == {f"{k}.zip": b"x" * k for k in range(1, 8)}
    same = container.read_folder(spark, folder)
    assert same.count() == 7 and container.audit(same).filter("ok").count() == 7
    with open(f"{folder}/bad.zip", "wb") as f:
        f.write(b"junk")
    rows = {os.path.basename(r["path"]): r for r in container_source.manifests(spark, folder).collect()}
    assert rows["bad.zip"]["error"] and rows["3.zip"]["manifest"] and len(rows) == 8
    assert spark.read.format(container_source.NAME).schema("path string").option("pathGlobFilter", "b*").load(folder).count() == 1
    assert spark.read.format(container_source.NAME).schema("size long").load(folder).agg(F.sum("size")).first()[0] == sum(os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder))


def test_a_write_that_fails_leaves_no_file(spark, folder):
    before = sorted(os.listdir(folder))
    schema = "path string, manifest string, members map<string,binary>"
    bad = spark.createDataFrame([(f"{k}.zip", "{}", {}) for k in range(50, 60)] + [("", "{}", {})], schema).repartition(4)
    twice = spark.createDataFrame([("60.zip", "{}", {}), ("b/60.zip", "{}", {})], schema)
    for df in (bad, twice, bad.select("path", "manifest")):
        with pytest.raises(Exception):  # noqa: B017
            df.write.format(container_source.NAME).mode("append").save(folder)
        assert sorted(os.listdir(folder)) == before


def test_overwriting(spark, folder):
    one = spark.createDataFrame([("9.zip", "{}", {"background.jpg": b"y"})], "path string, manifest string, members map<string,binary>")
    one.write.format(container_source.NAME).mode("overwrite").save(folder)
    assert os.listdir(folder) == ["9.zip"]
    with pytest.raises(Exception, match="no columns"):  # noqa: B017
        spark.read.format(container_source.NAME).schema("path string, other int").load(folder).collect()


def test_reads_and_messages_grow_no_faster_than_the_files(spark, tmp_path, monkeypatch):
    writer = container_source.ContainerWriter({"path": str(tmp_path)}, spark.createDataFrame([], "path string, manifest string, members map<string,binary>").schema, False)
    said = [writer.write(iter([{"path": f"{'long' * 20}-{k}.zip", "manifest": "{}", "members": {"a": b"x"}} for k in range(n, n + 300)])) for n in (0, 300)]
    assert all(len(pickle.dumps(m)) < 300 * 8 + 500 for m in said)  # eight bytes a file, no names
    writer.commit(said)
    assert len(os.listdir(tmp_path)) == 600
    reader = container_source.ContainerReader({"path": str(tmp_path)}, spark.createDataFrame([], "path string, names array<string>, members map<string,binary>").schema)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert len(batches) == 3 and sum(b.num_rows for b in batches) == 600
    monkeypatch.setattr(container_source, "BATCH_BYTES", 1)
    assert len(list(reader.read(part))) == 600
    monkeypatch.setattr(container_source, "PARTITION_BYTES", 300)
    assert sum(len(p.names) for p in reader.partitions()) == 600 and all(len(p.names) == 1 or sum(p.sizes) <= 300 for p in reader.partitions())


def test_equal_numbers_are_no_equal_names(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(container_source, "numbered", lambda name: bytes(8))
    writer = container_source.ContainerWriter({"path": str(tmp_path)}, spark.createDataFrame([], "path string, manifest string, members map<string,binary>").schema, False)
    row = lambda k: {"path": f"{k}.zip", "manifest": "{}", "members": None}
    writer.commit([writer.write(iter([row(1), row(2)])), writer.write(iter([row(3)])), writer.write(iter([])), None])
    assert sorted(os.listdir(tmp_path)) == ["1.zip", "2.zip", "3.zip"]

