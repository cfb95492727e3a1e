"""Programs outside: success, failure, hanging, children that stay behind, retried tasks, and scores."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from emulsia import clip_runner, errors

STUB = """#!/bin/sh
for a in "$@"; do last="$a"; done
case "$*" in
  *hang*) sleep 600 & echo $! > "$STUB_PIDS"; echo waiting; sleep 600;;
  *fail*) echo "no such codec"; exit 3;;
  *empty*) : > "$last";;
  *large*) head -c 5000 /dev/zero > "$last";;
  *libvmaf=*) printf '{"frames":[{"metrics":{"vmaf":90.0}},{"metrics":{"vmaf":80.0}}]}' > vmaf.json;;
  *-filters*) echo ' ... libvmaf  x';;
  *) printf small > "$last";;
esac
"""


@pytest.fixture
def stub(tmp_path, monkeypatch):
    for name in ("ffmpeg", "ffprobe"):
        (tmp_path / name).write_text(STUB)
        (tmp_path / name).chmod(0o755)
        monkeypatch.setenv(f"EMULSIA_{name.upper()}", str(tmp_path / name))
    return str(tmp_path / "ffmpeg")


def clip(tmp_path, name):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.mov").write_bytes(b"x" * 1000)
    return str(tmp_path / "in" / f"{name}.mov"), str(tmp_path / "out" / f"{name}.mp4")


def alive(pid):
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    with open(f"/proc/{pid}/stat") as f:
        return f.read().split()[2] != "Z"


def test_each_way_in_which_a_program_ends(spark, tmp_path, stub):
    names = ["good", "fail", "empty", "large"]
    rows = [clip(tmp_path, n) for n in names] + [(str(tmp_path / "gone.mov"), str(tmp_path / "out" / "gone.mp4"))]
    clips = spark.createDataFrame(rows, "path string, output_path string").repartition(2)
    found = clip_runner.compress(clips, F.lit(30), F.lit(6), F.lit(False), F.lit(False)).collect()
    got = {os.path.basename(r["path"]).split(".")[0]: r for r in found}
    assert {n: r["status"] for n, r in got.items()} == {"good": "ok", "fail": "failed", "empty": "failed", "large": "kept-original", "gone": "failed"}
    assert got["good"]["compressed_size"] == 5 and got["good"]["original_size"] == 1000 and "no such codec" in got["fail"]["said"] and "FileNotFound" in got["gone"]["said"]
    assert os.listdir(tmp_path / "out") == ["good.mp4"] and (tmp_path / "out" / "good.mp4").read_bytes() == b"small"
    both = clip_runner.encode(clips.filter(F.col("path").contains("large")).withColumn("command", F.array(F.lit(stub), F.lit("large"), F.lit(clip_runner.PLACE))), keep_smaller=False)
    assert both.first()["status"] == "ok" and os.path.getsize(tmp_path / "out" / "large.mp4") == 5000


def test_a_program_that_hangs_is_killed_with_its_children(tmp_path, stub, monkeypatch):
    monkeypatch.setenv("STUB_PIDS", str(tmp_path / "pids"))
    began = time.monotonic()
    with clip_runner.own_folder() as folder:
        ended = clip_runner.run([stub, "hang"], 1.0, folder)
        assert ended.code is None and "waiting" in ended.said and time.monotonic() - began < 20
    pid = int((tmp_path / "pids").read_text())
    for _ in range(50):
        if not alive(pid):
            break
        time.sleep(0.1)
    assert not alive(pid) and not os.path.exists(folder)


def test_a_time_limit_is_a_status(spark, tmp_path, stub, monkeypatch):
    path, target = clip(tmp_path, "slow")
    clips = spark.createDataFrame([(path, target, ["/bin/sleep", "30"])], "path string, output_path string, command array<string>")
    row = clip_runner.encode(clips, limit=0.5).first()
    assert row["status"] == "timeout" and not os.path.exists(target)


def test_a_task_that_is_tried_again_leaves_one_whole_file(spark, tmp_path, stub):
    path, target = clip(tmp_path, "good")
    clips = spark.createDataFrame([(path, target)], "path string, output_path string")
    for _ in range(2):
        assert clip_runner.compress(clips, F.lit(30), F.lit(6), F.lit(False), F.lit(False)).first()["status"] == "ok"
    assert os.listdir(tmp_path / "out") == ["good.mp4"]
    with pytest.raises(FileNotFoundError):
        clip_runner.committed(str(tmp_path / "nothing"), target)
    assert os.listdir(tmp_path / "out") == ["good.mp4"]


def test_scores(spark, tmp_path, stub):
    from emulsia import tools

    tools.says.cache_clear()
    rows = [clip(tmp_path, "good"), clip(tmp_path, "fail")]
    clips = spark.createDataFrame(rows, "path string, output_path string").coalesce(1)
    got = clip_runner.scores(clips, F.lit("vmaf_v0.6.1"), F.lit(False)).collect()
    assert got[0]["score"]["mean"] == 85.0 and got[0]["score"]["min"] == 80.0 and got[0]["score"]["frames"] == 2
    assert got[1]["score"] is None and "no such codec" in got[1]["said"]
    tools.says.cache_clear()


def test_without_programs(spark, monkeypatch, tmp_path):
    monkeypatch.setenv("PATH", str(tmp_path))
    for name in ("ffmpeg", "ffprobe"):
        monkeypatch.delenv(f"EMULSIA_{name.upper()}", raising=False)
    clips = spark.createDataFrame([("a", "b")], "path string, output_path string")
    with pytest.raises(errors.ClipError):
        clip_runner.compress(clips, F.lit(30), F.lit(6), F.lit(False), F.lit(False))
    with pytest.raises(errors.ClipError):
        clip_runner.scores(clips, F.lit("m"), F.lit(False))
    with clip_runner.own_folder() as folder:
        assert clip_runner.run([str(tmp_path / "nothing")], 1, folder).code == 127
