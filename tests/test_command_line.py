"""The command line, run in this process on small folders."""

from __future__ import annotations

import json

import pytest

from emulsia import __main__ as cli
from emulsia.sources import container, sinks


def halved(path, data):
    if data == b"bad":
        raise OSError("unreadable")
    return "ok", len(data) // 2, path + ".avif"


@pytest.fixture
def run(spark, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda **_: spark)

    def go(*args):
        code = cli.main([str(a) for a in args])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    return go


def test_compress_skips_what_the_ledger_has(run, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name, data in (("a.jpg", b"x" * 10), ("B.PNG", b"y" * 20), ("c.jpg", b"bad"), ("notes.txt", b"z")):
        (inbox / name).write_bytes(data)
    assert [r["path"].rsplit("/", 1)[1] for r in run("compress", inbox)[1]] == ["B.PNG", "a.jpg", "c.jpg"]
    args = ("compress", inbox, "-o", tmp_path / "out", "--ledger", tmp_path / "ledger", "--encoder", f"{__name__}:halved")
    code, (totals,) = run(*args)
    assert code == 1 and (totals["ok"], totals["failed"], totals["total_in"], totals["total_out"]) == (2, 1, 30, 15)
    code, (totals,) = run(*args)
    assert code == 1 and (totals["ok"], totals["failed"]) == (0, 1)
    # other settings are other work
    assert run(*args, "--set", "faithful.quality=11")[1][0]["ok"] == 2
    assert run(*args, "--set", "faithful.quality=500")[0] == 2 and run("compress", inbox, "--encoder", "halved")[0] == 2


def test_containers_settings_and_baselines(run, spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(container.pack(container.manifest_text("a.jpg", 1, 1, []), {"background.avif": b"b"}))
    assert run("verify", tmp_path)[0] == 0 and run("info", tmp_path)[1][0]["manifest"]["original"]["filename"] == "a.jpg"
    (tmp_path / "b.zip").write_bytes(b"no archive")
    assert run("verify", tmp_path)[0] == 1
    assert run("init", tmp_path / "s.yaml")[0] == 0 and run("init", tmp_path / "s.yaml")[0] == 2
    row = ("a", "faithful", "ok", 2.0, 0.9, None, 1, 10, 5, None)
    for name, ratio in (("old", 2.0), ("new", 2.5)):
        sinks.save_baseline(spark.createDataFrame([(*row[:3], ratio, *row[4:])], sinks.BENCH), str(tmp_path / name))
    assert run("bench", tmp_path / "old", tmp_path / "new")[1][0]["d_ratio"] == 0.5


def test_watch_takes_files_that_stay(run, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    assert [(r["files"], r["stable"]) for r in run("watch", tmp_path, "--interval", 0, "--cycles", 2)[1]] == [(1, 0), (1, 1)]
    assert cli.main(["backends"]) == 0


def test_restore_quality_and_compare(run, capsys, tmp_path):
    import numpy as np

    from emulsia import photos, settings
    from emulsia.functions import png

    image = np.kron(np.arange(64, dtype=np.uint8).reshape(8, 8), np.ones((6, 6), dtype=np.uint8))[..., None].repeat(3, axis=2)
    chosen = settings.resolve(flags={"aggressive.content_aware": False})
    photo = photos.Photo(image)
    (tmp_path / "a.zip").write_bytes(photos.pack("a.png", b"x", photo, photos.plan(photo, [], chosen), chosen))
    (tmp_path / "b.zip").write_bytes(b"junk")
    code, rows = run("restore", tmp_path, "-o", tmp_path / "out")
    assert code == 1 and [r.get("name") for r in rows] == ["a.png", None] and "ContainerError" in rows[1]["error"]
    (tmp_path / "before.png").write_bytes(png.encode(image))
    (facts,) = run("quality", tmp_path / "before.png", tmp_path / "out" / "a.png")[1]
    assert facts["psnr"] > 25 and 0.5 < facts["ssim"] <= 1
    assert run("compare", tmp_path / "before.png", tmp_path / "out" / "a.png")[0] == 0 and "<figure>" in (tmp_path / "out" / "a_compare.html").read_text()
