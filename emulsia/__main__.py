"""The command line over the plans: python -m emulsia COMMAND --help.

Encoders and detectors are plug-ins, given as module:function; without an encoder, `compress` plans a dry run.
"""

from __future__ import annotations

import argparse
import base64
import importlib
import json
import math
import sys
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsia import clip_runner, codecs, detectors, photos, settings
from emulsia.errors import EmulsiaError, SettingsError
from emulsia.functions import perceptual, video
from emulsia.operators import reports
from emulsia.plans import batch
from emulsia.session import build_session
from emulsia.sources import archive, container, container_source, ledger, sinks
from emulsia.streaming.inbox import Inbox

def plugin(name: str):
    """The object that module:name names."""
    module, colon, attribute = name.partition(":")
    if not colon:
        raise SettingsError(f"a plug-in is module:function, not {name!r}")
    return getattr(importlib.import_module(module), attribute)


def layered(args: argparse.Namespace) -> dict[str, object]:
    flags = {k: settings._value(v) for k, _, v in (x.partition("=") for x in args.set or [])}
    return settings.resolve(settings.load(args.config) if args.config else None, flags, args.preset)


def show(rows: DataFrame) -> None:
    """Rows of a result, a line of JSON each; they pass through the driver a partition at a time."""
    for r in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        print(r["line"])


def scanned(spark: SparkSession, folder: str, chosen: dict[str, object], content: bool) -> DataFrame:
    files = archive.scan_folder(spark, folder, archive.PHOTO, content=True)
    mtime = F.unix_micros("modificationTime").alias("mtime")
    hashed = archive.with_content_hash(files.select("path", F.col("length").alias("size"), mtime, "content"))
    photo = settings.as_struct(chosen, "faithful." if chosen["mode"] == "faithful" else "aggressive.")
    hashed = hashed.withColumn("fingerprint", ledger.fingerprint(photo))
    return hashed if content else hashed.drop("content")


def compress(spark: SparkSession, args: argparse.Namespace) -> int:
    chosen = layered(args)
    kept = ledger.processed(spark, args.ledger) if args.ledger else None
    known = kept.read() if kept else spark.createDataFrame([], ledger.PROCESSED)
    outputs = known.select("output_path").distinct()
    flagged = ledger.with_hits(scanned(spark, args.folder, chosen, True), known, outputs)
    misses = flagged.filter(~F.col("hit")).drop("hit")
    if args.encoder is None:
        show(misses.select("path", "size", F.lit("would-encode").alias("status")).orderBy("path"))
        return 0
    results = batch.run_misses(misses, plugin(args.encoder), str(chosen["mode"]))
    target = f"{args.output.rstrip('/')}/runs/{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:8]}"
    results.write.parquet(target)  # encoders run once: what follows reads their results
    done = spark.read.schema(batch.RESULT).parquet(target)
    if kept:
        stats = flagged.select("path", "size", "mtime")
        with kept:
            kept.record(done.filter(F.col("status").isin(*ledger.RECORDED)).join(stats, "path").select(*known.columns))
    rows = reports.totals(done.select("mode", "status", "original_size", "compressed_size"), ["mode"])
    show(rows)
    return 1 if done.filter("status = 'failed'").limit(1).count() else 0


def clips(spark: SparkSession, args: argparse.Namespace) -> int:
    """Clips of a folder through the installed encoder; what isn't smaller, fails or takes too long leaves no file."""
    chosen = layered(args)
    local = lambda c: F.regexp_replace(c, "^file:/+", "/")
    found = archive.scan_folder(spark, args.folder, archive.VIDEO).select(local(F.col("path")).alias("path"))
    found = found.withColumn("output_path", video.output_path(F.col("path"), F.lit(args.output.rstrip("/"))))
    done = clip_runner.compress(found, F.lit(int(chosen["video.crf"])), F.lit(int(chosen["video.preset"])), F.lit(True), F.lit(False), limit=args.limit, task_cores=args.cores)
    target = f"{args.output.rstrip('/')}/runs/clips-{uuid.uuid4().hex[:8]}"
    done.write.parquet(target)  # encoders run once: what follows reads their results
    rows = spark.read.schema(clip_runner.RESULT).parquet(target)
    show(rows.orderBy("path"))
    return 1 if rows.filter("status IN ('failed', 'timeout')").limit(1).count() else 0


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    audited = container.audit(container.read_folder(spark, args.folder)).orderBy("path")
    show(audited)
    return 1 if audited.filter(~F.col("ok")).limit(1).count() else 0


def info(spark: SparkSession, args: argparse.Namespace) -> int:
    found = container_source.manifests(spark, args.folder)
    show(found.select("path", "size", F.from_json("manifest", container.MANIFEST).alias("manifest"), "error"))
    return 0


def init(spark: SparkSession | None, args: argparse.Namespace) -> int:
    with open(args.path, "x", encoding="utf-8") as f:
        f.write(settings.default_text())
    return 0


def bench(spark: SparkSession, args: argparse.Namespace) -> int:
    old, new = sinks.load_baseline(spark, args.old), sinks.load_baseline(spark, args.new)
    show(reports.diff_runs(old, new, ["file", "mode"], ["ratio", "ssim", "original_bytes", "output_bytes"]).orderBy("file", "mode"))
    return 0


def watch(spark: SparkSession, args: argparse.Namespace) -> int:
    """Scans until stopped, or --cycles times; a file is taken once, when two scans in a row agree about it."""
    inbox = Inbox(spark, args.state or f"{args.folder.rstrip('/')}/.emulsia-watch")
    cycle = 0
    while args.cycles is None or cycle < args.cycles:
        files = archive.scan_folder(spark, args.folder).select("path", F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
        now, found = inbox.cycle(files)
        stable = found.count()
        if stable:
            inbox.settle(found.withColumn("verdict", F.lit("done")))
        print(json.dumps({"cycle": cycle, "files": now.count(), "stable": stable}), flush=True)
        cycle += 1
        if args.cycles is None or cycle < args.cycles:
            time.sleep(args.interval)
    return 0


def restore(spark: SparkSession, args: argparse.Namespace) -> int:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(args.folder).select("path", "content")
    target = f"{args.output.rstrip('/')}/restored-{uuid.uuid4().hex[:8]}"
    photos.restore_photos(files).write.parquet(target)  # restored once: files and report read it
    done = spark.read.schema(photos.RESULT).parquet(target)
    name = F.concat(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.zip$", ""), F.lit(".png"))
    show(sinks.write_files(done.filter("status = 'ok'").select(name.alias("name"), "content"), args.output).orderBy("name"))
    bad = done.filter("status <> 'ok'").select("path", "error").orderBy("path")
    show(bad)
    return 1 if bad.limit(1).count() else 0


def pair(args: argparse.Namespace) -> tuple[list[bytes], dict[str, object]]:
    """Two pictures and how alike they are."""
    data = [open(p, "rb").read() for p in (args.before, args.after)]
    a, b = (photos.load_any(d).image for d in data)
    if a.shape != b.shape:
        b = photos.enlarged(b, *a.shape[:2]).round().clip(0, 255).astype(a.dtype)
    error = float(((codecs.unit(a) - codecs.unit(b)) ** 2).mean())
    psnr = float("inf") if error == 0 else -10 * math.log10(error)
    return data, {"psnr": psnr, "ssim": codecs.similarity(a, b), "ssimulacra2": perceptual.score(a, b), "ratio": len(data[0]) / len(data[1]) if data[1] else 0.0}


def quality(spark: SparkSession | None, args: argparse.Namespace) -> int:
    print(json.dumps(pair(args)[1]))
    return 0


def compare(spark: SparkSession | None, args: argparse.Namespace) -> int:
    data, facts = pair(args)
    path = args.output or f"{args.after.rpartition('.')[0]}_compare.html"
    uri = lambda d: "data:image/png;base64," + base64.b64encode(d).decode()
    with open(path, "w", encoding="utf-8") as f:
        f.write(sinks.comparison_page("Before and after", {"before": uri(data[0]), "after": uri(data[1])}, [(k, f"{v:.4f}", "") for k, v in facts.items()]))
    print(path)
    return 0


def backends(spark: SparkSession | None, args: argparse.Namespace) -> int:
    print("\n".join(detectors.known_backends()))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="emulsia", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, text: str, session: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__, help=text, description=text)
        p.set_defaults(run=run, session=session)
        return p

    p = command(compress, "encode the files of a folder that the ledger lacks")
    p.add_argument("folder")
    p.add_argument("-o", "--output", default=".")
    p.add_argument("--ledger", help="a Parquet table of finished work")
    p.add_argument("--encoder", help="module:function from (path, bytes) to (status, size, output path)")
    p.add_argument("--config", help="a settings file")
    p.add_argument("--preset", choices=sorted(settings.PRESETS))
    p.add_argument("--set", action="append", metavar="KEY=VALUE")
    p = command(clips, "encode the clips of a folder")
    p.add_argument("folder")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--limit", type=float, default=6 * 3600, help="seconds that an encoding may take")
    p.add_argument("--cores", type=int, default=4, help="cores of a task, on a cluster")
    p.add_argument("--config", help="a settings file")
    p.add_argument("--preset", choices=sorted(settings.PRESETS))
    p.add_argument("--set", action="append", metavar="KEY=VALUE")
    for run, text in ((verify, "check the containers of a folder"), (info, "show the manifests of the containers of a folder")):
        command(run, text).add_argument("folder")
    p = command(init, "write a settings file with the defaults", session=False)
    p.add_argument("path")
    p = command(bench, "compare two saved baselines")
    p.add_argument("old")
    p.add_argument("new")
    p = command(watch, "scan an inbox again and again")
    p.add_argument("folder")
    p.add_argument("--interval", type=float, default=30)
    p.add_argument("--cycles", type=int)
    p.add_argument("--state", help="a folder that keeps what was taken, also over restarts")
    p = command(restore, "restore the containers of a folder as PNG files")
    p.add_argument("folder")
    p.add_argument("-o", "--output", required=True)
    for run, text in ((quality, "how alike two pictures are"), (compare, "a page with two pictures side by side")):
        p = command(run, text, session=False)
        p.add_argument("before")
        p.add_argument("after")
        if run is compare:
            p.add_argument("-o", "--output")
    command(backends, "list the known detectors", session=False)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(build_session(spark_ui_showConsoleProgress="false") if args.session else None, args)
    except (EmulsiaError, OSError) as e:
        print(f"emulsia: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
