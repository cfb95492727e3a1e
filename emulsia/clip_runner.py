"""Clips encoded and scored by programs outside, one process a clip, in tasks that have the cores for it.

A program writes into the task's own temporary folder; its file goes beside the target under a name of its own and takes
the target's name in one step, so a target is whole or not there, and a task that is tried again starts anew. A process
that takes too long, or whose task is ended, is killed with all that it started.
"""

from __future__ import annotations

import contextlib
import os
import shutil
import signal
import subprocess
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulsia import tools
from emulsia.errors import ClipError
from emulsia.functions import pixels, probe

PLACE = "{out}"  # stands for the file that a command writes
TAIL = 2000  # characters of what a program said that are kept
RESULT = "path string, status string, original_size long, compressed_size long, output_path string, seconds double, said string"
LOG = "path string, log string, said string"


@dataclass
class Ended:
    """How a process ended: its code (null: it took too long), what it last said, and the seconds it took."""

    code: int | None
    said: str
    seconds: float


def run(command: list[str], limit: float, folder: str) -> Ended:
    """Runs a command in a folder. What it prints goes to a file there, so that no pipe fills up."""
    began = time.monotonic()
    with open(os.path.join(folder, "said"), "w+b") as out:
        try:
            child = subprocess.Popen(command, cwd=folder, stdin=subprocess.DEVNULL, stdout=out, stderr=subprocess.STDOUT, start_new_session=True)
        except OSError as e:
            return Ended(127, f"{type(e).__name__}: {e}", 0.0)
        try:
            code = child.wait(limit)
        except subprocess.TimeoutExpired:
            code = None
        finally:
            # the child leads a group of its own: what it started ends with it
            with contextlib.suppress(ProcessLookupError):
                os.killpg(child.pid, signal.SIGKILL)
            child.wait()
        out.seek(max(0, out.seek(0, os.SEEK_END) - 4 * TAIL))
        return Ended(code, out.read().decode("utf-8", "replace")[-TAIL:], time.monotonic() - began)


@contextlib.contextmanager
def own_folder() -> Iterator[str]:
    folder = tempfile.mkdtemp(prefix="clip-")
    try:
        yield folder
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def committed(made: str, target: str) -> None:
    """Moves a file to its target, which is on another disk perhaps, in one visible step."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    beside = os.path.join(os.path.dirname(target), f".{os.path.basename(target)}.{uuid.uuid4().hex}")
    try:
        shutil.move(made, beside)
        os.replace(beside, target)
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.remove(beside)


def cores(df: DataFrame, n: int) -> ResourceProfile | None:
    """A profile that gives each task of a stage n cores; none on a local master, which has no profiles."""
    if n <= 1 or df.sparkSession.sparkContext.master.startswith("local"):
        return None
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(n)).build


def _each(rows: DataFrame, one: Callable[..., dict], inputs: list[str], schema: str, types: list[pa.DataType], n: int) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for r in b.select(inputs).to_pylist():
                out = one(**r)
                yield pa.RecordBatch.from_arrays([pa.array([out.get(c)], t) for c, t in zip(names, types)], names=names)

    return rows.select(*inputs).mapInArrow(batches, schema, profile=cores(rows, n))


def encode(clips: DataFrame, limit: float = 6 * 3600, task_cores: int = 4, keep_smaller: bool = True) -> DataFrame:
    """clips (path, command, output_path), where the command has PLACE for the file that it writes, as RESULT rows.

    ok; kept-original where the encoding isn't smaller; timeout; or failed, with the end of what the program said.
    """

    def one(path: str, command: list[str], output_path: str) -> dict:
        row = {"path": path, "status": "failed"}
        try:
            row["original_size"] = os.path.getsize(path)
            with own_folder() as folder:
                made = os.path.join(folder, "made" + os.path.splitext(output_path)[1])
                ended = run([made if c == PLACE else c for c in command], limit, folder)
                row |= {"seconds": ended.seconds, "said": ended.said}
                if ended.code is None:
                    row["status"] = "timeout"
                elif ended.code == 0 and os.path.isfile(made) and os.path.getsize(made):
                    row["compressed_size"] = os.path.getsize(made)
                    if keep_smaller and row["compressed_size"] >= row["original_size"]:
                        row["status"] = "kept-original"
                    else:
                        committed(made, output_path)
                        row |= {"status": "ok", "output_path": output_path}
        except OSError as e:
            row["said"] = f"{type(e).__name__}: {e}"
        return row

    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string()]
    return _each(clips, one, ["path", "command", "output_path"], RESULT, types, task_cores)


def logs(clips: DataFrame, limit: float = 6 * 3600, task_cores: int = 4, log: str = "vmaf.json") -> DataFrame:
    """clips (path, command), whose command writes a log into its folder, as path, log and, where there is none, what was said."""

    def one(path: str, command: list[str]) -> dict:
        with own_folder() as folder:
            ended = run(command, limit, folder)
            at = os.path.join(folder, log)
            if ended.code == 0 and os.path.isfile(at):
                with open(at, encoding="utf-8", errors="replace") as f:
                    return {"path": path, "log": f.read()}
            return {"path": path, "said": "took too long" if ended.code is None else ended.said}

    return _each(clips, one, ["path", "command"], LOG, [pa.string()] * 3, task_cores)


def compress(clips: DataFrame, crf: Column, preset: Column, ten_bit: Column, dynamic: Column, **options: object) -> DataFrame:
    """clips (path, output_path) encoded by the encoder that is installed, as RESULT rows."""
    program = tools.find("ffmpeg")
    if program is None:
        raise ClipError("no encoder: install ffmpeg, or set EMULSIA_FFMPEG")
    command = tools.clip_command(F.col("path"), F.lit(PLACE), crf, preset, ten_bit, dynamic, program)
    return encode(clips.withColumn("command", command), **options)


def scores(clips: DataFrame, model: Column, scaled: Column, threads: int = 4, **options: object) -> DataFrame:
    """clips (path, output_path) with the pooled scores of their encodings (mean, p1, min, frames), null where scoring failed."""
    if not tools.clips_scorable():
        raise ClipError("no scorer: an ffmpeg with libvmaf is needed")
    words = lambda *w: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in w])
    graph = tools.score_graph(model, scaled, threads)
    command = words(tools.find("ffmpeg"), "-hide_banner", "-nostdin", "-i", F.col("output_path"), "-i", F.col("path"), "-lavfi", graph, "-f", "null", "-")
    found = logs(clips.withColumn("command", command), task_cores=threads, **options)
    frames = probe.frame_scores(F.col("log"))
    return found.select("path", F.when(frames.isNotNull(), pixels.pooled(frames)).alias("score"), "said")

