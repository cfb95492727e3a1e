"""Programs outside: where they are, what they can do, and the commands that encode and score clips.

Nothing here runs an encoder. A program is the file that EMULSIA_<NAME> names, else one beside a program that was found,
else one on the path; a missing one is no error.
"""

from __future__ import annotations

import functools
import hashlib
import os
import shutil
import subprocess
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from emulsia.errors import ModelError

#: The arguments of the commands and the filters of the scoring graph.
OPENING = ("-y", "-hide_banner", "-nostdin", "-loglevel", "error")
WHOLE = ("-map", "0:v:0", "-map", "0:a:0?", "-map_metadata", "0")
SPAN = ("-map", "0:v:0", "-an")
CODING = ("-fps_mode", "passthrough", "-c:v", "libsvtav1")
TUNING = ("-svtav1-params", "tune=0")
DEPTHS = ("yuv420p", "yuv420p10le")
DYNAMIC = ("-dolbyvision", "1", "-strict", "unofficial")
SOUND = ("-c:a", "copy")
CLOSING = ("-movflags", "+faststart+use_metadata_tags", "-f", "mp4")
SCALED, STAMPED = "scale=-2:1080:flags=bicubic,", "settb=AVTB,setpts=N/(30*TB)"
SCORED = "eof_action=endall:log_fmt=json:log_path=vmaf.json"
#: Programs that come beside another one.
BESIDE = {"avifdec": "avifenc", "ffprobe": "ffmpeg"}


def find(name: str) -> str | None:
    named = os.environ.get(f"EMULSIA_{name.upper()}")
    if named and Path(named).is_file():
        return named
    other = find(BESIDE[name]) if name in BESIDE else None
    if other:
        sibling = Path(other).with_name(name + Path(other).suffix)
        if sibling.is_file():
            return str(sibling)
    return shutil.which(name)


def clips_encodable() -> bool:
    return find("ffmpeg") is not None and find("ffprobe") is not None


@functools.cache
def says(program: str, *args: str) -> str:
    """What a program prints, nothing if it can't be run or fails."""
    try:
        done = subprocess.run([program, *args], capture_output=True, text=True, timeout=60)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout if done.returncode == 0 else ""


def clips_scorable() -> bool:
    program = find("ffmpeg")
    return clips_encodable() and " libvmaf " in says(program, "-hide_banner", "-filters")


def keeps_dynamic_metadata() -> bool:
    program = find("ffmpeg")
    return program is not None and "dolbyvision" in says(program, "-hide_banner", "-h", "encoder=libsvtav1")


def clip_command(source: Column, target: Column, crf: Column, preset: Column, ten_bit: Column, dynamic: Column, program: str = "ffmpeg") -> Column:
    """The command that encodes a clip, as an array: timestamps as they are, the first picture and sound track, metadata kept."""
    carried = F.when(dynamic, _texts(*DYNAMIC)).otherwise(_texts())
    return F.concat(_texts(program, *OPENING), F.array(F.lit("-i"), source), _texts(*WHOLE), _coding(crf, preset, ten_bit), carried, _texts(*SOUND, *CLOSING), F.array(target))


def sample_command(source: Column, target: Column, start: Column, length: Column, crf: Column, preset: Column, ten_bit: Column, program: str = "ffmpeg") -> Column:
    """The command that encodes a span of a clip to be scored and thrown away: pictures only."""
    seek = F.when(start > 0, F.array(F.lit("-ss"), F.format_string("%.3f", start))).otherwise(_texts())
    span = F.array(F.lit("-i"), source, F.lit("-t"), F.format_string("%.3f", length))
    return F.concat(_texts(program, *OPENING), seek, span, _texts(*SPAN), _coding(crf, preset, ten_bit), _texts(*CLOSING), F.array(target))


def score_graph(model: Column, scaled: Column, threads: int) -> Column:
    """The filter graph that scores a clip against its source frame by frame, in order, whatever their timestamps."""
    scale = F.when(scaled, SCALED).otherwise("")
    branch = lambda i, name: F.concat(F.lit(f"[{i}:v]"), scale, F.lit(f"{STAMPED}[{name}];"))
    return F.concat(branch(0, "d"), branch(1, "r"), F.lit("[d][r]libvmaf=model=version="), model, F.lit(f":n_threads={threads}:{SCORED}"))


def _texts(*words: str) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _coding(crf: Column, preset: Column, ten_bit: Column) -> Column:
    depth = F.when(ten_bit, DEPTHS[1]).otherwise(DEPTHS[0])
    levels = F.array(F.lit("-crf"), crf.cast("string"), F.lit("-preset"), preset.cast("string"))
    return F.concat(_texts(*CODING), levels, _texts(*TUNING), F.array(F.lit("-pix_fmt"), depth))


def weights(path: str, sha256: str | None = None, least_bytes: int = 1024) -> Path:
    """A file of weights that is there, isn't cut off and has its checksum, else ModelError. Nothing is fetched."""
    file = Path(path)
    if not file.is_file():
        raise ModelError(f"no weights at {path}: put the file there, or go on without the model")
    if file.stat().st_size < least_bytes:
        raise ModelError(f"{path} has only {file.stat().st_size} bytes")
    if sha256 is not None:
        with file.open("rb") as f:
            got = hashlib.file_digest(f, "sha256").hexdigest()
        if got != sha256.lower():
            raise ModelError(f"{path} has the checksum {got}, not {sha256}")
    return file
