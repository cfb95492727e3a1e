"""The photo container: a ZIP of a JSON manifest and members, read and written as rows, and its audit."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The manifest's schema, a superset of all its versions, and the order in which members are looked up.
MANIFEST = (
    "version string, mode string, original struct<filename:string,width:int,height:int,size_bytes:bigint,hash_sha256:string,orientation:int>, exif_preserved boolean, icc_preserved boolean, "
    "gain_map_preserved boolean, settings struct<bg_scale:double,bg_quality:int,bg_codec:string,face_quality:int,face_codec:string,blend_mode:string,model:string,residual boolean,preset:string,bit_depth:int>, "
    "faces array<struct<id:int,bbox:array<int>,padded_bbox:array<int>,confidence:double>>, regions array<struct<id:int,bbox:array<int>,scale:double>>, created_at string"
)
LOOKUP = {"background": ("jpg", "avif", "jxl"), "crop": ("png", "avif", "jxl", "jpg"), "residual": ("avif", "jxl", "jpg")}
VERSION = "1.11.0"
#: The rows that a task hands on at once, fewer where they reach the bytes.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 8 << 20
_TYPES = [pa.string(), pa.string(), pa.map_(pa.string(), pa.binary()), pa.string()]
MEMBERS = "path string, manifest string, members map<string,binary>, error string"


def unpack(data: bytes | None) -> tuple[str | None, dict[str, bytes], str | None]:
    """Manifest text, other members, and what is wrong with the archive as a whole."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            names = z.namelist()
            if "manifest.json" not in names:
                return None, {}, "manifest.json is missing"
            return z.read("manifest.json").decode(), {n: z.read(n) for n in names if n != "manifest.json"}, None
    except (zipfile.BadZipFile, UnicodeDecodeError, EOFError, OSError) as e:
        return None, {}, f"unreadable: {type(e).__name__}"


def pack(manifest: str, members: dict[str, bytes]) -> bytes:
    """A deflated archive with a fixed order and time, the manifest first."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [("manifest.json", manifest.encode()), *sorted(members.items())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def sliced(b: pa.RecordBatch, rows: Iterable[tuple[tuple, int]], names: list[str], types: list[pa.DataType], kept: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    """What the rows of a batch become, each with its bytes, in slices of ROWS_AT_ONCE or BYTES_AT_ONCE; columns of the batch that are kept go along."""
    ready, held, begin = [], 0, 0
    for i, (row, size) in enumerate(rows, 1):
        ready.append(row)
        held += size
        if i == b.num_rows or len(ready) >= ROWS_AT_ONCE or held >= BYTES_AT_ONCE:
            made = [pa.array(c, t) for c, t in zip(zip(*ready), types)]
            yield pa.RecordBatch.from_arrays([*made, *(b.column(k).slice(begin, i - begin) for k in kept)], names=[*names, *kept])
            ready, held, begin = [], 0, i


def mapped(files: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, kept: Sequence[str]) -> DataFrame:
    """files (path, content and columns that are kept) through a function of batches to the schema's columns and those kept."""
    fields = [*T.StructType.fromDDL(schema).fields, *(files.schema[k] for k in kept)]
    return files.select(*dict.fromkeys(["path", "content", *kept])).mapInArrow(run, T.StructType(fields))


def _unpacked(batches: Iterator[pa.RecordBatch], kept: Sequence[str] = ()) -> Iterator[pa.RecordBatch]:
    def rows(b: pa.RecordBatch) -> Iterator[tuple[tuple, int]]:
        for path, data in zip(b.column("path"), b.column("content")):
            manifest, members, wrong = unpack(data.as_py())
            yield (path.as_py(), manifest, list(members.items()), wrong), sum(map(len, members.values())) + len(manifest or "") + (len(data.as_py() or b"") if "content" in kept else 0)

    for b in batches:
        yield from sliced(b, rows(b), ["path", "manifest", "members", "error"], _TYPES, kept)


def read_containers(files: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """files (path, content) as path, manifest (a struct), members and error, with the files' columns that are kept."""
    raw = mapped(files, lambda batches: _unpacked(batches, kept), MEMBERS, kept)
    read = F.from_json("manifest", MANIFEST)
    broken = F.when(F.col("error").isNull() & (F.col("manifest").isNull() | read["version"].isNull()), "manifest.json isn't valid").otherwise(F.col("error"))
    return raw.select("path", read.alias("manifest"), "members", broken.alias("error"), *kept)


def read_folder(spark: SparkSession, path: str, suffix: str = "zip") -> DataFrame:
    return read_containers(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(path))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, begin = [], 0
        for i, (m, x) in enumerate(zip(b.column("manifest"), b.column("members")), 1):
            data.append(pack(m.as_py(), dict(x.as_py() or [])))
            if i == b.num_rows or i - begin >= ROWS_AT_ONCE or sum(map(len, data)) >= BYTES_AT_ONCE:
                yield pa.RecordBatch.from_arrays([b.column("path").slice(begin, i - begin), pa.array(data, pa.binary()), pa.array([len(d) for d in data], pa.int64())], names=["path", "content", "size"])
                data, begin = [], i


def pack_containers(plans: DataFrame) -> DataFrame:
    """plans (path, manifest text, members) as path, content and size: a dry run writes nothing and has the size."""
    return plans.select("path", "manifest", "members").mapInArrow(_packed, "path string, content binary, size long")


def member(members, stem: str, kind: str):
    """The first present member of the kind's suffixes."""
    return F.coalesce(*[F.try_element_at(members, F.lit(f"{stem}.{s}")) for s in LOOKUP[kind]])


def audit(containers: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """path, problems and ok, with the columns that are kept: every declared face and region must be well formed and have its crop."""
    from emulsia.functions.boxes import well_formed

    names = F.coalesce(F.map_keys("members"), F.array().cast("array<string>"))
    has = lambda stem, kind: F.exists(F.array(*[F.concat(stem, F.lit(f".{s}")) for s in LOOKUP[kind]]), lambda n: F.array_contains(names, n))

    def entries(field: str, folder: str) -> list:
        items = F.coalesce(F.col(f"manifest.{field}"), F.array().cast(containers.schema["manifest"].dataType[field].dataType))
        label = lambda i, what: F.concat(F.lit(f"{field[:-1]} "), i.cast("string"), F.lit(f": {what}"))
        broken = F.transform(items, lambda e, i: F.when(~well_formed(e["bbox"]), label(i, "malformed bbox")))
        missing = F.transform(items, lambda e, i: F.when(~has(F.concat(F.lit(f"{folder}/"), F.lpad(i.cast("string"), 3, "0")), "crop"), label(i, "missing crop")))
        return [broken, missing]

    background = F.array(F.when(F.col("error").isNull() & ~has(F.lit("background"), "background"), F.lit("missing background")))
    unreadable = F.array(F.col("error"))
    problems = F.filter(F.concat(unreadable, background, *entries("faces", "faces"), *entries("regions", "regions")), lambda p: p.isNotNull())
    return containers.select("path", problems.alias("problems"), (F.size(problems) == 0).alias("ok"), *kept)


def manifest_text(filename: str, width: int, height: int, faces: list[dict], regions: list[dict] | None = None) -> str:
    """A manifest of the present version."""
    return json.dumps({"version": VERSION, "mode": "aggressive", "original": {"filename": filename, "width": width, "height": height}, "faces": faces, "regions": regions or []}, sort_keys=True)
