"""Photos end to end: load, encode faithfully, or plan a container and restore it; each runs in Arrow batches.

A file is independent of the others, so nothing is shuffled; one that fails is a row with the error. Codecs and detectors
are plug-ins; the built-in PNG and JPEG make all of it work without any.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsia import codecs
from emulsia.errors import ContainerError, EmulsiaError, PlanError, RestoreError, SkipFile
from emulsia.functions import align, exif, heif, perceptual, pixels, png, restore
from emulsia.functions.search import QUALITY
from emulsia.sources import container

Box = tuple[int, int, int, int]
Detect = Callable[[np.ndarray], list[tuple[int, int, int, int, float]]]
#: The least sides and scales, and the bounds of a mask's margin.
DETAIL_FLOOR, THUMB_HEIGHT, THUMB_QUALITY, MARGINS = 0.5, 256, 80, (8, 32)
#: Turns of the array for each EXIF orientation: mirrored left to right first, then quarter turns against the clock.
TURNS = {1: (False, 0), 2: (True, 0), 3: (False, 2), 4: (True, 2), 5: (True, 1), 6: (False, 3), 7: (True, 3), 8: (False, 1)}


@dataclass
class Photo:
    """Upright pixels with what the file said about them."""

    image: np.ndarray
    exif: bytes | None = None
    icc: bytes | None = None
    orientation: int = 1
    gain: np.ndarray | None = None
    gain_xmp: bytes | None = None

    @property
    def bits(self) -> int:
        return 8 * self.image.dtype.itemsize


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    mirrored, quarters = TURNS.get(orientation, (False, 0))
    return np.ascontiguousarray(np.rot90(image[:, ::-1] if mirrored else image, quarters))


def load(data: bytes, strip_place: bool = False) -> Photo:
    """A photo turned upright, its EXIF block saying so, and without its place if that is asked; grey becomes three channels.

    A gain map behind the picture is stored unturned like the picture, so it is turned with it. A decoder of HEIF turns
    what it decodes, so neither is turned again; a gain map there that can't be decoded is left out.
    """
    image = codecs.decode(data)
    if heif.owns(data):
        return _from_items(data, image, strip_place)
    block, icc = png.extras(data) if data.startswith(png.SIGNATURE) else (exif.exif_of(data), exif.profile_of(data)) if data[:2] == b"\xff\xd8" else (None, None)
    turn = exif.read_orientation(block)
    photo = Photo(upright(coloured(image), turn), cleaned(block, strip_place), icc, turn)
    if found := exif.gain_map_of(data) if data[:2] == b"\xff\xd8" else None:
        photo.gain, photo.gain_xmp = upright(codecs.decode(found[1]), turn), found[2]
    return photo


def coloured(image: np.ndarray) -> np.ndarray:
    """Three channels: without a mask, and grey three times."""
    if image.ndim == 3 and image.shape[2] in (2, 4):
        image = image[..., :-1]
    return np.repeat(image.reshape(*image.shape[:2], 1), 3, axis=2) if image.ndim == 2 or image.shape[2] == 1 else image


def cleaned(block: bytes | None, strip_place: bool) -> bytes | None:
    """An EXIF block that says upright, without its place if that is asked."""
    block = exif.upright(block)
    return exif.without_place(block) if strip_place else block


def _from_items(data: bytes, image: np.ndarray, strip_place: bool) -> Photo:
    found = heif.Heif(data)
    block = found.exif()
    photo = Photo(coloured(image), cleaned(block, strip_place), found.items[found.primary].profile, exif.read_orientation(block))
    if gain := found.gain_map():
        try:
            photo.gain = codecs.decode(found.picture(gain.id))
        except EmulsiaError:
            pass
    return photo


def load_any(data: bytes) -> Photo:
    """A photo from a picture or, rebuilt without a model, from a container."""
    return rebuild(data) if data[:2] == b"PK" else load(data)


def luma(image: np.ndarray) -> np.ndarray:
    """Grey values from 0 to 255."""
    return codecs.unit(image) @ np.array([0.299, 0.587, 0.114]) * 255


def encoded(photo: Photo, names: list[str], quality: int | None | Callable[[str], int], thorough: bool = False) -> tuple[str, bytes, float | None]:
    """The smallest of the installed codecs' encodings, checked, the first on a tie; the quality may depend on the codec."""
    tried = [(n, codecs.encode(photo.image, n, quality(n) if callable(quality) else quality)) for n in names if codecs.available(n)]
    if not tried:
        raise PlanError(f"none of the codecs {', '.join(names)} is installed")
    name, data = min(tried, key=lambda x: len(x[1]))
    score = codecs.checked(data, photo.image, thorough)
    if name == "png" and (photo.exif or photo.icc):
        data = png.encode(photo.image, photo.exif, photo.icc)
    return name, data, score


#: How alike a picture is to the one before it, the higher the better.
METRICS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {"ssimulacra2": perceptual.score, "ssim": codecs.similarity}


def tuned(image: np.ndarray, boxes: list[Box], name: str, settings: dict[str, object]) -> int:
    """The least quality at which the codec keeps the part of the picture that holds all boxes at the target of the metric.

    Only that part is encoded, in 8 bits; a probe that fails counts as below the target. Without boxes it is the set quality.
    """
    if not boxes:
        return int(settings["faithful.quality"])
    x1, y1, x2, y2 = (f(b[k] for b in boxes) for k, f in enumerate((min, min, max, max)))
    part = np.ascontiguousarray(eight_bits(image[y1:y2, x1:x2]))
    metric, target = METRICS[str(settings["faithful.target_metric"])], float(settings["faithful.target_value"])
    low, high, probes = QUALITY
    best = None
    for _ in range(probes):
        middle = (low + high) // 2
        if metric(part, codecs.decode(codecs.encode(part, name, middle))) >= target:
            best, high = middle, middle - 1
        else:
            low = middle + 1
    return high if best is None else best


def mask(height: int, width: int) -> np.ndarray:
    """A feathered mask whose margin is an eighth of the width, within MARGINS."""
    margin = max(MARGINS[0], min(MARGINS[1], width // 8))
    y, x = np.arange(height)[:, None], np.arange(width)[None, :]
    edge = np.minimum(np.minimum(y, height - 1 - y), np.minimum(x, width - 1 - x))
    return np.clip(edge / margin, 0.0, 1.0)


@dataclass
class Plan:
    """What of a photo is kept sharp, and how small the rest becomes."""

    scale: float
    faces: list[dict] = field(default_factory=list)
    regions: list[Box] = field(default_factory=list)
    reason: str | None = None


def padded(face: tuple, width: int, height: int, settings: dict[str, object]) -> Box:
    x1, y1, x2, y2, *_ = face
    pad = float(settings["detector.padding"])
    cx, cy, hw, hh = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) * pad / 2, (y2 - y1) * pad / 2
    return max(0, int(cx - hw)), max(0, int(cy - hh)), min(width, int(cx + hw)), min(height, int(cy + hh))


def plan(photo: Photo, found: list[tuple[int, int, int, int, float]], settings: dict[str, object]) -> Plan:
    """Faces as padded boxes, small faces as regions too, and the scale, raised where the background can't be made anew."""
    height, width = photo.image.shape[:2]
    faces = [{"id": i, "bbox": [*f[:4]], "padded_bbox": [*padded(f, width, height, settings)], "confidence": f[4]} for i, f in enumerate(found)]
    out = Plan(float(settings["aggressive.bg_scale"]), faces)
    if not faces:
        strategy = settings["aggressive.no_face_strategy"]
        if strategy == "skip":
            raise SkipFile("no faces")
        if strategy == "conservative":
            out.scale = float(settings["aggressive.no_face_bg_scale"])
    if settings["aggressive.content_aware"]:
        short = float(settings["aggressive.small_face_ratio"]) * min(width, height)
        small = [f for f in faces if 0 < min(f["bbox"][2] - f["bbox"][0], f["bbox"][3] - f["bbox"][1]) < short]
        if settings["aggressive.region_local"]:
            out.regions = [tuple(f["padded_bbox"]) for f in small if f["padded_bbox"][2] > f["padded_bbox"][0] and f["padded_bbox"][3] > f["padded_bbox"][1]]
        detail = pixels.detail_ratio(luma(photo.image)) > float(settings["aggressive.text_edge_threshold"])
        why = "small face" if small else "detail" if detail else None
        floor = float(settings["aggressive.conservative_bg_scale"])
        if why and out.scale < floor:
            out.scale, out.reason = floor, why
    return out


def shrunk(image: np.ndarray, scale: float) -> np.ndarray:
    size = tuple(max(1, int(n * scale)) for n in image.shape[:2])
    planes = [pixels.resized(image[..., k].astype(float), *size) for k in range(image.shape[2])]
    return _samples(np.stack(planes, axis=2), image.dtype)


def _samples(x: np.ndarray, dtype: np.dtype) -> np.ndarray:
    return np.clip(np.rint(x), 0, np.iinfo(dtype).max).astype(dtype)


def eight_bits(image: np.ndarray) -> np.ndarray:
    return image if image.dtype == np.uint8 else _samples(image / 257.0, np.dtype(np.uint8))


def member(image: np.ndarray, codec: str, quality: int, lossless_from: int = 101) -> tuple[str, bytes]:
    """The suffix and bytes of a member: PNG from a quality on, else the codec that is asked for, or JPEG where it isn't installed."""
    kind = "png" if quality >= lossless_from else codec if codecs.available(codec) else "jpg"
    return kind, codecs.encode(np.ascontiguousarray(image), kind, quality)


def pack(name: str, data: bytes, photo: Photo, chosen: Plan, settings: dict[str, object]) -> bytes:
    """The container of a photo: a small background, sharp crops and regions, and, if asked, what the background lacks."""
    image = eight_bits(photo.image)
    height, width = image.shape[:2]
    bg_kind, background = member(shrunk(image, chosen.scale), str(settings["aggressive.bg_codec"]), int(settings["aggressive.bg_quality"]))
    members = {f"background.{bg_kind}": background, "thumbnail.jpg": codecs.encode(shrunk(image, min(1.0, THUMB_HEIGHT / height)), "jpg", THUMB_QUALITY)}
    crops = [(f"faces/{i:03}", f["padded_bbox"]) for i, f in enumerate(chosen.faces)] + [(f"regions/{i:03}", r) for i, r in enumerate(chosen.regions)]
    for stem, (x1, y1, x2, y2) in crops:
        kind, crop = member(image[y1:y2, x1:x2], str(settings["aggressive.face_codec"]), int(settings["aggressive.face_quality"]), 100)
        members[f"{stem}.{kind}"] = crop
    if settings["aggressive.residual"]:
        lack = image.astype(float) - enlarged(codecs.decode(background), height, width)
        codes = np.clip(np.rint(lack / 2 + 128), 0, 255).astype(np.uint8)
        kind, residual = member(shrunk(codes, float(settings["aggressive.residual_scale"])), "jxl", int(settings["aggressive.residual_quality"]))
        members[f"residual.{kind}"] = residual
    if photo.exif:
        members["exif.bin"] = photo.exif
    if photo.icc:
        members["icc.bin"] = photo.icc
    gain = photo.gain is not None and bool(settings["faithful.preserve_gain_map"])
    if gain:
        members |= {"gain_map.png": png.encode(photo.gain), "gain_map.xmp": photo.gain_xmp or b""}
    manifest = json.loads(container.manifest_text(name, width, height, chosen.faces, [{"id": i, "bbox": list(r), "scale": 1.0} for i, r in enumerate(chosen.regions)]))
    manifest["original"] |= {"size_bytes": len(data), "hash_sha256": hashlib.sha256(data).hexdigest(), "orientation": photo.orientation}
    manifest |= {"exif_preserved": photo.exif is not None, "icc_preserved": photo.icc is not None, "gain_map_preserved": gain, "settings": {"bg_scale": chosen.scale, "bg_quality": int(settings["aggressive.bg_quality"]), "bg_codec": bg_kind, "face_quality": int(settings["aggressive.face_quality"]), "face_codec": str(settings["aggressive.face_codec"]), "blend_mode": settings["aggressive.blend_mode"], "residual": bool(settings["aggressive.residual"]), "preset": settings["aggressive.preset"], "bit_depth": 8}}
    return container.pack(json.dumps(manifest, sort_keys=True), members)


def enlarged(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return np.stack([pixels.resized(image[..., k].astype(float), height, width) for k in range(image.shape[2])], axis=2)


def grain_of(crops: list[np.ndarray]) -> float:
    """The median over the crops of the robust deviation of what a blur takes away, in grey values."""
    found = []
    for c in crops:
        grey = luma(c)
        fine = grey - restore.gaussian(grey, 1.0)
        found.append(1.4826 * float(np.median(np.abs(fine - np.median(fine)))))
    return float(np.median(found)) if found else 0.0


def unpack(data: bytes) -> tuple[dict, dict[str, bytes]]:
    manifest, members, wrong = container.unpack(data)
    try:
        whole = json.loads(manifest) if manifest is not None else None
    except ValueError as e:
        raise ContainerError("the manifest isn't JSON") from e
    if wrong or whole is None:
        raise ContainerError(wrong or "the manifest is missing")
    return whole, members


@dataclass
class Enhancer:
    """A model of faces: `find` gives five landmarks for each face of a picture, `enhance` a better upright face of the same shape."""

    find: Callable[[np.ndarray], list[np.ndarray]]
    enhance: Callable[[np.ndarray], np.ndarray]


def rebuild(data: bytes, upscale: Callable[[np.ndarray, int, int], np.ndarray] | None = None, settings: dict[str, object] | None = None, enhancer: Enhancer | None = None) -> Photo:
    """A photo from its container: the background enlarged (by a model, if one is given), then regions, then faces.

    An enhancer works on the faces that only the background holds: stored crops are laid over what it made.

    What a model made is anchored to the stored background and, if asked, moved to shrink to it; a residual replaces the
    model. Grain of the crops' strength is laid over the background.
    """
    return rebuilt(*unpack(data), upscale, settings, enhancer)


def rebuilt(manifest: dict, members: dict[str, bytes], upscale: Callable[[np.ndarray, int, int], np.ndarray] | None = None, settings: dict[str, object] | None = None, enhancer: Enhancer | None = None) -> Photo:
    """A photo from its container's manifest and members, as `rebuild` says."""
    from emulsia.settings import DEFAULTS

    chosen = settings or DEFAULTS
    width, height = manifest["original"]["width"], manifest["original"]["height"]
    scale = float((manifest.get("settings") or {}).get("bg_scale") or chosen["aggressive.bg_scale"])
    stored = next((members[n] for n in (f"background.{s}" for s in container.LOOKUP["background"]) if n in members), None)
    if stored is None:
        raise RestoreError("the container has no background")
    try:
        background = codecs.decode(stored)
        residual = next((codecs.decode(members[n]) for n in (f"residual.{s}" for s in container.LOOKUP["residual"]) if n in members), None)
        crop = lambda stem: next(members[n] for n in (f"{stem}.{s}" for s in container.LOOKUP["crop"]) if n in members)
        patches = {kind: [codecs.decode(crop(f"{kind}/{i:03}")) for i in range(len(manifest.get(kind) or []))] for kind in ("regions", "faces")}
    except (StopIteration, EmulsiaError) as e:
        raise RestoreError(f"a member is missing or can't be read: {e}") from e
    if residual is not None:
        out = enlarged(background, height, width) + 2 * (enlarged(residual, height, width) - 128)
    elif upscale is not None:
        out = upscale(background, height, width).astype(float)
        if chosen["aggressive.restore_anchor"]:
            plain = enlarged(background, height, width)
            out = out + restore.gaussian(plain - out, 1 / scale)
        for _ in range(int(chosen["aggressive.restore_backproject_iters"])):
            small = np.stack([pixels.resized(out[..., k], *background.shape[:2]) for k in range(3)], axis=2)
            out = out + 0.5 * enlarged(background - small, height, width)
    else:
        out = enlarged(background, height, width)
    if enhancer is not None:
        out = align.enhanced(out, enhancer.find(np.clip(out, 0, 255)), enhancer.enhance, float(chosen["aggressive.face_enhance_strength"]))
    if chosen["aggressive.restore_grain"]:
        strength = grain_of(patches["faces"] or patches["regions"])
        if strength > 0:
            out = out + restore.grain((height, width), strength)[..., None]
    out = np.clip(out, 0, 255)
    boxes = [(kind, tuple(e["bbox"] if kind == "regions" else e["padded_bbox"])) for kind in ("regions", "faces") for e in manifest.get(kind) or []]
    pictures = [*patches["regions"], *patches["faces"]]
    laid = [(b, enlarged(p, b[3] - b[1], b[2] - b[0]), mask(b[3] - b[1], b[2] - b[0])) for (_, b), p in zip(boxes, pictures)]
    if (manifest.get("settings") or {}).get("blend_mode") == "poisson":
        for b, p, _ in laid:
            out = np.clip(restore.poisson(out, b, p), 0, 255)
        laid = []
    gain = png.decode(members["gain_map.png"]) if "gain_map.png" in members else None
    return Photo(_samples(restore.composite(out, laid), np.dtype(np.uint8)), members.get("exif.bin"), members.get("icc.bin"), gain=gain, gain_xmp=members.get("gain_map.xmp"))


RESULT = "path string, status string, codec string, content binary, original_size long, compressed_size long, faces int, similarity double, error string"
_TYPES = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.string()]
_NAMES = ["path", "status", "codec", "content", "original_size", "compressed_size", "faces", "similarity", "error"]


def _each(files: DataFrame, one: Callable[[str, bytes], tuple], kept: Sequence[str] = ()) -> DataFrame:
    """files (path, content) through one(path, bytes) to (status, codec, content, faces, similarity), with the columns that are kept."""
    plugins = codecs.plugins()

    def rows(b: pa.RecordBatch) -> Iterator[tuple[tuple, int]]:
        for path, data in ((p.as_py(), d.as_py()) for p, d in zip(b.column("path"), b.column("content"))):  # one file in memory at a time beside the batch and the slice
            size = len(data or b"")
            try:
                status, codec, out, faces, score = one(path, data or b"")
                yield (path, status, codec, out, size, len(out), faces, score, None), len(out)
            except SkipFile as e:
                yield (path, "skipped", None, None, size, None, None, None, str(e)), 0
            except Exception as e:  # one file must not end the batch
                yield (path, "failed", None, None, size, None, None, None, f"{type(e).__name__}: {e}"), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.install(plugins)
        for b in batches:
            yield from container.sliced(b, rows(b), _NAMES, _TYPES, kept)

    return container.mapped(files, run, RESULT, kept)


def compress_faithful(files: DataFrame, settings: dict[str, object], detect: Detect | None = None) -> DataFrame:
    """Files (path, content) as RESULT rows: the smallest encoding, or `skipped-larger` with the original.

    With faithful.auto_tune and a detector, a codec's quality is the least that keeps the faces at the metric's target.
    """
    names = ["avif", "jxl"] if settings["faithful.codec"] == "both" else [str(settings["faithful.codec"])]
    quality = None if settings["faithful.lossless"] else int(settings["faithful.quality"])

    def one(path: str, data: bytes) -> tuple:
        photo = load(data, bool(settings["strip_gps"]))
        found = detect(photo.image) if detect else None
        boxes = [padded(f, *photo.image.shape[1::-1], settings) for f in found or []]
        chosen = (lambda name: tuned(photo.image, boxes, name, settings)) if settings["faithful.auto_tune"] and quality is not None else quality
        codec, out, score = encoded(photo, [*names, "png"] if settings["faithful.lossless"] else names, chosen, bool(settings["faithful.verify_thorough"]))
        faces = None if found is None else len(found)
        if settings["faithful.skip_if_larger"] and quality is not None and len(out) >= len(data):
            return "skipped-larger", None, data, faces, score
        return "ok", codec, out, faces, score

    return _each(files, one)


def compress_photos(files: DataFrame, settings: dict[str, object], detect: Detect) -> DataFrame:
    """Files (path, content) as RESULT rows whose content is a container."""

    def one(path: str, data: bytes) -> tuple:
        photo = load(data, bool(settings["strip_gps"]))
        chosen = plan(photo, detect(photo.image), settings)
        return "ok", "container", pack((path or "").rsplit("/", 1)[-1], data, photo, chosen, settings), len(chosen.faces), None

    return _each(files, one)


def restore_photos(containers: DataFrame, settings: dict[str, object] | None = None, upscale: Callable[[np.ndarray, int, int], np.ndarray] | None = None, enhancer: Enhancer | None = None, kept: Sequence[str] = ()) -> DataFrame:
    """Containers (path, content) as RESULT rows whose content is a PNG, with the columns that are kept; models are functions that the job takes along."""

    def one(path: str, data: bytes) -> tuple:
        manifest, members = unpack(data)
        photo = rebuilt(manifest, members, upscale, settings, enhancer)
        return "ok", "png", png.encode(photo.image, photo.exif, photo.icc), len(manifest.get("faces") or []), None

    return _each(containers, one, kept)


def bench(files: DataFrame, settings: dict[str, object], detect: Detect) -> DataFrame:
    """A benchmark's rows of both modes: the sizes, the ratio, and the similarity of what comes back; nothing is written."""

    def aggressive(path: str, data: bytes) -> tuple:
        photo = load(data, bool(settings["strip_gps"]))
        chosen = plan(photo, detect(photo.image), settings)
        out = pack((path or "").rsplit("/", 1)[-1], data, photo, chosen, settings)
        return "ok", "container", out, len(chosen.faces), codecs.similarity(photo.image, rebuild(out, settings=settings).image)

    modes = {"faithful": compress_faithful(files, settings | {"faithful.verify_thorough": True}, detect), "aggressive": _each(files, aggressive)}
    rows = None
    for mode, done in modes.items():
        ok = F.col("status").isin("ok", "skipped-larger")
        cells = done.select(
            F.col("path").alias("file"), F.lit(mode).alias("mode"), "status", F.when(ok, F.try_divide(F.col("original_size").cast("double"), F.col("compressed_size"))).alias("ratio"), F.col("similarity").alias("ssim"),
            F.lit(None).cast("double").alias("restore_lpips"), "faces", F.when(ok, F.col("original_size")).alias("original_bytes"), F.when(ok, F.col("compressed_size")).alias("output_bytes"), "error",
        )
        rows = cells if rows is None else rows.unionByName(cells)
    return rows
