"""Detectors as plug-ins: a named factory gives a function from image bytes to boxes, run in Arrow batches.

haar runs a cascade that a file holds; the other built-in names are those of libraries that aren't installed here, so
they need a plug-in to run them (`provide`) and are an error without one; an image that can't be read, or a detector that fails, gives an empty list and an error beside it, never a failed job.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsia.errors import DetectorError

Detect = Callable[[bytes], list[tuple[int, int, int, int, float]]]
#: The names that plug-ins may not take.
BUILT_IN = ("haar", "yunet", "mediapipe")
_plugins: dict[str, Callable[..., Detect]] = {}
_BOX = pa.struct([("x1", pa.int32()), ("y1", pa.int32()), ("x2", pa.int32()), ("y2", pa.int32()), ("confidence", pa.float64())])
FOUND = "path string, faces array<struct<x1:int,y1:int,x2:int,y2:int,confidence:double>>, error string"


def register_detector(name: str, factory: Callable[..., Detect]) -> None:
    for bad, why in ((not isinstance(name, str) or not name, "needs a name"), (name in BUILT_IN, "is built in"), (name in _plugins, "is taken"), (not callable(factory), "needs a callable factory")):
        if bad:
            raise DetectorError(f"detector {name!r} {why}")
    _plugins[name] = factory


def unregister_detector(name: str) -> None:
    if name in BUILT_IN:
        raise DetectorError(f"detector {name!r} is built in")
    _plugins.pop(name, None)


def registered_detectors() -> tuple[str, ...]:
    return tuple(sorted(n for n in _plugins if n not in BUILT_IN))


def known_backends() -> tuple[str, ...]:
    return BUILT_IN + registered_detectors()


def provide(name: str, factory: Callable[..., Detect]) -> None:
    """Gives a built-in name the factory of an installed library."""
    if name not in BUILT_IN or not callable(factory):
        raise DetectorError(f"{name!r} isn't a built-in detector, or its factory isn't callable")
    _plugins[name] = factory


def create_detector(name: str, **settings: object) -> Detect:
    """The plug-in's function; a built-in name that nothing provides is an error, never a detector that finds nothing."""
    if name in _plugins:
        return _plugins[name](**settings)
    if name == "haar":
        return _haar(**settings)
    if name in BUILT_IN:
        raise DetectorError(f"detector {name!r} needs an image library: install one and call detectors.provide({name!r}, factory), or register a detector of your own")
    raise DetectorError(f"unknown detector {name!r}")


def _haar(cascade: str | None = None, **_: object) -> Detect:
    """A function that finds faces by the cascade in a file (an XML; else that of EMULSIA_HAAR_CASCADE); its faces are sure."""
    from emulsia import photos
    from emulsia.functions import cascade as C

    path = cascade or os.environ.get("EMULSIA_HAAR_CASCADE")
    if not path:
        raise DetectorError("detector 'haar' needs a cascade: give the path of its XML, or set EMULSIA_HAAR_CASCADE")
    try:
        with open(path, "rb") as file:
            trained = C.read(file.read())
    except OSError as e:
        raise DetectorError(f"the cascade can't be read: {e}") from e

    def run(data: bytes) -> list[tuple[int, int, int, int, float]]:
        gray = photos.luma(photos.eight_bits(photos.load(data).image))
        return [(*box, 1.0) for box in C.faces(trained, gray.round().astype("uint8"))]

    return run


def create_hand_detector(name: str | None, **settings: object) -> Detect | None:
    """The plug-in that finds hands, none where none is asked for or provided: hands are then guessed from the faces."""
    if name is None or (name in BUILT_IN and name not in _plugins):
        return None
    return create_detector(name, **settings)


def detect(files: DataFrame, name: str, **settings: object) -> DataFrame:
    """files (path, content) to path, faces and error; call it on cache misses only."""
    run = create_detector(name, **settings)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            faces, errors = [], []
            for data in b.column("content").to_pylist():
                try:
                    faces.append([dict(zip(("x1", "y1", "x2", "y2", "confidence"), f)) for f in run(data)])
                    errors.append(None)
                except Exception as e:  # one image must not end the job
                    faces.append([])
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(faces, pa.list_(_BOX)), pa.array(errors, pa.string())], names=["path", "faces", "error"])

    return files.select("path", "content").mapInArrow(batches, FOUND)


def post_filter(found: DataFrame, width: int, height: int, nms_iou: float = 0.3, min_size_ratio: float = 0.05, max_aspect_ratio: float = 1.6) -> DataFrame:
    """path and faces: plausible boxes, most confident, then largest first, none overlapping a kept one by more than nms_iou."""
    from emulsia.functions import boxes as B

    w, h = lambda f: f["x2"] - f["x1"], lambda f: f["y2"] - f["y1"]
    plausible = lambda f: (w(f) > 0) & (h(f) > 0) & (F.least(w(f), h(f)) >= min_size_ratio * min(width, height)) & (F.greatest(w(f) / h(f), h(f) / w(f)) <= max_aspect_ratio)
    keyed = F.transform(F.filter("faces", plausible), lambda f, i: F.struct((-f["confidence"]).alias("c"), (-B.area(f)).alias("a"), i.alias("i"), f.alias("f")))
    ranked = F.transform(F.sort_array(keyed), lambda k: k["f"])
    return found.select("path", B.suppress(ranked, nms_iou, True, "struct<x1:int,y1:int,x2:int,y2:int,confidence:double>").alias("faces"))


def faces_in_clips(frames: DataFrame) -> DataFrame:
    """(path, faces) from frames (path, faces): the most faces of a sampled frame; a frame that failed counts as none."""
    return frames.groupBy("path").agg(F.max(F.coalesce(F.size("faces"), F.lit(0))).cast("int").alias("faces"))
