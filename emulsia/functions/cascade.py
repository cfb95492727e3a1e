"""Faces by a boosted cascade over rectangle sums: read from a file, run over a pyramid of sizes, and grouped.

A window is normalised by the deviation of its pixels. All windows of a size are tested at once: each stage sees only
those that passed the ones before, and a rectangle's sum is four looks into the table of sums.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emulsia.errors import DetectorError
from emulsia.functions import pixels

#: Growth from size to size, neighbours that a face needs, how far alike boxes may be apart, and the slack of a stage.
GROWTH, NEIGHBOURS, APART, SLACK = 1.1, 5, 0.2, 1e-5
LEAST_SIDE, LEAST_SHARE = 30, 0.04


@dataclass
class Stage:
    """Its threshold, and for each tree the nodes (left, right, feature, threshold) and the values of the leaves; negative and zero are leaves."""

    threshold: float
    trees: list[tuple[list[tuple[int, int, int, float]], list[float]]]


@dataclass
class Cascade:
    width: int
    height: int
    stages: list[Stage]
    features: list[list[tuple[int, int, int, int, float]]]  # rectangles (x, y, width, height, weight)


def read(text: str | bytes) -> Cascade:
    """A cascade from the XML in which trained ones are published: upright rectangle features only."""
    try:
        root = ET.fromstring(text)
        top = root.find("cascade")
        if top is None or top.findtext("featureType", "").strip() != "HAAR":
            raise DetectorError("not a cascade of rectangle features")
        numbers = lambda e: [float(x) for x in (e.text or "").split()]
        features = []
        for f in top.find("features"):
            if (f.findtext("tilted") or "0").strip() not in ("0", ""):
                raise DetectorError("a cascade with tilted features isn't supported")
            features.append([(*(int(v) for v in r[:4]), r[4]) for r in (numbers(e) for e in f.find("rects"))])
        stages = []
        for s in top.find("stages"):
            trees = []
            for w in s.find("weakClassifiers"):
                nodes, leaves = numbers(w.find("internalNodes")), numbers(w.find("leafValues"))
                trees.append(([(int(a), int(b), int(c), d) for a, b, c, d in zip(*[iter(nodes)] * 4)], leaves))
            stages.append(Stage(float(s.findtext("stageThreshold")), trees))
        cascade = Cascade(int(top.findtext("width")), int(top.findtext("height")), stages, features)
    except (ET.ParseError, AttributeError, TypeError, ValueError, IndexError) as e:
        raise DetectorError(f"the cascade can't be read: {e}") from e
    if any(x < 0 or y < 0 or x + w > cascade.width or y + h > cascade.height for f in cascade.features for x, y, w, h, _ in f):
        raise DetectorError("a feature of the cascade lies outside of its window")
    for nodes, leaves in (t for s in cascade.stages for t in s.trees):
        if any(f >= len(cascade.features) or max(a, b) >= len(nodes) or min(a, b) <= -len(leaves) for a, b, f, _ in nodes) or any(0 < c <= i for i, n in enumerate(nodes) for c in n[:2]):
            raise DetectorError("a tree of the cascade refers to what isn't there")
    return cascade


def _sums(gray: np.ndarray) -> np.ndarray:
    return np.pad(np.cumsum(np.cumsum(gray.astype(np.int64), axis=0), axis=1), ((1, 0), (1, 0)))


class Level:
    """A picture at one size, with its windows' places and norms."""

    def __init__(self, cascade: Cascade, gray: np.ndarray, step: int):
        self.cascade, self.sums = cascade, _sums(gray)
        y, x = np.mgrid[0 : gray.shape[0] - cascade.height + 1 : step, 0 : gray.shape[1] - cascade.width + 1 : step]
        self.y, self.x = y.ravel(), x.ravel()
        inner = (1, 1, cascade.width - 2, cascade.height - 2)
        area = inner[2] * inner[3]
        squares = _sums(gray.astype(np.int64) ** 2)
        spread = area * self.rectangle(*inner, squares) - self.rectangle(*inner) ** 2
        self.norm = np.where(spread > 0, np.sqrt(np.maximum(spread, 1)), 1.0)

    def rectangle(self, x: int, y: int, width: int, height: int, sums: np.ndarray | None = None) -> np.ndarray:
        s, top, left = self.sums if sums is None else sums, self.y + y, self.x + x
        return s[top + height, left + width] - s[top, left + width] - s[top + height, left] + s[top, left]

    def keep(self, mask: np.ndarray) -> None:
        self.y, self.x, self.norm = self.y[mask], self.x[mask], self.norm[mask]

    def passed(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows that pass all stages."""
        for stage in self.cascade.stages:
            if not len(self.y):
                break
            total = np.zeros(len(self.y))
            for nodes, leaves in stage.trees:
                total += self._tree(nodes, np.array(leaves))
            self.keep(total >= stage.threshold - SLACK)
        return self.y, self.x

    def _tree(self, nodes: list, leaves: np.ndarray) -> np.ndarray:
        at = np.zeros(len(self.y), dtype=np.int64)
        out = np.zeros(len(self.y))
        for i, (left, right, feature, threshold) in enumerate(nodes):  # children come behind their parents
            value = sum(weight * self.rectangle(*box) for *box, weight in self.cascade.features[feature])
            there = at == i
            to = np.where(value < threshold * self.norm, left, right)
            leaf = there & (to <= 0)
            out[leaf] = leaves[-to[leaf]]
            at = np.where(leaf, -1, np.where(there, to, at))
        return out


def grouped(boxes: np.ndarray, neighbours: int = NEIGHBOURS) -> list[tuple[int, int, int, int]]:
    """Mean boxes (x, y, width, height) of those that are alike, directly or through others, where there are more than `neighbours`."""
    if not len(boxes) or neighbours <= 0:
        return [tuple(b) for b in boxes.tolist()]
    label = np.arange(len(boxes))
    corners = np.column_stack([boxes[:, :2], boxes[:, :2] + boxes[:, 2:]])
    for i in range(len(boxes)):
        reach = APART * (np.minimum(boxes[i, 2], boxes[i + 1 :, 2]) + np.minimum(boxes[i, 3], boxes[i + 1 :, 3])) / 2
        alike = i + 1 + np.flatnonzero((np.abs(corners[i + 1 :] - corners[i]) <= reach[:, None]).all(axis=1))
        if len(alike):
            mine = np.unique(np.append(label[alike], label[i]))
            label[np.isin(label, mine)] = mine[0]
    found = [(np.rint(boxes[label == k].mean(axis=0)).astype(int), int((label == k).sum())) for k in np.unique(label)]
    kept = [(b, n) for b, n in found if n > neighbours]

    def inside(a: np.ndarray, b: np.ndarray) -> bool:
        slack = np.rint(b[2:] * APART)
        return bool((a[:2] >= b[:2] - slack).all() and (a[:2] + a[2:] <= b[:2] + b[2:] + slack).all())

    return [tuple(int(v) for v in a) for i, (a, n) in enumerate(kept) if not any(i != j and (m > max(3, n) or n < 3) and inside(a, b) for j, (b, m) in enumerate(kept))]


def windows(cascade: Cascade, gray: np.ndarray, least: int = 0) -> np.ndarray:
    """Boxes (x, y, width, height) of all windows that pass, over all sizes from `least` on."""
    out, factor = [np.zeros((0, 4), dtype=np.int64)], 1.0
    while True:
        width, height = round(cascade.width * factor), round(cascade.height * factor)
        size = round(gray.shape[0] / factor), round(gray.shape[1] / factor)
        if size[0] < cascade.height or size[1] < cascade.width:
            return np.concatenate(out)
        if min(width, height) >= least:
            small = gray if factor == 1 else np.clip(np.rint(pixels.resized(gray.astype(float), *size)), 0, 255).astype(np.uint8)
            y, x = Level(cascade, small, 1 if factor > 2 else 2).passed()
            out.append(np.column_stack([np.rint(x * factor), np.rint(y * factor), np.full(len(x), width), np.full(len(x), height)]).astype(np.int64))
        factor *= GROWTH


def faces(cascade: Cascade, gray: np.ndarray, least: int | None = None, neighbours: int = NEIGHBOURS) -> list[tuple[int, int, int, int]]:
    """Boxes (x1, y1, x2, y2) of faces; the least side grows with the picture, so that a large one's noise isn't searched."""
    side = max(LEAST_SIDE, int(min(gray.shape) * LEAST_SHARE)) if least is None else least
    return [(x, y, x + w, y + h) for x, y, w, h in grouped(windows(cascade, gray, side), neighbours)]


def raster_faces(cascade: Cascade, width: int, times: int):
    """A function of grey rasters of 0 to 255, row by row: the number of windows that pass, each pixel repeated `times` in both directions."""

    @F.pandas_udf(T.IntegerType())
    def count(values: pd.Series) -> pd.Series:
        cells = np.ones((times, times), dtype=np.uint8)
        return pd.Series([len(windows(cascade, np.kron(np.asarray(v, dtype=np.uint8).reshape(-1, width), cells))) for v in values])

    return count
