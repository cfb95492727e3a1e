"""Settings as dotted keys in layers: defaults, then a preset, then a file, then flags; and their checks.

Resolved settings are literals on the driver; `as_struct` carries those that affect an output into a plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from emulsia.detectors import known_backends
from emulsia.errors import SettingsError

#: The defaults.
DEFAULTS: dict[str, object] = {
    "mode": "faithful", "strip_gps": False,
    "detector.backend": "haar", "detector.confidence": 0.6, "detector.padding": 1.5, "detector.roi": "face", "detector.nms_iou": 0.3, "detector.min_size_ratio": 0.05, "detector.max_aspect_ratio": 1.6,
    "faithful.codec": "avif", "faithful.quality": 70, "faithful.lossless": False, "faithful.speed": 6, "faithful.auto_tune": True, "faithful.target_metric": "ssimulacra2", "faithful.target_value": 90.0,
    "faithful.chroma": "auto", "faithful.output_bit_depth": 10, "faithful.verify": True, "faithful.verify_thorough": False, "faithful.skip_if_larger": True, "faithful.preserve_gain_map": True, "faithful.gain_map_headroom": 3.0,
    "aggressive.bg_scale": 0.25, "aggressive.bg_quality": 85, "aggressive.bg_codec": "jpg", "aggressive.face_quality": 95, "aggressive.face_codec": "jpg", "aggressive.output_bit_depth": 8,
    "aggressive.detector_backend": None, "aggressive.detector_confidence": 0.5, "aggressive.detector_min_size_ratio": 0.02, "aggressive.no_face_strategy": "conservative", "aggressive.no_face_bg_scale": 0.5,
    "aggressive.content_aware": True, "aggressive.conservative_bg_scale": 0.5, "aggressive.region_local": True, "aggressive.region_scale": 1.0, "aggressive.protect_hands": True, "aggressive.protect_hands_backend": None,
    "aggressive.hand_zone_scale": 1.0, "aggressive.hand_zone_max_frac": 0.30, "aggressive.text_edge_threshold": 0.05, "aggressive.small_face_ratio": 0.04, "aggressive.protect_text": False,
    "aggressive.text_region_tile_threshold": 0.06, "aggressive.text_region_max_frac": 0.30, "aggressive.residual": False, "aggressive.residual_scale": 0.5, "aggressive.residual_quality": 60, "aggressive.quality_target": None,
    "aggressive.face_enhance_backend": "gfpgan", "aggressive.face_enhance_fidelity": 0.7, "aggressive.face_enhance_strength": 1.0, "aggressive.restore_anchor": True, "aggressive.restore_backproject_iters": 0,
    "aggressive.restore_grain": True, "aggressive.blend_mode": "gaussian", "aggressive.preset": None,
    "video.enabled": True, "video.crf": 32, "video.preset": 6, "video.vmaf_target": 93.0, "video.auto_tune": False, "video.skip_efficient": True, "video.preserve_dolby_vision": True, "video.face_aware": True,
    "video.face_vmaf_target": 95.0, "video.preserve_live_photos": True,
}
#: What each preset sets.
PRESETS: dict[str, dict[str, object]] = {
    "ratio": {"aggressive.bg_scale": 0.125, "aggressive.bg_codec": "jxl", "aggressive.face_codec": "avif", "aggressive.face_quality": 90, "aggressive.detector_backend": "yunet"},
    "pretty": {"aggressive.bg_scale": 0.25, "aggressive.bg_codec": "avif", "aggressive.detector_backend": "yunet", "aggressive.face_enhance_fidelity": 0.5, "aggressive.face_enhance_strength": 1.0},
    "fidelity": {"aggressive.residual": True, "aggressive.residual_quality": 75, "aggressive.bg_scale": 0.25, "aggressive.bg_codec": "jxl", "aggressive.face_quality": 98, "aggressive.detector_backend": "yunet", "detector.roi": "head_shoulders"},
    "family": {"aggressive.detector_backend": "yunet", "aggressive.protect_hands_backend": "mediapipe", "aggressive.small_face_ratio": 0.06, "detector.roi": "head_shoulders"},
}
PRESETS["share"] = PRESETS["ratio"] | {"strip_gps": True}
#: Settings that a container's restorer takes from the preset it was made with.
RESTORE = ("aggressive.face_enhance_backend", "aggressive.face_enhance_fidelity", "aggressive.face_enhance_strength")


@dataclass(frozen=True)
class Check:
    key: str
    says: str
    allows: Callable[[object], bool]


def among(key: str, *values: object) -> Check:
    return Check(key, f"must be one of {', '.join(map(str, values))}", lambda v: v in values)


def between(key: str, low: float, high: float, open_low: bool = False) -> Check:
    return Check(key, f"must be {'above' if open_low else 'at least'} {low:g} and at most {high:g}", lambda v: v is None or isinstance(v, (int, float)) and (low < v if open_low else low <= v) and v <= high)


CHECKS = [
    among("mode", "faithful", "aggressive"),
    Check("detector.backend", "must be a known backend", lambda v: v in known_backends()),
    between("detector.nms_iou", 0, 1), between("detector.min_size_ratio", 0, float("inf")), between("detector.max_aspect_ratio", 1, float("inf")), among("detector.roi", "face", "head_shoulders", "person"),
    among("faithful.codec", "avif", "jxl", "webp", "both"), between("faithful.quality", 0, 100), among("faithful.output_bit_depth", 10, 12), among("faithful.target_metric", "ssim", "ssimulacra2"),
    between("faithful.gain_map_headroom", 0, 6, True), between("aggressive.bg_scale", 0.05, 1), among("aggressive.face_codec", "jpg", "avif", "jxl"), among("aggressive.bg_codec", "jpg", "avif", "jxl"),
    among("aggressive.output_bit_depth", 8, 10, 12), Check("aggressive.detector_backend", "must be a known backend", lambda v: v is None or v in known_backends()),
    between("aggressive.detector_min_size_ratio", 0, float("inf")), between("aggressive.conservative_bg_scale", 0.05, 1), between("aggressive.text_edge_threshold", 0, 1), between("aggressive.small_face_ratio", 0, 1),
    between("aggressive.text_region_tile_threshold", 0, 1, True), between("aggressive.text_region_max_frac", 0, 1, True), between("aggressive.region_scale", 0, 1, True), between("aggressive.hand_zone_scale", 0, 1, True),
    between("aggressive.hand_zone_max_frac", 0, 1, True), between("aggressive.residual_scale", 0, 1, True), between("aggressive.residual_quality", 1, 100), between("aggressive.face_enhance_fidelity", 0, 1),
    between("aggressive.face_enhance_strength", 0, 1), among("aggressive.blend_mode", "gaussian", "linear", "poisson"), between("video.crf", 0, 63), between("video.preset", 0, 13), between("video.vmaf_target", 0, 100, True),
    between("video.face_vmaf_target", 0, 100, True),
]


def check(settings: dict[str, object]) -> None:
    """Raises for the first setting that isn't allowed."""
    for c in CHECKS:
        if not c.allows(settings[c.key]):
            raise SettingsError(f"{c.key} {c.says}, not {settings[c.key]!r}")


def resolve(file: dict[str, object] | None = None, flags: dict[str, object] | None = None, preset: str | None = None) -> dict[str, object]:
    """Settings from the layers. Unknown keys of a file are ignored, unknown flags are errors; an explicit quality ends the search."""
    if preset is not None and preset not in PRESETS:
        raise SettingsError(f"unknown preset {preset!r}")
    flags = {k: v for k, v in (flags or {}).items() if v is not None}
    if bad := [k for k in flags if k not in DEFAULTS]:
        raise SettingsError(f"unknown setting {bad[0]!r}")
    out = DEFAULTS | PRESETS.get(preset, {}) | {k: v for k, v in (file or {}).items() if k in DEFAULTS} | flags
    out["aggressive.preset"] = preset
    if "faithful.quality" in flags and "faithful.auto_tune" not in flags:
        out["faithful.auto_tune"] = False
    out["faithful.verify"] = bool(out["faithful.verify"] or out["faithful.verify_thorough"])
    check(out)
    return out


def detector_of(settings: dict[str, object]) -> dict[str, object]:
    """The detector's settings in aggressive mode: its own where set, else inherited."""
    own = {n: settings[f"aggressive.detector_{n}"] for n in ("backend", "confidence", "min_size_ratio")}
    base = {k.removeprefix("detector."): v for k, v in settings.items() if k.startswith("detector.")}
    return base | {n: v for n, v in own.items() if v is not None}


def restore_overrides(preset: str | None, explicit: set[str]) -> dict[str, object]:
    """What a container's preset sets for restoring, but for keys set explicitly; unknown presets set nothing."""
    return {k: v for k, v in PRESETS.get(preset, {}).items() if k in RESTORE and k not in explicit}


def as_struct(settings: dict[str, object], prefix: str) -> Column:
    """The settings under a prefix as a struct with sorted names, ready for a fingerprint."""
    return F.struct(*[_literal(v).alias(k.removeprefix(prefix)) for k, v in sorted(settings.items()) if k.startswith(prefix)])


#: The settings of a clip's output, and those of the detector that decide whether a face is found.
CLIP = ("crf", "preset", "vmaf_target", "auto_tune", "skip_efficient", "preserve_dolby_vision", "face_aware", "face_vmaf_target", "preserve_live_photos")
FINDS = ("backend", "confidence", "nms_iou", "min_size_ratio", "max_aspect_ratio")


def _literal(value: object) -> Column:
    if isinstance(value, Column):
        return value
    kind = "string" if value is None else "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
    return F.lit(value).cast(kind)


def clip_struct(settings: dict[str, object]) -> Column:
    """What a clip's output depends on, ready for a fingerprint: the clip settings and, only where faces matter, what
    decides whether one is found. Photo settings aren't in it, so changing them encodes no clip again."""
    fields = {"mode": F.lit("video")} | {k: _literal(settings[f"video.{k}"]) for k in CLIP}
    if settings["video.face_aware"]:
        fields["detector"] = F.struct(*[_literal(settings[f"detector.{k}"]).alias(k) for k in sorted(FINDS)])
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def to_text(settings: dict[str, object], notes: bool = False) -> str:
    """Settings as the text of a file: a section for each prefix; notes add what a setting may be."""
    says = {c.key: c.says for c in CHECKS}
    lines, section = [], None
    for key in sorted(settings, key=lambda k: ("." in k, list(DEFAULTS).index(k) if k in DEFAULTS else len(DEFAULTS))):
        head, _, name = key.rpartition(".")
        if head != section and head:
            lines.append(f"{head}:")
        section = head
        value = settings[key]
        shown = "null" if value is None else str(value).lower() if isinstance(value, bool) else repr(value) if isinstance(value, (int, float)) else f'"{value}"'
        note = f"  # {says[key]}" if notes and key in says else ""
        lines.append(f"{'  ' if head else ''}{name}: {shown}{note}")
    return "\n".join(lines) + "\n"


def default_text() -> str:
    """The text of a file with the defaults, and beside each setting what it may be."""
    return to_text(DEFAULTS, notes=True)


def from_text(text: str) -> dict[str, object]:
    """Settings of a file's text, with dotted keys; an odd line is an error that names it."""
    out: dict[str, object] = {}
    section = ""
    for n, line in enumerate(text.splitlines(), start=1):
        plain = line.split(" #")[0].rstrip()
        if not plain or plain.lstrip().startswith("#"):
            continue
        name, colon, value = plain.strip().partition(":")
        if not colon or not name:
            raise SettingsError(f"line {n} of the settings has no name and value: {line!r}")
        if not plain.startswith(" "):
            section = ""
        value = value.strip()
        if not value:
            section = f"{name}."
            continue
        out[section + name] = _value(value)
    return out


def _value(text: str) -> object:
    if text[0] == text[-1] and text[0] in "'\"" and len(text) > 1:
        return text[1:-1]
    known = {"null": None, "~": None, "true": True, "false": False}
    if text.lower() in known:
        return known[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def save(settings: dict[str, object], path: str) -> None:
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(to_text(settings), encoding="utf-8")


def load(path: str) -> dict[str, object]:
    from pathlib import Path

    return from_text(Path(path).read_text(encoding="utf-8"))
