"""The errors of the engine. A caller that catches EmulsiaError catches all of them."""

from __future__ import annotations


class EmulsiaError(Exception):
    """Any error of the engine."""


class SettingsError(EmulsiaError, ValueError):
    """A setting that isn't allowed."""


class DetectorError(EmulsiaError, ValueError):
    """A plug-in that can't be registered, found or run."""


class EncodeError(EmulsiaError):
    """An encoding that failed, or a codec that isn't there."""


class PlanError(EmulsiaError):
    """A compression that couldn't be planned or carried out."""


class RestoreError(EmulsiaError):
    """A container that couldn't be restored."""


class ModelError(EmulsiaError):
    """Weights that can't be found or don't have their checksum; callers go on without the model."""


class ContainerError(EmulsiaError):
    """A container that is malformed or can't be read."""


class SkipFile(EmulsiaError):
    """Says that a file is to be skipped, which isn't a failure."""


class ClipError(EmulsiaError):
    """A clip that can't be probed or encoded."""


class InputError(EmulsiaError):
    """A format that isn't supported."""
