"""Functions over pictures hold a bounded part of a batch, not all of its samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from emulsia.functions import jpeg, pixels, png

SHADES = [np.full((256, 256), k, dtype=np.uint8) for k in (3, 200)]


@pytest.mark.parametrize("values, encode", [(jpeg.jpeg_values, lambda x: jpeg.encode(x, 100)), (png.png_values, png.encode)])
def test_samples_are_handed_on_in_slices(values, encode):
    files = [encode(x) for x in SHADES] * 10 + [b"junk", None]
    slices = list(values.func(iter([pd.Series(files, dtype=object), pd.Series([], dtype=object), pd.Series(files[:1], dtype=object)])))
    assert max(sum(len(v) for v in s if v is not None) for s in slices) <= pixels.SAMPLES_AT_ONCE
    got = [v for s in slices for v in s]
    assert [None if v is None else (len(v), int(v[0]), int(v[-1])) for v in got] == [(65536, 3, 3), (65536, 200, 200)] * 10 + [None, None, (65536, 3, 3)]
