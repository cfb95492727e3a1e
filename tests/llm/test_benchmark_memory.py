"""The broadcast set of a large benchmark stays small."""

from __future__ import annotations

import pickle
import random
import subprocess
import sys

import numpy as np
import xxhash

from emulsia.llm import decontaminate

BUILD = """
import random, resource
from emulsia.llm import decontaminate
rng = random.Random(1)
vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(60_000)]
items = [(str(i), " ".join(rng.choice(vocabulary) for _ in range(200))) for i in range(7_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
grams = decontaminate.Grams(items)
print(sum(len(t) for _, t in items), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024)
"""


def test_memory_of_a_large_benchmark():
    said = subprocess.run([sys.executable, "-c", BUILD], capture_output=True, text=True, check=True).stdout.split()
    text, taken = map(int, said)
    assert text > 9_000_000 and taken < 15 * text


def test_pickled_size_and_collisions(monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(60))) for i in range(200)]
    grams = decontaminate.Grams(items)
    assert len(pickle.dumps(grams)) < 8 * sum(len(t) for _, t in items)
    # all windows share a hash: only those with equal words count
    monkeypatch.setattr(decontaminate, "hashed", lambda words, at, size: at.astype("u8") * 0)
    grams = decontaminate.Grams(items[:20])
    text = [b"x", *items[3][1].encode().split(), b"y"]
    hits = list(grams.scan(text, np.array([xxhash.xxh64_intdigest(w) for w in text], dtype=np.uint64)))
    assert [h[0] for h in hits] == list(range(1, 52)) and all("3" in h[2] for h in hits)
