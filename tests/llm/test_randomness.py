"""The battery of randomness tests on labelled tokens, and its statistics against plain versions."""

from __future__ import annotations

import base64
import math
import random

import pytest
from pyspark.sql import functions as F

from emulsia.llm import secrets

RNG = random.Random(12)
WORDS = "user profile request handler account status default manager server client config message update session archive invoice payment report image folder version number address language content window element parser stream buffer".split()


def keys() -> dict[str, list[str]]:
    def draw(alphabet):
        return ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(20, 44))) for _ in range(120)]

    alphabets = list(secrets.ALPHABETS.values())
    out = {name: draw(alphabets[i]) for name, i in (("hex upper", 1), ("base32", 2), ("base36", 3), ("base62", 5))}
    return out | {"base64": [base64.b64encode(RNG.randbytes(RNG.randint(18, 40))).decode() for _ in range(120)]}


def plain() -> dict[str, list[str]]:
    def made(f):
        return [f([RNG.choice(WORDS) for _ in range(RNG.randint(3, 6))]) for _ in range(200)]

    digit = lambda: str(RNG.randrange(1000))
    return {
        "camel": made(lambda w: w[0] + "".join(map(str.capitalize, w[1:])) + digit()), "snake": made(lambda w: "_".join(w) + "_" + digit()), "slug": made(lambda w: "-".join(w) + "-" + digit()),
        "path": made(lambda w: "/".join(w) + "/" + digit()), "constant": made(lambda w: "_".join(w).upper() + "_" + digit()), "long word": made(lambda w: "".join(w)),
        "date": [f"{RNG.randint(1990, 2030)}{RNG.randint(1, 12):02d}{RNG.randint(1, 28):02d}T{RNG.randint(0, 23):02d}{RNG.randint(0, 59):02d}{RNG.randint(0, 59):02d}Z" for _ in range(100)],
        "number": [str(RNG.randrange(10**19, 10**20)) for _ in range(100)],
    }


@pytest.fixture(scope="module")
def found(spark):
    rows, truth = [], {}
    for kind, tokens in (keys() | plain()).items():
        for t in tokens:
            if len(t) >= secrets.MIN_TOKEN:
                truth[len(rows)] = kind
                rows.append((len(rows), f"see {t} there"))
    out = secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    share: dict[str, list[bool]] = {}
    for r in out:
        share.setdefault(truth[r["doc_id"]], []).append("random" in r["spans"] or "hex" in r["spans"])
    return {k: sum(v) / len(v) for k, v in share.items()}


def test_keys_of_each_encoding_are_found(found):
    assert all(found[k] >= 0.95 for k in ("hex upper", "base32", "base36", "base62", "base64")), found


def test_ordinary_tokens_are_left_alone(found):
    assert all(found[k] <= 0.05 for k in ("camel", "snake", "slug", "path", "constant", "long word", "date", "number")), found


def tails(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def plain_uniformity(t: str) -> float:
    symbols = next(a for a in secrets.ALPHABETS.values() if set(t) <= set(a))
    k, n = len(symbols), len(t)
    chi = sum(t.count(s) ** 2 for s in symbols) * k / n - n
    z = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    v = [symbols.index(c) + 1 - (k + 1) / 2 for c in t]
    changes = sum(x * y < 0 for x, y in zip(v, v[1:]))
    lag = sum(x * y for x, y in zip(v, v[1:])) / ((k * k - 1) / 12)
    ps = [math.erfc(z / math.sqrt(2)) / 2, tails((2 * changes - (n - 1)) / math.sqrt(n - 1)), tails(lag / math.sqrt(n - 1))]
    y = -sum(math.log(max(p, 1e-200)) for p in ps)
    return math.exp(-y) * (1 + y + y * y / 2)


def plain_ordinary(t: str) -> float:
    size = len(next(a for a in secrets.ALPHABETS.values() if set(t) <= set(a)))
    log, last = 0.0, 4
    for c in t:
        kind = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
        log += math.log(secrets.NEXT[last][kind])
        log += math.log(secrets.LETTERS[ord(c.lower()) - 97] / sum(secrets.LETTERS)) if kind < 2 else math.log(0.1 if kind == 2 else 0.2)
        last = kind
    return min(1.0, math.exp(log + len(t) * math.log(size)))


def test_statistics_against_plain_versions(spark):
    tokens = [t for kind in (keys() | plain()).values() for t in kind[:8] if "=" not in t]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.uniformity(F.col("t")).alias("u"), secrets.ordinary(F.col("t")).alias("o")).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        assert math.isclose(r["u"], plain_uniformity(r["t"]), rel_tol=1e-3, abs_tol=2e-6), r
        assert math.isclose(r["o"], plain_ordinary(r["t"]), rel_tol=1e-6, abs_tol=1e-12), r


def test_a_very_long_token_is_judged_whole(spark):
    token = "".join(RNG.choice(secrets.ALPHABETS["[A-Za-z0-9]"]) for _ in range(60_000))
    rows = [(1, f"a {token} b"), (2, "a " + "xy" * 30_000 + " b")]
    got = {r["doc_id"]: r["spans"] for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "random:2:60002", 2: ""}


def test_redaction_of_one_id_with_two_texts(spark):
    rows = [(1, "password=hunter22 ok"), (1, "no secret here"), (1, "no secret here"), (None, None)]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string"), "#").collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", "# ok"), ("1", "no secret here"), ("1", "no secret here"), ("None", "")]
