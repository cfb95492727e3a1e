from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Kept string, n_words int, shard string, component_id string, taken int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgéü") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(1, 90)) for _ in range(40)]
    texts = [*base, None, "", "   \n\t", base[0], base[0], base[3] + " tail", words(rng, 30_000), (base[5] + "\n") * 5, base[7].upper(), " x y z"]
    out = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "x", 1, "y", "z", 2) for i, t in enumerate(texts)]
    return [*out, out[2], out[2], (None, base[9], "en", "s1", 3, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, "another text under a used id", "en", "s2", 28, "x", 1, "y", "z", 2)]


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
