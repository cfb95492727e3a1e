"""Queries take every row of their tables."""

from __future__ import annotations

from emulsia.plans import catalogue


def plain_mass(w, h):
    return sum(max(0.0, min(1.0, min(y, h - 1 - y, x, w - 1 - x) / 8.0)) for x in range(w) for y in range(h))


def test_soft_mask_has_no_bound_on_ids(spark, tmp_path):
    rows = [(k, s) for k, s in ((1, 1), (200, 50), (201, 1), (202, 49), (20_000, 13), (10**12, 27))]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["p_partkey"]: r["mass"] for r in catalogue.QUERIES["soft_mask"](spark, str(tmp_path)).collect()}
    assert got == {k: round(plain_mass(20 + s, 20 + s % 7), 6) for k, s in rows}
