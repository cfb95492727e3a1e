"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the blanks that separate words, as a Java class body.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and the master is local (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="emulsia-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column | str = "text") -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def words_of(text: Column | str = "text") -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(f"({WORD})"), F.lit(1))


def bind(value: Column, body) -> Column:
    """body(value), with value computed once per row: a lambda variable can't be inlined by the optimizer."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in whatever case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """At most n rows in an Arrow batch of the plans that are run inside: for rows with large values."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], amounts: dict[str, str], per_bucket: int = 4096, rows: int | None = None) -> DataFrame:
    """df with, for each `name: amount`, the sum of amount over the earlier rows of the group in hash order.

    The order is that of a 64-bit hash of `order`, ties by `order` itself, so it doesn't depend on the partitioning.
    No task gets a whole group: hash ranges of about per_bucket rows are summed first, then the sums within runs of
    per_bucket ranges, then those of the runs. Rows equal in group and order get consecutive sums. `rows` is the number
    of rows of df, if it is known; columns of df may have any names.
    """
    n = rows if rows is not None else df.count()
    buckets = max(1, -(-n // per_bucket))
    rank, at, run = fresh(df, "__rank", "__range", "__run")
    taken = fresh(df, *[f"__{kind}_{i}" for kind in ("sum", "base", "local", "run_sum", "run_base") for i in range(len(amounts))], *[f"__g{i}" for i in range(len(group))], "__at", "__of")
    k = len(amounts)
    sums, bases, locals_, run_sums, run_bases = (taken[i * k : (i + 1) * k] for i in range(5))
    keys, (own, of) = taken[5 * k : 5 * k + len(group)], taken[-2:]
    ranked = df.withColumn(rank, F.xxhash64(F.lit("order"), *order))
    ranked = ranked.withColumn(at, F.pmod(F.shiftrightunsigned(rank, 1), F.lit(buckets)))
    earlier = lambda *c: Window.partitionBy(*c[:-1]).orderBy(c[-1]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda x, w, out: F.coalesce(F.sum(x).over(w), F.lit(0)).alias(out)

    ranges = ranked.groupBy(*group, at).agg(*[F.sum(a).alias(s) for a, s in zip(amounts.values(), sums)])
    ranges = ranges.select(*[F.col(g).alias(x) for g, x in zip(group, keys)], F.col(at).alias(own), F.floor(F.col(at) / per_bucket).alias(run), *sums)
    runs = ranges.groupBy(*keys, run).agg(*[F.sum(s).alias(r) for s, r in zip(sums, run_sums)])
    runs = runs.select(*[F.col(x).alias(f"{x}r") for x in keys], F.col(run).alias(of), *[so_far(r, earlier(*keys, run), b) for r, b in zip(run_sums, run_bases)])
    ranges = ranges.select(*keys, own, run, *[so_far(s, earlier(*keys, run, own), b) for s, b in zip(sums, bases)])
    ranges = ranges.join(runs, [F.col(x).eqNullSafe(F.col(f"{x}r")) for x in keys] + [F.col(run) == F.col(of)])
    ranges = ranges.select(*keys, own, *[(F.col(b) + F.col(r)).alias(b) for b, r in zip(bases, run_bases)])

    inside = Window.partitionBy(*group, at).orderBy(rank, *order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranked.select("*", *[so_far(a, inside, x) for a, x in zip(amounts.values(), locals_)])
    on = [F.col(g).eqNullSafe(F.col(x)) for g, x in zip(group, keys)] + [F.col(at) == F.col(own)]
    joined = local.join(ranges.hint("merge"), on, "left")
    return joined.select(*df.columns, *[(F.col(x) + F.col(b)).alias(name) for name, x, b in zip(amounts, locals_, bases)])


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", nulls: tuple[str, ...] = ("source",)) -> DataFrame:
    """left joined with right on keys of the same name, which stay once; keys in `nulls` match null with null."""
    named = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) if k in nulls else F.col(k) == F.col(f"__r_{k}") for k in keys]
    return left.join(named, on, how).drop(*[f"__r_{k}" for k in keys])
