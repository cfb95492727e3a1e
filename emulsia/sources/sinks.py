"""Sinks: the CSV report, versioned baselines, encoded files, and an HTML comparison."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the report in order, and the version of a baseline.
REPORT = ("file", "mode", "codec", "original_bytes", "output_bytes", "ratio", "quality", "faces", "ssim_downscaled", "status", "output_path", "vmaf_p1")
BASELINE_VERSION = 1
BENCH = "file string, mode string, status string, ratio double, ssim double, restore_lpips double, faces int, original_bytes bigint, output_bytes bigint, error string"


def report_cells(rows: DataFrame) -> DataFrame:
    """The report's columns as text: fixed decimals, blank where nothing was measured; absent columns are blank."""

    def cell(name: str) -> Column:
        if name not in rows.columns:
            return F.lit("")
        digits = {"ratio": "%.4f", "ssim_downscaled": "%.4f", "vmaf_p1": "%.2f"}.get(name)
        shown = F.format_string(digits, F.col(name).cast("double")) if digits else F.col(name).cast("string")
        return F.when(F.col(name).isNull(), "").otherwise(shown)

    return rows.select(*[cell(n).alias(n) for n in REPORT])


def write_report(rows: DataFrame, path: str) -> None:
    """One CSV file in order of the file names: a report has a row a file, which one task can write."""
    ordered = report_cells(rows).orderBy("file", "mode").coalesce(1)
    ordered.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def save_baseline(rows: DataFrame, path: str) -> None:
    """Rows of a benchmark as JSON lines with the version in each, so that any number of tasks writes them."""
    rows.withColumn("version", F.lit(BASELINE_VERSION)).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A saved baseline; another version is an error, unknown keys are ignored."""
    read = spark.read.schema(f"version int, {BENCH}").json(path)
    checked = F.assert_true(F.coalesce(F.col("version") == BASELINE_VERSION, F.lit(False)), "the baseline has another version")
    return read.filter(checked.isNull()).drop("version")


def write_files(encoded: DataFrame, folder: str) -> DataFrame:
    """encoded (name, content) as files in the folder, each published by a rename; name, bytes and error of each."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        for b in source:
            sizes, errors = [], []
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                try:
                    part = f"{root}/{name}.part"
                    with fs.open_output_stream(part, compression=None) as out:
                        out.write(data)
                    fs.move(part, f"{root}/{name}")
                    sizes.append(len(data))
                    errors.append(None)
                except Exception as e:  # one file must not end the job
                    sizes.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], names=["name", "bytes", "error"])

    return encoded.select("name", "content").mapInArrow(batches, "name string, bytes long, error string")


def data_uri(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def comparison_page(title: str, images: dict[str, str], metrics: list[tuple[str, str, str]]) -> str:
    """A self-contained page with pictures as data URIs and a table of metrics."""
    figures = "".join(f"<figure><img src='{html.escape(uri, quote=True)}'><figcaption>{html.escape(name)}</figcaption></figure>" for name, uri in images.items())
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in row) + "</tr>" for row in metrics)
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{figures}<table>{rows}</table>"
