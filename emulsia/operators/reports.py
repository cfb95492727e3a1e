"""Report rows, totals, comparisons of runs, layered settings and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed value: the SSIM that a search aims at where the other metric isn't available.
SSIM_TARGET = 0.98


def row_status(status: Column, mode: Column, dry_run: Column) -> Column:
    """The ledger's status of a result."""
    kept = F.when(dry_run, "would-keep-original").otherwise("kept-original")
    written = F.when(dry_run, "would-write").otherwise("written")
    return (
        F.when(status.isin("failed", "failed-unexpected"), "failed").when(status == "skipped", "skipped").when(status == "skipped-unchanged", "cached")
        .when((mode == "video") & (status == "would-encode"), "would-write").when((mode == "video") & (status == "kept-original"), kept)
        .when(mode == "video", "written").when((mode == "faithful") & (status == "skipped-larger"), kept).otherwise(written)
    )


def ratio(original: Column, output: Column) -> Column:
    """original / output, 0 where output is 0."""
    return F.coalesce(F.try_divide(original.cast("double"), output.cast("double")), F.lit(0.0))


def totals(results: DataFrame, by: list[str]) -> DataFrame:
    """Counters and sums of results: status, original_size, compressed_size."""
    sized = F.col("status").isin("ok", "skipped-larger", "kept-original")
    s = results.groupBy(*by).agg(
        F.count_if(sized | (F.col("status") == "would-encode")).alias("ok"), F.count_if(F.col("status") == "skipped-unchanged").alias("unchanged"),
        F.count_if(F.col("status").isin("failed", "failed-unexpected")).alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(sized, F.col("original_size"))), F.lit(0)).alias("total_in"), F.coalesce(F.sum(F.when(sized, F.col("compressed_size"))), F.lit(0)).alias("total_out"),
    )
    return s.withColumn("ratio", ratio(F.col("total_in"), F.col("total_out")))


def diff_runs(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Full outer comparison by key: NEW, GONE or both, and deltas that are null where a side is."""
    a, b = old.select(*keys, F.lit(True).alias("__old"), *[F.col(m).alias(f"__o_{m}") for m in metrics]), new.select(*keys, F.lit(True).alias("__new"), *[F.col(m).alias(f"__n_{m}") for m in metrics])
    side = F.when(F.col("__old").isNull(), "NEW").when(F.col("__new").isNull(), "GONE").otherwise("BOTH")
    return a.join(b, keys, "full_outer").select(*keys, side.alias("presence"), *[(F.col(f"__n_{m}") - F.col(f"__o_{m}")).alias(f"d_{m}") for m in metrics])


def layered(*layers: Column) -> Column:
    """The first layer that sets the value, the most specific first."""
    return F.coalesce(*layers)


def running(results: DataFrame, order: list[str], by: list[str], amounts: dict[str, str]) -> DataFrame:
    """Running sums by group in a total order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return results.withColumns({out: F.sum(c).over(w) for out, c in amounts.items()})


def size_text(n: Column) -> Column:
    """Bytes in the largest unit of the 1024 ladder that they reach, one decimal, half-even."""
    value = n.cast("double")
    text = F.format_string("%.1f GB", F.bround(value / 1024**3, 1))
    for power, name in ((2, "MB"), (1, "KB")):
        text = F.when(value < 1024 ** (power + 1), F.format_string(f"%.1f {name}", F.bround(value / 1024**power, 1))).otherwise(text)
    return F.when(value < 1024, F.format_string("%.1f B", value)).otherwise(text)


def notice(processed: Column, ok: Column, failed: Column) -> Column:
    """What a cycle says: nothing when idle, problems first."""
    return F.when(F.coalesce(processed, F.lit(0)) == 0, "silent").when(failed > 0, "problem").otherwise("done")


def table_text(diff: Column, value: Column, delta: Column, digits: int = 3) -> Column:
    """A cell of a comparison: the value, then its signed change in brackets, NEW or GONE; blank where not measured."""
    number = F.when(value.isNull(), "").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))
    change = F.when(delta.isNull(), "").otherwise(F.format_string(f" (%+.{digits}f)", delta.cast("double")))
    return F.when(diff == "NEW", F.concat(number, F.lit(" NEW"))).when(diff == "GONE", F.lit("GONE")).otherwise(F.concat(number, change))


def duration_text(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    minutes = F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)
    hours = F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60)
    return F.when(s >= 3600, hours).otherwise(minutes)


def quality_report(a: Column, b: Column, ssim: Column, original: Column, output: Column, faces: Column | None = None) -> Column:
    """A pair of pictures as one row: psnr, ssim, ratio and, where there are faces, the ssim within their union and outside.

    faces: a struct of (inside, outside), null where no face is; arrays of other sizes can't be compared and are an error.
    """
    from emulsia.functions.pixels import psnr

    same = F.assert_true(F.size(a) == F.size(b), F.lit("the pictures have different sizes"))
    part = lambda k: (faces[k] if faces is not None else F.lit(None)).cast("double")
    return F.struct(F.when(same.isNull(), psnr(a, b)).alias("psnr"), ssim.alias("ssim"), ratio(original, output).alias("ratio"), part("inside").alias("face_ssim"), part("outside").alias("background_ssim"))


def tune_metric(wanted: Column, available: Column, target: Column) -> Column:
    """(metric, target): the wanted metric, or SSIM with its own target where it isn't available."""
    falls = (wanted == "ssimulacra2") & ~available
    return F.struct(F.when(falls, "ssim").otherwise(wanted).alias("metric"), F.when(falls, SSIM_TARGET).otherwise(target).alias("target"))


def watch_videos(enabled: Column, unwanted: Column, mode: Column, encoder: Column) -> Column:
    """(include, reason): whether a watch takes clips, and what to say where it doesn't though they were wanted."""
    asked = enabled & ~unwanted
    reason = F.when(asked & (mode == "aggressive"), "clips are only encoded in faithful mode and will be skipped").when(asked & ~encoder, "clips will be skipped: no encoder was found")
    return F.struct((asked & reason.isNull()).alias("include"), reason.alias("reason"))


def honesty_note(mode: Column, lossless: Column) -> Column:
    """What a backup must say about its copies; null where they are exact."""
    return F.when(mode == "aggressive", "backgrounds are made anew on restoring: not a copy to keep alone").when(~lossless, "visually lossless, not exact: ask for lossless if this is the only copy")


def cycle_line(c: Column, interval: Column | None = None) -> Column:
    """One line about a cycle: processed with what came of it, saved, unchanged, waiting and held; idle where nothing ran."""
    some = lambda name, text: F.when(c[name] > 0, F.concat(c[name].cast("string"), F.lit(f" {text}")))
    done = F.concat_ws(", ", F.concat(c["ok"].cast("string"), F.lit(" ok")), some("failed", "failed"), some("skipped", "skipped"))
    ran = c["processed"] > 0
    parts = [
        F.when(ran, F.concat(F.lit("processed "), c["processed"].cast("string"), F.lit(": "), done)).otherwise("idle"),
        F.when(ran & (c["saved"] != 0), F.concat(F.lit("saved "), size_text(c["saved"]))), some("unchanged", "unchanged"), some("awaiting", "not yet stable (still syncing?)"),
        some("held", "failed/skipped earlier (retried when the file changes)"),
    ]
    if interval is not None:
        parts.append(F.concat(F.lit("next scan in "), interval.cast("string"), F.lit("s")))
    return F.concat_ws(" | ", *parts)


def backup_summary(t: Column, lossless: Column, no_encoder: Column) -> Column:
    """What a finished backup says: counts, sizes, and what the copies are."""
    some = lambda name, text: F.when(t[name] > 0, F.concat(t[name].cast("string"), F.lit(f" {text}")))
    counts = F.concat_ws(", ", F.concat(t["ok"].cast("string"), F.lit(" compressed")), some("unchanged", "already backed up"), some("failed", "failed"), some("skipped", "skipped"))
    times = F.format_string("%.1f", F.bround(ratio(t["total_in"], t["total_out"]), 1))
    sizes = F.when(t["total_out"] > 0, F.concat(size_text(t["total_in"]), F.lit(" to "), size_text(t["total_out"]), F.lit(", "), times, F.lit(" times smaller")))
    exact = F.when(lossless, "The copies are exact.").otherwise("The copies are visually lossless, not exact.")
    return F.concat_ws("\n", counts, sizes, F.when(no_encoder, "Clips were skipped: no encoder was found."), exact, F.lit("The sources were not changed."))


def table_cells(rows: DataFrame) -> DataFrame:
    """Report rows as cells to show: sizes in units, a ratio with a times sign, blank where nothing was measured."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    sized = lambda name: blank(F.when(F.col(name).isNotNull(), size_text(F.col(name)))).alias(name)
    shown = F.format_string("%.1fx", F.bround(F.col("ratio"), 1))
    plain = [blank(F.col(n).cast("string")).alias(n) for n in ("quality", "faces")]
    return rows.select("file", "status", "mode", blank(F.col("codec")).alias("codec"), sized("original_bytes"), sized("output_bytes"), blank(F.when(F.col("ratio").isNotNull(), shown)).alias("ratio"), *plain)
