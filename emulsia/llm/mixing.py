"""Mixing sources to target weights: fixed blocks of words, multinomial draws, permuted indices, a join by index.

The words of a source, its documents in hash order, are cut into blocks of BLOCK words. The mix of a source is a run
of slots. Each slot falls into one of the output shards by a hash, uniformly and independently, so the counts of a
source in the shards are a multinomial draw given the source's total; fixing the totals is what makes each source end
within a word of its target instead of a square root away. The drawn counts deal the slots: shard 0 gets as many of a
source's first slots as were drawn for it, shard 1 the next, and so on. Slot k takes the block whose permuted index is k
modulo the number of blocks, so that a source is repeated only when all of its blocks were taken equally often. Blocks
and slots are joined by (source, index). The index permutation is the rank of the block in hash order, found in hash
ranges.

Defined results: a null text has no words; a null source is a source of its own, the last; rows with equal ids and
texts are separate rows; a very long text is cut into blocks like any other; a table without words has targets and
takings of 0; an empty table gives an empty table; columns of docs may have any names. Built-in expressions only. Texts
don't move in `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality_rules import split_words

BLOCK = 256
SHARD_WORDS = 1 << 24
#: The weights of the sources, in order and repeating; the share of all words; the most of a source.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
RUN = 4096  # blocks or slots that one generated row stands for


def source_targets(slim: DataFrame, source: str = "source", size: str = "size") -> DataFrame:
    """Per source: source_size and target, by filling up sources in order of the share at which they are full.

    One row a source: the windows here are over that table only.
    """
    per = slim.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(place, F.lit(len(WEIGHTS))).cast("int") + 1)
    per = per.withColumn("weight", weight)
    full_at = F.col("source_size") * MOST / F.col("weight")
    fill = Window.partitionBy(F.lit(0)).orderBy(full_at, F.col(source).asc_nulls_last())
    before = F.coalesce(F.sum(F.col("source_size") * MOST).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights_left = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumns({"k": F.row_number().over(fill), "level": (F.sum("source_size").over(everything) * SHARE - before) / weights_left})
    # the first source in this order that isn't full at its level; those behind it share that level
    level = F.min(F.when(F.col("level") <= full_at, F.struct(F.col("k"), F.col("level")))).over(everything)["level"]
    target = F.when(level.isNull() | (full_at < level), (F.col("source_size") * MOST).cast("double")).otherwise(level * F.col("weight"))
    return per.select(F.col(source), "source_size", target.alias("target"))


def _runs(sources: DataFrame, count: str, index: str, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """A row for each index below count; a hot source is generated by many tasks."""
    runs = sources.filter(F.col(count) > 0).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({count} - 1) div {RUN}"))))
    spread = runs.repartition(*keys, "__run")
    last = F.least(F.col(count), (F.col("__run") + 1) * RUN) - 1
    return spread.withColumn(index, F.explode(F.sequence(F.col("__run") * RUN, last))).drop("__run")


def draws(figures: DataFrame, seed: int, shard_words: int) -> DataFrame:
    """Figures of the sources by out_shard, with drawn and before: how many of a source's slots were drawn for the shard
    and for those before it."""
    wanted = figures.agg(F.coalesce(F.sum("wanted"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-wanted // shard_words))
    slots = _runs(figures.select("source", "n_slots"), "n_slots", "nth")
    shard = F.pmod(F.xxhash64(F.lit("shard"), F.lit(seed), "source", "nth"), F.lit(shards)).cast("int")
    drawn = slots.groupBy("source", shard.alias("out_shard")).agg(F.count("*").alias("drawn"))
    earlier = Window.partitionBy("source").orderBy("out_shard").rowsBetween(Window.unboundedPreceding, -1)
    # joined here, a row a source and shard: the optimizer can't tell that the slots are many more
    drawn = common.join_same(drawn.withColumn("before", F.coalesce(F.sum("drawn").over(earlier), F.lit(0))), figures, ["source"])
    return common.stored(drawn, "mix-draws")


def plan(slim: DataFrame, rows: int, seed: int = 11, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (source, size, ...rest) the sources, the slots and the documents' pieces of blocks; rows: of slim.

    sources: source, source_size, target and figures of its blocks. slots: source, slot, out_shard, block, words (taken
    from the block's start). pieces: the columns of slim, start, block, low and high (the words of the block).
    """
    others = [c for c in slim.columns if c not in ("source", "size")]
    sources = source_targets(slim).withColumn("wanted", F.round("target").cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumns({"n_blocks": F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}"), "passes": whole, "rest": F.col("wanted") - whole * F.col("source_size")})
    sources = sources.withColumn("last_words", F.col("source_size") - (F.col("n_blocks") - 1) * BLOCK)
    sources = sources.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.when(F.col("rest") > 0, F.least("n_blocks", F.expr(f"(rest + {BLOCK}) div {BLOCK} + 1"))).otherwise(0))
    sources = common.stored(sources, "mix-sources")
    n_blocks = sources.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n")).first()["n"]

    blocks = _runs(sources.select("source", "n_blocks", "last_words"), "n_blocks", "block")
    words = F.when(F.col("block") == F.col("n_blocks") - 1, F.col("last_words")).otherwise(BLOCK)
    blocks = blocks.select("source", "block", words.alias("block_words"), (F.col("block") == F.col("n_blocks") - 1).alias("is_last"), F.lit(1).cast("long").alias("__one"))
    blocks = common.prefix_sums(blocks, ["source"], ["source", "block"], {"index": "__one"}, rows=n_blocks).drop("__one")
    blocks = common.stored(blocks, "mix-blocks")
    lasts = blocks.filter("is_last").select("source", F.col("index").alias("last_index"))

    figures = common.join_same(sources, lasts, ["source"], "left")
    dealt = _runs(draws(figures, seed, shard_words), "drawn", "k", ("source", "out_shard"))
    slots = dealt.withColumn("slot", F.col("before") + F.col("k")).drop("drawn", "before", "k")
    slots = slots.withColumns({"index": F.col("slot") % F.col("n_blocks"), "round": F.expr("slot div n_blocks")})
    joined = common.join_same(slots, blocks.drop("is_last").hint("merge"), ["source", "index"])
    before = F.col("index") * BLOCK - F.when(F.col("index") > F.col("last_index"), BLOCK - F.col("last_words")).otherwise(0)
    part = F.greatest(F.lit(0), F.least("block_words", F.col("rest") - before))
    taken = F.when(F.col("round") < F.col("passes"), F.col("block_words")).otherwise(part)
    slots = joined.select("source", "slot", "round", "passes", "out_shard", "block", taken.cast("long").alias("words")).filter("words > 0")

    at = common.prefix_sums(slim.filter("size > 0"), ["source"], [*others, "size"], {"start": "size"}, rows=rows)
    pieces = at.withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))))
    pieces = pieces.withColumns({"low": F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("block") * BLOCK), "high": F.least(F.lit(BLOCK).cast("long"), F.col("start") + F.col("size") - F.col("block") * BLOCK)})
    return sources, slots, pieces


def _taken(slots: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces with `whole` (times that all of it is taken in full passes), `part` (words from low in the last pass) and
    `least` (the first output shard that takes words of the block)."""
    uses = slots.groupBy("source", "block").agg(
        F.sum(F.when(F.col("round") < F.col("passes"), 1).otherwise(0)).cast("long").alias("whole"),
        F.max(F.when(F.col("round") >= F.col("passes"), F.col("words"))).alias("reach"),
        F.min(F.when(F.col("round") < F.col("passes"), F.col("out_shard"))).alias("whole_in"), F.min(F.when(F.col("round") >= F.col("passes"), F.col("out_shard"))).alias("part_in"),
    )
    joined = common.join_same(pieces, uses.hint("merge"), ["source", "block"], "left")
    part = F.greatest(F.lit(0).cast("long"), F.least("high", F.coalesce("reach", F.lit(0))) - F.col("low"))
    least = F.least("whole_in", F.when(part > 0, F.col("part_in")))
    return joined.withColumns({"whole": F.coalesce("whole", F.lit(0)), "part": part, "least": least}).drop("reach", "whole_in", "part_in")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of docs: key, size, source_size, target, taken and first_shard, the first output shard that takes
    words of the document (null: none does)."""
    slim = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.size(split_words(F.col(text))).cast("long").alias("size"))
    slim = common.stored(slim, "mix-sizes")
    sources, slots, pieces = plan(slim, slim.count())
    found = _taken(slots, pieces)
    taken = found.groupBy("key", "source", "size", "start").agg(
        F.sum(F.col("whole") * (F.col("high") - F.col("low")) + F.col("part")).cast("long").alias("taken"), F.min("least").alias("first_shard")
    ).drop("start")
    taken = taken.unionByName(slim.filter("size = 0").withColumns({"taken": F.lit(0).cast("long"), "first_shard": F.lit(None).cast("int")}))
    out = common.join_same(taken, sources, ["source"], "left")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken", "first_shard")


def mixed_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", chars: str | None = "n_chars") -> DataFrame:
    """The mix as rows with the columns of docs: a document once for each full pass that takes all of it, and once
    more with the words that the last pass takes. A row with all words has the text unchanged, one with some has them
    joined by blanks, and its `chars` column, if there is one, is the length of that text."""
    columns = docs.columns
    names = ("__size", "__digest", "__nth", "__spans", "__times", "__key", "__d", "__n", "__part", "__copy", "__same")
    words, digest, nth, spans, times, of_key, of_digest, of_nth, partly, copy, same_n = common.fresh(docs, *names)
    keyed = docs.withColumns({digest: F.xxhash64(F.sha2(common.text_of(text), 256), F.col(source), *[F.col(c) for c in columns if c not in (text, source, key)])})
    slim = keyed.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(digest).alias("digest"), F.size(split_words(F.col(text))).cast("long").alias("size"))
    same = Window.partitionBy("key", "digest")
    slim = slim.withColumns({"nth": F.row_number().over(same.orderBy("digest")), "same": F.count("*").over(same)})
    slim = common.stored(slim, "mix-sizes")
    _, slots, pieces = plan(slim, slim.count())
    found = _taken(slots, pieces)
    first = F.col("block") * BLOCK + F.col("low") - F.col("start")
    span = F.struct(first.alias("from"), F.col("part").alias("n"))
    per = found.groupBy("key", "digest", "nth", "same", "size", "start").agg(F.min("whole").cast("int").alias("times"), F.sort_array(F.collect_list(F.when(F.col("part") > 0, span))).alias("spans"), F.sum("part").alias("part"))
    per = per.select(F.col("key").alias(of_key), F.col("digest").alias(of_digest), F.col("nth").alias(of_nth), F.col("same").alias(same_n), F.col("size").alias(words), F.col("times").alias(times), F.when(F.col("part") < F.col("size"), F.col("spans")).alias(spans), F.col("part").alias(partly))
    per = common.stored(per, "mix-taken")
    row = lambda df, other: df[key].eqNullSafe(other[of_key]) & (df[digest] == other[of_digest])
    once, often = per.filter(F.col(same_n) == 1), per.filter(F.col(same_n) > 1)
    joined = keyed.join(once.hint("merge"), row(keyed, once)).withColumn(nth, F.lit(1))
    # only repeated rows are numbered, which takes their texts through another shuffle
    if not often.isEmpty():
        repeated = often.select(of_key, of_digest).distinct()
        some = keyed.join(repeated, row(keyed, repeated), "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(key, digest).orderBy(digest)))
        joined = joined.unionByName(some.join(often.hint("merge"), row(some, often) & (some[nth] == often[of_nth])))
    none = F.array().cast(joined.schema[spans].dataType)
    copies = F.concat(F.array_repeat(F.struct(F.lit(True).alias("all"), none.alias("spans")), F.col(times)), F.when(F.col(partly) > 0, F.array(F.struct(F.col(spans).isNull().alias("all"), F.coalesce(F.col(spans), none).alias("spans")))).otherwise(F.array().cast("array<struct<all:boolean,spans:array<struct<from:bigint,n:bigint>>>>")))
    out = joined.withColumn(copy, F.explode(copies))
    some = common.bind(split_words(F.col(text)), lambda w: F.array_join(F.flatten(F.transform(F.col(copy)["spans"], lambda s: F.slice(w, (s["from"] + 1).cast("int"), s["n"].cast("int")))), " "))
    out = out.withColumn(text, F.when(F.col(copy)["all"], F.col(text)).otherwise(some))
    if chars in columns:
        out = out.withColumn(chars, F.when(F.col(copy)["all"], F.col(chars)).otherwise(F.length(text).cast(docs.schema[chars].dataType)))
    return out.select(*columns)
