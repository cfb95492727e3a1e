"""Secret scan: three base patterns, and a battery of randomness tests on other tokens.

Base spans are assignments, access keys and hexadecimal runs. Other candidates are the whole runs of MIN_TOKEN or more
key characters. A candidate's encoding, the smallest alphabet that holds it, is inferred, and three tests ask whether it
could be a uniform draw from that alphabet: a chi-squared test of the counts of all its symbols, a runs test about its
middle, and the serial correlation of neighbours' places in it. Fisher's rule combines them; a token under UNIFORM_P
isn't random.

Tokens that could be random are secrets where they can't be ordinary. An ordinary token is described by the classes of
neighbouring characters and the frequencies of letters; the uniform probability of a token over its ordinary one is
an e-value, whose inverse is a p-value of "ordinary" (Markov's inequality). It falls with every character, so that length
counts by itself, and secrets are discovered among all tokens of the corpus under a false-discovery rate of FDR within
each class of length (Benjamini and Hochberg). The thresholds come from counts of p-values in BINS bins a class, so
nothing is ranked row by row.

Defined results: a null text is empty and has no spans; a very long text or token is judged whole; columns besides
doc_id and text aren't read; equal rows give equal results; an empty table gives an empty table. Offsets are code
points, the end exclusive. Built-in expressions only, nothing but the bins is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The base patterns (group 2 of an assignment is its value) and the least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
TOKEN = "[A-Za-z0-9+/_=-]"
MIN_TOKEN = 16
FDR = 0.05
UNIFORM_P = 0.002
BINS = 200
SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, kind: int, keep: str, lengths: Column | None = None) -> Column:
    """Spans of the matches of pattern that also match `keep` in full; gaps between matches give the offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def walk(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        step = lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNotNull() & F.coalesce(x["hit"].rlike(keep), F.lit(False)), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"), (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"))))).otherwise(a["out"]).alias("out"),
        )
        pairs = F.zip_with(gaps, m, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step)["out"]

    return F.when(text.rlike(keep.removeprefix("^").removesuffix("$")), common.bind(found, walk)).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, by start, then kind."""
    assign = _spans(text, ASSIGN, 0, "^" + ASSIGN.removesuffix("+)") + f"{{{MIN_ASSIGN},}})$")
    access = _spans(text, ACCESS, 1, f"^AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}$")
    hexes = _spans(text, rf"(?<![0-9a-f])[0-9a-f]{{{MIN_HEX},}}", 2, f"^[0-9a-f]{{{MIN_HEX},}}$")
    return F.array_sort(F.concat(assign, access, hexes))


#: The alphabets, the smaller first; frequencies of the letters a to z in English, in percent.
ALPHABETS = {
    "[0-9a-f]": "0123456789abcdef", "[0-9A-F]": "0123456789ABCDEF", "[A-Z2-7]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "[a-z0-9]": "abcdefghijklmnopqrstuvwxyz0123456789", "[A-Z0-9]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "[A-Za-z0-9]": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "[A-Za-z0-9+/]": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "[A-Za-z0-9_-]": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "[A-Za-z0-9+/_=-]": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: Shares of the next class (lower, upper, digit, other) after each of them and, last, at the start of an ordinary token.
NEXT = ((0.86, 0.05, 0.04, 0.05), (0.40, 0.50, 0.05, 0.05), (0.08, 0.05, 0.75, 0.12), (0.60, 0.15, 0.20, 0.05), (0.50, 0.30, 0.15, 0.05))


def token_spans(text: Column) -> Column:
    """Spans of candidate tokens: whole runs of key characters."""
    whole = rf"(?<!{TOKEN}){TOKEN}{{{MIN_TOKEN},}}"
    return _spans(text, whole, 3, f"^{TOKEN}{{{MIN_TOKEN},}}$")


def _two_tails(z: Column) -> Column:
    """P(|Z| > z) of a normal Z, by a formula of Abramowitz and Stegun (7.1.26), to about 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def _chars(token: Column) -> Column:
    return F.filter(F.split(token, ""), lambda c: c != "")


def alphabet(token: Column) -> Column:
    """The smallest of the alphabets that holds all characters."""
    out = F.lit(list(ALPHABETS.values())[-1])
    for pattern, symbols in reversed(list(ALPHABETS.items())[:-1]):
        out = F.when(token.rlike(f"^{pattern}+$"), symbols).otherwise(out)
    return out


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _neighbours(values: Column, f) -> Column:
    n = F.size(values) - 1
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), f)


def uniformity(token: Column) -> Column:
    """The combined p-value of "drawn uniformly from its alphabet"; small where the token isn't random."""

    def tests(symbols: Column) -> Column:
        k, n = F.length(symbols).cast("double"), F.length(token).cast("double")
        counts = F.transform(_chars(symbols), lambda s: (F.length(token) - F.length(F.replace(token, s, F.lit("")))).cast("double"))
        chi = _sum(F.transform(counts, lambda c: c * c)) * k / n - n
        # the cube-root transform of a chi-squared is close to normal
        z = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), 1 / 3) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
        p_chi = F.when(z > 0, _two_tails(z) / 2).otherwise(1 - _two_tails(z) / 2)
        places = F.transform(_chars(token), lambda c: F.instr(symbols, c) - (k + 1) / 2)

        def ordered(v: Column) -> Column:
            changes = _sum(_neighbours(v, lambda x, y: F.when(x * y < 0, 1.0).otherwise(0.0)))
            lag = _sum(_neighbours(v, lambda x, y: x * y)) / ((k * k - 1) / 12)
            return F.struct(_two_tails((2 * changes - (n - 1)) / F.sqrt(n - 1)).alias("runs"), _two_tails(lag / F.sqrt(n - 1)).alias("lag"))

        def combined(p: Column) -> Column:
            floor = lambda x: F.log(F.greatest(x, F.lit(1e-200)))
            y = -(floor(p_chi) + floor(p["runs"]) + floor(p["lag"]))
            return common.bind(y, lambda t: F.exp(-t) * (1 + t + t * t / 2))

        return common.bind(common.bind(places, ordered), combined)

    return common.bind(alphabet(token), tests)


def ordinary(token: Column) -> Column:
    """A p-value of "an ordinary token": the ordinary over the uniform probability, 1 at most."""
    letters = [math.log(x / sum(LETTERS)) for x in LETTERS]
    kind = [0 if chr(i).islower() else 1 if chr(i).isupper() else 2 if chr(i).isdigit() else 3 for i in range(128)]
    within = [letters[ord(chr(i).lower()) - 97] if kind[i] < 2 else math.log(0.1 if kind[i] == 2 else 0.2) for i in range(128)]
    kinds, logs, steps = (F.array(*map(F.lit, x)) for x in (kind, within, [math.log(x) for row in NEXT for x in row]))

    def step(a: Column, c: Column) -> Column:
        now = F.get(kinds, c)
        return F.struct(now.alias("kind"), (a["log"] + F.get(steps, a["kind"] * 4 + now) + F.get(logs, c)).alias("log"))

    codes = F.transform(_chars(token), lambda c: F.ascii(c))
    log = F.aggregate(codes, F.struct(F.lit(len(NEXT) - 1).alias("kind"), F.lit(0.0).alias("log")), step)["log"]
    return F.least(F.lit(1.0), F.exp(log + F.length(token) * F.log(F.length(alphabet(token)).cast("double"))))


def secrecy(token: Column) -> Column:
    """The p-value of "ordinary" for a token that could be random, else 1."""
    body = F.regexp_replace(token, "=+$", "")
    return common.bind(body, lambda t: F.when(F.length(t) < MIN_TOKEN, 1.0).when(common.bind(uniformity(t), lambda p: p < UNIFORM_P), 1.0).otherwise(ordinary(t)))


def _length_class(n: Column) -> Column:
    return F.least(F.lit(8), F.floor(F.log2(n / F.lit(10.0)) * 2)).cast("int")


def _bin(p: Column) -> Column:
    """Bins of equal width in log p; the first holds p below 1e-20."""
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.ceil(BINS * (1 + F.log10(F.greatest(p, F.lit(1e-30))) / 20)) - 1)).cast("int")


def thresholds(tokens: DataFrame) -> DataFrame:
    """Per length class, the last bin of the Benjamini-Hochberg discoveries (-1: none), from (klass, bin) rows."""
    bins = tokens.groupBy("klass", "bin").count()
    up_to = Window.partitionBy("klass").orderBy("bin")
    bins = bins.withColumns({"k": F.sum("count").over(up_to), "m": F.sum("count").over(Window.partitionBy("klass"))})
    edge = F.pow(F.lit(10.0), 20.0 * ((F.col("bin") + 1) / BINS - 1))
    return bins.groupBy("klass").agg(F.coalesce(F.max(F.when(edge <= FDR * F.col("k") / F.col("m"), F.col("bin"))), F.lit(-1)).alias("last"))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """Per row: key, base (spans of the base kinds) and spans (these and those of random tokens that no base span meets);
    `also` names more columns to keep."""
    t, more = common.text_of(text), list(also or {})
    lean = docs.select(F.col(key).alias("doc_id"), t.alias("text"), *[c.alias(n) for n, c in (also or {}).items()])
    found = lean.select("doc_id", *more, base_spans(F.col("text")).alias("base"), F.transform(token_spans(F.col("text")), lambda s: F.struct(s.alias("span"), F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]).alias("token"))).alias("tokens"))
    free = F.filter("tokens", lambda x: ~F.exists("base", lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"])))
    judged = found.select("doc_id", *more, "base", F.transform(free, lambda x: F.struct(x["span"].alias("span"), _length_class(F.length(x["token"])).alias("klass"), _bin(secrecy(x["token"])).alias("bin"))).alias("tokens"))
    judged = common.stored(judged, "secret-tokens")
    limits = thresholds(judged.select(F.explode("tokens").alias("t")).select("t.klass", "t.bin"))
    # at most nine length classes
    table = limits.agg(F.map_from_entries(F.collect_list(F.struct("klass", "last"))).alias("limits"))
    joined = judged.withColumn("limits", table.scalar())
    random = F.transform(F.filter("tokens", lambda x: x["bin"] <= F.coalesce(F.try_element_at("limits", x["klass"]), F.lit(-1))), lambda x: x["span"])
    return joined.select(F.col("doc_id").alias(key), *more, "base", F.array_sort(F.concat("base", random)).alias("spans"))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]", text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the text with every span replaced by mask; overlapping spans become one mask."""
    digest = F.xxhash64(F.sha2(common.text_of(text), 256))
    found = scan(docs, text, key, {"__digest": digest}).select("__digest", "spans").distinct()
    joined = docs.select(key, text, digest.alias("__of")).join(found, F.col("__of") == F.col("__digest"))
    step = lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).otherwise(a["out"]).alias("out"),
    )
    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return joined.select(key, common.bind(done, lambda d: F.concat(d["out"], F.substring(common.text_of(text), d["at"] + 1, F.length(common.text_of(text))))).alias(text))
