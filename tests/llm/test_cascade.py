"""The cascade: one verdict whatever the order, one name, and no rule behind the one that caught a text."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from emulsia.llm import quality_rules as q

ROWS = [(1, "one two"), (2, "#$% " * 40), (3, "so very odd! " * 3 + "! " * 60), (4, " ".join(f"{a}word{b}" for a in "abcdefg" for b in "hijklmn")), (5, " ".join(str(i * 7919) for i in range(60))), (6, None), (7, "\n\n".join(["a line of its own"] * 3 + [f"line {i} of many" for i in range(9)])), (8, "x" * 2000 + " " + " ".join(f"v{i}" for i in range(30)))]


def test_order_changes_neither_verdict_nor_name(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    rules, seen = q.production_rules(), set()
    for order in itertools.islice(itertools.permutations(range(len(rules))), 0, 5040, 1700):
        monkeypatch.setattr(q, "plan_cascade", lambda d, r, t="text", order=order: [q.Measured(r[i], 1.0, 0.1) for i in order])
        got = {r["doc_id"]: (r["kept"], r["rejected_by"]) for r in q.judge(docs, rules).collect()}
        assert {r["doc_id"] for r in q.keep_good(docs, rules).collect()} == {i for i, (kept, _) in got.items() if kept}
        seen.add(tuple(sorted(got.items())))
    (verdicts,) = seen
    names = {i: by for i, (_, by) in verdicts}
    assert names[1] == "few_words" and names[2] == "repeats" and names[4] is None and names[5] == "digits" and names[6] == "few_words" and names[8] == "long_words"


def test_blank_lines_dont_hide_repeated_ones(spark):
    text = "\n\n".join(["the same words on each of these lines"] * 5 + ["another one", "and one more"])
    (row,) = spark.createDataFrame([(text,)], "text string").select(q.cascade(q.production_rules()[3:4], q.Measures(F.col("text"), q.split_words(F.col("text")))).alias("by")).collect()
    assert row["by"] == "duplicate_lines"


def test_rules_behind_the_first_are_not_computed(spark):
    def never(m):
        return F.raise_error(F.lit("a rule behind the one that caught the text was computed")).cast("boolean")

    rules = [q.Rule("short", lambda m: m.n_words < 100), q.Rule("never", never)]
    docs = spark.createDataFrame(ROWS[:1], "doc_id long, text string")
    by = docs.select(q.cascade(rules, q.Measures(F.col("text"), q.split_words(F.col("text")))).alias("by")).collect()
    assert [r["by"] for r in by] == ["short"]
