"""Distinctness and coreference of surrogates over many names, and forms that are used up."""

from __future__ import annotations

import itertools
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from emulsia.llm import queries, surrogates

SURNAMES = ["".join(x) for x in itertools.product(("Ba", "Del", "Fi", "Gor", "Hal", "Jen", "Ka", "Lin", "Mor", "Nel"), ("ba", "del", "fi", "gor", "hal", "jen", "ka", "lin", "mor", "nel"), ("ta", "vel", "son", "man", "er", "ing", "ov", "ski", "es", "ley"))]


def texts(spark, rows, key="k"):
    return {r["doc_id"]: r["text"] for r in surrogates.report(spark.createDataFrame(rows, "doc_id long, text string"), key).collect()}


def test_a_thousand_surnames_keep_coreference_and_distinctness(spark):
    assert len(set(SURNAMES)) == 1000
    got = texts(spark, [(i, f"Mr. {s} met Mr. Adam {s} and Mrs. Eva {s}.") for i, s in enumerate(SURNAMES)])
    names, given = set(), set()
    for i, s in enumerate(SURNAMES):
        a, he, b, she, c = re.fullmatch(r"Mr\. (\w+) met Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+)\.", got[i]).groups()
        assert a == b == c and a not in SURNAMES and he.endswith("o") and she.endswith("a")
        names.add(a)
        given.add((he, she))
    assert len(names) == 1000 and len(given) == 1


def test_names_in_other_forms(spark):
    got = texts(spark, [(1, "Dr. Anna Maria Luisa Rossi, Mrs. Anna O'Neil, Mr. Jean-Paul SMITH and Dr. Robin Smith-Rossi left. Dr. Robin said so."), (2, None), (3, "")])
    doctor, anna, jean, robin = re.search(r"Dr\. (.+), Mrs\. (.+), Mr\. (.+) and Dr\. (.+) left\.", got[1]).groups()
    assert len(doctor.split()) == 4 and not set(doctor.split()) & {"Anna", "Maria", "Luisa", "Rossi"}
    # behind a title without a gender, a given name has that of its other mentions
    assert doctor.split()[0] == anna.split()[0] and anna.split()[0].endswith("a")
    assert "'" in anna.split()[1] and jean.split()[0].count("-") == 1 and jean.split()[1].isupper() and "-" in robin.split()[1]
    assert got[2] is None and got[3] == ""


def test_a_used_up_form_gives_way(spark):
    octets = [("ip", f"{a}.{b}.{c}.{d}") for a, b, c, d in itertools.product(range(1, 10), range(1, 10), range(1, 10), range(0, 10, 1))]
    drawn = surrogates.entity_map(spark.createDataFrame(octets, "kind string, canon string"), "k").collect()
    new = {r["surrogate"] for r in drawn}
    assert len(new) == len(octets) and not new & {c for _, c in octets}
    numbers = [("ssn", f"{i}") for i in range(10)]
    drawn = surrogates.entity_map(spark.createDataFrame(numbers, "kind string, canon string"), "k").collect()
    new = {r["surrogate"] for r in drawn}
    assert len(new) == 10 and not new & {c for _, c in numbers}


def test_every_mention_of_a_corpus_against_plain_coreference(spark):
    rows = [(i, f"Call +1 555 01{i % 20:02d} 4{i % 7}{i % 5}1 or mail u{i % 30}@Example{i % 3}.org from 10.{i % 4}.0.{i % 9}") for i in range(200)]
    got = texts(spark, rows)
    for pattern in (r"\+1 555 \d{4} \d{3,4}|\+\d{1,3} \d{3} \d{4} \d{3,4}", r"\S+@\S+", r"\d+\.\d+\.\d+\.\d+"):
        to, back = {}, {}
        for i, t in rows:
            for old, new in zip(re.findall(pattern, t), re.findall(pattern, got[i])):
                assert to.setdefault(old.lower(), new.lower()) == new.lower() and back.setdefault(new.lower(), old.lower()) == old.lower()
        assert to and not set(to) & set(to.values())


N = 10**6
LONG = {
    "email": ["x@" + "a." * N + "com", "x@" + "a." * N + "1", "x" * N + "@b.org", "x@" + "a" * N, "@" * N],
    "ip": ["1.2.3.4." * N, "1" * N, "10.0.0.1 " * (N // 10)],
    "iban": ["DE44 " + "5001 " * N, "D" * N, "DE44" * N],
    "card": ["4111 " * N, "4" * N, "4111-" * N],
    "ssn": ["123-" * N, "123-45-" * N],
    "phone": ["+1 " + "555 " * N, "+" * N, "(555) " * N, "555." * N],
    "person": ["Mr. " + "Abc " * N, "Mr. A" + "-b" * N, "Mr. A" + "'b" * N, "Mr. " * N, "Mr. " + "A" * N],
}


@pytest.mark.parametrize("kind", LONG)
def test_a_million_repetitions_match_without_recursion(spark, kind):
    one, all_ = F.lit(f"(?:{surrogates.PATTERNS[kind]})"), F.lit(surrogates.ALL)
    for text in LONG[kind]:
        df = spark.createDataFrame([(text,)], "t string")
        hit = F.col("h")
        found = df.select("t", F.regexp_extract_all("t", one, F.lit(0)).alias("own"), F.coalesce(F.try_element_at(F.regexp_extract_all("t", all_, F.lit(0)), F.lit(1)), F.lit("")).alias("h"), F.size(F.split("t", surrogates.ALL, -1)).alias("gaps"))
        got = found.select(F.size("own").alias("n"), "gaps", F.length("h").alias("first"), surrogates.kind_of(hit).alias("kind"), F.length(F.regexp_replace(hit, surrogates.TITLE, "")).alias("named"), F.col("t").rlike(surrogates.SIGNS).alias("signs")).first()
        assert got["gaps"] >= 1
    if kind in ("email", "person"):
        first = spark.createDataFrame([(LONG[kind][0],)], "t string").select(F.length(F.regexp_extract("t", surrogates.ALL, 0))).first()[0]
        assert first == len(LONG[kind][0].rstrip())


def test_possessive_patterns_find_what_greedy_ones_do(spark):
    greedy = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    texts_ = ["".join(x) for x in itertools.product(["u@", "@", "a.b@"], ["b", "b.", "b.c", "b..c", ".", "b-", "1."], ["org", ".org", ".o", ".org2", ".1", ".com.", ".com.x y", ".co.uk", "-", ".c-d"], ["", ".", " z@y.de", ".fr!", ".7"])]
    got = spark.createDataFrame([(t,) for t in texts_], "t string").select("t", F.regexp_extract_all("t", F.lit(surrogates.PATTERNS["email"]), F.lit(0)).alias("h")).collect()
    assert len(got) == len(texts_)
    for r in got:
        assert r["h"] == greedy.findall(r["t"]), r["t"]


def test_a_name_of_thousands_of_words_is_replaced_whole(spark):
    got = texts(spark, [(1, "Mr. " + "Abc Def " * 3000 + "said"), (2, "to x@" + "a." * 3000 + "com")])
    assert not re.search(r"\b(?:Abc|Def)\b", got[1]) and len(got[1].split()) == 6002 and got[2] != "to x@" + "a." * 3000 + "com"


SCRIPTS = {"GREEK": "Παπαδόπουλος", "ARMENIAN": "Պետրոսյան", "CYRILLIC": "Иванова", "LATIN": "Ångström", "COPTIC": "Ⲡⲉⲧⲣⲟⲥ", "GEORGIAN": "ᲒᲘᲝᲠᲒᲘ"}


def test_names_keep_their_script(spark):
    got = texts(spark, [(i, f"Dr {name} said so") for i, name in enumerate(SCRIPTS.values())])
    for i, (script, name) in enumerate(SCRIPTS.items()):
        new = got[i].removeprefix("Dr ").removesuffix(" said so")
        assert new != name and len(new) > 1 and all(unicodedata.name(c).startswith(script) for c in new), (new, name)


def test_a_session_without_a_key_draws_its_own(spark, tmp_path):
    spark.conf.unset(queries.SURROGATE_KEY)
    spark.createDataFrame([(1, "Mr. Smith left")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda: queries.op7_surrogate_pii(spark, str(tmp_path)).first()["text"]
    first, key = run(), spark.conf.get(queries.SURROGATE_KEY)
    assert len(key) == 64 and run() == first
    spark.conf.set(queries.SURROGATE_KEY, "another")
    other = run()
    spark.conf.unset(queries.SURROGATE_KEY)
    run()
    assert other != first and spark.conf.get(queries.SURROGATE_KEY) not in (key, "another")
    spark.conf.unset(queries.SURROGATE_KEY)
