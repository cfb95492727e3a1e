"""Surrogates for personal data: keyed replacements of the same type, gender, script and format.

One pattern finds e-mail addresses, IPv4 addresses, card, account and social security numbers, phone numbers, and names
behind a title. Mentions are brought to a canonical form (digits of a phone number, lower case of an address), so that
all spellings of an entity get the same surrogate. A name is made of entities of its own: its last word is a surname,
the others are given names, and each word keeps its surrogate in all names, so that "Mr. Lee" stays the Lee of "Mr. Kim
Lee" and two names that differ in a word still differ. A given name has the gender of its title; behind a title without
one, that of the titles it has elsewhere in the corpus, if they agree.

A surrogate is drawn by a hash of the key, type, canonical form and attempt: digits become digits, letters letters of
the same case, octets octets of as many digits, cards that pass the Luhn check pass it again, and names take syllables of
their script with an ending for the gender; in a script without syllables here, letters of the word itself, drawn anew. Surrogates are then compared over the corpus: where two entities of a type
share one, or it is itself an entity of the corpus, all but the least entity draw again, until none do. From attempt
WIDE on, a form whose class may be used up gives way: one more character an attempt, or octets of any length, and from
attempt WIDEST octets that no address has. The map is joined to the mentions, never collected.

Defined results: a null text stays null and has no mentions; a very long text is searched whole; repeated rows are rows
of their own and get equal texts; columns of docs may have any names, but `also` replaces one of its name; an empty
table gives an empty table. Built-in expressions only. Texts with a mention are written once to the shared folder; other
texts don't move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A word of a name: Smith, Anne-Marie, O'Neil. Repeated groups are possessive, or bounded: others match by recursion, a
#: level a repetition, and a text that repeats enough overflows the stack.
NAME = r"\p{Lu}(?:\p{L}+|['’]\p{L}+)(?:[-'’]\p{L}+)*+"
#: A domain: all labels, if they end in a top-level one, or else as many as do, of the 127 that a domain may have.
DOMAIN = r"(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*+(?<=\.[A-Za-z]{2,63})|[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,})"
#: The patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@" + DOMAIN,
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "person": r"\b(?:Mr|Mrs|Ms|Miss|Sir|Dr|Prof|Herr|Frau|Señora|Señor|Madame|Monsieur|г-н|г-жа)\.? " + NAME + "(?: " + NAME + ")*+",
}
MALE, FEMALE = r"^(?:Mr|Sir|Herr|Señor|Monsieur|г-н)\b", r"^(?:Mrs|Ms|Miss|Frau|Señora|Madame|г-жа)\b"
SYLLABLES = {
    "latin": ["ba", "del", "fi", "gor", "hal", "jen", "ka", "lin", "mor", "nel", "or", "pe", "quin", "ro", "san", "ta", "vel", "wes"],
    "cyrillic": ["ба", "вел", "го", "дор", "жен", "зи", "кар", "лен", "ми", "нов", "ор", "пе", "ро", "сан", "та", "фи"],
    "greek": ["βα", "γε", "δο", "ζη", "θα", "κα", "λε", "μα", "νι", "πα", "ρο", "σα", "τα", "φι", "χρι", "ψα"],
    "armenian": ["բա", "գո", "դա", "զա", "թա", "լի", "խա", "կա", "հա", "մա", "նա", "պե", "ռու", "սա", "տի", "քա"],
    "georgian": ["ბა", "გო", "და", "ვა", "ზა", "თა", "კა", "ლე", "მა", "ნი", "პა", "რუ", "სო", "ტა", "ქე", "შა"],
}
ENDINGS = {
    "m": {"latin": "o", "cyrillic": "ов", "greek": "ος", "armenian": "են", "georgian": "გი", "other": ""},
    "f": {"latin": "a", "cyrillic": "ова", "greek": "α", "armenian": "ուհի", "georgian": "ნა", "other": ""},
    "n": {"latin": "en", "cyrillic": "их", "greek": "ης", "armenian": "ի", "georgian": "რი", "other": ""},
}
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every mention but a name has, and a name's title: a text without either isn't searched.
SIGNS = r"[0-9@]|\b(?:Mr|Mrs|Ms|Miss|Sir|Dr|Prof|Herr|Frau|Señora|Señor|Madame|Monsieur|г-н|г-жа)\.? \p{Lu}"
WIDE, WIDEST = 8, 24
TITLE = r"^(?:\S+?)\.? (?=\p{Lu})"


def kind_of(hit: Column) -> Column:
    out = F.lit("person")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(hit.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    person = F.when(hit.rlike(MALE), "person_m").when(hit.rlike(FEMALE), "person_f").otherwise("person_n")
    return F.when(out == "person", person).otherwise(out)


def parts_of(hit: Column, kind: Column) -> Column:
    """The entities of a mention, as an array of (kind, word, canon): the words of a name, or the whole."""
    digits = F.regexp_replace(hit, "[^0-9]", "")
    whole = F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.lower(F.regexp_replace(hit, " ", ""))).otherwise(F.lower(hit))
    words = F.split(F.regexp_replace(hit, TITLE, ""), " ")
    given = F.concat(F.lit("given"), F.substring(kind, -2, 2))
    part = lambda k, w, c: F.struct(k.alias("kind"), w.alias("word"), c.alias("canon"))
    named = common.bind(words, lambda ws: F.transform(ws, lambda w, i: part(F.when(i == F.size(ws) - 1, "surname").otherwise(given), w, F.lower(w))))
    return F.when(kind.startswith("person"), named).otherwise(F.array(part(kind, hit, whole)))


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _letters(text: Column, seed: Column) -> Column:
    """Each digit and letter a-z of a canonical form redrawn, other characters kept."""
    pick = lambda c, i: (
        F.when(c.rlike("^[0-9]$"), F.substring(F.lit("0123456789"), _draw(seed, i, 10) + 1, F.lit(1)))
        .when(c.rlike("^[a-z]$"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _draw(seed, i, 26) + 1, F.lit(1))).otherwise(c)
    )
    return F.array_join(F.transform(_chars(text), pick), "")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits doubled at every second place from the last but one."""
    step = lambda a, d: F.struct((1 - a["odd"]).alias("odd"), (a["sum"] + F.when(a["odd"] == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)).alias("sum"))
    return F.aggregate(F.reverse(F.transform(_chars(digits), lambda c: c.cast("int"))), F.struct(F.lit(0).alias("odd"), F.lit(0).alias("sum")), step)["sum"]


def _card(canon: Column, seed: Column) -> Column:
    drawn = F.concat(F.substring(canon, 1, 1), F.substring(_letters(canon, seed), F.lit(2), F.length(canon) - 2))
    check = F.pmod(10 - F.pmod(_luhn_sum(F.concat(drawn, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    last = F.when(F.pmod(_luhn_sum(canon), F.lit(10)) == 0, check).otherwise(F.substring(_letters(canon, seed), -1, 1))
    return F.concat(drawn, last)


def _octets(canon: Column, seed: Column, attempt: Column) -> Column:
    def pick(o: Column, i: Column) -> Column:
        same = F.when(F.length(o) == 1, 1 + _draw(seed, i, 9)).when(F.length(o) == 2, 10 + _draw(seed, i, 90)).otherwise(100 + _draw(seed, i, 155))
        return F.when(attempt < WIDE, same).when(attempt < WIDEST, 1 + _draw(seed, i, 254)).otherwise(256 + _draw(seed, i, 744)).cast("string")

    return F.array_join(F.transform(F.split(canon, r"\."), pick), ".")


def _email(canon: Column, seed: Column) -> Column:
    top = F.regexp_extract(canon, r"\.[a-z]{2,}$", 0)
    return F.concat(_letters(F.substring(canon, F.lit(1), F.length(canon) - F.length(top)), seed), top)


def _word(canon: Column, kind: Column, seed: Column, attempt: Column) -> Column:
    """A word of a name: a stem for each of its hyphenated parts, an apostrophe behind the first letter where it had one."""
    gender = F.substring(kind, -1, 1)

    def of(script: str) -> Column:
        known = SYLLABLES.get(script)
        options = F.array(*[F.lit(x) for x in known]) if known else F.filter(_chars(canon), lambda c: c.rlike(r"^\p{L}$"))
        count = F.lit(len(known)) if known else F.size(options)
        ending = F.create_map(*[F.lit(x) for g, e in ENDINGS.items() for x in (g, e[script])])

        def stem(part: Column, i: Column) -> Column:
            syllables = F.transform(F.sequence(F.lit(1), 3 + (attempt / 4).cast("int")), lambda k: F.get(options, F.pmod(F.xxhash64(seed, i * 100 + k), count).cast("int")))
            name = common.bind(F.array_join(syllables, ""), lambda n: F.when(part.rlike("^.['’]"), F.concat(F.substring(n, 1, 1), F.lit("'"), F.initcap(F.substring(n, F.lit(2), F.length(n))))).otherwise(n))
            return F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))

        whole = F.array_join(F.transform(F.split(canon, "-"), stem), "-")
        return F.concat(whole, F.when(kind.startswith("given"), F.element_at(ending, gender)).otherwise(""))

    out = F.when(canon.rlike(r"\p{IsLatin}"), of("latin"))
    for script in list(SYLLABLES)[1:]:
        out = out.when(canon.rlike(rf"\p{{Is{script.title()}}}"), of(script))
    return out.otherwise(of("other"))


def surrogate(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a canonical form, itself in canonical form (names: as written)."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256)
    more = F.repeat(F.lit("0"), F.greatest(F.lit(0), attempt - (WIDE - 1)))
    longer = F.concat(canon, more)
    named = kind.startswith("given") | (kind == "surname")
    return common.bind(seed, lambda s: (
        F.when(kind == "email", _email(F.concat(F.translate(more, "0", "a"), canon), s)).when(kind == "ip", _octets(canon, s, attempt)).when(kind == "card", _card(longer, s))
        .when(kind == "iban", F.concat(F.substring(canon, 1, 2), F.substring(_letters(longer, s), F.lit(3), F.length(longer))))
        .when(named, _word(canon, kind, s, attempt)).otherwise(_letters(longer, s))
    ))


def entity_map(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon), no two of a type with one surrogate, none a real entity.

    Given names of all genders are one type. Each round redraws the losers of a collision only; forms widen, so that
    there is always a free one.
    """
    typed = entities.withColumn("type", F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")))
    start = F.lit(0)
    drawn = common.stored(typed.withColumns({"attempt": start, "surrogate": surrogate(F.col("kind"), F.col("canon"), key, start)}), "surrogates")
    real = typed.select("type", F.col("canon").alias("real")).distinct()
    owner = F.struct("attempt", "canon", "kind")
    while True:
        first = drawn.groupBy("type", "surrogate").agg(F.min(owner).alias("first"), F.count("*").alias("n"))
        taken = first.join(real.hint("merge"), (first["type"] == real["type"]) & (F.lower("surrogate") == F.col("real")), "left").select(first["type"], "surrogate", "first", (F.col("real").isNotNull()).alias("is_real"), "n")
        bad = common.stored(taken.filter("n > 1 OR is_real"), "collisions")
        if bad.isEmpty():
            return drawn.drop("attempt", "type")
        marked = common.join_same(drawn, bad.hint("merge"), ["type", "surrogate"], "left")
        again = F.coalesce(F.col("is_real") | (F.col("n").isNotNull() & ~F.col("first").eqNullSafe(owner)), F.lit(False))
        more = F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt"))
        redrawn = F.when(again, surrogate(F.col("kind"), F.col("canon"), key, F.col("attempt") + 1)).otherwise(F.col("surrogate"))
        drawn = common.stored(marked.select("kind", "canon", "type", more.alias("attempt"), redrawn.alias("surrogate")), "surrogates")


def genders(entities: DataFrame) -> DataFrame:
    """entities with `as_kind`: a given name without a gender takes that of its other mentions, if they agree."""
    seen = entities.filter("kind IN ('given_m', 'given_f')").groupBy("canon").agg(F.min("kind").alias("low"), F.max("kind").alias("high"))
    seen = seen.filter("low = high").select(F.lit("given_n").alias("kind"), "canon", "low")
    joined = common.join_same(entities, seen.hint("merge"), ["kind", "canon"], "left")
    return joined.select("kind", "canon", F.coalesce("low", "kind").alias("as_kind"))


def poured(word: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the format of the mention."""
    shown = F.regexp_replace(word, "[^0-9A-Za-z]", "")
    plain = F.regexp_replace(new, "[^0-9a-z]", "")
    step = lambda a, c: F.struct(
        F.when(c.rlike("^[0-9A-Za-z]$"), a["i"] + 1).otherwise(a["i"]).alias("i"),
        F.concat(a["out"], F.when(c.rlike("^[A-Z]$"), F.upper(F.substring(plain, a["i"] + 1, F.lit(1)))).when(c.rlike("^[0-9a-z]$"), F.substring(plain, a["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
    )
    filled = F.aggregate(_chars(word), F.struct(F.lit(0).alias("i"), F.lit("").alias("out")), step)["out"]
    named = F.when((F.length(word) > 1) & (F.upper(word) == word), F.upper(new)).otherwise(new)
    return F.when(kind.startswith("given") | (kind == "surname"), named).when(F.length(shown) == F.length(plain), filled).otherwise(new)


def replace(docs: DataFrame, key: str, text: str = "text", also: str = "mentions") -> DataFrame:
    """docs with the texts replaced, and (also) the mentions as an array of (kind, surrogate) in order."""
    hits, row, other = common.fresh(docs, "__hits", "__row", "__other")
    searched = F.when(common.text_of(text).rlike(SIGNS), F.regexp_extract_all(common.text_of(text), F.lit(ALL), F.lit(0)))
    found = docs.withColumn(hits, F.coalesce(searched, F.array().cast("array<string>")))
    kinds = F.transform(hits, lambda h: common.bind(kind_of(h), lambda k: F.struct(h.alias("hit"), k.alias("kind"), parts_of(h, k).alias("parts"))))
    some = common.stored(found.filter(F.size(hits) > 0).withColumn(hits, kinds).withColumn(row, F.monotonically_increasing_id()), "mentions")
    mentions = some.select(F.col(row).alias("row"), F.posexplode(hits).alias("at", "m"))
    words = mentions.select("row", "at", F.col("m.hit").alias("hit"), F.col("m.kind").alias("is"), F.posexplode("m.parts").alias("nth", "p")).select("row", "at", "hit", "is", "nth", "p.*")
    entities = genders(common.stored(words.select("kind", "canon").distinct(), "entities"))
    drawn = entity_map(entities.select(F.col("as_kind").alias("kind"), "canon").distinct(), key).withColumnsRenamed({"kind": "as_kind"})
    # merged: compressed tables look small to the planner, and these grow with the entities
    drawn = common.join_same(entities, drawn.hint("merge"), ["as_kind", "canon"]).select("kind", "canon", "surrogate")
    joined = common.join_same(words, drawn.hint("merge"), ["kind", "canon"]).select("row", "at", "hit", "is", "nth", poured(F.col("word"), F.col("kind"), F.col("surrogate")).alias("new"))
    title = F.when(F.col("is").startswith("person"), F.regexp_extract("hit", TITLE, 0)).otherwise("")
    names = F.concat(title, F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "new"))), lambda x: x["new"]), " "))
    whole = joined.repartition("row").groupBy("row", "at", "hit", "is").agg(names.alias("new"))
    lists = whole.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.col("is").alias("kind"), "new"))).alias("news"))
    filled = some.join(lists.withColumnsRenamed({"row": other}).hint("merge"), F.col(row) == F.col(other))
    gaps = F.split(common.text_of(text), ALL, -1)
    changed = F.array_join(F.zip_with(gaps, F.col("news"), lambda g, n: F.concat(g, F.coalesce(n["new"], F.lit("")))), "")
    shown = F.transform("news", lambda n: F.struct(n["kind"].alias("kind"), n["new"].alias("surrogate")))
    own = [F.col(c) for c in docs.columns if c.lower() not in (text.lower(), also.lower())]
    out = filled.select(*own, changed.alias(text), shown.alias(also))
    same = found.filter(F.size(hits) == 0).select(*own, text, F.array().cast(out.schema[also].dataType).alias(also))
    return out.unionByName(same)


def report(docs: DataFrame, key: str) -> DataFrame:
    """Per document: doc_id, the number of mentions of each kind, n_distinct surrogates, and the text with surrogates."""
    done = replace(docs.select("doc_id", "text"), key)
    count = lambda k: F.size(F.filter("mentions", lambda m: m["kind"].startswith(k))).cast("long").alias(f"n_{k}")
    return done.select("doc_id", *[count(k) for k in PATTERNS], F.size(F.array_distinct("mentions")).cast("long").alias("n_distinct"), "text")
