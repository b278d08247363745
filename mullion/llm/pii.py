"""Surrogates for personal data: keyed, of the same type and format, distinct where the originals are, the same everywhere.

DataFrame functions only. One pattern finds entities; an entity is made of parts (an address, a number, each name), a part
is known by its type and its canonical form, whatever way it is written. Each distinct part gets a surrogate that a keyed
hash of type, form and attempt makes; parts that share one, or whose surrogate is itself somebody's data here, take their
next attempt until none is left. Texts then get their entities rewritten in the format each was written in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mullion.llm.common import picked, plain
from mullion.runtime import cut

# Forms of address and the gender they tell.
FEMALE_TITLES = "Mrs Ms Miss Frau Mme Madame Mlle Sra Señora Doña Г-жа Госпожа"
MALE_TITLES = "Mr Herr Monsieur Sr Señor Don Г-н Господин"
OTHER_TITLES = "Dr Prof"
# Syllables that names are built from, by script.
LATIN = "ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne no pa ra re ro sa se ta te to va ve wa za".split()
CYRILLIC = "ба бе бо ва ве да до за ка ко ла ле ло ма ме мо на не но па ра ре ро са се та те то".split()

_TITLES = "|".join(t for t in f"{FEMALE_TITLES} {MALE_TITLES} {OTHER_TITLES}".split())
# What may stand before a word of a name, as it is.
PARTICLES = "van von vom zu zur zum den der des de del della di da do dos das du la le los las af av bin ibn ben ter ten y e und"
# A word of a name is no title and ends before a possessive; initials and particles are passed over.
_WORD = rf"(?<!\p{{L}})(?!(?:{_TITLES})(?![\p{{L}}'-]))\p{{Lu}}(?=[\p{{L}}'-])\p{{L}}*(?:['-](?!s(?!\p{{L}}))\p{{L}}+)*"
_WORD_IN_RUN = rf"(?:(?:{PARTICLES.replace(' ', '|')}) ){{0,3}}(?:\p{{Lu}}\. ?){{0,4}}(?:d'|l'|al-|el-)?{_WORD.replace('(?<!' + chr(92) + 'p{L})', '', 1)}"
PATTERNS = {
    "email": r"[A-Za-z0-9_][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_+/=-]{8,}",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\w)",
    "name": rf"(?<![\p{{L}}])(?:(?:{_TITLES})\.? )+{_WORD_IN_RUN}(?: {_WORD_IN_RUN})*",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = r"[@\d]|(?i:password|passwd|secret|token|key)|(?:" + _TITLES + r")\.? \p{L}"


def kind(value: Column) -> Column:
    """Type of an entity, by the first pattern it is whole."""
    out = F.lit("name")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(value.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


def _words(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(_WORD), F.lit(0))


def parts(value: Column, type_: Column) -> Column:
    """Array of (type, form) of an entity: one, or the given names and the family name of a person."""
    rest = _words(value)

    def titled(titles: str) -> Column:
        return value.rlike(rf"\A(?:(?:{_TITLES})\.? )*?(?:{titles.replace(' ', '|')})\.? ")

    gender = F.when(titled(FEMALE_TITLES), "f").when(titled(MALE_TITLES), "m").otherwise("n")
    person = F.transform(rest, lambda w, i: F.struct(
        F.concat(F.when(i < F.size(rest) - 1, F.concat(F.lit("given-"), gender)).otherwise(F.lit("family")), F.lit("-"),
                 F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")).alias("type"), F.lower(w).alias("form")))
    digits = F.regexp_replace(value, r"\D", "")
    form = (F.when(type_.isin("card", "ssn", "phone"), digits).when(type_ == "email", F.lower(value))
            .when(type_ == "iban", F.regexp_replace(value, " ", "")).when(type_ == "secret", F.regexp_extract(value, r"[=:]\s*\"?(.*)\z", 1)).otherwise(value))
    return F.when(type_ == "name", person).otherwise(F.array(F.struct(type_.alias("type"), form.alias("form"))))


def _noise(key: str, *of: Column) -> Column:
    """64 and more hexadecimal digits that only the key's owner can tell."""
    seed = F.concat_ws("\x1f", F.lit(key), *of)
    return F.concat(F.sha2(F.concat(F.lit("a"), seed), 512), F.sha2(F.concat(F.lit("b"), seed), 512))


def _pick(noise: Column, at, count: int) -> Column:
    """Number below ``count`` from four digits of the noise at a place, which comes round again."""
    return F.conv(F.substr(noise, (at * 3) % 252 + 1, F.lit(4)), 16, 10).cast("int") % count


def _swapped(form: Column, noise: Column) -> Column:
    """Every letter another of its case and script, every digit another digit, all else as it is."""
    chars = F.split(form, "")

    def one(c, i):
        def turned(low: str, size: int):
            return F.chr(F.lit(ord(low)) + (F.ascii(c) - ord(low) + 1 + _pick(noise, i, size - 1)) % size)

        return (F.when(c.rlike("[0-9]"), turned("0", 10)).when(c.rlike("[a-f]") & ~form.rlike("[g-zG-Z@]"), turned("a", 6))
                .when(c.rlike("[a-z]"), turned("a", 26)).when(c.rlike("[A-Z]"), turned("A", 26)).otherwise(c))

    return F.array_join(F.transform(chars, one), "")


def _luhn(body: Column) -> Column:
    """The digits with the check digit after them."""
    total = F.aggregate(F.transform(F.reverse(F.split(body, "")), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int"))),
                        F.lit(0), lambda acc, d: acc + d)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _built(noise: Column, syllables: list[str], attempt: Column, ending: Column) -> Column:
    table = F.array(*[F.lit(s) for s in syllables])
    made = F.transform(F.sequence(F.lit(0), F.lit(2) + F.least(attempt, F.lit(20))), lambda i: F.get(table, _pick(noise, i, len(syllables))))
    return F.initcap(F.concat(F.array_join(made, ""), ending))


def surrogate(type_: Column, form: Column, attempt: Column, key: str) -> Column:
    """Surrogate of a part in its canonical form."""
    noise = _noise(key, type_, form, attempt.cast("string"))
    swapped = _swapped(form, noise)
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    head, last = F.regexp_extract(domain, r"\A(.*)\.[^.]+\z", 1), F.substring_index(domain, ".", -1)
    email = F.concat(_swapped(local, noise), F.lit("@"), _swapped(head, F.reverse(noise)), F.lit("."), last)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_pick(noise, i, 254) + 1).cast("string")), ".")
    card = _luhn(F.concat(F.substring(form, 1, 1), F.substring(swapped, 2, 14)))
    # A number keeps its first digit: with a country code that is the part all its region shares.
    phone = F.concat(F.substring(form, 1, 1), F.substr(swapped, F.lit(2)))
    ending = {("latin", "f"): "a", ("latin", "m"): "n", ("latin", "n"): "l", ("cyrillic", "f"): "а", ("cyrillic", "m"): "н", ("cyrillic", "n"): "ль"}
    out = swapped
    for script, syllables, tail in (("latin", LATIN, "son"), ("cyrillic", CYRILLIC, "ин")):
        for g in "fmn":
            out = F.when(type_ == f"given-{g}-{script}", _built(noise, syllables, attempt, F.lit(ending[script, g]))).otherwise(out)
        out = F.when(type_ == f"family-{script}", _built(noise, syllables, attempt, F.lit(tail))).otherwise(out)
    out = F.when(type_ == "email", email).when(type_ == "ip", ip).when(type_ == "card", card).when(type_ == "phone", phone).when(
        type_ == "key", F.concat(F.lit("AKIA"), F.substr(swapped, F.lit(5)))).when(type_ == "iban", F.concat(F.substring(form, 1, 2), F.substr(swapped, F.lit(3)))).otherwise(out)
    return out


def _family(type_: Column) -> Column:
    """The kind a part's type belongs to."""
    return F.when(type_.rlike("^(given|family)-"), "name").otherwise(type_)


def settled(names: DataFrame) -> DataFrame:
    """One type for each form of ``names`` (type, form, n): given or family, and the gender, by most of its n mentions."""
    def n(start: str) -> Column:
        return F.sum(F.when(F.col("type").startswith(start), F.col("n")).otherwise(0))

    votes = names.groupBy("form").agg(n("family").alias("family"), n("given").alias("given"), n("given-f").alias("f"), n("given-m").alias("m"), F.max(F.substring_index("type", "-", -1)).alias("script"))
    gender = F.when(F.col("f") > F.col("m"), "given-f-").when(F.col("m") > F.col("f"), "given-m-").otherwise("given-n-")
    return votes.select(F.concat(F.when(F.col("family") > F.col("given"), "family-").otherwise(gender), "script").alias("type"), "form")


def assign(found: DataFrame, key: str) -> DataFrame:
    """Distinct (type, form) with a surrogate each, no two of a type alike and none that is a form of its type itself.

    Given and family names count as one type there.

    Rounds go on while a collision is left; what collides is a handful of rows, and only their number reaches the driver.
    """
    table = cut(found.select("type", "form").distinct().withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("type"), F.col("form"), F.lit(0), key)))
    while True:
        shared = table.groupBy(_family(F.col("type")).alias("class"), F.lower("surrogate").alias("low")).agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("owner")).filter("n > 1").drop("n")
        taken = table.select(_family(F.col("type")).alias("class"), F.lower("form").alias("low"), F.lit(True).alias("real"))
        seen = table.withColumn("class", _family(F.col("type"))).withColumn("low", F.lower("surrogate")).join(shared, ["class", "low"], "left").join(taken.distinct(), ["class", "low"], "left")
        again = F.coalesce("real", F.lit(False)) | F.coalesce(F.col("form") != F.col("owner"), F.lit(False))
        clash = cut(seen.filter(again).select("type", "form"))
        if clash.isEmpty():
            return table.select("type", "form", "surrogate")
        next_ = F.col("attempt") + F.coalesce(F.col("move"), F.lit(0))
        moved = table.join(clash.withColumn("move", F.lit(1)), ["type", "form"], "left").withColumn("attempt", next_)
        table = cut(moved.withColumn("surrogate", F.when(F.col("move") == 1, surrogate(F.col("type"), F.col("form"), F.col("attempt"), key)).otherwise(F.col("surrogate"))).drop("move"))


def _cased(word: Column, made: Column) -> Column:
    return F.when(word == F.upper(word), F.upper(made)).otherwise(made)


def _bare(names: Column) -> Column:
    """Pattern of runs of the name words of one document, standing without a title."""
    any_ = F.concat(F.lit(r"(?=\p{Lu})(?iu:"), F.array_join(names["form"], "|"), F.lit(r")(?!\p{L})"))
    return F.concat(F.lit(r"(?<!\p{L})"), any_, F.lit("(?: "), any_, F.lit(")*"))


def _fitted(value: Column, type_: Column, made: Column) -> Column:
    """The surrogate in the format the value is written in; ``made`` holds the surrogates of its parts in order."""
    only = F.get(made, F.lit(0))
    digits = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda acc, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substr(only, acc["at"] + 1, F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))), lambda acc: acc["out"])
    spaced = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), lambda acc, c: F.when(
        c == " ", F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], F.substr(only, acc["at"] + 1, F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))), lambda acc: acc["out"])
    cased = F.zip_with(_words(value), made, _cased)
    name = F.array_join(F.flatten(F.zip_with(F.split(value, _WORD, -1), cased, lambda g, w: F.array(g, F.coalesce(w, F.lit(""))))), "")
    secret = F.concat(F.regexp_extract(value, r"\A(.*?[=:]\s*\"?)", 1), only)
    email = F.when(value == F.upper(value), F.upper(only)).otherwise(only)
    return (F.when(type_.isin("card", "ssn", "phone"), digits).when(type_ == "iban", spaced).when(type_ == "name", name).when(type_ == "secret", secret)
            .when(type_ == "email", email).otherwise(only))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text with surrogates, n_entities (replaced, repeats counted).

    Texts are read whole; one without entities comes back as it is, null as an empty text. The same part has the same
    surrogate in every document and way of writing, for one ``key``; keep it secret. Ids may be null or repeat. A person is
    found by a title; the words of the name are then replaced wherever they stand in that document. Names that no title
    goes with in their document are not found.
    """
    source = picked(docs, doc_id=id_col, text=text_col).withColumn("text", plain(F.col("text")))
    hinted = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    values = source.select("doc_id", F.xxhash64("text").alias("mark"), F.explode_outer(F.array_distinct(hinted)).alias("value")).filter("value IS NOT NULL").distinct()
    values = cut(values.withColumn("type", kind(F.col("value"))).withColumn("parts", parts(F.col("value"), F.col("type"))))
    distinct = values.groupBy("value", "type", "parts").agg(F.count(F.lit(1)).alias("n"))
    pieces = distinct.select("value", "n", F.col("type").alias("kind"), F.posexplode("parts").alias("at", "part")).select("value", "n", "kind", "at", "part.type", "part.form")
    found = pieces.filter("kind <> 'name'").select("type", "form").unionByName(settled(pieces.filter("kind = 'name'")))
    table = assign(found, key).select(_family(F.col("type")).alias("kind"), "form", "surrogate")
    # An entity has as many parts as a name has words.
    fitted = pieces.join(table, ["kind", "form"]).groupBy("value", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate", "form"))).alias("made"))
    names = F.when(F.col("kind") == "name", F.transform("made", lambda p: F.struct(p["form"].alias("form"), p["surrogate"].alias("surrogate"))))
    fitted = fitted.select("value", _fitted(F.col("value"), F.col("kind"), F.col("made.surrogate")).alias("replacement"), names.alias("names"))
    # A document's own entities, no more than its text has.
    maps = values.select("doc_id", "mark", "value").join(fitted, "value").groupBy("doc_id", "mark").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "replacement"))).alias("swap"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    m = maps.select(F.col("doc_id").alias("m_id"), "mark", "swap", "names")
    met = source.withColumn("mark", F.xxhash64("text")).join(m.withColumnRenamed("mark", "m_mark"), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("mark") == F.col("m_mark")), "left")
    named = F.size("names") > 0
    pattern = F.concat(F.lit(f"{ANY}|"), _bare(F.col("names")))
    met = met.withColumn("held", F.when(F.col("swap").isNotNull(), F.when(named, F.regexp_extract_all("text", pattern, F.lit(0))).otherwise(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))))
    gaps = F.when(named, F.split("text", pattern, -1)).otherwise(F.split("text", ANY, -1))

    def word(w):
        return _cased(w, F.coalesce(F.element_at(F.map_from_entries("names"), F.lower(w)), w))

    def replaced(v):
        return F.coalesce(F.element_at(F.col("swap"), v), F.array_join(F.transform(F.split(v, " "), word), " "))

    woven = F.array_join(F.flatten(F.zip_with(gaps, F.transform("held", replaced), lambda g, r: F.array(g, F.coalesce(r, F.lit(""))))), "")
    return met.select("doc_id", F.when(F.col("swap").isNull(), F.col("text")).otherwise(woven).alias("text"), F.when(F.col("held").isNull(), 0).otherwise(F.size("held")).cast("bigint").alias("n_entities"))
