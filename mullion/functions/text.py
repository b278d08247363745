"""Text functions on Columns: keys, headings, tags, prices, printed numbers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from mullion.functions import vocab


def match_key(c: Column) -> Column:
    """Upper-cased letters and digits only, so punctuation never splits a model."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def norm_header(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9# ]+", " "), " +", " "))


def squeezed(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def without_group(c: Column) -> Column:
    """A normalised heading without group words and without adjacent repeats."""
    def tidy(kept: Column) -> Column:
        return F.array_join(F.transform(
            F.filter(F.transform(kept, lambda w, i: F.struct(w.alias("w"), F.get(kept, i - 1).alias("before"))),
                     lambda s: s.before.isNull() | (s.before != s.w)), lambda s: s.w), " ")

    # As the variable of a lambda the words are split once, not once a word.
    words = F.filter(F.split(c, " "), lambda w: ~w.isin(vocab.GROUP_WORDS))
    return F.get(F.transform(F.array(words), tidy), F.lit(0))


def extra_key(header: Column, index: Column) -> Column:
    """Snake-case key for a column that did not map; ``column_n`` when nothing is left."""
    key = F.regexp_replace(F.regexp_replace(F.lower(header), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(key != "", key).otherwise(F.concat(F.lit("column_"), (index + 1).cast("string")))


def is_tag(c: Column) -> Column:
    return c.rlike(vocab.TAG_RE)


def join_split_mark(c: Column) -> Column:
    """'105 B' is one mark: 105B."""
    return F.regexp_replace(F.trim(c), r"^(\d{1,4})\s+([A-Za-z]{1,2})$", "$1$2")


def run_on_tag(c: Column) -> Column:
    """struct(tag, room): '114 ALTERATION ROOM' becomes its number and its room."""
    first = F.regexp_extract(F.trim(c), r"^(\S+)\s+(.*[A-Za-z]{3}.*)$", 1)
    rest = F.regexp_extract(F.trim(c), r"^(\S+)\s+(.*[A-Za-z]{3}.*)$", 2)
    ok = is_tag(first)
    return F.struct(F.when(ok, first).otherwise(c).alias("tag"), F.when(ok, F.trim(rest)).otherwise(F.lit("")).alias("room"))


def clean_tag(c: Column) -> Column:
    return run_on_tag(join_split_mark(c))


def listed_tags(c: Column) -> Column:
    """The tags a cell lists, when every part is tag-shaped and there are two or more."""
    parts = F.filter(F.split(F.trim(c), r"(?i)\s*(?:[,;&]|\bAND\b|\s)\s*"), lambda p: p != "")
    return F.when((F.size(parts) >= 2) & F.forall(parts, is_tag), parts).otherwise(F.array().cast("array<string>"))


def clean(c: Column) -> Column:
    """Typesetting variants of hyphens, spaces and quotes written one way."""
    c = F.translate(c, "‑‐–  ”″’", "---  \"\"'")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x1f\\x7f]", " "), r"(?U)\s+", " "))


def amount(c: Column) -> Column:
    return F.regexp_replace(c, "[$,]", "").try_cast("decimal(12,2)")


def is_price(c: Column) -> Column:
    return c.rlike(vocab.MONEY_RE) | c.rlike(vocab.DECIMAL_RE)


def norm_finish(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"\s+", ""))


def known_finishes() -> list[str]:
    return sorted({n for pair in vocab.FINISH_PAIRS for n in pair} | set(vocab.OTHER_FINISHES))


def is_finish(c: Column) -> Column:
    known = known_finishes()
    return (norm_finish(c).isin(known) | c.rlike(r"^US\d+[A-Z]{0,3}$") | c.rlike(r"^(6\d\d|7[0-2]\d)[A-Za-z]{0,2}$")
            | (c.rlike(r"^\d{1,2}[A-Z]{1,3}$") & F.concat(F.lit("US"), norm_finish(c)).isin(known)))


def is_size(c: Column) -> Column:
    return c.rlike(vocab.SIZE_RE)


def is_code(c: Column) -> Column:
    return c.rlike(vocab.CODE_RE) & ~c.rlike(vocab.DATE_RE) & ~c.rlike(vocab.DECIMAL_RE) & ~is_finish(c)


def token_kind(c: Column) -> Column:
    """What a price-table token is: price, size, finish, code or word."""
    return (F.when(is_price(c), "price").when(is_size(c), "size").when(is_finish(c), "finish")
            .when(is_code(c), "code").otherwise("word"))


def finish_group(c: Column) -> Column:
    """One id per set of names that mean the same finish; unknown names are their own group."""
    name = norm_finish(c)
    pairs = F.create_map(*[F.lit(x) for a, b in vocab.FINISH_PAIRS for x in (b, a)])
    return F.coalesce(F.element_at(pairs, name), name)


def finishes_in(c: Column) -> Column:
    """Finish words of a heading, kept only when every part is finish-shaped."""
    parts = F.transform(F.split(c, r"\s+or\s+|/"), norm_finish)
    return F.when(F.forall(parts, lambda p: p.rlike(vocab.FINISH_HEAD_RE)), parts).otherwise(
        F.array().cast("array<string>"))


def expand_product(c: Column) -> Column:
    """'[98/99]48' names 9848 and 9948; no digit or an odd shape names nothing."""
    pre, alts, suf = (F.regexp_extract(c, vocab.PRODUCT_RE, i) for i in (1, 2, 3))
    ok = c.rlike(vocab.PRODUCT_RE) & c.rlike(r"\d")
    return F.when(~ok, F.array().cast("array<string>")).when(
        alts == "", F.array(F.concat(pre, suf))).otherwise(
        F.transform(F.split(alts, "/"), lambda a: F.concat(pre, a, suf)))


def printed_page(c: Column) -> Column:
    """Page number in the running header: three layouts tried in order, '' when none."""
    head = F.substring(c, 1, 200)
    layouts = [r"^\s*(\d{1,4})[^\w\n]{1,12}Price book", r"Rev\. [\d/]+[^\w\n]{1,12}(\d{1,4})\b",
               r"(?:^|\n)\s*(\d{1,4})\s*\n?\s*\d{2}/\d{2}/\d{4}"]
    return F.coalesce(*[F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in layouts], F.lit(""))


def amounts(c: Column) -> Column:
    """Every number printed on a page, deductions also as negatives."""
    as_number = lambda t: F.regexp_replace(t, "[$,]", "").try_cast("decimal(18,2)")
    plain = F.transform(F.regexp_extract_all(c, F.lit(vocab.NUMBER_RE), F.lit(0)), as_number)
    less = F.transform(F.regexp_extract_all(c, F.lit(vocab.DEDUCTION_RE), F.lit(1)),
                       lambda t: (-as_number(t)).cast("decimal(18,2)"))
    return F.array_compact(F.array_union(plain, less))


def norm_number(c: Column) -> Column:
    """A-5.01, A5.01 and A5-01 are one sheet."""
    return F.upper(F.regexp_replace(c, r"[-.\s]", ""))


def rating(c: Column) -> Column:
    """Fire rating stated in a description ('1 HR'), '' when none."""
    n = F.regexp_extract(c, r"(?i)(\d+)\s*[-\s]?\s*(HR|HOUR)", 1)
    return F.when(n != "", F.concat(n, F.lit(" HR"))).otherwise(F.lit(""))


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length: how close two keys are spelled."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def phrase_pattern(query: str) -> str | None:
    """Pattern for a corpus search: gaps of spaces or hyphens are optional, the
    text may not touch another letter or digit unless the query ends in ``*``."""
    words = [w for w in re.split(r"[\s\-]+", query.strip().rstrip("*")) if w]
    if not words:
        return None
    end = "" if query.strip().endswith("*") else "(?![A-Za-z0-9])"
    return "(?i)(?<![A-Za-z0-9])" + r"[\s\-]*".join(re.escape(w) for w in words) + end


def any_of(c: Column, tests) -> Column:
    return reduce(lambda a, b: a | b, [t(c) for t in tests])


# Heading words -----------------------------------------------------------

def header_words(c: Column) -> Column:
    """Known schedule-heading words of one cell: empty for sentences and long cells."""
    text = F.trim(F.regexp_replace(F.upper(c), r"\s+", " "))
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z0-9._]+"), F.lit(0)))
    phrases = [w for w in vocab.HEADER_WORDS if " " in w or "." in w]
    single = [w for w in vocab.HEADER_WORDS if w not in phrases]
    spell = F.create_map(*[F.lit(x) for kv in vocab.ABBREVIATIONS.items() for x in kv])
    hits = F.array_union(
        F.array_union(F.array_compact(F.transform(tokens, lambda t: F.element_at(spell, t))),
                      F.array_intersect(tokens, F.array(*[F.lit(w) for w in single]))),
        F.filter(F.array(*[F.lit(w) for w in phrases]), lambda w: F.contains(text, w)))
    # Most cells hold no such word: one pattern rules them out before any array work.
    any_word = "|".join(re.escape(w) for w in sorted({*vocab.HEADER_WORDS, *vocab.ABBREVIATIONS}))
    able = (F.length(c) >= 2) & c.rlike("[A-Za-z]")  # every word has two characters and a letter
    ok = able & c.rlike(f"(?i){any_word}") & (F.length(text) <= 32) & (F.size(tokens) <= 5)
    return F.when(ok, hits).otherwise(F.array().cast("array<string>"))


def starts_table(c: Column) -> Column:
    upper = F.upper(F.trim(c))
    first = F.substring(upper, 1, 1).isin(sorted({w[0] for w in vocab.TABLE_STARTS}))  # most texts are told by it
    return first & F.regexp_replace(F.regexp_replace(upper, r"\s+", " "), r"[.:]+$", "").isin(vocab.TABLE_STARTS)


def map_headers(headers: Column) -> Column:
    """Canonical field per heading of one table, '' where none."""
    norms = F.transform(headers, norm_header)
    return grant_headers(norms, F.transform(norms, header_claims))


def header_claims(norm: Column) -> Column:
    """The (pass, field) claims a normalised heading can make, as pass * fields + field."""
    fields = [f for f, _ in vocab.HEADER_ALIASES]
    alias = F.array(*[
        F.struct(F.lit(i).alias("f"), F.lit(_norm(a)).alias("a"), F.lit(_norm(a).replace(" ", "")).alias("sq"),
                 F.lit(" " in _norm(a) or a in vocab.SAFE_MID_HEADING).alias("loose"))
        for i, (_, names) in enumerate(vocab.HEADER_ALIASES) for a in dict.fromkeys(names)])
    not_doors = F.array(*[F.lit(f" {w} ") for w in vocab.NOT_THE_DOORS])
    thickness, rooms = fields.index("door_thickness"), [fields.index(f) for f in ("from_space", "to_space")]

    def claims(h: Column) -> Column:
        t, bare = h.t, h.bare
        padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
        not_this = F.exists(not_doors, lambda w: F.contains(padded(t), w))
        numbered = t.rlike(r"\b(?:NO|NUMBER|NUM)$|#$")
        allowed = lambda a: ~((a.f == thickness) & not_this) & ~(a.f.isin(rooms) & numbered)
        either = lambda test: test(t) | test(bare)
        long = lambda a: F.length(a.a) >= 3
        begins = lambda x, y: F.startswith(x, F.concat(y, F.lit(" ")))
        passes = [
            lambda a: (t == a.a) | (bare == a.a) | (squeezed(t) == a.sq),
            lambda a: long(a) & either(lambda x: begins(x, a.a) | begins(a.a, x)),
            lambda a: long(a) & a.loose & either(lambda x: F.contains(padded(x), padded(a.a))),
            lambda a: F.contains(t, F.lit(" ")) & (F.length(a.a) <= 2) & (F.substring_index(t, " ", -1) == a.a),
        ]

        def codes(k, test):
            return F.transform(F.filter(alias, lambda a: allowed(a) & test(a)), lambda a: a.f + k * len(fields))

        found = [codes(k, test) for k, test in enumerate(passes)]
        return F.when(t == "", F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(*found)))

    return F.get(F.transform(F.array(F.struct(norm.alias("t"), without_group(norm).alias("bare"))), claims), F.lit(0))


def grant_headers(norms: Column, claims: Column) -> Column:
    """Claims granted in order of pass and field, one heading per field and one field
    per heading; a repeated door heading hands over to the frame's field.

    Both inputs ride in the fold's state, so they are worked out once per table.
    """
    fields = [f for f, _ in vocab.HEADER_ALIASES]
    start = F.struct(claims.alias("wanted"), F.transform(norms, lambda h: F.lit(-1)).alias("m"))

    def grant(state: Column, code: Column) -> Column:
        field = code % len(fields)
        at = F.array_position(F.transform(state.wanted, lambda c, i: F.array_contains(c, code) & (F.get(state.m, i) == -1)), True)
        granted = F.when(F.array_contains(state.m, field) | (at == 0), state.m).otherwise(
            F.transform(state.m, lambda v, i: F.when(i == at - 1, field).otherwise(v)))
        return F.struct(state.wanted.alias("wanted"), granted.alias("m"))

    names = F.array(*[F.lit(f) for f in fields])
    mapped = F.aggregate(F.sequence(F.lit(0), F.lit(4 * len(fields) - 1)), start, grant,
                         lambda s: F.transform(s.m, lambda v: F.when(v < 0, F.lit("")).otherwise(F.get(names, v))))
    frame = F.create_map(*[F.lit(x) for kv in vocab.DOOR_TO_FRAME.items() for x in kv])

    def hand_over(state: Column, i: Column) -> Column:
        here = F.get(state.norms, i)
        earlier = F.filter(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))),
                           lambda j: (j < i) & (F.get(state.norms, j) == here) & F.map_contains_key(frame, F.get(state.m, j)))
        target = F.element_at(frame, F.get(state.m, F.get(earlier, F.lit(0))))
        ok = (F.get(state.m, i) == "") & (here != "") & (F.size(earlier) > 0) \
            & ~F.array_contains(state.m, F.coalesce(target, F.lit("?")))
        return F.struct(state.norms.alias("norms"), F.when(
            ok, F.transform(state.m, lambda v, k: F.when(k == i, target).otherwise(v))).otherwise(state.m).alias("m"))

    return F.aggregate(F.sequence(F.lit(0), F.size(norms) - 1), F.struct(norms.alias("norms"), mapped.alias("m")),
                       hand_over, lambda s: s.m)


def _norm(s: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[^A-Z0-9# ]+", " ", s.upper())).strip()


# Titles ------------------------------------------------------------------

def says(title: Column, words: list[str]) -> Column:
    """Any of the words as a whole word or its plural, never inside another word."""
    return title.rlike("(?<![A-Z])(?:" + "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\&", "&") for w in words)
                       + ")S?(?![A-Z])")


def is_the_floor(title: Column) -> Column:
    return says(title, vocab.IS_THE_FLOOR) | title.rlike(r"(?<![A-Z])FLOOR\s*(?:&|\+|/|AND)")


def discipline(number: Column) -> Column:
    return F.regexp_extract(F.upper(number), "^[A-Z]+", 0)


def is_architectural(number: Column) -> Column:
    d = discipline(number)
    return ~d.isin(vocab.NOT_ARCHITECTURAL) & (F.substring(d, 1, 1).isin(vocab.DRAWS_DOORS) | d.isin(vocab.ALSO_ARCHITECTURAL))


def is_floor_plan(title: Column) -> Column:
    t = F.upper(title)
    floor = is_the_floor(t)
    hard = [w for w in vocab.NOT_A_FLOOR_PLAN if w not in vocab.SHARES_THE_SHEET]
    return (t.rlike(r"\bPLANS?\b") & ~says(t, hard) & (floor | ~says(t, vocab.SHARES_THE_SHEET))
            & ~says(t, vocab.ONE_PART_OF_IT) & (floor | ~says(t, vocab.ANOTHER_SUBJECT)))


def not_a_plan(title: Column) -> Column:
    t = F.upper(title)
    plan, floor = t.rlike(r"\bPLANS?\b"), is_the_floor(t)
    return (says(t, vocab.INDEX_TITLES) | (plan & ~floor & says(t, vocab.ANOTHER_SUBJECT))
            | (says(t, vocab.OTHER_PROJECTION) & ~plan) | (says(t, vocab.CEILING_TITLES) & ~floor))


def is_enlargement(title: Column) -> Column:
    t = F.upper(title)
    return contains_any(t, vocab.ENLARGED) & ~F.contains(t, F.lit("FLOOR PLAN"))


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of(c, [lambda x, w=w: F.contains(x, F.lit(w)) for w in words])


def level_of(title: Column) -> Column:
    """Storey named one way whatever the title's wording, with its phase."""
    t = F.upper(title)
    number, ordinal, word = (F.regexp_extract(t, vocab.LEVEL_RE, i) for i in (1, 2, 3))
    ordinals = F.create_map(*[F.lit(x) for kv in vocab.ORDINALS.items() for x in kv])
    name = (F.when(number != "", F.concat(F.lit("LEVEL "), number))
            .when(ordinal != "", F.coalesce(F.concat(F.lit("LEVEL "), F.element_at(ordinals, ordinal)), ordinal))
            .when(F.startswith(word, F.lit("MEZZ")), "MEZZANINE").otherwise(word))
    phase = F.regexp_extract(t, vocab.PHASE_RE, 1)
    return F.trim(F.when(phase != "", F.concat(name, F.lit(" PHASE "), phase)).otherwise(name))


def says_door_schedule(title: Column) -> Column:
    t = F.upper(title)
    return F.contains(t, F.lit("SCHEDULE")) & contains_any(t, vocab.SHEET_DOOR_WORDS)


def is_other_schedule(title: Column) -> Column:
    t = F.regexp_replace(F.upper(title), r"\s+", " ")
    return (t != "") & ~contains_any(t, vocab.DOOR_WORDS) & contains_any(t, vocab.OTHER_SCHEDULES)


def door_sheet_level(number: Column, title: Column) -> Column:
    named = says_door_schedule(title)
    general = (number != "") & F.contains(F.upper(title), F.lit("SCHEDULE")) & ~is_other_schedule(title) & is_architectural(number)
    return F.when(named & (number != ""), "named").when(named, "title").when(general, "schedules")


def names_another_trade(header: Column) -> Column:
    return F.arrays_overlap(F.split(norm_header(header), " "), F.array(*[F.lit(w) for w in vocab.FOREIGN_COLUMNS]))
