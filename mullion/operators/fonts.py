"""Repair of text whose font came without its character map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed value: characters ordinary drawing text is made of.
READABLE = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,-/'\"#&():;%+*="
# Fixed value: characters of Latin, Greek and their marks, moved by a table. None of them comes to stand at nought.
PLAIN = "".join(map(chr, range(1, 0x400)))
_PLAIN_ONLY = r"^[\x01-\u03ff]*+\z"
_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
_SPACE = r"[\t\n\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def shifts(spans: DataFrame, font: list[str]) -> DataFrame:
    """Shift that makes a font's text readable, for fonts that need one.

    Texts shrink to a histogram of characters per font before anything else, so
    the 95 candidate shifts meet a few hundred rows per font, not its text.
    """
    chars = (spans.select(*font, F.explode(F.split("text", "")).alias("c"))
             .groupBy(*font, "c").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("u", F.ascii("c")))
    # Patterns look at each character of a font once: as the filter could slip below the count, it asks for a count too.
    chars = chars.filter((F.col("n") > 0) & (F.col("c") != "") & ~F.when(F.col("n") > 0, F.col("c").rlike(_SPACE)))
    ok = [ord(c) for c in READABLE]
    share = (chars.select(*font, "c", "u", "n", F.explode(F.sequence(F.lit(1), F.lit(95))).alias("shift"))
             .groupBy(*font, "shift")
             .agg(F.sum(F.when((F.col("u") + F.col("shift")).isin(ok), F.col("n")).otherwise(0)).alias("readable"),
                  F.sum(F.when(F.col("u").isin(ok), F.col("n")).otherwise(0)).alias("plain"),
                  F.sum("n").alias("total"), F.max(F.col("c").rlike(_CONTROL)).alias("control")))
    best = F.max_by(F.struct("shift", "readable", "total"), F.struct("readable", -F.col("shift")))
    return (share.filter("control AND plain < 0.9 * total").groupBy(*font).agg(best.alias("b"))
            .filter("b.readable >= 0.9 * b.total")
            .select(*font, F.col("b.shift").cast("bigint").alias("shift"), "b.readable", "b.total"))


def _one_by_one(text: str, by: str) -> Column:
    char = f"decode(unhex(lpad(hex(ascii(c) + ({by})), 8, '0')), 'UTF-32')"
    return F.expr(f"array_join(transform(filter(split({text}, ''), c -> c <> ''), c -> {char}), '')")


def shifted(text: str, by: str, drawn: Column) -> Column:
    """Every character of a text moved by a number of places.

    ``drawn`` are the characters ``PLAIN`` moved; a text of those alone is translated, any other goes character by character.
    """
    return F.when(F.col(text).rlike(_PLAIN_ONLY), F.call_function("translate", F.col(text), F.lit(PLAIN), drawn)).otherwise(_one_by_one(text, by))


def drawn_below(text: str, by: int) -> Column:
    """A text as a font shows it whose glyph numbers lie ``by`` below the letters they draw."""
    high = "".join(c for c in PLAIN if ord(c) > by)
    whole = F.col(text).rlike(rf"^[\x{by + 1:02x}-\u03ff]*+\z")
    return F.when(whole, F.call_function("translate", F.col(text), F.lit(high), F.lit("".join(chr(ord(c) - by) for c in high)))).otherwise(_one_by_one(text, str(-by)))


def repair(spans: DataFrame, font: list[str]) -> DataFrame:
    """Spans with unreadable text shifted back, every character of them; readable spans are left as they came.

    A span counts as unreadable if it holds a control character and its font has a shift. Null texts and fonts stay.
    """
    from mullion.runtime import small

    drawn = F.expr(f"array_join(transform(sequence({ord(PLAIN[0])}, {ord(PLAIN[-1])}), u -> decode(unhex(lpad(hex(u + shift), 8, '0')), 'UTF-32')), '')")
    moved = shifted("text", "shift", F.col("_drawn"))
    return (spans.join(small(shifts(spans, font).select(*font, "shift", drawn.alias("_drawn"))), font, "left")
            .withColumn("text", F.when(F.col("shift").isNotNull() & F.col("text").rlike(_CONTROL), moved).otherwise(F.col("text")))
            .drop("shift", "_drawn"))
