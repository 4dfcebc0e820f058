"""Personal data by patterns, checksums and context words (built-in functions only).

Each kind has a pattern that proposes spans and a check that confirms them: Luhn for cards, mod 97 for IBANs, ranges and digit counts
for the rest. A span's score starts at its kind's score and rises with context words shortly before it. Base kinds (email, ip, card,
phone) stay whatever their score; the added kinds need ``LEAST_SCORE``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before a span in which context words count, what they add, and the score that an added kind needs.
CONTEXT_CHARS, CONTEXT_SCORE, LEAST_SCORE = 48, 0.35, 0.6
#: Matches that are gone through before their spans are set aside.
CHUNK = 256
#: Letters and digits of an IBAN by country; other codes may have any number from 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def luhn(digits: Column) -> Column:
    """True if the digits pass the Luhn check."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(False).alias("twice")),
        lambda acc, d: F.struct(
            (acc.sum + F.when(acc.twice, F.coalesce(d.try_cast("int"), F.lit(0)) * 2 - F.when(F.coalesce(d.try_cast("int"), F.lit(0)) > 4, 9).otherwise(0)).otherwise(F.coalesce(d.try_cast("int"), F.lit(0)))).alias("sum"),
            (~acc.twice).alias("twice"),
        ),
        lambda acc: acc.sum,
    )
    return F.pmod(total, F.lit(10)) == 0


def mod97(iban: Column) -> Column:
    """True if the letters and digits pass the ISO 13616 check."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), F.pmod(acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97))).otherwise(F.pmod(acc * 100 + F.ascii(c) - 55, F.lit(97))),
    )
    return rest == 1


def may_be_iban(seen: Column) -> Column:
    """True if some beginning of at least 15 letters and digits passes the ISO 13616 check, found in one pass over them."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(F.ascii(c) - 55)
    add = lambda rest, c: F.pmod(rest * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97))
    letters = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    def state(n: Column, rest: Column, head: Column, found: Column) -> Column:
        return F.struct(n.alias("n"), rest.alias("rest"), head.alias("head"), found.alias("found"))

    # Two letters and two digits move to the end: that is 6 digits more, and 10**6 is 27 modulo 97.
    def step(acc: Column, c: Column) -> Column:
        rest = F.when(acc.n >= 4, add(acc.rest, c)).otherwise(acc.rest)
        head = F.when(acc.n < 4, add(acc.head, c)).otherwise(acc.head)
        return state(acc.n + 1, rest, head, acc.found | ((acc.n >= 14) & (F.pmod(rest * 27 + acc.head, F.lit(97)) == 1)))

    return F.aggregate(letters(only("A-Z0-9", seen)), state(F.lit(0), F.lit(0), F.lit(0), F.lit(False)), step, lambda acc: acc.found)


def iban_at(seen: Column) -> Column:
    """The longest IBAN that starts a stretch of text and ends at a word's end, or an empty string."""
    ends = F.array(*[F.regexp_extract(seen, rf"^[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n}}}(?![A-Za-z0-9])", 0) for n in range(30, 10, -1)])
    fits = lambda x: F.length(only("A-Z0-9", x))
    code = F.substr(seen, F.lit(1), F.lit(2))
    length = F.coalesce(*[F.when(code.isin(countries.split()), n) for n, countries in IBAN_LENGTHS.items()])
    longest = F.coalesce(F.get(F.filter(ends, lambda x: (x != "") & (fits(x) == F.coalesce(length, fits(x))) & mod97(only("A-Z0-9", x))), F.lit(0)), F.lit(""))
    return F.when(may_be_iban(seen), longest).otherwise(F.lit(""))


def only(chars: str, hit: Column) -> Column:
    """The characters of hit in the class ``chars``."""
    return F.regexp_replace(hit, f"[^{chars}]", "")


def ip_parts(hit: Column) -> Column:
    """True if no part is above 255; leading zeros are no matter."""
    value = lambda x: F.regexp_replace(x, "^0+", "")
    return F.forall(F.split(hit, r"\."), lambda x: (F.length(value(x)) <= 3) & (F.coalesce(value(x).try_cast("int"), F.lit(0)) <= 255))


def digits_between(least: int, most: int) -> Callable[[Column], Column]:
    return lambda hit: F.length(only("0-9", hit)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """maybe: a cheap pattern without which the text has no match. pattern: no part of it gives back what it took (possessive), so time
    is linear in the text; ``\\G`` is the end of the match before. score: before context. base: stays whatever the score. pick: for a
    pattern that looks ahead (in a group of its own) further than it takes, the span that starts what it has seen, for ``check``."""

    name: str
    maybe: str
    pattern: str
    check: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True
    pick: Callable[[Column], Column] | None = None


KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda hit: F.lit(True), 0.9, "mail|contact|write"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", ip_parts, 0.6, r"\bip\b|host|server|address|login"),
    Kind("card", "[0-9]{4}[ -]?[0-9]{2}|(?:[0-9][ -]?){16}", r"[0-9]++(?:[ -][0-9]++)*+", lambda hit: digits_between(16, 19)(hit) & luhn(only("0-9", hit)), 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", digits_between(8, 15), 0.6, r"phone|\btel\b|call|mobile|fax"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", lambda hit: hit != "", 0.9, "iban|bank|account", False, iban_at),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda hit: F.lit(True), 0.3, r"\bssn\b|social|security", False),
    Kind("short_card", "[0-9]{4}[ -]?[0-9]{2}|(?:[0-9][ -]?){13}", r"[0-9]++(?:[ -][0-9]++)*+", lambda hit: digits_between(13, 15)(hit) & luhn(only("0-9", hit)), 0.3, "card|visa|credit|amex", False),
    Kind("local_phone", "[0-9]{3}[ .)-]", r"(?<![0-9+.-])\(?[0-9]{3}[ .)-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9-])", lambda hit: F.lit(True), 0.3, r"phone|\btel\b|call|mobile|fax", False),
)


def spans_of(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind in a non-null text; starts ascend.

    One pattern, anchored to the end of the match before it, takes the gap and the match: the lengths of both give code-point offsets, and
    the last code points of what has been passed are a match's context. Of spans that overlap, as those of a pattern that looks ahead can,
    the first stays. Matches are gone through in chunks and their spans put together at the end, so time is linear in the matches of a text.
    """
    rule = F.lit(rf"(?s)\G(.*?)({kind.pattern})")
    gaps, hits = F.regexp_extract_all(text, rule, F.lit(1)), F.regexp_extract_all(text, rule, F.lit(2))
    both = F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("took"), hit.alias("hit")))
    if kind.pick:
        both = F.zip_with(both, F.regexp_extract_all(text, rule, F.lit(3)), lambda x, ahead: F.struct(x.gap.alias("gap"), x.took.alias("took"), kind.pick(F.concat(x.hit, ahead)).alias("hit")))
    both = F.transform(both, lambda x: F.struct(x.gap.alias("gap"), x.took.alias("took"), F.char_length(x.gap).alias("skip"), F.char_length(x.took).alias("size"), F.char_length(x.hit).alias("chars"), kind.check(x.hit).alias("good")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,before:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc.at + x.skip
        before = F.right(F.concat(acc.tail, x.gap), F.lit(CONTEXT_CHARS))
        good = x.good & (start >= acc.until)
        span = F.when(good, F.array(F.struct(start.alias("start"), (start + x.chars).alias("end"), before.alias("before")))).otherwise(none)
        tail = F.right(F.concat(acc.tail, x.gap, x.took), F.lit(CONTEXT_CHARS))
        return F.struct((start + x["size"]).alias("at"), tail.alias("tail"), F.when(good, start + x.chars).otherwise(acc.until).alias("until"), F.concat(acc.spans, span).alias("spans"))

    def chunk(found: Column) -> Callable[[Column, Column], Column]:
        def merge(acc: Column, no: Column) -> Column:
            begin = F.struct(acc.now["at"].alias("at"), acc.now.tail.alias("tail"), acc.now.until.alias("until"), none.alias("spans"))
            return F.struct(F.aggregate(F.slice(found, no * CHUNK + 1, F.lit(CHUNK)), begin, step).alias("now"), F.concat(acc.done, F.array(acc.now.spans)).alias("done"))

        return merge

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.lit(0).alias("until"), none.alias("spans"))
    start = F.struct(zero.alias("now"), F.expr("cast(array() as array<array<struct<start:int,end:int,before:string>>>)").alias("done"))
    chunks = lambda found: F.when(F.size(found) > 0, F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    every = lambda acc: F.flatten(F.concat(acc.done, F.array(acc.now.spans)))
    # The matches are an array of one here, so that they are worked out once for all chunks.
    placed = F.get(F.transform(F.array(both), lambda found: F.aggregate(chunks(found), start, chunk(found), every)), F.lit(0))
    scored = F.transform(placed, lambda x: F.struct(F.lit(kind.name).alias("kind"), x.start.alias("start"), x.end.alias("end"), (F.lit(kind.score) + F.when(F.lower(x.before).rlike(kind.context), CONTEXT_SCORE).otherwise(0.0)).alias("score")))
    if not kind.base:
        scored = F.filter(scored, lambda x: x.score >= LEAST_SCORE)
    nothing = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    return F.when(text.rlike(kind.maybe), scored).otherwise(nothing)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id_col, found), found being array<struct<kind, start, end, score>>, by kind as in KINDS, then start.

    Offsets are code points, the end exclusive. Null text: as empty, no spans. Null and repeated ids: a row each. Other columns are
    ignored; an empty table gives an empty result. Overlaps between kinds are kept, overlaps within a kind cannot occur.
    """
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(id_col, *[spans_of(F.col("_text"), k).alias(f"_{k.name}") for k in KINDS])
    return rows.select(id_col, F.concat(*[F.col(f"_{k.name}") for k in KINDS]).alias("found"))


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_col) with every confirmed match of the base kinds replaced by its kind in brackets.

    A null text stays null, an empty one empty. Null and repeated ids: a row each. Kinds are replaced one after another, so what one kind has
    replaced is text to the next. Other columns are left out; an empty table gives an empty result.
    """
    text = F.col(text_col)
    for kind in KINDS[:4]:
        text = masked(text, kind)
    return docs.select(F.col(id_col), text.alias(text_col))


def masked(text: Column, kind: Kind) -> Column:
    """A text with the confirmed matches of one kind replaced."""
    rule = F.lit(rf"(?s)\G(.*?)({kind.pattern})")
    gaps, hits = F.regexp_extract_all(text, rule, F.lit(1)), F.regexp_extract_all(text, rule, F.lit(2))
    rest = F.substr(text, F.char_length(F.array_join(gaps, "")) + F.char_length(F.array_join(hits, "")) + 1)
    parts = F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.when(kind.check(hit), f"[{kind.name}]").otherwise(hit)))
    return F.when(text.rlike(kind.maybe), F.concat(F.array_join(parts, ""), rest)).otherwise(text)
