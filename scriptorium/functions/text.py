"""Tokens and stems as column expressions; there is no Python in any of them.

Text is read as lines: an honorific (mr., ms., mrs.) is glued to the word after it on its line, separators are single characters other
than ASCII letters, digits, full stop and apostrophe, and dotted abbreviations become one token.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.scratch import stored, written

#: Between an honorific and its word, and after each character of a dotted abbreviation, until the text has been split.
GLUE, DOT = "\x01", "\x02"
#: Positions of a document whose running sums are one task's.
SPAN = 4096
#: Our own stopwords.
STOPWORDS = (
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so "
    "that the their them then there these they this to was we were what when which who will with you your"
).split()


def prepared(text: Column) -> Column:
    """Lower-case words with single spaces between; empty words stay, because an honorific may take one."""
    s = text
    for found, made in (("\r\n", "\n"), ("\r", "\n"), ("\n", "  "), ("_", " ")):
        s = F.replace(s, F.lit(found), F.lit(made))
    # A class of ranges takes eight times as long a character as the named one; blanks need not be replaced by themselves.
    s = F.regexp_replace(s, r"[^\w.' ]", " ")
    s = F.replace(F.lower(s), F.lit("'"), F.lit(""))
    glued = lambda x: F.regexp_replace(x, r"(^| )(mrs|mr|ms)\. ([^ ]*)", f"$1$2{GLUE}$3")
    return if_has(s, lambda x: x.contains("mr. ") | x.contains("ms. ") | x.contains("mrs. "), glued)


def if_has(text: Column, has: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """The text, changed if it has what the change is for; it is worked out once for both, and others are spared the passes."""
    return F.get(F.transform(F.array(text), lambda x: F.when(has(x), change(x)).otherwise(x)), F.lit(0))


def tokenize(text: Column) -> Column:
    """array<string> of the tokens of a whole text, by passes over it whose time is linear; no function is called per word.

    A word's abbreviation is its longest start of single characters with full stops between; it is one token without its full stops, and
    the rest of the word is split at them. A word after an honorific starts behind the glue; if it has no token, the honorific goes too.
    """
    s = F.regexp_replace(prepared(text), rf"(?:(?<![^ {GLUE}])|\G(?!^))([^. {GLUE}])\.+", f"$1{DOT}")
    # Characters of an abbreviation come together, with a last one that ends the word as well.
    s = F.regexp_replace(s, f"{DOT}(?=[^ .](?:{DOT}|(?![^ ])))", "")
    whole = lambda x: F.regexp_replace(F.regexp_replace(x, f"{GLUE}[.]+", GLUE), f"(?:mrs|mr|ms){GLUE}(?![^ ])", "")
    s = if_has(s, lambda x: x.contains(GLUE), lambda x: F.replace(whole(x), F.lit(GLUE), F.lit("")))
    for end in (".", DOT):
        s = F.replace(s, F.lit(end), F.lit(" "))
    return F.array_remove(F.split(s, " "), "")


def cut(word: Column, chars: int) -> Column:
    return F.left(word, F.length(word) - chars)


def ends(word: Column, *endings: str) -> Column:
    found = word.endswith(endings[0])
    for e in endings[1:]:
        found = found | word.endswith(e)
    return found


def _singular(token: Column) -> Column:
    return (
        F.when(token.endswith("sses"), cut(token, 2))
        .when(ends(token, "ies", "ied"), F.when(F.length(token) > 4, cut(token, 2)).otherwise(F.concat(cut(token, 2), F.lit("e"))))
        .when(ends(token, "ss", "us"), token)
        .when(token.endswith("s") & token.rlike("[aeiou].+s$"), cut(token, 1))
        .otherwise(token)
    )


def _ending(a: Column) -> Column:
    """With the length of the verb ending that goes; the ending needs a vowel before it."""
    size = F.lit(0)
    for ending in ("ed", "ing", "edly", "ingly"):
        size = F.when(a.endswith(ending) & a.rlike(f"[aeiou].*{ending}$"), len(ending)).otherwise(size)
    return F.struct(a.alias("a"), size.alias("size"))


def _cut(x: Column) -> Column:
    return F.struct(x.a.alias("a"), x.size.alias("size"), F.left(x.a, F.length(x.a) - x.size).alias("rest"))


def _repaired(x: Column) -> Column:
    a, rest = x.a, x.rest
    repaired = (
        F.when(x.size == 0, a)
        .when(ends(rest, "at", "bl", "iz"), F.concat(rest, F.lit("e")))
        .when(F.length(rest) == 1, F.lit(""))
        .when(rest.rlike(r"([^lsz])\1$"), cut(rest, 1))
        .when(short(rest), F.concat(rest, F.lit("e")))
        .otherwise(rest)
    )
    less = F.when(a.endswith("eedly"), 3).otherwise(1)
    enough = a.rlike("[aeiou][^aeiou].*eed(ly)?$")
    return F.when(ends(a, "eedly", "eed"), F.when(enough, F.left(a, F.length(a) - less)).otherwise(a)).otherwise(repaired)


def stems(tokens: Column) -> Column:
    """array<string>: plurals and verb endings off (the first two steps of the Porter algorithm, with their own repairs).

    Each step is a pass over the array, so that its outcome is worked out once per token.
    """
    for step in (_singular, _ending, _cut, _repaired):
        tokens = F.transform(tokens, step)
    return tokens


def stem(token: Column) -> Column:
    return F.get(stems(F.array(token)), F.lit(0))


def short(word: Column) -> Column:
    """True if the word has exactly one change from vowels to consonants; y and digits are consonants."""
    return word.rlike("^[^aeiou]*[aeiou]+[^aeiou]+[aeiou]*$")


def ws_tokens(text: Column) -> Column:
    """array<string>: runs of anything but white space (Unicode's, and U+001C to U+001F), case kept."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.filter(F.split(spaced, " "), lambda x: x != "")


def without(tokens: Column, stopwords: list[str]) -> Column:
    """array<string> of the tokens that are not stopwords."""
    return F.filter(tokens, lambda x: ~x.isin(list(stopwords))) if stopwords else tokens


def token_rows(docs: DataFrame, stopwords: list[str] | DataFrame = STOPWORDS, id_col: str | tuple[str, ...] = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token) of the tokens that are not stopwords; pos counts all tokens, from 0. ``id_col`` may be several columns: lines of
    files are known by the file and their number, and these and pos are a token's place."""
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    rows = docs.select(*ids, F.posexplode(tokenize(F.coalesce(F.col(text_col), F.lit("")))).alias("pos", "token"))
    if isinstance(stopwords, DataFrame):
        return rows.join(stopwords.select(F.col(stopwords.columns[0]).alias("token")), "token", "left_anti").select(*ids, "pos", "token")
    return rows.where(~F.col("token").isin(list(stopwords))) if stopwords else rows


def analyze(docs: DataFrame, stopwords: list[str] | DataFrame = STOPWORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, token, stem) of the tokens that are not stopwords; pos counts all tokens, from 0. Empty stems stay."""
    return token_rows(docs, stopwords, id_col, text_col).withColumn("stem", stem(F.col("token")))


def numbered(tokens: DataFrame, order: tuple[str, ...]) -> bool:
    """Whether a token's place is an integer id and a position as ``token_rows`` has them, which are 32 bits and never null."""
    kinds = dict(tokens.dtypes)
    return len(order) == 2 and kinds.get(order[0]) in ("int", "bigint") and kinds.get(order[1]) == "int" and not tokens.schema[order[1]].nullable


def is_short(doc: str, pos: str) -> Column:
    """Whether an id and a position fit into 43 and 20 bits, as most do; null ids do not."""
    return F.coalesce(F.col(doc).between(-(1 << 42), (1 << 42) - 1) & F.col(pos).between(0, (1 << 20) - 1), F.lit(False))


def short_number(tokens: DataFrame, doc: str, pos: str) -> tuple[Column, Callable[[Column], Column]]:
    """What ``one_number`` gives, of short places, without the decimals that take most of the time of counting; null for others."""
    place = F.when(is_short(doc, pos), F.col(doc).cast("bigint") * (1 << 20) + F.col(pos))
    return place, lambda x: F.struct(F.shiftright(x, 20).cast(dict(tokens.dtypes)[doc]).alias(doc), x.bitwiseAND((1 << 20) - 1).cast("int").alias(pos))


def one_number(tokens: DataFrame, doc: str, pos: str) -> tuple[Column, Callable[[Column], Column]]:
    """A place that is not short as a number of the same order, and what makes it a struct again. A number's least value is kept in a hash
    table; for that of a struct, Spark sorts all tokens of a task. A null id comes first, as in a struct."""
    number = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    wide = lambda c: c.cast("decimal(38,0)")
    null, span, half = -(1 << 63) - 1, F.lit(str(1 << 32)).cast("decimal(11,0)"), number(1 << 31)
    ids = F.coalesce(F.col(doc).cast("decimal(20,0)"), F.lit(str(null)).cast("decimal(20,0)"))
    place = wide(wide(ids * span) + F.col(pos).cast("decimal(11,0)"))

    def back(x: Column) -> Column:
        low = F.pmod(wide(x + half), wide(span))
        high = F.call_function("div", wide(wide(x + half) - low), wide(span))
        known = F.when(x >= number(-(1 << 95) - (1 << 31)), high)
        return F.struct(known.cast(dict(tokens.dtypes)[doc]).alias(doc), wide(low - half).cast("int").alias(pos))

    return F.when(~is_short(doc, pos), place), back


def firsts_of(tokens: DataFrame, term: str, to: Callable[[Column], Column] | None, order: tuple[str, ...]) -> DataFrame:
    """(term, cnt, first) of each term; with ``to``, of what it makes of them, worked out once per different term."""
    kinds = [short_number(tokens, *order), one_number(tokens, *order)] if numbered(tokens, order) else [(F.struct(*order), lambda x: x)]
    names = [f"place{i}" for i in range(len(kinds))]
    counts = tokens.groupBy(F.col(term).alias("term")).agg(F.count("*").alias("cnt"), *[F.min(place).alias(n) for n, (place, _) in zip(names, kinds, strict=True)])
    if to is not None:
        counts = counts.withColumn("term", to(F.col("term"))).groupBy("term").agg(F.sum("cnt").alias("cnt"), *[F.min(n).alias(n) for n in names])
    found = [F.when(F.col(n).isNotNull(), back(F.col(n))) for n, (_, back) in zip(names, kinds, strict=True)]
    return counts.select("term", "cnt", (F.least(*found) if len(found) > 1 else found[0]).alias("first"))


def top_terms(tokens: DataFrame, n: int = 300, term: str = "stem", order: tuple[str, ...] = ("doc_id", "pos"), to: Callable[[Column], Column] | None = None) -> DataFrame:
    """(term, cnt, ord): most frequent terms, those that occur first before others of the same count; ord is their order, from 1. ``order`` is a
    token's place: an id and a position, or the file, line and position of texts that have no id."""
    best = firsts_of(tokens, term, to, order).orderBy(F.desc("cnt"), "first").limit(n)
    return best.select("term", "cnt", F.row_number().over(Window.orderBy(F.desc("cnt"), "first")).cast("bigint").alias("ord"))


def vocab_growth(tokens: DataFrame, term: str = "stem", doc: str = "doc_id", pos: str = "pos", to: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, word_count, unique_count) at the end of each document: tokens and different terms so far.

    The order of documents is their id's. Counts per document come first; the running sums go over documents, in two levels (blocks of
    ids, then inside a block), so no task sees all tokens or all documents.
    """
    firsts = firsts_of(tokens, term, to, (doc, pos)).groupBy(F.col(f"first.{doc}").alias(doc)).agg(F.count("*").alias("fresh"))
    counts = tokens.groupBy(doc).agg(F.count("*").alias("words")).join(firsts, doc, "left").select(doc, "words", F.coalesce("fresh", F.lit(0)).alias("fresh"))
    counts = counts.withColumn("block", F.floor(F.col(doc) / 4096))
    # Inside a block first; its last document has the block's sums, so the tokens are read once for both levels.
    inside = Window.partitionBy("block").orderBy(doc)
    counts = written(counts.select(doc, "block", F.sum("words").over(inside).alias("words"), F.sum("fresh").over(inside).alias("fresh")))
    blocks = counts.groupBy("block").agg(F.max("words").alias("bw"), F.max("fresh").alias("bf"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("bw").over(before), F.lit(0)).alias("bw"), F.coalesce(F.sum("bf").over(before), F.lit(0)).alias("bf"))
    return counts.join(blocks, "block").select(doc, (F.col("bw") + F.col("words")).alias("word_count"), (F.col("bf") + F.col("fresh")).alias("unique_count"))


def vocab_curve(tokens: DataFrame, term: str = "stem", doc: str = "doc_id", pos: str = "pos", span: int = SPAN) -> DataFrame:
    """(word_count, unique_count) after every token: the points of ``vocab_growth`` in between.

    Sums go over documents, over spans of ``span`` positions of a document, and over the tokens of a span, so a very long document is
    many tasks' work.
    """
    firsts = tokens.groupBy(term).agg(F.min(F.struct(doc, pos)).alias("first")).select(F.col(f"first.{doc}").alias("d2"), F.col(f"first.{pos}").alias("p2"))
    marked = tokens.join(firsts, (F.col(doc) == F.col("d2")) & (F.col(pos) == F.col("p2")), "left")
    marked = stored(marked.select(doc, pos, F.floor(F.col(pos) / span).alias("span"), F.col("d2").isNotNull().cast("bigint").alias("fresh")))
    sums = marked.groupBy(doc, "span").agg(F.count("*").alias("words"), F.sum("fresh").alias("new"))
    own = sums.groupBy(doc).agg(F.sum("words").alias("all_words"), F.sum("new").alias("all_new"))
    base = vocab_growth(tokens, term, doc, pos).join(own, doc).select(doc, (F.col("word_count") - F.col("all_words")).alias("w0"), (F.col("unique_count") - F.col("all_new")).alias("u0"))
    before = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy(doc).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = sums.select(doc, "span", before("words").alias("w1"), before("new").alias("u1")).join(base, doc)
    inside = Window.partitionBy(doc, "span").orderBy(pos)
    words = F.col("w0") + F.col("w1") + F.row_number().over(inside)
    return marked.join(spans, [doc, "span"]).select(words.alias("word_count"), (F.col("u0") + F.col("u1") + F.sum("fresh").over(inside)).alias("unique_count"))
