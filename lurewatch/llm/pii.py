"""Personal data by patterns, checksums and nearby words, in built-in functions only.

Regular expressions propose spans; a validator confirms them (number ranges,
digit counts, Luhn, mod-97); words nearby raise or lower the score. Positions come
from the gaps between matches, so a text is read once per kind and split once. Sums
over matches go by blocks, and pieces of a text are taken from blocks of it, so
that time is in step with the text and its matches.

The patterns find what the plain ones in their comments find, in linear time: a
match can only begin at the start of its run of characters, or right after the
match before, which the look-behinds state; and possessive groups never retry.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lurewatch.functions.arrays import let
from lurewatch.llm.common import drop_clashing

#: Code points before and after a span in which context words count.
NEAR = 40
#: Elements that are summed in one go, and code points of a block of text.
BLOCK = 128
PIECE = 1024


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text that has no character or string of this cannot match.
    needs: str
    #: Score of a confirmed match, without context.
    score: float
    context: str
    #: Part of the contract's base kinds.
    base: bool = True


#: The kinds of the contract, in its order, and IBANs. An IBAN has two letters, two check
#: digits and 11 to 30 letters or digits, together or in groups of four.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9,
         r"mail|contact|write|reach|address"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|host|server|address|login|client"),
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", "", 0.8,
         r"card|visa|master|amex|credit|debit|payment|account"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"phone|tel|call|mobile|cell|fax|contact"),
    Kind("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])", "", 0.9,
         r"iban|bank|account|transfer|payment", base=False),
)
#: Words that speak against personal data.
AGAINST = r"example|sample|dummy|version|isbn|order no|serial"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _mod97(match: Column) -> Column:
    """The remainder of an IBAN whose first four characters are put last and letters read as 10 to 35."""
    packed = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substr(packed, F.lit(5)), F.substring(packed, 1, 4))
    return F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda rest, c: F.when(c == "", rest)
        .when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97)
        .otherwise((rest * 100 + F.ascii(c) - 55) % 97),
    )


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match) == 1
    return F.lit(True)


def _before(values: Column, merge) -> Column:
    """For each element what the ones before it give together (0 before the first), in time linear in their number."""
    longs = "array<bigint>"
    zero = F.lit(0).cast("bigint")

    def each(items: Column, start: Column) -> Column:
        done = F.aggregate(
            items, F.struct(start.alias("sum"), F.array().cast(longs).alias("found")),
            lambda d, x: F.struct(merge(d["sum"], x).alias("sum"), F.concat(d["found"], F.array(d["sum"])).alias("found")),
        )
        return done["found"]

    def by_blocks(v: Column) -> Column:
        count = F.ceil(F.size(v) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))
        sums = lambda b: F.transform(b, lambda x: F.aggregate(x, zero, merge))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, each(sums(b), zero), each)))

    return let(values, lambda v: F.when(F.size(v) > 0, by_blocks(v)).otherwise(F.array().cast(longs)))


def _pieces(text: Column) -> Column:
    """The text in blocks of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from one code point to another, from its blocks; what lies outside is left out."""
    first = F.floor(start / PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.greatest(F.floor(end / PIECE).cast("int") - first + 1, F.lit(0)))
    return F.substr(F.array_join(some, ""), (start - first * PIECE + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def _spans(kind: Kind, text: Column, pieces: Column) -> Column:
    """Confirmed matches with their places and scores, in order."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    def placed(m: Column) -> Column:
        # a gap and the match behind it
        pairs = F.zip_with(
            F.slice(gaps, F.lit(1), F.size(m)), m,
            lambda gap, x: F.struct(F.length(gap).cast("bigint").alias("gap"), F.length(x).cast("bigint").alias("size"), x.alias("text")),
        )

        def spans(p: Column) -> Column:
            begins = _before(F.transform(p, lambda x: x["gap"] + x["size"]), lambda a, x: a + x)
            return F.zip_with(
                p, begins,
                lambda x, at: F.struct(x["text"].alias("text"), (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end")),
            )

        return F.filter(let(pairs, spans), lambda x: _confirmed(kind.name, x["text"]))

    def scored(x: Column) -> Column:
        around = F.lower(
            F.concat(
                _cut(pieces, F.greatest(x["start"] - NEAR, F.lit(0)), x["start"]), F.lit(" "), _cut(pieces, x["end"], x["end"] + NEAR)
            )
        )

        def score(a: Column) -> Column:
            value = kind.score + F.when(a.rlike(kind.context), 0.1).otherwise(0.0) - F.when(a.rlike(AGAINST), 0.3).otherwise(0.0)
            return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 2)

        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), let(around, score).alias("score"))

    may = text.contains(kind.needs) if kind.needs else text.rlike("[0-9][0-9]" if kind.name == "iban" else "[0-9][ -]?[0-9]")
    return F.when(may, F.transform(let(matches, placed), scored)).otherwise(F.array().cast(SPAN))


def add_personal_data(docs: DataFrame, text: str = "text", output: str = "pii") -> DataFrame:
    """Adds all spans of personal data: kind, start, end (code points, end exclusive), score 0 to 1.

    By kind in the order of KINDS, then by start; spans of different kinds may
    overlap. Null and empty texts have none. Texts are read whole, and time is in step with
    their length and matches. A column of the same name is replaced; rows come back as often as they
    are there; an empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = drop_clashing(docs, [output]) if output.lower() != text.lower() else docs
    found = let(_pieces(whole), lambda p: F.concat(*[_spans(k, whole, p) for k in KINDS]))
    return kept.withColumn(output, found)


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def whole(s: Column, pieces: Column) -> Column:
        # the end of all spans before one: what starts earlier is part of them
        ends = _before(F.transform(s, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
        parts = F.zip_with(
            s, ends,
            lambda x, at: F.when(
                x["start"] >= at, F.concat(_cut(pieces, at, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
            ).otherwise(""),
        )
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), _cut(pieces, last, F.length(text).cast("bigint")))

    done = let(ordered, lambda s: let(_pieces(text), lambda p: whole(s, p)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data masked in their text; null stays null."""
    found = add_personal_data(docs, text, "__pii")
    return found.withColumn(text, masked(F.col(text), F.col("__pii"))).drop("__pii")
