"""Column expressions on addresses, domains and plain text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.functions.arrays import first_of, string_array

# Python's str.strip() and \s cover Unicode blanks and \x1c-\x1f.
BLANK = r"[\s\x1c-\x1f]"


def fill(template: str, *values: Column) -> Column:
    """`template` with each `{}` replaced by the next column."""
    pieces = template.split("{}")
    parts: list[Column] = []
    for i, piece in enumerate(pieces):
        if piece:
            parts.append(F.lit(piece))
        if i < len(values):
            parts.append(values[i].cast("string"))
    return F.concat(*parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def normalize_whitespace(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def strip_html_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def domain_of_address(address: Column) -> Column:
    """Lower-case text after the first `@`, or an empty string."""
    at = F.instr(address, "@")
    return F.when(at > 0, F.lower(address.substr(at + 1, F.length(address)))).otherwise("")


def base_domain(domain: Column) -> Column:
    """The last two labels of a domain."""
    return F.substring_index(domain, ".", -2)


def first_label(domain: Column) -> Column:
    return F.substring_index(domain, ".", 1)


def contains_first(text: Column, words: list[str], also=None) -> Column:
    """The first of `words` found in `text` (and passing `also(word)`), else NULL.

    `text` is read once per word: hand in a plain column or bind it with `let`.
    """
    holds = lambda word: text.contains(word) if also is None else text.contains(word) & also(word)
    return first_of(string_array(words), holds)
