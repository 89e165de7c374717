"""Scalar functions on log lines, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def java_regex(p: str) -> str:
    """A Python regular expression in Java's notation; constructs without counterpart are rejected."""
    if re.search(r"\(\?\(|\(\?P>|\\g<", p):
        raise ValueError(f"unsupported construct in {p!r}")
    p = re.sub(r"\(\?P=([A-Za-z_]\w*)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", p)
    p = re.sub(r"\(\?P<([A-Za-z_]\w*)>", lambda m: f"(?<{m[1].replace('_', '')}>", p)
    return p.replace("(?u)", "(?U)")


def java_literal(s: str) -> str:
    """A replacement that stands for itself."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def replace_delimiters(c: Column, patterns: list[str]) -> Column:
    """Every match of each pattern becomes a space."""
    for p in patterns:
        c = F.regexp_replace(c, java_regex(p), " ")
    return c


def replace_delimiter(c: Column, literal: str) -> Column:
    """A literal delimiter becomes a space."""
    return F.replace(c, F.lit(literal), F.lit(" "))


def found_terms(c: Column, pattern: str) -> Column:
    """All matches of a pattern: whole matches, or the group where the pattern has exactly one. More groups are rejected."""
    groups = re.compile(pattern).groups
    if groups > 1:
        raise ValueError(f"{pattern!r} has {groups} groups; use one or none")
    return F.regexp_extract_all(c, F.lit(java_regex(pattern)), F.lit(groups))


def replace_terms(c: Column, rules: list[tuple[str, str]]) -> tuple[Column, dict[str, Column]]:
    """Apply (pattern, replacement) rules in order; later rules see earlier replacements. Returns the text and, by
    replacement, the terms each rule found (an array; rules with the same replacement: the last one)."""
    terms = {}
    for pattern, replacement in rules:
        terms[replacement] = found_terms(c, pattern)
        c = F.regexp_replace(c, java_regex(pattern), java_literal(replacement))
    return c, terms


def collapse_placeholders(c: Column, replacements: list[str]) -> Column:
    """A run of one placeholder, with spaces, slashes and equal signs between, becomes one. Placeholders are taken as
    regular expressions and share their spaces, so mixed runs collapse in part only."""
    for p in replacements:
        c = F.regexp_replace(c, f"(({java_regex(p)})[ /=]*)+", java_literal(p))
    return c


def squeeze(c: Column) -> Column:
    """Without asterisks, runs of spaces as one."""
    return F.regexp_replace(F.replace(c, F.lit("*"), F.lit("")), " +", " ")


def split_alpha(c: Column) -> Column:
    """Runs of letters and of other characters apart by a space; without tokens that are punctuation (a piece of it in
    the order of ASCII, as a substring test has it)."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0)), lambda x: F.regexp_replace(x, r"^[\s]+|[\s]+$", ""))
    toks = F.filter(F.split(F.array_join(runs, " "), " "), lambda t: (F.length(t) > 0) & (F.instr(F.lit(PUNCTUATION), t) == 0))
    return F.array_join(toks, " ")


def split_camel(c: Column) -> Column:
    """A space before every run of capitals and before every capitalised word."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "([A-Z]+)", " $1"), "([A-Z][a-z]+)", " $1"))


def mask_digits(c: Column, mask: str = "[DIGITS]") -> Column:
    """Tokens of digits only become the mask; white space is squeezed."""
    toks = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    return F.array_join(F.transform(toks, lambda t: F.when(t.rlike(r"^\d+$"), F.lit(mask)).otherwise(t)), " ")


def tokens(c: Column, extra_delimiters: tuple[str, ...] = ()) -> Column:
    """White-space tokens after turning the extra (literal) delimiters into spaces; an empty array for a blank line."""
    c = F.trim(c)
    for d in extra_delimiters:
        c = F.replace(c, F.lit(d), F.lit(" "))
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def split_at(c: Column, pattern: str = r"[\s=:,]") -> Column:
    """Pieces between matches, empty ones dropped."""
    return F.filter(F.split(c, java_regex(pattern)), lambda t: t != "")


def parameters_by_substring(logline: Column, template: Column) -> Column:
    """Tokens of the line that don't occur anywhere in the template's text."""
    return F.filter(F.split(logline, r"\s+"), lambda t: (t != "") & ~F.contains(template, t))


def parameters_by_alignment(logline: Column, template: Column, wildcard: str = "*") -> Column:
    """Parameters found by walking the line's and the template's tokens side by side.

    Equal tokens close the open parameter; a wildcard takes one token (a following wildcard starts a new one); any
    other difference adds the token to the open parameter and waits at the template's token. What remains of the line when
    the template is over belongs to the open parameter, if there is one. Null text gives an empty array.
    """
    ll, pp = (F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != "") for x in (logline, template))
    zero = F.struct(
        F.lit(1).alias("j"),
        F.array().cast("array<string>").alias("buf"),
        F.lit(False).alias("wild"),
        F.array().cast("array<string>").alias("out"),
    )

    def step(a: Column, tok: Column) -> Column:
        at = F.try_element_at(pp, a["j"])
        over = a["j"] > F.size(pp)
        open_ = F.size(a["buf"]) > 0
        closed = F.when(open_, F.concat(a["out"], F.array(F.array_join(a["buf"], " ")))).otherwise(a["out"])
        none = F.array().cast("array<string>")
        one, more = F.array(tok), F.concat(a["buf"], F.array(tok))
        return (
            F.when(over, F.struct(a["j"].alias("j"), F.when(open_, more).otherwise(a["buf"]).alias("buf"), a["wild"].alias("wild"), a["out"].alias("out")))
            .when(tok == at, F.struct((a["j"] + 1).alias("j"), none.alias("buf"), F.lit(False).alias("wild"), closed.alias("out")))
            .when(
                at == wildcard,
                F.struct(
                    (a["j"] + 1).alias("j"),
                    F.when(a["wild"], one).otherwise(more).alias("buf"),
                    F.lit(True).alias("wild"),
                    F.when(a["wild"], F.concat(a["out"], F.array(F.array_join(a["buf"], " ")))).otherwise(a["out"]).alias("out"),
                ),
            )
            .otherwise(F.struct(a["j"].alias("j"), more.alias("buf"), a["wild"].alias("wild"), a["out"].alias("out")))
        )

    done = F.aggregate(ll, zero, step, lambda a: F.when(F.size(a["buf"]) > 0, F.concat(a["out"], F.array(F.array_join(a["buf"], " ")))).otherwise(a["out"]))
    return F.when(logline.isNull() | template.isNull(), F.array().cast("array<string>")).otherwise(done)


def event_id(template: Column) -> Column:
    """First eight hexadecimal digits of the template's MD5."""
    return F.substring(F.md5(template), 1, 8)


def attribute_key(*cols: Column) -> Column:
    """Columns as one text, joined by '-'."""
    return F.concat_ws("-", *[c.cast("string") for c in cols])


def plain_tokens(c: Column) -> Column:
    """Punctuation as spaces, lower case, tokens."""
    return F.filter(F.split(F.lower(F.translate(c, PUNCTUATION, " " * len(PUNCTUATION))), r"\s+"), lambda t: t != "")


def first_word(c: Column) -> Column:
    """First word or sign of a token in lower case."""
    return F.regexp_extract(F.lower(c), r"(\w+|[^\w\s])", 1)


def pad(a: Column, length: int, value: Column) -> Column:
    """Cut or fill an array to a length."""
    return F.slice(F.concat(a, F.array_repeat(value, length)), 1, length)


def binary_label(c: Column) -> Column:
    """0 for '-', 1 for any other text, null for null."""
    return (c != "-").cast("int")
