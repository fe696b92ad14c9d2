"""Text primitives as JVM-side column expressions.

The semantics are those of a Unicode-aware ``strip``/``splitlines``/``title``; Spark's own
``trim`` and ``initcap`` only know the blank (U+0020).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# ---- fixed values -------------------------------------------------------------------------
# every character a Unicode strip removes
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# the same set as a regex class body
BLANK_SET = (
    r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# line ends
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
# label/value separators
SEPARATORS = ":\\-–—="
# -------------------------------------------------------------------------------------------

BLANK = f"[{BLANK_SET}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_bare(c: Column) -> Column:
    """True only where ``strip`` changes nothing: visible ASCII at both ends."""
    visible = lambda x: (x >= "!") & (x < "\x7f")
    return visible(c) & visible(F.substring(c, -1, 1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    The optimizer inlines projected columns into the expressions above them; inside a lambda that would repeat an
    expensive expression (splitting a document) for every element. A bound variable cannot be inlined.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def split_lines(c: Column) -> Column:
    """Lines without their ends; no empty line after a final line end; null and '' give no lines."""
    # the final line end is cut first, so that splitting happens once
    body = F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", "")
    # a plain line feed needs no pattern engine, and most texts have no other line end
    plain_body = F.when(c.endswith("\n"), F.substr(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    return (
        F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.array().cast("array<string>"))
        .when(contains_any(c, RARE_BREAKS), F.split(body, LINE_BREAK, -1)).otherwise(F.split(plain_body, "\n", -1))
    )


def stripped_lines(c: Column) -> Column:
    return F.transform(split_lines(c), strip)


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def collapse_blanks(c: Column) -> Column:
    return strip(F.regexp_replace(c, BLANK + "+", " "))


def strip_separators(c: Column) -> Column:
    """Drop leading label separators and blanks."""
    return F.rtrim(F.ltrim(c, F.lit(SEPARATORS.replace("\\", "") + BLANKS)), F.lit(BLANKS))


def contains_any(c: Column, words: list[str]) -> Column:
    """True when the text holds one of the words (plain substring)."""
    cond = F.lit(False)
    for w in words:
        cond = cond | c.contains(w)
    return cond


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30))))
    return F.array_join(cased, "")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def slug(c: Column) -> Column:
    """Lower-case, runs of other characters to one underscore, no underscore at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def quote_regex(c: Column) -> Column:
    """A label column as a literal inside a regular expression."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|/\-#&~])", r"\\$1")


def extract(text: Column, pattern: Column, group: int) -> Column:
    """``regexp_extract`` with a pattern per row."""
    return F.call_function("regexp_extract", text, pattern, F.lit(group))


# a noncharacter (reserved by Unicode for internal use) between the groups of one match
GROUP_MARK = "\ufdd0"


def two_groups(text: Column, pattern: str) -> Column:
    """``struct<l, v>`` of the groups of a full-line match, null without one; a single pass of the pattern."""
    return let(F.regexp_replace(text, pattern, f"$1{GROUP_MARK}$2"), lambda m: F.when(
        m != text,
        F.struct(strip(F.substring_index(m, GROUP_MARK, 1)).alias("l"),
                 strip(F.substring_index(m, GROUP_MARK, -1)).alias("v"))))


def hit(text: Column, pattern: Column | str, group: int = 1) -> Column:
    """First match of a pattern, null when there is none (``regexp_extract`` gives '')."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(F.regexp_like(text, p), F.regexp_extract(text, p, group))
