"""Scalar functions over report fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrascope.schemas import UNKNOWN

# the characters a unicode-aware strip removes
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# fixed values: spellings of "no value" besides the empty string
NULL_WORDS = ("", "nan", "none")

# fixed values: e-mail and phone patterns
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = (
    r"(?<!\p{Nd})(?:\+?\p{Nd}{1,3}[-.\s]?)?(?:\(?\p{Nd}{2,4}\)?[-.\s]?)\p{Nd}{3,4}[-.\s]?\p{Nd}{3,4}(?!\p{Nd})"
)
# fixed values: words of an oil, gas or hazmat domain
DOMAIN_WORDS = ("oil", "gas", "hazmat", "pipeline")
HTML_TAG = r"<[^>]+>"
NUMBER = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"

# the same characters for a regular expression; possessive, so scans stay linear
_BLANKS = r"[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + r"]*+"
# a phone number starts with one of these: most positions fail on one character
_PHONE_START = r"(?=[+(\p{Nd}])"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value evaluated once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def matches(value: Column, words: str) -> Column:
    """Whether the stripped value matches an expression; long texts fail at their first letter."""
    return value.rlike(rf"\A{_BLANKS}{words}{_BLANKS}\z")


def is_blank(value: Column) -> Column:
    """Null, empty, or a spelled-out null."""
    return F.coalesce(matches(value, f"(?i:{'|'.join(filter(None, NULL_WORDS))})?"), F.lit(True))


def unknown_if_blank(value: Column) -> Column:
    return F.when(is_blank(value), F.lit(UNKNOWN)).otherwise(strip(value))


def known(value: Column) -> Column:
    """The stripped value, or null where it is blank: the form used inside Spark."""
    return F.when(~is_blank(value), strip(value))


def strip_html(value: Column) -> Column:
    """Text without tags; a value made of tags alone is kept as it is."""
    kept = known(value)
    bare = strip(F.regexp_replace(kept, HTML_TAG, ""))
    return F.coalesce(F.nullif(bare, F.lit("")), kept, F.lit(UNKNOWN))


def make_record_id(dataset: Column, source_record_id: Column) -> Column:
    return F.concat_ws("__", dataset, source_record_id)


def site_label(place: Column, region: Column) -> Column:
    """"place, region", or whichever of the two is known."""
    return F.coalesce(
        F.nullif(F.concat_ws(", ", known(place), known(region)), F.lit("")), F.lit(UNKNOWN)
    )


def number(text: Column) -> Column:
    """The number a text spells, or null.

    The pattern comes first because a failed cast raises and catches an
    exception per row, which costs far more than the test.
    """
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def whole_number(text: Column) -> Column:
    """The integer text of a number below 10^15, cut at the decimal point; else null."""
    parsed = number(text)
    return F.when(F.abs(parsed) < 1e15, parsed.cast("bigint").cast("string"))


def normalize_code(value: Column) -> Column:
    """Whole numbers lose their fraction ("71.0" -> "71"); other text is kept."""
    text = strip(value)
    parsed = number(text)
    return F.when(parsed == F.floor(parsed), F.coalesce(whole_number(text), text)).otherwise(text)


def integer_text(value: Column) -> Column:
    """A numeric id or age as integer text, UNKNOWN where blank."""
    return F.coalesce(whole_number(strip(value)), unknown_if_blank(value))


def decode_sex(value: Column) -> Column:
    code = whole_number(strip(value))
    return F.when(code == "1", "male").when(code == "2", "female").otherwise(UNKNOWN)


def normalize_text(value: Column) -> Column:
    """Comparison key: lower case, only letters, numbers and underscores, single blanks.

    One pass suffices: whatever is neither letter, number nor underscore ends up
    as a blank, and runs of blanks collapse.
    """
    return F.trim(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}_]+", " "))


def is_malformed(value: Column) -> Column:
    """Missing, UNKNOWN or shorter than five characters without surrounding blanks."""
    return F.coalesce(matches(value, f"(?:(?i:{UNKNOWN})|(?s:.{{0,4}}))"), F.lit(True))


def has_pii(value: Column) -> Column:
    """An e-mail address or a phone number occurs; the `@` test spares most e-mail scans."""
    email = F.contains(value, F.lit("@")) & value.rlike(EMAIL)
    return F.coalesce(email | value.rlike(_PHONE_START + PHONE), F.lit(False))


def parse_bool(value: Column) -> Column:
    return F.coalesce(F.lower(strip(value.cast("string"))) == "true", F.lit(False))


def word_count(value: Column) -> Column:
    return F.coalesce(F.regexp_count(value, F.lit(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0))


def domain_relevant(domain: Column) -> Column:
    return F.coalesce(F.lower(domain).rlike("|".join(DOMAIN_WORDS)), F.lit(False))


def usable_text(value: Column) -> Column:
    """Neither blank nor the UNKNOWN sentinel."""
    return ~F.coalesce(matches(value, f"(?i:{UNKNOWN})?"), F.lit(True))


def render_unknown(value: Column) -> Column:
    """Boundary form of a column kept as null inside Spark."""
    return F.coalesce(value, F.lit(UNKNOWN))
