"""Text expressions shared by the operators. All of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a strip removes (every Unicode white space and the four separators)
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def has_text(text: Column) -> Column:
    """True for a string that is neither null nor empty."""
    return F.coalesce(text, F.lit("")) != ""


def strings(array: Column) -> Column:
    return F.coalesce(array, F.array().cast("array<string>"))


def string_array(*items: Column) -> Column:
    return F.array(*items).cast("array<string>")


def split_names(text: Column, separator: str = ";") -> Column:
    """Names of a separated list, stripped, empty ones dropped."""
    parts = F.transform(F.split(text_or_empty(text), separator), strip)
    return F.filter(parts, lambda name: name != "")


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def preview(text: Column, width: int = 200) -> Column:
    """First ``width`` characters, with an ellipsis when something was cut."""
    cut = F.concat(F.substring(text, 1, width), F.lit("..."))
    return F.when(F.length(text) > width, cut).otherwise(text)


def filled(template: str, *values: Column) -> Column:
    """A text with ``{}`` places filled by columns, as one concatenation; null if any value is."""
    pieces = template.split("{}")
    if len(pieces) != len(values) + 1:
        raise ValueError(f"{len(values)} values for {template!r}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)


def float_text(value: Column) -> Column:
    """Shortest decimal text of a double with plain digits from 1e-4 up to 1e16.

    Spark switches to exponents below 1e-3 and from 1e7, so digits are moved back in place there.
    """
    plain = value.cast("double").cast("string")
    sign = F.when(plain.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    unsigned = F.regexp_replace(plain, "^-", "")
    mantissa = F.substring_index(unsigned, "E", 1)
    exponent = F.regexp_extract(plain, r"E(-?\d+)$", 1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), r"(?<=\d)0+$", "")
    big_whole = F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0"))
    big_rest = F.substring(digits, exponent + 2, F.length(digits))
    big = F.concat(big_whole, F.lit("."), F.when(big_rest == "", F.lit("0")).otherwise(big_rest))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    far = F.concat(
        F.regexp_replace(mantissa, r"\.0$", ""),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exponent).cast("string"),
    )
    moved = (
        F.when((exponent >= 0) & (exponent < 16), big)
        .when((exponent < 0) & (exponent >= -4), small)
        .otherwise(far)
    )
    # the digits are only touched where there is an exponent
    return (
        F.when(F.contains(plain, F.lit("E")), F.concat(sign, moved))
        .when(plain == "NaN", F.lit("nan"))
        .when(plain == "Infinity", F.lit("inf"))
        .when(plain == "-Infinity", F.lit("-inf"))
        .otherwise(plain)
    )
