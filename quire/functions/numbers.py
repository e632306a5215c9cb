"""Numbers in cells, on pages and in colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are numbers in their shortest form: integers, decimals without trailing zeros, and the exponents beyond both.
CANONICAL = r"^(?:0|-?[1-9][0-9]*|-?(?:0|[1-9][0-9]*)\.[0-9]*[1-9])$"
EXPONENT = r"^-?[1-9](?:\.[0-9]*[1-9])?e(?:\+(?:2[1-9]|[3-9][0-9]|[12][0-9]{2}|30[0-8])|-(?:[7-9]|[1-9][0-9]|[12][0-9]{2}|30[0-8]))$"
TINY = r"^-?0\.0{6,}"
NUMERIC = r"^[+-]?(?:Infinity|[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)$|^0[xX][0-9a-fA-F]+$|^0[oO][0-7]+$|^0[bB][01]+$|^$"


def is_typed(value: Column) -> Column:
    """Whether a cell becomes a number on export: at most 15 characters that a number prints back exactly."""
    t = F.trim(value)
    return (t != "") & (F.length(t) <= 15) & ((t.rlike(CANONICAL) & ~t.rlike(TINY)) | t.rlike(EXPONENT))


def json_value(value: Column) -> Column:
    """A cell as JSON text: a number where is_typed(), else a quoted string."""
    return F.when(is_typed(value), F.trim(value)).otherwise(json_string(value))


#: The short escapes of JSON; other control characters are written by their number.
SHORT_ESCAPES = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(value: Column) -> Column:
    """A JSON string: quotes, backslashes and all control characters are escaped; texts without any take one test."""
    escaped = value
    for raw, short in SHORT_ESCAPES.items():
        escaped = F.replace(escaped, F.lit(raw), F.lit(short))
    rare = escaped
    for c in (chr(k) for k in range(32)):
        if c not in SHORT_ESCAPES:
            rare = F.replace(rare, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    escaped = F.when(escaped.rlike(r"[\x00-\x1f]"), rare).otherwise(escaped)
    return F.concat(F.lit('"'), F.when(value.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(value), F.lit('"'))


def is_numeric(value: Column) -> Column:
    """Whether a cell reads as a number once commas are taken out; also hexadecimal, octal, binary and Infinity."""
    t = F.trim(value)
    return (t != "") & F.replace(t, F.lit(","), F.lit("")).rlike(NUMERIC)


def column_letters(n: Column) -> Column:
    """Spreadsheet letters of a column number from 0."""
    def letter(k: Column) -> Column:
        return F.char((F.lit(65) + k).cast("int"))

    one, two, three = letter(n % 26), letter(F.floor(n / 26 - 1) % 26), letter(F.floor((n - 702) / 676) % 26)
    return F.when(n < 26, one).when(n < 702, F.concat(two, one)).otherwise(F.concat(three, letter(F.floor((n - 702) / 26) % 26), one))


def sqlite_real(x: Column) -> Column:
    """A REAL as SQLite prints it: 15 significant digits, always a decimal point, exponents of two digits."""
    sci = F.format_string("%.14e", x)
    mantissa, exponent = F.regexp_extract(sci, r"^(-?[0-9.]+)e", 1), F.regexp_extract(sci, r"e([+-][0-9]+)$", 1).cast("int")
    sign, digits = F.when(sci.startswith("-"), "-").otherwise(""), F.regexp_replace(mantissa, "[^0-9]", "")
    whole = F.when(exponent >= 0, F.substring(digits, F.lit(1), exponent + 1)).otherwise("0")
    part = F.when(exponent >= 0, F.substr(digits, exponent + 2)).otherwise(F.concat(F.repeat(F.lit("0"), -exponent - 1), digits))
    trimmed = F.regexp_replace(part, "0+$", "")
    fixed = F.concat(sign, whole, F.lit("."), F.when(trimmed == "", "0").otherwise(trimmed))
    short = F.regexp_replace(mantissa, "0+$", "")
    long = F.concat(short, F.when(short.endswith("."), "0").otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    return F.when(x == 0, "0.0").when((exponent < -4) | (exponent >= 15), long).otherwise(fixed)


def luminance(hex_colour: Column) -> Column:
    """Relative luminance of #rrggbb."""
    def part(at: int) -> Column:
        c = F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * part(2) + 0.7152 * part(4) + 0.0722 * part(6)
