"""Cleaning, parsing and formatting of text columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallwise.schemas import COLLECTION_LABELS

# The characters a web form's trim treats as white space, as a list and as a regex class.
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE = r"\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"


def text(c: Column) -> Column:
    """Missing text reads as empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def trim(c: Column) -> Column:
    """Trim every kind of white space; SQL's own trim stops at blanks."""
    return F.trim(c, F.lit(SPACES))


def clean_text(c: Column, limit: int | None = None, upper: bool = False) -> Column:
    out = trim(text(c))
    if upper:
        out = F.upper(out)
    return F.substring(out, 1, limit) if limit else out


def leading_int(c: Column) -> Column:
    """Leading whole number of a text, NULL where there is none."""
    return F.regexp_extract(c.cast("string"), f"^[{SPACE}]*([+-]?[0-9]+)", 1).try_cast("bigint")


def parse_int(c: Column, default: int = 0) -> Column:
    """Leading whole number of a text; anything else, and zero, gives ``default``."""
    digits = "0*[1-9][0-9]*" if default else "[0-9]+"
    number = F.regexp_extract(c.cast("string"), f"^[{SPACE}]*([+-]?{digits})", 1)
    return F.coalesce(number.try_cast("bigint"), F.lit(default).cast("bigint"))


def whole_number(df: DataFrame, name: str, default: int = 0) -> Column:
    """``parse_int`` of a column, without the detour over text where it holds whole numbers already."""
    if isinstance(df.schema[name].dataType, T.IntegralType):
        number = F.col(name).cast("bigint")
        return F.coalesce(F.when(number != 0, number), F.lit(default).cast("bigint"))
    return parse_int(F.col(name), default)


def parse_int32(c: Column, default: int = 0) -> Column:
    """As ``parse_int``, for INT columns: what lies beyond their range stops at its end."""
    return clamp(parse_int(c, default), -(2**31), 2**31 - 1).cast("int")


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def one_of(c: Column, allowed: Iterable[str], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def truthy(c: Column, data_type: str = "string") -> Column:
    """Truth of a form value: any non-empty text is true, even ``'false'``."""
    if data_type == "boolean":
        return F.coalesce(c, F.lit(False))
    if data_type == "string":
        return F.coalesce(F.length(c) > 0, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


#: Letters of a slug, and of the beginning of a title that it is looked for in first.
SLUG, SLUG_HEAD = 70, 320


def _dashed(lowered: Column) -> Column:
    plain = F.regexp_replace(lowered, f"[^a-z0-9{SPACE}-]+", "")
    return F.regexp_replace(plain, f"[{SPACE}-]+", "-")


def slugify(title: Column) -> Column:
    """URL form of a title: ASCII letters, digits and single hyphens, at most 70 long.

    A beginning that gives a letter more than a slug has settles the slug, whatever follows; any other text is read whole.
    """
    head = _dashed(F.ltrim(F.lower(F.substring(text(title), 1, SLUG_HEAD)), F.lit(SPACES)))
    slug = F.substring(F.when(F.length(head) > SLUG, head).otherwise(_dashed(trim(F.lower(text(title))))), 1, SLUG)
    return F.when(slug == "", "piece").otherwise(slug)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def filled(message: str, value: Column) -> Column:
    """A message with a value in place of its braces; a missing value reads ``null``."""
    before, after = message.split("{}")
    return F.concat(F.lit(before), F.coalesce(value.cast("string"), F.lit("null")), F.lit(after))


def phone_display(c: Column) -> Column:
    """Indian mobile numbers as ``+91 xxxxx xxxxx``, others as plus and digits."""
    digits = digits_only(c)
    indian = F.concat_ws(" ", F.lit("+91"), F.substring(digits, 3, 5), F.substring(digits, 8, 5))
    return F.when(digits.rlike("^91[0-9]{10}$"), indian).otherwise(F.concat(F.lit("+"), digits))


def indian_digits(c: Column) -> Column:
    """1234567 becomes 12,34,567."""
    return F.regexp_replace(c.cast("string"), r"(\d)(?=(\d\d)+\d$)", "$1,")


def rupees(c: Column) -> Column:
    return F.concat(F.lit("₹"), indian_digits(F.coalesce(c, F.lit(0))))


def collection_label(code: Column) -> Column:
    pairs = [F.lit(x) for kv in COLLECTION_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def encode_component(c: Column) -> Column:
    """Percent-encode as a browser does for one URL component."""
    out = F.url_encode(c)
    # What form encoding writes, and the component form of it.
    for code, char in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def order_ref(at: Column, prefix: str) -> Column:
    """Reference from the order's time: the last six base-36 digits of its milliseconds."""
    return F.concat(F.lit(prefix), F.right(F.conv(F.unix_millis(at), 10, 36), F.lit(6)))


def day_label(day: Column) -> Column:
    """Short date, as in ``5 Jan``."""
    return F.date_format(day, "d MMM")
