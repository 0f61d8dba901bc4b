"""Labels, formats and links as column expressions."""

from __future__ import annotations

import base64
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.functions.text import ascii_words

# What can't be part of a place name in a mast's label, in any case: a company's form, a height, a
# height's mark, a month with a year, a year, a period, makers' codes; and what may open a name but ends it.
STRONG = [
    r"Pvt\b",
    r"\d{2,3}(?:\.\d+)?\s*m\b",
    r"\bHt(?:\b\.?|(?=\d))",
    r"\b(?:\d{1,2})?(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s*'?\d{2,4}\b",
    r"\b(?:19|20)\d{2}\b",
    r"\b\d+\s*year\b",
    r"\b(?:MPWL|CECL(?:WM)?|MEIL|Suzlon|Vestas)\b",
]
WEAK = [r"\bWM\b", r"\bmast\b"]
AT_ENDS = [r"\bwind\b"]
EDGE = r"[\s.,\-]"
LEAST_NAME = 3


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


#: Patterns of label clean-up: the text before the first marker, markers at the end and at the start, a marker at the start.
BEFORE_MARKER = rf"(?is)^(.*?){any_of(STRONG + WEAK)}"
TAIL = rf"(?i)(?:{any_of(STRONG + WEAK + AT_ENDS)}{EDGE}*)+$"
HEAD = rf"(?i)^(?:{EDGE}*{any_of(STRONG + WEAK + AT_ENDS)})+"
OPENS_STRONG = rf"(?i)^{any_of(STRONG)}"


def tidy(text: Column) -> Column:
    """Quotes and stars gone, white space run together, separators cut from both ends."""
    out = F.regexp_replace(F.regexp_replace(text, "[\"'*]", ""), r"\s+", " ")
    return F.regexp_replace(out, rf"^{EDGE}+|{EDGE}+$", "")


def display_name(label: Column) -> Column:
    """The place name in a free-form mast label, null for a null label.

    What stands before the first marker; where a marker opens the label, what
    is left of it without the markers at its end, or at its start if it still
    opens with one that can't be a name; the whole label if nothing is left.
    """
    line = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(label, r"^([^\r\n]*)", 1), '"[^"]*"', " "), "'[^']*'", " "), "_", " ")
    found = F.regexp_extract(line, ascii_words(BEFORE_MARKER), 1)
    head = tidy(F.when(line.rlike(ascii_words(BEFORE_MARKER)), found).otherwise(line))
    peeled = F.regexp_replace(F.regexp_replace(F.regexp_replace(line, rf"^{EDGE}+|{EDGE}+$", ""), ascii_words(TAIL), ""), rf"^{EDGE}+|{EDGE}+$", "")
    rest = tidy(F.regexp_replace(peeled, ascii_words(HEAD), ""))
    tail, whole = tidy(peeled), tidy(line)
    return (
        F.when(label.isNull(), None).when(F.length(head) > 0, head).when(peeled.rlike(ascii_words(OPENS_STRONG)) & (F.length(rest) >= LEAST_NAME), rest)
        .when((F.length(tail) > 0) & (tail != whole), tail).when(F.length(whole) > 0, whole).otherwise(F.trim(label))
    )


def height_m(label: Column) -> Column:
    """Metres in a label, two or three digits before an m, from 10 to 200; else null."""
    first, second = (F.regexp_extract(label, p, 1) for p in (ascii_words(r"(?i)([0-9]{2,3})\s*m\b"), "(?i)([0-9]{2,3})m"))
    value = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit(""))).cast("int")
    return F.when(value.between(10, 200), value)


def height_class(height: Column) -> Column:
    return F.when(height.isNull() | (height <= 0), -1).when(height < 50, 0).when(height <= 100, 1).otherwise(2)


def grouped(value: Column) -> Column:
    """A whole number with separators as in India: the last three digits, then pairs."""
    digits = F.format_string("%d", F.abs(value))
    head = F.reverse(F.substring(digits, 1, 64).substr(F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0))))
    pairs = F.regexp_replace(F.reverse(F.regexp_replace(head, "([0-9]{2})", "$1,")), "^,", "")
    out = F.when(F.length(digits) <= 3, digits).otherwise(F.concat(pairs, F.lit(","), F.right(digits, F.lit(3))))
    return F.concat(F.when(value < 0, "-").otherwise(""), out)


def rounded(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def rupees(value: Column) -> Column:
    return F.concat(F.lit("₹"), grouped(rounded(value)))


def rupees_short(value: Column) -> Column:
    """Crore and lakh from their size on, else the whole amount."""
    return F.when(F.abs(value) >= 1e7, F.format_string("₹%.2f Cr", value / 1e7)).when(F.abs(value) >= 1e5, F.format_string("₹%.2f L", value / 1e5)).otherwise(rupees(value))


def kilometres(value: Column) -> Column:
    return F.concat(grouped(rounded(value)), F.lit(" km"))


def percent(value: Column, digits: int = 1) -> Column:
    """A share as per cent, a dash where there is none."""
    return F.when(value.isNull(), "—").otherwise(F.format_string(f"%.{digits}f%%", value * 100))


def area_percent(value: Column) -> Column:
    """A share as per cent, with a decimal below one."""
    p = value * 100
    return F.when(p <= 0, "0%").when(p < 1, F.format_string("%.1f%%", p)).otherwise(F.concat(rounded(p).cast("string"), F.lit("%")))


def coordinates(lon: Column, lat: Column) -> Column:
    side = lambda v, a, b: F.concat(F.format_string("%.4f° ", F.abs(v)), F.when(v >= 0, a).otherwise(b))
    return F.concat(side(lat, "N", "S"), F.lit(", "), side(lon, "E", "W"))


def with_unit(value: Column, unit: str, digits: int = 2) -> Column:
    """A number without trailing zeros, and its unit; null stays null."""
    return F.concat(F.regexp_replace(F.format_string(f"%.{digits}f", value), r"\.?0+$", ""), F.lit(f" {unit}"))


def day_label(text: Column) -> Column:
    """'3 Jun 2021' from D/M/Y or D-M-Y; other texts as they are."""
    parts = [F.regexp_extract(F.trim(text), r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})$", i).try_cast("int") for i in (1, 2, 3)]
    names = F.array(*[F.lit(m) for m in ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")])
    return F.when(parts[0].between(1, 31) & parts[1].between(1, 12), F.concat_ws(" ", parts[0], F.get(names, parts[1] - 1), parts[2])).otherwise(text)


PLAIN, DEFLATED = "0", "1"


def permalink(ring: Column) -> Column:
    """A ring of (x, y) at six decimals as a link that needs no deflate: JSON in base64 for addresses."""
    number = lambda v: F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    json = F.concat(F.lit("["), F.array_join(F.transform(ring, lambda p: F.concat(F.lit("["), number(p["x"]), F.lit(","), number(p["y"]), F.lit("]"))), ","), F.lit("]"))
    return F.concat(F.lit(f"aoi={PLAIN}"), F.rtrim(F.translate(F.base64(F.encode(json, "UTF-8")), "+/\r\n", "-_"), F.lit("=")))


def ring_of(link: Column) -> Column:
    """The ring of a plain link, null if it holds none: fewer than 4 or more than 4000 vertices, or no numbers."""
    data = F.translate(F.regexp_extract(link, rf"(?:^|[#&])aoi={PLAIN}([A-Za-z0-9_-]+)", 1), "-_", "+/")
    padded = F.concat(data, F.repeat(F.lit("="), F.pmod(-F.length(data), F.lit(4))))
    found = F.from_json(F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8"), "array<array<double>>")
    good = F.size(found).between(4, 4000) & F.forall(found, lambda v: (F.size(v) == 2) & F.forall(v, lambda x: x.isNotNull()))
    return F.when(good, F.transform(found, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))


@F.pandas_udf(T.StringType())
def deflated(link: pd.Series) -> pd.Series:
    """The deflated form of plain links."""

    def pack(text: str | None) -> str | None:
        head, _, data = (text or "").partition(f"aoi={PLAIN}")
        if not data:
            return None
        made = zlib.compressobj(wbits=-15)
        raw = made.compress(base64.urlsafe_b64decode(data + "=" * (-len(data) % 4))) + made.flush()
        return f"{head}aoi={DEFLATED}{base64.urlsafe_b64encode(raw).decode().rstrip('=')}"

    return link.map(pack)


@F.pandas_udf(T.StringType())
def inflated(link: pd.Series) -> pd.Series:
    """The plain form of deflated links; null for what can't be inflated."""

    def unpack(text: str | None) -> str | None:
        head, _, data = (text or "").partition(f"aoi={DEFLATED}")
        try:
            raw = zlib.decompress(base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)), wbits=-15)
        except (ValueError, zlib.error):
            return None
        return f"{head}aoi={PLAIN}{base64.urlsafe_b64encode(raw).decode().rstrip('=')}"

    return link.map(unpack)
