"""Column helpers that several steps use. All are built-in functions of Spark."""

from __future__ import annotations

import functools
import sys
from datetime import date, datetime
from decimal import Decimal as Number

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Java's patterns work like Unicode-aware ones with only \n as line end under these flags.
FLAGS = "(?Ud)"


def kind_of(v: Column) -> Column:
    """The type of what a variant holds, as schema_of_variant says."""
    return F.schema_of_variant(v)


def length_of(v: Column, t: T.DataType) -> Column | None:
    """Characters of text, bytes of binary, elements of arrays and maps, fields of structs; None if the type has none.
    In a variant, null for a value without length."""
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return F.char_length(v)
    if isinstance(t, T.BinaryType):
        return F.octet_length(v)
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.when(v.isNotNull(), F.size(v))
    if isinstance(t, T.StructType):
        return F.when(v.isNotNull(), F.lit(len(t)))
    if isinstance(t, T.VariantType):
        kind = kind_of(v)
        return F.when(kind.rlike("^STRING"), F.char_length(F.try_variant_get(v, "$", "string"))).when(kind.rlike("^ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>"))).when(kind.rlike("^OBJECT"), F.size(F.try_variant_get(v, "$", "map<string,variant>")))
    return None


def sized(v: Column, t: T.DataType) -> Column:
    """Does the value have a length?"""
    return kind_of(v).rlike("^(STRING|ARRAY|OBJECT|VOID)") if isinstance(t, T.VariantType) else F.lit(True)


def literal(x: object, t: T.DataType) -> Column | None:
    """A Python value as a literal that compares with a column of type t; None if they don't compare."""
    number = isinstance(x, (int, float, Number))
    if isinstance(t, T.BooleanType):
        return F.lit(x) if isinstance(x, bool) else F.lit(x) if number else None
    if isinstance(t, T.DecimalType):
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return F.lit(x)
        return F.lit(Number(str(x)) if isinstance(x, float) else Number(x)) if number else None
    if isinstance(t, T.NumericType):
        return F.lit(int(x) if isinstance(x, bool) else x) if number else None
    if isinstance(t, T.StringType):
        return F.lit(x) if isinstance(x, str) else None
    if isinstance(t, T.BinaryType):
        return F.lit(bytes(x)) if isinstance(x, (bytes, bytearray)) else None
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(x) if isinstance(x, (date, datetime)) else None
    return None


@functools.cache
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that full case folding changes after lower case, to one character and to several. From Python's own
    tables, by rule; made once."""
    special = {c: c.casefold() for c in map(chr, range(128, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and c.lower().casefold() != c.lower()}
    special |= {low: low.casefold() for c in list(special) for low in c.lower() if low.casefold() != low}
    del special["ß"]
    return {c: f for c, f in sorted(special.items()) if len(f) == 1}, {c: f for c, f in sorted(special.items()) if len(f) > 1}


def folded(v: Column) -> Column:
    """Text as str.casefold gives it: lower case and ss for ß; texts with a character that folds in another way, all but a
    few of which lie beyond Latin and Greek letters in use, go through tables."""
    single, longer = _foldings()
    low = F.lower(v)
    text = F.when(F.octet_length(v) == F.char_length(v), low).otherwise(F.replace(low, F.lit("ß"), F.lit("ss")))
    few = sorted(c for c in (*single, *longer) if ord(c) < 0x400)
    rare = "[" + "".join(few) + "\\x{400}-\\x{10FFFF}]"
    changed = F.translate(text, "".join(single), "".join(single.values()))
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    each = F.transform(F.split(changed, ""), lambda c: F.coalesce(F.element_at(table, c), c))
    slow = F.when(text.rlike("[" + "".join(longer) + "]"), F.array_join(each, "")).otherwise(changed)
    return F.when((F.octet_length(v) != F.char_length(v)) & text.rlike(rare), slow).otherwise(text)


def without_controls(v: Column) -> Column:
    """Text without control and unassigned characters other than white space."""
    return F.regexp_replace(v, F.lit(FLAGS + r"[\p{C}&&[^\s]]+"), F.lit(""))


def line_feeds(v: Column) -> Column:
    return F.regexp_replace(v, r"\r\n?", "\n")
