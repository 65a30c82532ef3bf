"""Steps that let a value pass or reject it."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime
from decimal import Decimal as Number

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.native import kind_of, length_of, literal, sized
from tamis.plans.core import Called, Outcome, Step, issue, no_issues, shown

#: Names of types that Type takes, and what they are: Spark types, and patterns of schema_of_variant.
KINDS: dict[str, tuple[tuple[type, ...], str]] = {
    "str": ((T.StringType, T.CharType, T.VarcharType), "^STRING"),
    "bytes": ((T.BinaryType,), "^BINARY"),
    "bool": ((T.BooleanType,), "^BOOLEAN"),
    "int": ((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType), "^(BIGINT|INT|SMALLINT|TINYINT|BOOLEAN)"),
    "float": ((T.FloatType, T.DoubleType), "^(FLOAT|DOUBLE)"),
    "decimal": ((T.DecimalType,), "^DECIMAL"),
    "number": ((T.NumericType, T.BooleanType), "^(BIGINT|INT|SMALLINT|TINYINT|BOOLEAN|FLOAT|DOUBLE|DECIMAL)"),
    "date": ((T.DateType, T.TimestampType, T.TimestampNTZType), "^(DATE|TIMESTAMP)"),
    "datetime": ((T.TimestampType, T.TimestampNTZType), "^TIMESTAMP"),
    "sequence": ((T.ArrayType,), "^ARRAY"),
    "mapping": ((T.MapType, T.StructType), "^OBJECT"),
}
#: Python types stand for the kinds of their values.
PYTHON = {str: "str", bytes: "bytes", bytearray: "bytes", bool: "bool", int: "int", float: "float", Number: "decimal", datetime: "datetime", date: "date", list: "sequence", tuple: "sequence", dict: "mapping"}
#: With allow_subclass=False, kinds that are subclasses of another don't pass for it.
EXACT = {"int": ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "^(BIGINT|INT|SMALLINT|TINYINT)"), "date": ((T.DateType,), "^DATE")}


class Type(Step):
    """The value is of one of the types: Python types, names of KINDS, or Spark types."""

    def __init__(self, allowed: object, allow_subclass: bool = True, aliases: dict | None = None):
        self.allowed = tuple(allowed) if isinstance(allowed, (list, tuple, set, frozenset)) else (allowed,)
        self.allow_subclass, self.aliases = allow_subclass, aliases or {}
        for a in self.allowed:
            if not (a in PYTHON or a in KINDS or isinstance(a, (T.DataType, type)) and (isinstance(a, T.DataType) or issubclass(a, T.DataType))):
                raise TypeError(f"{a!r} names no type")

    def _kinds(self) -> Iterable[tuple[tuple[type, ...], str]]:
        for a in self.allowed:
            name = PYTHON.get(a, a) if not isinstance(a, T.DataType) else a
            if isinstance(name, str):
                yield KINDS[name] if self.allow_subclass else EXACT.get(name, KINDS[name])
            else:
                yield (type(a) if isinstance(a, T.DataType) else a,), "^" + (a.simpleString() if isinstance(a, T.DataType) else a.typeName()).upper()

    def label(self) -> str:
        return " or ".join(str(self.aliases.get(a, getattr(a, "__name__", a))) for a in self.allowed)

    def tests(self, v: Column, t: T.DataType) -> list:
        message = f"is not of type {self.label()}"
        if isinstance(t, T.VariantType):
            return [(v.isNotNull() & (kind_of(v) != "VOID") & ~kind_of(v).rlike("|".join(p for _, p in self._kinds())), "wrong_type", message)]
        if any(isinstance(t, k) for k, _ in self._kinds()):
            return []
        return [(v.isNotNull(), "wrong_type", message)]


class Array(Type):
    """The value is an array; text, bytes and mappings are not."""

    def __init__(self, aliases: dict | None = None):
        super().__init__("sequence", aliases=aliases)


class NoOp(Step):
    """Leaves the value as it is."""


class Choice(Step):
    """The value is one of the choices. Equality is that of the column's type; case counts. Without choices all values fail."""

    def __init__(self, choices: Iterable):
        self.choices = list(dict.fromkeys(choices))

    def tests(self, v: Column, t: T.DataType) -> list:
        message = "is not a valid choice: " + ", ".join(map(str, self.choices[:20]))
        known = [c for c in (literal(c, t) for c in self.choices if c is not None) if c is not None]
        if isinstance(t, T.VariantType):
            text = F.try_variant_get(v, "$", "string")
            return [(v.isNotNull() & (kind_of(v) != "VOID") & ~(text.isin(*[str(c) for c in self.choices]) if self.choices else F.lit(False)), "not_valid_choice", message)]
        return [(v.isNotNull() & ~v.isin(*known) if known else v.isNotNull(), "not_valid_choice", message)]


class Empty(Step):
    """The value's length is 0; a value that has no length, such as a number, is not empty."""

    def tests(self, v: Column, t: T.DataType) -> list:
        n = length_of(v, t)
        return [(v.isNotNull() if n is None else n > 0, "not_empty", "must be empty")]


class NotEmpty(Step):
    """The value's length is not 0; null passes unless allow_none is false."""

    code = "empty"

    def __init__(self, allow_none: bool = True):
        self.allow_none = allow_none

    def message(self) -> str:
        return "must not be empty"

    def tests(self, v: Column, t: T.DataType) -> list:
        n = length_of(v, t)
        bad = [] if n is None else [(n == 0, self.code, self.message())]
        null = v.isNull() if not isinstance(t, T.VariantType) else v.isNull() | F.is_variant_null(v)
        return bad if self.allow_none else [(null, self.code, self.message()), *bad]


class Required(NotEmpty):
    """The value is neither null nor empty."""

    def __init__(self):
        super().__init__(allow_none=False)

    def message(self) -> str:
        return "is required"


class Length(Step):
    """The value's length is `length`; text counts characters, bytes count bytes."""

    def __init__(self, length: int):
        self.length = length

    def tests(self, v: Column, t: T.DataType) -> list:
        n = length_of(v, t)
        if n is None:
            return [(v.isNotNull(), "wrong_type", "has no length")]
        return [(v.isNotNull() & ~sized(v, t), "wrong_type", "has no length"), (n > self.length, "too_long", f"must have length {self.length}"), (n < self.length, "too_short", f"must have length {self.length}")]


class _Bound(Step):
    code, text = "", ""

    def __init__(self, n: int):
        self.n = n

    def bad(self, n: Column) -> Column:
        raise NotImplementedError

    def tests(self, v: Column, t: T.DataType) -> list:
        n = length_of(v, t)
        if n is None:
            return [(v.isNotNull(), "exception", "has no length")]
        return [(v.isNotNull() & ~sized(v, t), "exception", "has no length"), (self.bad(n), self.code, self.text.format(self.n))]


class MaxLength(_Bound):
    """The value's length is at most n."""

    code, text = "too_long", "must have length {} at most"

    def bad(self, n: Column) -> Column:
        return n > self.n


class MinLength(_Bound):
    """The value's length is at least n."""

    code, text = "too_short", "must have length {} at least"

    def bad(self, n: Column) -> Column:
        return n < self.n


class _Limit(Step):
    code, text = "", ""

    def __init__(self, limit: object, exclusive: bool = False):
        self.limit, self.exclusive = limit, exclusive

    def bad(self, v: Column, limit: Column) -> Column:
        raise NotImplementedError

    def tests(self, v: Column, t: T.DataType) -> list:
        message = self.text.format("more than" if self.exclusive and self.code == "too_small" else "less than" if self.exclusive else "at least" if self.code == "too_small" else "at most", self.limit)
        if isinstance(t, T.VariantType):
            if isinstance(self.limit, str):
                text = F.when(kind_of(v).rlike("^STRING"), F.try_variant_get(v, "$", "string"))
                return [(self._fits(v, "^STRING"), "exception", "can't be compared"), (self.bad(text, F.lit(self.limit)), self.code, message)]
            x = F.when(kind_of(v).rlike(KINDS["number"][1]), F.try_variant_get(v, "$", "double"))
            return [(self._fits(v, KINDS["number"][1]), "exception", "can't be compared"), (self.bad(x, F.lit(float(self.limit))) & ~F.isnan(x), self.code, message)]
        limit = literal(self.limit, t)
        if limit is None:
            return [(v.isNotNull(), "exception", "can't be compared")]
        v = v.cast("int") if isinstance(t, T.BooleanType) else v
        bad = self.bad(v, limit)
        return [(bad & ~F.isnan(v) if isinstance(t, (T.FloatType, T.DoubleType)) else bad, self.code, message)]

    def _fits(self, v: Column, kinds: str) -> Column:
        return v.isNotNull() & (kind_of(v) != "VOID") & ~kind_of(v).rlike(kinds)


class Max(_Limit):
    """The value is at most the limit, or less if exclusive. NaN passes: it is not greater than anything."""

    code, text = "too_big", "must be {} {}"

    def bad(self, v: Column, limit: Column) -> Column:
        return v >= limit if self.exclusive else v > limit


class Min(_Limit):
    """The value is at least the limit, or more if exclusive. NaN passes."""

    code, text = "too_small", "must be {} {}"

    def bad(self, v: Column, limit: Column) -> Column:
        return v <= limit if self.exclusive else v < limit


def _ipv6(text: str) -> tuple[str | None, str | None]:
    import socket

    try:
        return socket.inet_ntop(socket.AF_INET6, socket.inet_pton(socket.AF_INET6, text)), None
    except (OSError, ValueError, UnicodeError):
        return None, "not_ip_address"


#: Fixed value: an octet without leading zeros.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


class IpAddress(Called):
    """Text that is an IPv4 address of four octets, or an IPv6 address, which is written in its short form."""

    python = staticmethod(_ipv6)

    def __init__(self, ipv4: bool = True, ipv6: bool = False):
        if not (ipv4 or ipv6):
            raise ValueError("allow IPv4, IPv6 or both")
        self.ipv4, self.ipv6 = ipv4, ipv6

    def _v4(self, v: Column) -> Column:
        return v.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z") if self.ipv4 else F.lit(False)

    def tests(self, v: Column, t: T.DataType) -> list:
        text, wrong = _text(v, t)
        return [(wrong, "wrong_type", "is not text"), (text.isNotNull() & ~self._v4(text), "not_ip_address", "is not an IP address")]

    def convert(self, v: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        return _text(v, t)[0], T.StringType()

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        return super().compile(v, t, path) if self.ipv6 else Step.compile(self, v, t, path)

    def column(self, df, state, t):
        return super().column(df, state, t) if self.ipv6 else Step.column(self, df, state, t)

    def elements(self, df, states, t):
        return super().elements(df, states, t) if self.ipv6 else Step.elements(self, df, states, t)

    def needs(self, v: Column, t: T.DataType) -> Column:
        text, _ = _text(v, t)
        return F.when(~self._v4(text), text)

    def finish(self, v: Column, t: T.DataType, got: Column, path: Column) -> Outcome:
        text, wrong = _text(v, t)
        code = F.when(wrong, "wrong_type").otherwise(got["code"])
        message = F.when(wrong, "is not text").otherwise("is not an IP address")
        return Outcome(F.when(code.isNull(), F.coalesce(got["value"], text)), F.when(code.isNotNull(), F.array(issue(path, code, message, self.name, shown(v, t)))).otherwise(no_issues()), T.StringType())


def _text(v: Column, t: T.DataType) -> tuple[Column, Column]:
    """A value as text where it is text, and whether it is something else."""
    if isinstance(t, T.StringType):
        return v, F.lit(False)
    if isinstance(t, T.VariantType):
        return F.when(kind_of(v).rlike("^STRING"), F.try_variant_get(v, "$", "string")), v.isNotNull() & ~kind_of(v).rlike("^(STRING|VOID)")
    return F.lit(None).cast("string"), v.isNotNull()


__all__ = ["Array", "Choice", "Empty", "IpAddress", "Length", "Max", "MaxLength", "Min", "MinLength", "NoOp", "NotEmpty", "Required", "Type"]
