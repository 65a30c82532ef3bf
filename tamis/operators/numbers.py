"""Steps that make numbers."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal as Number

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.native import SPACES, kind_of
from tamis.plans.core import Step

SCALE = 18
#: A finite number as text: digits may be parted by single underscores.
_DIGITS = r"\d(?:_?\d)*"
NUMBER = rf"(?U)\A[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
ENDLESS = r"(?i)\A[+-]?(?:s?nan[0-9]*|inf(?:inity)?)\z"
#: Most numbers are plain: decimal(38, 18) holds them as they are.
SHORT = r"\A[+-]?[0-9]{1,19}(?:\.[0-9]{0,18})?\z"


def _numeric_text(v: Column, t: T.DataType) -> Column | None:
    """A number's text, null where the value is none; None if the type can't hold one."""
    if isinstance(t, T.StringType):
        return F.btrim(v, F.lit(SPACES))
    if isinstance(t, T.BooleanType):
        return v.cast("int").cast("string")
    if isinstance(t, T.NumericType):
        return v.cast("string")
    if isinstance(t, T.VariantType):
        kind = kind_of(v)
        return F.when(kind.rlike("^BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("int").cast("string")).when(kind.rlike("^(STRING|BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)"), F.btrim(F.try_variant_get(v, "$", "string"), F.lit(SPACES)))
    return None


def _tuple(v: Column, t: T.DataType) -> Column | None:
    """struct<sign, digits, exp> as a number's text."""
    if isinstance(t, T.StructType) and [f.name for f in t] == ["sign", "digits", "exp"]:
        digits = F.array_join(F.transform(v["digits"], lambda d: d.cast("string")), "")
        return F.when(v.isNotNull(), F.concat(F.when(v["sign"] == 1, "-").otherwise(""), F.when(digits == "", "0").otherwise(digits), F.lit("E"), v["exp"].cast("string")))
    return None


class Decimal(Step):
    """A finite number as decimal(38, scale), from text, numbers, booleans, or struct<sign, digits, exp>.

    max_precision rounds half to even: to so many places, or to the places that a decimal number has. A number that
    decimal(38, scale) can't hold gets the code `exception`.
    """

    def __init__(self, max_precision: int | Number | None = None, allow_tuples: bool = True, scale: int = SCALE):
        self.places = max_precision if max_precision is None or isinstance(max_precision, int) else -Number(max_precision).as_tuple().exponent
        self.allow_tuples, self.scale = allow_tuples, scale

    def text(self, v: Column, t: T.DataType) -> Column | None:
        return _tuple(v, t) if self.allow_tuples and isinstance(t, T.StructType) else _numeric_text(v, t)

    def exact(self, t: T.DataType) -> bool:
        """Is the value a number that needs no reading?"""
        return isinstance(t, (T.DecimalType, T.IntegralType))

    def stages(self, t: T.DataType) -> list[Callable[[Column], Column]]:
        new = T.DecimalType(38, self.scale)
        rounded = lambda d: d if self.places is None else F.bround(d, self.places).try_cast(new)
        if self.exact(t):
            return [lambda v: F.struct(v.isNotNull().alias("there"), rounded(v.try_cast(new)).alias("number"))]
        if self.text(F.lit(None), t) is None:
            return []
        return [lambda v: self.text(v, t), self._read, lambda x: F.struct(x["text"].alias("text"), x["finite"].alias("finite"), rounded(x["number"]).alias("number"))]

    def _read(self, text: Column) -> Column:
        """struct<text, finite, number>, number null where decimal can't hold it."""
        finite = text.rlike(NUMBER)
        number = F.when(finite, F.replace(text, F.lit("_"), F.lit("")).try_cast(T.DecimalType(38, self.scale)))
        return F.struct(text.alias("text"), finite.alias("finite"), number.alias("number"))

    def faults(self, v: Column, t: T.DataType, got: Column) -> list:
        if self.exact(t):
            return [(got["there"] & got["number"].isNull(), "exception", "is too large")]
        wrong = [(v.isNotNull() & got["text"].isNull() & ~kind_of(v).rlike("^VOID"), "wrong_type", "is neither text nor a number")] if isinstance(t, T.VariantType) else []
        return [*wrong, (~got["finite"] & got["text"].rlike(ENDLESS), "not_finite", "is not finite"), (~got["finite"], "not_numeric", "is not a number"), (got["finite"] & got["number"].isNull(), "exception", "is too large")]

    def judge(self, v: Column, t: T.DataType, got: Column) -> tuple[list, Column, T.DataType]:
        new = T.DecimalType(38, self.scale)
        if not self.stages(t):
            return [(v.isNotNull(), "wrong_type", "is neither text nor a number")], F.lit(None).cast(new), new
        return self.faults(v, t, got), got["number"], new


class Int(Decimal):
    """A whole number as decimal(38, 0); 42.000 and 2.6E4 are whole. Judged on the digits, so none are lost to a scale."""

    def __init__(self):
        super().__init__(scale=0)

    def exact(self, t: T.DataType) -> bool:
        return isinstance(t, T.IntegralType)

    def stages(self, t: T.DataType) -> list[Callable[[Column], Column]]:
        if self.exact(t) or self.text(F.lit(None), t) is None:
            return super().stages(t)
        return [lambda v: self.text(v, t), self._read, self._parts, self._digits, self._whole]

    def _read(self, text: Column) -> Column:
        """Short numbers go by decimal; others are taken apart by the steps below, one pattern for all parts."""
        return F.struct(text.alias("text"), F.when(text.rlike(SHORT), text.try_cast(T.DecimalType(38, 18))).alias("short"))

    def _parts(self, x: Column) -> Column:
        text, long = x["text"], x["short"].isNull()
        parts = F.split(F.regexp_replace(F.replace(text, F.lit("_"), F.lit("")), r"(?U)^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$", "$1;$2;$3;$4"), ";")
        return F.struct(text.alias("text"), x["short"].alias("short"), F.when(long & text.rlike(NUMBER), parts).alias("p"))

    def _digits(self, x: Column) -> Column:
        p = x["p"]
        given = F.get(p, F.lit(3))
        power = F.when(given == "", 0).otherwise(F.coalesce(given.try_cast("int"), F.when(given.startswith("-"), -1000).otherwise(1000)))
        point = F.char_length(F.get(p, F.lit(1))) + F.greatest(F.least(power, F.lit(1000)), F.lit(-1000))
        return F.struct(x["text"].alias("text"), x["short"].alias("short"), F.get(p, F.lit(0)).alias("sign"), F.concat(F.get(p, F.lit(1)), F.get(p, F.lit(2))).alias("digits"), point.alias("point"))

    def _whole(self, x: Column) -> Column:
        digits, point, new = x["digits"], x["point"], T.DecimalType(38, 0)
        whole = F.when(point <= 0, "0").otherwise(F.concat(x["sign"], F.regexp_replace(F.rpad(F.substring(digits, F.lit(1), point), F.greatest(point, F.lit(1)), F.lit("0")), r"^0+(?=\d)", "")))
        rest = F.substring(digits, F.greatest(point, F.lit(0)) + 1, F.greatest(F.char_length(digits), F.lit(1)))
        short = x["short"].isNotNull()
        number = F.when(short, x["short"].cast(T.DecimalType(20, 0))).otherwise(whole.try_cast(new)).cast(new)
        part = F.when(short, x["short"] != x["short"].cast(T.DecimalType(20, 0))).otherwise(rest.rlike("[^0]"))
        return F.struct(x["text"].alias("text"), F.when(x["text"].isNotNull(), short | digits.isNotNull()).alias("finite"), part.alias("part"), number.alias("number"))

    def faults(self, v: Column, t: T.DataType, got: Column) -> list:
        every = super().faults(v, t, got)
        return every if self.exact(t) else [*every[:-1], (got["part"], "not_int", "is not whole"), every[-1]]


#: Is the value to go away from zero, once it is cut to a multiple of the step towards zero? By name of the rounding; r is
#: what was cut off, h whether that is under (-1), at (0) or over (1) half a step, odd and five say whether the multiple is
#: odd and whether it ends in 0 or 5.
ROUNDINGS = {
    "ROUND_HALF_UP": lambda r, h, odd, five: h >= 0,
    "ROUND_HALF_EVEN": lambda r, h, odd, five: (h > 0) | (h == 0) & odd,
    "ROUND_CEILING": lambda r, h, odd, five: r > 0,
    "ROUND_FLOOR": lambda r, h, odd, five: r < 0,
    "ROUND_DOWN": lambda r, h, odd, five: F.lit(False),
    "ROUND_UP": lambda r, h, odd, five: r != 0,
    "ROUND_HALF_DOWN": lambda r, h, odd, five: h > 0,
    "ROUND_05UP": lambda r, h, odd, five: (r != 0) & five,
}


class Round(Decimal):
    """The nearest multiple of to_nearest; the result is a decimal, or int, float or str if result_type says so.

    Remainders decide, so nothing is lost to a quotient's scale. A multiple that decimal(38, scale) can't hold has the code
    `exception`. to_nearest has fewer places than scale.
    """

    def __init__(self, to_nearest: object = 1, rounding: str = "ROUND_HALF_UP", result_type: type = Number, scale: int = SCALE):
        super().__init__(scale=scale)
        self.step = Number(str(to_nearest))
        if not self.step > 0:
            raise ValueError("to_nearest must be positive")
        if -self.step.as_tuple().exponent >= scale:
            raise ValueError(f"to_nearest needs fewer places than scale, {scale}")
        if rounding not in ROUNDINGS:
            raise ValueError(f"rounding is one of {', '.join(ROUNDINGS)}")
        self.rounding, self.result_type = rounding, result_type

    def stages(self, t: T.DataType) -> list[Callable[[Column], Column]]:
        first = super().stages(t)
        return [*first, self._cut, self._rounded(t)] if first else []

    def _times(self, n: int) -> Column:
        return F.lit(n * self.step if n > 1 else self.step)

    def _cut(self, x: Column) -> Column:
        """The number, its multiple towards zero and what that leaves. try_ throughout: numbers that don't fit are null."""
        d = x["number"]
        r = F.try_mod(d, self._times(1))
        return F.struct(x.alias("x"), r.alias("r"), F.try_subtract(d, r).try_cast(T.DecimalType(38, self.scale)).alias("base"))

    def _rounded(self, t: T.DataType) -> Callable[[Column], Column]:
        def made(y: Column) -> Column:
            r, base, one = y["r"], y["base"], self._times(1)
            left = F.try_subtract(one, F.abs(r))
            half = F.when(F.abs(r) < left, -1).when(F.abs(r) == left, 0).otherwise(1)
            away = ROUNDINGS[self.rounding](r, half, F.try_mod(base, self._times(2)) != 0, F.try_mod(base, self._times(5)) == 0)
            far = F.when(r < 0, F.try_subtract(base, one)).otherwise(F.try_add(base, one))
            number = F.when(away, far.try_cast(T.DecimalType(38, self.scale))).otherwise(base)
            x = y["x"]
            return F.struct(*[x[name].alias(name) for name in (["there"] if self.exact(t) else ["text", "finite"])], number.alias("number"))

        return made

    def judge(self, v: Column, t: T.DataType, got: Column) -> tuple[list, Column, T.DataType]:
        faults, out, new = super().judge(v, t, got)
        if self.result_type is int:
            return faults, out.try_cast(T.DecimalType(38, 0)), T.DecimalType(38, 0)
        if self.result_type is float:
            return faults, out.cast("double"), T.DoubleType()
        if self.result_type is str:
            plain = F.regexp_replace(out.cast("string"), r"(\.\d*?)0+$", "$1")
            return faults, F.regexp_replace(plain, r"\.$", ""), T.StringType()
        return faults, out, new


__all__ = ["Decimal", "Int", "Round"]
