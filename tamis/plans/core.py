"""Steps and how they become columns.

A step checks or changes one value. It is described once, on the driver, and compiled to column expressions: a state,
struct<path, value, issues>, goes in and out of each. A null value passes unless a step says otherwise; a chain stops at
the first step that adds issues. Nothing here shuffles or drops rows.

A chain over a column keeps each step's state in a column of its own, so expressions never nest. Inside arrays, maps and
structs the states of the step before are the argument of the next step's `transform`, which keeps plans linear as well.
Steps that need Python run once for a column, or once for an array of values: Python can't be called inside a lambda.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUE = "struct<path:string,code:string,message:string,step:string,value:string>"
ISSUES = f"array<{ISSUE}>"
_numbers = itertools.count()


def no_issues() -> Column:
    return F.array().cast(ISSUES)


def ddl(t: T.DataType) -> str:
    return t.simpleString()


def shown(v: Column, t: T.DataType) -> Column:
    """A value as text, for issues."""
    if isinstance(t, T.BinaryType):
        return F.hex(v)
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(v)
    if isinstance(t, T.VariantType):
        return F.to_json(v)
    return v.cast("string")


def issue(path: Column, code: Column | str, message: Column | str, step: str, value: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(path.alias("path"), text(code).alias("code"), text(message).alias("message"), F.lit(step).alias("step"), value.alias("value")).cast(ISSUE)


def below(path: Column, part: Column) -> Column:
    """The path of a part of the value at path; empty parts leave no trace."""
    return F.concat_ws(".", F.nullif(path, F.lit("")), F.nullif(part.cast("string"), F.lit("")))


@dataclass(frozen=True)
class Outcome:
    """What a step makes of a value: the new value, array<issue>, and the value's type."""

    value: Column
    issues: Column
    dtype: T.DataType


class Piped(type):
    """Lets classes be piped like the steps they make without arguments: Required | Int."""

    def __or__(cls, other: object) -> Chain:
        return to_step(cls) | other

    def __ror__(cls, other: object) -> Chain:
        return to_step(other) | to_step(cls)


class Step(metaclass=Piped):
    """Base of all steps. Leaves give `tests` and `convert`; others override `compile`."""

    #: A Python function value -> (value, code) for steps that need one, see `Called`.
    python: Callable | None = None

    @property
    def name(self) -> str:
        return type(self).__name__

    def __or__(self, other: object) -> Chain:
        return Chain(self) | other

    def __ror__(self, other: object) -> Chain:
        return Chain(to_step(other)) | self

    def tests(self, v: Column, t: T.DataType) -> list[tuple[Column, str, Column | str]]:
        """(condition that the value is bad, code, message), the first that holds counts."""
        return []

    def convert(self, v: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        return v, t

    def replacement(self, v: Column, t: T.DataType) -> Column | None:
        """What stands for a bad value; null unless a step says otherwise."""
        return None

    def stages(self, t: T.DataType) -> list[Callable[[Column], Column]]:
        """Costly parts that tests and the new value share: functions of the value, then each of what the one before made.
        A column holds each, or inside collections a `transform` of its own, so each runs once for a value."""
        return []

    def judge(self, v: Column, t: T.DataType, got: Column) -> tuple[list, Column, T.DataType]:
        """Tests, the new value and its type; got: what the last stage made, or the value itself without stages."""
        return self.tests(v, t), *self.convert(v, t)

    def _judges(self, t: T.DataType) -> bool:
        """Does `judge` say all, or does the step compile in a way of its own?"""
        return type(self).compile is Step.compile or bool(self.stages(t))

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        got = F.array(v)
        for f in self.stages(t):
            got = F.transform(got, f)
        return self.outcome(*self.judge(v, t, F.get(got, F.lit(0)) if self.stages(t) else v), v, t, path)

    def outcome(self, tests: list, value: Column, new: T.DataType, v: Column, t: T.DataType, path: Column, first: Column | None = None) -> Outcome:
        """The outcome, from tests of a value and what becomes of a good one. first: see `first_fault`, if it is at hand."""
        if not tests:
            return Outcome(value, no_issues(), new)
        first = first_fault(tests) if first is None else first
        code, message = (F.get(F.array(*[F.lit(x[i]) if isinstance(x[i], str) else x[i] for x in tests]), first) for i in (1, 2))
        other = self.replacement(v, t)
        good = F.when(first.isNull(), value)
        good = good if other is None else good.otherwise(other)
        return Outcome(good, F.when(first.isNotNull(), F.array(issue(path, code, message, self.name, shown(v, t)))).otherwise(no_issues()), new)

    def column(self, df: DataFrame, state: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        """df with a column for the state after this step, that column, and the value's type."""
        s = F.col(state)
        if not self._judges(t):
            o, name = self.compile(s["value"], t, s["path"]), fresh()
            return df.withColumn(name, advance(s, o, t)), name, o.dtype
        v, got, first = s["value"], s["value"], None
        for i, f in enumerate(self.stages(t)):
            name = fresh()
            df, got = df.withColumn(name, f(got if i else F.when(F.size(s["issues"]) == 0, v))), F.col(name)
        tests, value, new = self.judge(v, t, got)
        if tests:
            name = fresh()
            df, first = df.withColumn(name, F.when(F.size(s["issues"]) == 0, first_fault(tests))), F.col(name)
        o = self.outcome(tests, value, new, v, t, s["path"], first)
        name = fresh()
        return df.withColumn(name, advance(s, o, t)), name, o.dtype

    def element(self, states: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        """An array of states after this step, for use inside expressions."""
        kept: list[T.DataType] = []
        stages = self.stages(t)
        if not stages:

            def one(s: Column) -> Column:
                o = self.compile(s["value"], t, s["path"])
                kept.append(o.dtype)
                return advance(s, o, t)

            out = F.transform(states, one)
            return out, kept[0]
        pairs = F.transform(states, lambda s: F.struct(s.alias("s"), F.when(F.size(s["issues"]) == 0, s["value"]).alias("got")))
        for f in stages:
            pairs = F.transform(pairs, _on_got(f))

        def two(x: Column) -> Column:
            s = x["s"]
            o = self.outcome(*self.judge(s["value"], t, x["got"]), s["value"], t, s["path"])
            kept.append(o.dtype)
            return advance(s, o, t)

        out = F.transform(pairs, two)
        return out, kept[0]

    def elements(self, df: DataFrame, states: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        """As `column`, for a column that holds an array of states."""
        out, new = self.element(F.col(states), t)
        name = fresh()
        return df.withColumn(name, out), name, new


def fresh() -> str:
    return f"_tamis_{next(_numbers)}"


def advance(s: Column, o: Outcome, t: T.DataType) -> Column:
    """The next state: a value that already has issues keeps them, and stays if its type does."""
    ok = F.size(s["issues"]) == 0
    same = s["value"] if o.dtype == t else F.lit(None).cast(o.dtype)
    return F.struct(s["path"].alias("path"), F.when(ok, o.value).otherwise(same).alias("value"), F.when(ok, o.issues).otherwise(s["issues"]).alias("issues"))


def start(v: Column, path: Column) -> Column:
    return F.struct(path.cast("string").alias("path"), v.alias("value"), no_issues().alias("issues"))


def _on_got(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(x["s"].alias("s"), f(x["got"]).alias("got"))


def first_fault(tests: list) -> Column:
    """The number of the first test that finds fault, from 0; null if none does."""
    out = F.when(tests[0][0], 0)
    for i, (bad, _, _) in enumerate(tests[1:], 1):
        out = out.when(bad, i)
    return out


class Called(Step):
    """A step of which a part runs in Python, by batches: `native` first, then `python` on rows that `needs` it."""

    result: T.DataType = T.StringType()

    def needs(self, v: Column, t: T.DataType) -> Column:
        """The value to hand to Python, null where Python isn't needed."""
        raise NotImplementedError

    def finish(self, v: Column, t: T.DataType, got: Column, path: Column) -> Outcome:
        """The outcome, given struct<value, code> of Python (null where it wasn't asked)."""
        raise NotImplementedError

    def _schema(self) -> str:
        return f"struct<value:{ddl(self.result)},code:string>"

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        raise TypeError(f"{self.name} needs Python here, which can't run this deep inside collections; apply it to the column, or one level in")

    def column(self, df: DataFrame, state: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        call = self.python
        s, got, name = F.col(state), fresh(), fresh()

        @F.pandas_udf(self._schema())
        def run(x: pd.Series) -> pd.DataFrame:
            out = [(None, None) if v is None else call(v) for v in x]
            return pd.DataFrame({"value": pd.Series([o[0] for o in out], dtype=object), "code": pd.Series([o[1] for o in out], dtype=object)})

        df = df.withColumn(got, run(F.when(F.size(s["issues"]) == 0, self.needs(s["value"], t))))
        o = self.finish(s["value"], t, F.col(got), s["path"])
        return df.withColumn(name, advance(s, o, t)), name, o.dtype

    def elements(self, df: DataFrame, states: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        call = self.python
        got, name = fresh(), fresh()

        @F.pandas_udf(f"array<{self._schema()}>")
        def run(x: pd.Series) -> pd.Series:
            one = lambda v: dict(zip(("value", "code"), (None, None) if v is None else call(v), strict=True))
            return x.map(lambda a: None if a is None else [one(v) for v in a])

        df = df.withColumn(got, run(F.transform(F.col(states), lambda s: F.when(F.size(s["issues"]) == 0, self.needs(s["value"], t)))))
        kept: list[T.DataType] = []

        def join(s: Column, g: Column) -> Column:
            o = self.finish(s["value"], t, g, s["path"])
            kept.append(o.dtype)
            return advance(s, o, t)

        out = F.zip_with(F.col(states), F.col(got), join)
        return df.withColumn(name, out), name, kept[0]


class Chain(Step):
    """Steps in order, up to the first that finds fault. `|` gives a new chain and leaves its operands as they are."""

    def __init__(self, *steps: object):
        self.steps = tuple(s for s in map(to_step, steps) if not (isinstance(s, Chain) and not s.steps))

    def __or__(self, other: object) -> Chain:
        return Chain(*self.steps, other)

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        states = F.array(start(v, path))
        states, t = self.element(states, t)
        s = F.get(states, F.lit(0))
        return Outcome(s["value"], s["issues"], t)

    def column(self, df: DataFrame, state: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        for step in self.steps:
            df, state, t = step.column(df, state, t)
        return df, state, t

    def element(self, states: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        for step in self.steps:
            states, t = step.element(states, t)
        return states, t

    def elements(self, df: DataFrame, states: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        for step in self.steps:
            df, states, t = step.elements(df, states, t)
        return df, states, t


def to_step(x: object) -> Step:
    """A step from a step, a step's class or another function without arguments that gives one, or None (no step)."""
    if x is None:
        return Chain()
    if isinstance(x, Step):
        return x
    if callable(x):
        made = x()
        if isinstance(made, Step) or made is None:
            return to_step(made)
    raise TypeError(f"{x!r} is not a step, nor a function without arguments that gives one")
