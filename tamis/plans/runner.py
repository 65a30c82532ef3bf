"""Running a step over a column, and what becomes of the issues: kept beside the values, raised, logged, or handed on."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import ISSUES, Step, fresh, start, to_step


class Invalid(ValueError):
    """Raised on the driver when a strict run met a bad value; `context` holds what Spark said."""

    def __init__(self, message: str, context: dict | None = None):
        super().__init__(message)
        self.context = context or {}


class Handler:
    """What becomes of issues. This one keeps them beside the values. Subclasses override `value`, which makes the cleaned
    column, or `table`, which gets all rows with their issues before anyone else does."""

    def value(self, value: Column, issues: Column, t: T.DataType) -> Column:
        return value

    def table(self, out: DataFrame, runner: Runner) -> DataFrame:
        return out


class Strict(Handler):
    """The first bad value that Spark meets stops the job. The error belongs to the value, so that it can't be pruned while
    the value is wanted."""

    def value(self, value: Column, issues: Column, t: T.DataType) -> Column:
        first = F.get(issues, F.lit(0))
        error = F.raise_error(F.concat_ws(" ", F.lit("invalid value:"), first["path"], first["code"], first["message"]))
        return F.when(F.size(issues) > 0, error.cast(t)).otherwise(value)


class Log(Handler):
    """Tells a logger of the driver how often each code was found where, at most `most` lines, commonest first, then goes on
    with all rows. Single issues belong in a table: see Sink."""

    def __init__(self, logger: logging.Logger | None = None, level: int = logging.ERROR, most: int = 1000):
        self.logger, self.level, self.most = logger or logging.getLogger(__name__), level, most

    def table(self, out: DataFrame, runner: Runner) -> DataFrame:
        for r in runner.counted(out).orderBy(F.desc("n"), "path", "code").limit(self.most).collect():
            self.logger.log(self.level, "%s: %s (%d times)", r["path"] or "value", r["code"], r["n"])
        return out


class Sink(Handler):
    """Hands a table with a row for each issue to a function, such as a writer of one's own, then goes on with all rows."""

    def __init__(self, put: Callable[[DataFrame], object]):
        self.put = put

    def table(self, out: DataFrame, runner: Runner) -> DataFrame:
        self.put(runner.exploded(out))
        return out


POLICIES: dict[str, type[Handler]] = {"collect": Handler, "strict": Strict, "log": Log}


def named(column: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def free(name: str, taken: Iterable[str]) -> str:
    """The name, with as many underscores behind it as it takes to be no other column's."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name


class Runner:
    """A step over one column of a DataFrame. The plan is made once, on first use; data is read when Spark is asked.

    policy: collect, strict, log, or a Handler. Where the input has columns of the names that are added, those added get an
    underscore; `names` holds them: the cleaned value, array<issue>, and is_valid.
    """

    def __init__(self, step: object, df: DataFrame, column: str, *, policy: str | Handler | type[Handler] = "collect", cleaned: str = "cleaned", issues: str = "issues", is_valid: str = "is_valid"):
        handler = POLICIES.get(policy, policy) if isinstance(policy, str) else policy
        handler = handler() if isinstance(handler, type) else handler
        if not isinstance(handler, Handler):
            raise ValueError(f"policy is one of {', '.join(POLICIES)}, or a Handler")
        self.step, self.df, self.column, self.handler = to_step(step), df, column, handler
        self.names: tuple[str, ...] = ()
        for name in (cleaned, issues, is_valid):
            self.names = (*self.names, free(name, (*df.columns, *self.names)))
        self._out: DataFrame | None = None

    def _own(self) -> list[Column]:
        return [named(c) for c in self.df.columns]

    def collect(self) -> DataFrame:
        """All rows and columns, with the cleaned value, array<issue> and is_valid."""
        if self._out is None:
            t, v = self.df.schema[self.column].dataType, named(self.column)
            if isinstance(t, T.NullType):
                t, v = T.StringType(), v.cast("string")
            first = fresh()
            df, state, new = self.step.column(self.df.withColumn(first, start(v, F.lit(""))), first, t)
            s = F.col(state)
            cleaned, issues, ok = self.names
            value = self.handler.value(s["value"], s["issues"], df.schema[state].dataType["value"].dataType)
            # made by a generator, so that conditions on them, unlike those on other columns, aren't pushed below the steps:
            # there each step would be written out, and run, once more for every mention of the one before
            made = F.struct(value.alias(cleaned), s["issues"].cast(ISSUES).alias(issues), (F.size(s["issues"]) == 0).alias(ok))
            out = df.select(*self._own(), F.inline(F.array(made)))
            self._out = self.handler.table(out, self)
        return self._out

    def valid(self) -> DataFrame:
        return self.collect().where(named(self.names[2]))

    def invalid(self) -> DataFrame:
        return self.collect().where(~named(self.names[2]))

    def exploded(self, out: DataFrame, with_context: bool = True) -> DataFrame:
        """A row for each issue of collected rows."""
        parts = ["path", "code", "message", *(["step", "value"] if with_context else [])]
        one = free("_issue", self.df.columns)
        rows = out.select(*self._own(), F.explode(named(self.names[1])).alias(one))
        return rows.select(*self._own(), *[named(one)[p].alias(free(p, self.df.columns)) for p in parts])

    def counted(self, out: DataFrame) -> DataFrame:
        one = out.select(F.explode(named(self.names[1])).alias("i"))
        return one.groupBy(F.col("i.path").alias("path"), F.col("i.code").alias("code")).agg(F.count("*").alias("n"))

    def errors(self, with_context: bool = True) -> DataFrame:
        """A row for each issue, with the columns of the input: path, code, message and, with context, step and value. Where
        the input has such a column, that of the issue gets an underscore."""
        return self.exploded(self.collect(), with_context)

    def exceptions(self) -> DataFrame:
        """The errors of values that a step could not work on, as opposed to values that it found wrong."""
        code = free("code", self.df.columns)
        return self.errors().where(named(code) == "exception")

    def error_codes(self) -> DataFrame:
        """Rows with codes, a map from path to the codes at it."""
        i = named(self.names[1])
        paths = F.array_distinct(F.transform(i, lambda x: x["path"]))
        codes = F.map_from_arrays(paths, F.transform(paths, lambda p: F.transform(F.filter(i, lambda x: x["path"] == p), lambda x: x["code"])))
        return self.collect().withColumn(free("codes", (*self.df.columns, *self.names)), codes)

    def report(self) -> DataFrame:
        """How often each code was found at each path."""
        return self.counted(self.collect())


def apply(df: DataFrame, column: str, step: object, **how) -> DataFrame:
    """df with cleaned, issues and is_valid for a column; see Runner."""
    return Runner(step, df, column, **how).collect()


def check(step: object, df: DataFrame, column: str) -> list:
    """All cleaned values of a strict run, on the driver; the first bad value raises Invalid. For small data and tests."""
    from pyspark.errors import PySparkException

    r = Runner(step, df, column, policy="strict")
    try:
        return [row[0] for row in r.collect().select(named(r.names[0])).collect()]
    except PySparkException as e:
        if "invalid value:" in str(e):
            raise Invalid(str(e).split("invalid value:", 1)[1].split("\n", 1)[0].strip(), {"cause": type(e).__name__}) from e
        raise


def assert_step(step: Step, df: DataFrame, column: str, expected: str, codes: str) -> None:
    """For tests of steps: `expected` and `codes` (array of path:code) are columns of df to compare with."""
    r = Runner(step, df, column)
    cleaned, issues, _ = r.names
    got = F.transform(named(issues), lambda i: F.concat(i["path"], F.lit(":"), i["code"]))
    bad = r.collect().withColumn("_codes", got).where(~(named(cleaned).eqNullSafe(named(expected)) & F.col("_codes").eqNullSafe(named(codes))))
    rows = bad.select(named(column), named(cleaned), named(expected), "_codes", named(codes)).limit(20).collect()
    assert not rows, "\n".join(map(str, rows))
