"""Reading inputs and writing what comes of them: plain Spark readers and writers, with the bad rows beside the good."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tamis.plans.runner import Log, Runner, named


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options: object) -> DataFrame:
    """Any format that Spark reads. Give text formats a schema: Spark reads them twice to guess one."""
    reader = spark.read.format(form).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def split(runner: Runner) -> tuple[DataFrame, DataFrame]:
    """Good rows with the cleaned value in the column's place, and a row for each issue of the others."""
    good = runner.valid().select(*[named(runner.names[0]).alias(c) if c == runner.column else named(c) for c in runner.df.columns])
    return good, runner.errors()


def write(runner: Runner, good: str, bad: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Good rows and issues to two tables."""
    rows, issues = split(runner)
    rows.write.format(form).mode(mode).save(good)
    issues.write.format(form).mode(mode).save(bad)


def log(runner: Runner, logger: logging.Logger, level: int = logging.ERROR, most: int = 1000) -> DataFrame:
    """Tell a logger what a runner found, and go on with all rows; see Log."""
    return Log(logger, level, most).table(runner.collect(), runner)
