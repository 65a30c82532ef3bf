"""A step that looks a value up in another DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.plans.core import Outcome, Step, advance, fresh, issue, no_issues, shown

UNORDERED = (T.MapType, T.VariantType)


def _orderly(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderly(f.dataType) for f in t)
    return _orderly(t.elementType) if isinstance(t, T.ArrayType) else not isinstance(t, UNORDERED)


class Lookup(Step):
    """The row of a table whose `field` equals the value, as a struct; without one the value is `not_found`.

    Works on a column, not inside collections: it is a join. How it is made is left to Spark, which knows at run time how
    many bytes the table's rows have and broadcasts them only if they are few. A key should not occur more than once: of
    several rows the first by its columns is taken, by those that have an order, then by the others as JSON.
    """

    def __init__(self, table: DataFrame, field: str, where: Column | str | None = None):
        self.table, self.field = table if where is None else table.where(where), field

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        raise TypeError("Lookup is a join and can't run inside collections")

    def column(self, df: DataFrame, state: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        key, row, name = fresh(), fresh(), fresh()
        fields = {f.name: F.col("`" + f.name.replace("`", "``") + "`") for f in self.table.schema}
        plain = [f.name for f in self.table.schema if _orderly(f.dataType)]
        whole = F.struct(*fields.values())
        if len(plain) == len(fields):
            first = F.min(whole)
        else:
            rest = F.to_json(F.struct(*[c for n, c in fields.items() if n not in plain]))
            first = F.min_by(whole, F.struct(*[fields[n] for n in plain], rest))
        rows = self.table.where(fields[self.field].isNotNull()).groupBy(fields[self.field].alias(key)).agg(first.alias(row))
        s = F.col(state)
        df = df.join(rows, s["value"] == F.col(key), "left")
        new = T.StructType([T.StructField(f.name, f.dataType) for f in self.table.schema])
        code = F.when(s["value"].isNotNull() & F.col(row).isNull(), "not_found")
        o = Outcome(F.col(row), F.when(code.isNotNull(), F.array(issue(s["path"], code, f"has no row by {self.field}", self.name, shown(s["value"], t)))).otherwise(no_issues()), new)
        return df.withColumn(name, advance(s, o, t)), name, new
