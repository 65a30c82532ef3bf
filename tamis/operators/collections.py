"""Steps over the elements of arrays and maps and over the fields of structs, maps and JSON objects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.native import kind_of
from tamis.plans.core import Called, Chain, Outcome, Step, advance, below, fresh, issue, no_issues, shown, start, to_step


def _has_python(step: Step) -> bool:
    if isinstance(step, Chain):
        return any(map(_has_python, step.steps))
    if isinstance(step, Each):
        return _has_python(step.step)
    if isinstance(step, Fields):
        return any(map(_has_python, step.steps.values()))
    return isinstance(step, Called)


def key_text(key: Column) -> Column:
    """A key as part of a path."""
    return key.cast("string")


def _entries(v: Column, t: T.DataType) -> tuple[Column, T.DataType] | None:
    """A map's, struct's or object's entries as map<string, X>; None if the type has none."""
    if isinstance(t, T.MapType):
        return (v if isinstance(t.keyType, T.StringType) else F.transform_keys(v, lambda k, _: k.cast("string"))), t.valueType
    if isinstance(t, T.VariantType):
        return F.when(kind_of(v).rlike("^OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")), T.VariantType()
    return None


class Each(Step):
    """A step for each element of an array (also of text, taken as characters) or each value of a map.

    All elements are seen to, and all their issues kept, under the element's index or key. only limits the indexes or keys:
    at others `unexpected` is reported, an array's slot becomes null and a map's entry goes. A variant is taken as an array,
    or with of="map" as an object. Override `item` to change what happens to single elements.
    """

    def __init__(self, step: object, only: Iterable | None = None, of: str = "array"):
        if of not in ("array", "map"):
            raise ValueError("of is array or map")
        self.step, self.only, self.of = to_step(step), None if only is None else list(only), of

    @property
    def name(self) -> str:
        return "Each"

    def item(self) -> Step:
        """The step for an element."""
        return self.step

    def _mapped(self, t: T.DataType) -> bool:
        return isinstance(t, (T.MapType, T.StructType)) or isinstance(t, T.VariantType) and self.of == "map"

    def _array(self, v: Column, t: T.DataType) -> tuple[Column, T.DataType] | None:
        if isinstance(t, T.ArrayType):
            return v, t.elementType
        if isinstance(t, T.StringType):
            return F.when(v == "", F.array().cast("array<string>")).otherwise(F.split(v, "", -1)), T.StringType()
        if isinstance(t, T.VariantType):
            return F.when(kind_of(v).rlike("^ARRAY"), F.try_variant_get(v, "$", "array<variant>")), T.VariantType()
        return None

    def _allowed(self, key: Column) -> Column:
        return F.lit(True) if self.only is None else key.isin(*self.only) if self.only else F.lit(False)

    def _unexpected(self, path: Column, value: Column) -> Column:
        return issue(path, "unexpected", F.concat(F.lit("is not expected: "), path), self.name, value)

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        if self._mapped(t):
            states, e, over = self._map_states(v, t, path)
            states, new = self.item().element(states, e)
            return self._map_out(v, t, states, over, new, path)
        array = self._array(v, t)
        if array is None:
            return self._wrong(v, t, path)
        states, new = self.item().element(self._array_states(*array, path), array[1])
        return self._array_out(v, t, array, states, new, path)

    def _array_states(self, v: Column, e: T.DataType, path: Column) -> Column:
        return F.transform(v, lambda x, i: start(F.when(self._allowed(i), x), below(path, i)))

    def _array_out(self, v: Column, t: T.DataType, array: tuple, states: Column, new: T.DataType, path: Column) -> Outcome:
        issues = F.flatten(F.transform(states, lambda s: s["issues"]))
        if self.only is not None:
            over = F.filter(F.transform(array[0], lambda x, i: F.when(~self._allowed(i), self._unexpected(below(path, i), shown(x, array[1])))), lambda x: x.isNotNull())
            # where an index isn't allowed, what the step says of the null in its place doesn't count
            issues = F.concat(F.flatten(F.transform(states, lambda s, i: F.when(self._allowed(i), s["issues"]).otherwise(no_issues()))), over)
            issues = F.array_sort(issues, self._by_index)
        wrong = F.lit(False) if not isinstance(t, T.VariantType) else v.isNotNull() & ~kind_of(v).rlike("^(ARRAY|VOID)")
        issues = F.when(wrong, F.array(issue(path, "wrong_type", "is no sequence", self.name, shown(v, t)))).otherwise(F.coalesce(issues, no_issues()))
        return Outcome(F.transform(states, lambda s: s["value"]), issues, T.ArrayType(new))

    @staticmethod
    def _by_index(a: Column, b: Column) -> Column:
        last = lambda x: F.coalesce(F.regexp_extract(x["path"], r"(\d+)$", 1).try_cast("int"), F.lit(0))
        return (last(a) - last(b)).cast("int")

    def _map_states(self, v: Column, t: T.DataType, path: Column) -> tuple[Column, T.DataType, Column]:
        """States in order of the entries, with the key at the path's end; the issues of keys that aren't allowed."""
        if isinstance(t, T.StructType):
            kinds = {f.dataType.simpleString() for f in t}
            if len(kinds) > 1:
                raise TypeError("Each over a struct needs fields of one type")
            v, e = F.when(v.isNotNull(), F.create_map(*[x for f in t for x in (F.lit(f.name), v[f.name])])), t[0].dataType
        else:
            v, e = _entries(v, t)
        over = F.transform(F.map_entries(F.map_filter(v, lambda k, _: ~self._allowed(k))), lambda x: self._unexpected(below(path, key_text(x["key"])), shown(x["value"], e)))
        states = F.transform(F.map_entries(F.map_filter(v, lambda k, _: self._allowed(k))), lambda x: start(x["value"], below(path, key_text(x["key"]))))
        return states, e, over

    def _map_out(self, v: Column, t: T.DataType, states: Column, over: Column, new: T.DataType, path: Column) -> Outcome:
        value = F.map_from_arrays(F.transform(states, lambda s: F.substring(s["path"], F.char_length(path) + F.when(path == "", 1).otherwise(2), F.char_length(s["path"]))), F.transform(states, lambda s: s["value"]))
        issues = F.coalesce(F.concat(F.flatten(F.transform(states, lambda s: s["issues"])), over), no_issues())
        if isinstance(t, T.VariantType):
            issues = F.when(v.isNotNull() & ~kind_of(v).rlike("^(OBJECT|VOID)"), F.array(issue(path, "wrong_type", "is no mapping", self.name, shown(v, t)))).otherwise(issues)
        return Outcome(value, issues, T.MapType(T.StringType(), new))

    def _wrong(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        return Outcome(F.lit(None).cast(t), F.when(v.isNotNull(), F.array(issue(path, "wrong_type", "has no elements", self.name, shown(v, t)))).otherwise(no_issues()), t)

    def column(self, df: DataFrame, state: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        """On a column the steps for elements follow each other column by column, and may run in Python."""
        s = F.col(state)
        v, path = F.when(F.size(s["issues"]) == 0, s["value"]), s["path"]
        name, first = fresh(), fresh()
        if self._mapped(t):
            states, e, over = self._map_states(v, t, path)
            df, last, new = self.item().elements(df.withColumn(first, states), first, e)
            o = self._map_out(v, t, F.col(last), over, new, path)
        elif (array := self._array(v, t)) is not None:
            df, last, new = self.item().elements(df.withColumn(first, self._array_states(*array, path)), first, array[1])
            o = self._array_out(v, t, array, F.col(last), new, path)
        else:
            o = self._wrong(v, t, path)
        return df.withColumn(name, advance(s, o, t)), name, o.dtype

    def elements(self, df: DataFrame, states: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        if _has_python(self):
            raise TypeError("a step that needs Python can't be two collections deep")
        return super().elements(df, states, t)


class Fields(Step):
    """A step for each declared key of a map, struct, or JSON object; the result is a struct.

    Declared keys come first, in order, then, if allowed, extra keys in a map `extra`, sorted. A missing key counts as
    null, or is `missing`; an extra one passes, or is `unexpected` and goes. Each policy is true, false, or the keys that
    may be missing or extra. None in place of a step leaves the value as it is. A struct's extra fields keep their names.
    """

    def __init__(self, steps: dict[str, object], allow_missing_keys: bool | Iterable[str] = True, allow_extra_keys: bool | Iterable[str] = True, extra: str = "extra"):
        if isinstance(allow_missing_keys, str) or isinstance(allow_extra_keys, str):
            raise TypeError("a policy is true, false, or a list of keys")
        self.steps = {k: to_step(s) for k, s in steps.items()}
        listed = lambda x: x if isinstance(x, bool) else list(x)
        self.missing, self.extras, self.extra = listed(allow_missing_keys), listed(allow_extra_keys), extra

    def item(self, key: str) -> Step:
        """The step for a key."""
        return self.steps[key]

    def _may(self, policy: bool | list[str], key: str) -> bool:
        return policy if isinstance(policy, bool) else key in policy

    def _source(self, v: Column, t: T.DataType) -> tuple[Column, T.DataType] | None:
        if isinstance(t, T.StructType):
            return v, t
        if isinstance(t, T.StringType):
            return None
        return _entries(v, t)

    def _value(self, source: Column, t: T.DataType, key: str) -> tuple[Column, T.DataType, Column]:
        """A key's value, its type, and whether it is there."""
        if isinstance(t, T.StructType):
            if key in t.names:
                return source[key], t[key].dataType, F.lit(True)
            return F.lit(None).cast("string"), T.StringType(), F.lit(False)
        return F.try_element_at(source, F.lit(key)), t, F.map_contains_key(source, F.lit(key))

    def _key(self, key: str, source: Column, t: T.DataType, path: Column) -> tuple[Column, T.DataType, Column]:
        """A key's first state; a key that must be there and isn't has the issue `missing` from the start."""
        value, kind, there = self._value(source, t, key)
        if isinstance(kind, T.VariantType):
            value = F.when(~F.is_variant_null(value), value)
        at = below(path, F.lit(key))
        first = start(value, at)
        if not self._may(self.missing, key):
            gone = source.isNotNull() & ~there
            first = F.struct(at.alias("path"), value.alias("value"), F.when(gone, F.array(issue(at, "missing", F.concat(F.lit("is missing: "), at), "Fields", F.lit(None).cast("string")))).otherwise(no_issues()).alias("issues"))
        return first, kind, there

    def _rest(self, source: Column, t: T.DataType, path: Column) -> tuple[list[Column], list[T.StructField], Column]:
        """The extra keys' columns, their fields, and the issues of those that aren't allowed."""
        declared = list(self.steps)
        if isinstance(t, T.StructType):
            more = sorted(n for n in t.names if n not in declared)
            stay = [n for n in more if self._may(self.extras, n)]
            go = [issue(below(path, F.lit(n)), "unexpected", f"is not expected: {n}", "Fields", shown(source[n], t[n].dataType)) for n in more if n not in stay]
            return [source[n].alias(n) for n in stay], [T.StructField(n, t[n].dataType) for n in stay], F.when(source.isNotNull(), F.array(*go)).otherwise(no_issues()) if go else no_issues()
        rest = F.map_filter(source, lambda k, _: ~k.isin(*declared)) if declared else source
        keys = F.array_sort(F.map_keys(rest))
        allowed = (lambda k: F.lit(self.extras)) if isinstance(self.extras, bool) else (lambda k: k.isin(*self.extras) if self.extras else F.lit(False))
        stay = F.filter(keys, lambda k: allowed(k))
        kept = F.map_from_arrays(stay, F.transform(stay, lambda k: F.element_at(rest, k)))
        go = F.transform(F.filter(keys, lambda k: ~allowed(k)), lambda k: issue(below(path, k), "unexpected", F.concat(F.lit("is not expected: "), k), "Fields", shown(F.element_at(rest, k), t)))
        if self.extras is False:
            return [], [], go
        return [kept.alias(self.extra)], [T.StructField(self.extra, T.MapType(T.StringType(), t))], go

    def _out(self, v: Column, t: T.DataType, source: Column, inner: T.DataType, done: list[tuple[str, Column, T.DataType]], path: Column) -> Outcome:
        more, fields, over = self._rest(source, inner, path)
        value = F.when(source.isNotNull(), F.struct(*[s["value"].alias(k) for k, s, _ in done], *more))
        issues = F.when(source.isNotNull(), F.concat(*[s["issues"] for _, s, _ in done], F.coalesce(over, no_issues()))).otherwise(no_issues())
        if isinstance(t, T.VariantType):
            wrong = v.isNotNull() & ~kind_of(v).rlike("^(OBJECT|VOID)")
            issues = F.when(wrong, F.array(issue(path, "wrong_type", "is no mapping", "Fields", shown(v, t)))).otherwise(issues)
        return Outcome(value, issues, T.StructType([T.StructField(k, d) for k, _, d in done] + fields))

    def _wrong(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        new = T.StructType([T.StructField(k, T.StringType()) for k in self.steps])
        return Outcome(F.lit(None).cast(new), F.when(v.isNotNull(), F.array(issue(path, "wrong_type", "is no mapping", "Fields", shown(v, t)))).otherwise(no_issues()), new)

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        got = self._source(v, t)
        if got is None:
            return self._wrong(v, t, path)
        source, inner = got
        done = []
        for k in self.steps:
            first, kind, _ = self._key(k, source, inner, path)
            states, new = self.item(k).element(F.array(first), kind)
            done.append((k, F.get(states, F.lit(0)), new))
        return self._out(v, t, source, inner, done, path)

    def column(self, df: DataFrame, state: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        s = F.col(state)
        v, path = F.when(F.size(s["issues"]) == 0, s["value"]), s["path"]
        name = fresh()
        got = self._source(v, t)
        if got is None:
            o = self._wrong(v, t, path)
            return df.withColumn(name, advance(s, o, t)), name, o.dtype
        held = fresh()
        df = df.withColumn(held, got[0])
        source, inner = F.col(held), got[1]
        done = []
        for k in self.steps:
            first, kind, _ = self._key(k, source, inner, path)
            at = fresh()
            df, last, new = self.item(k).column(df.withColumn(at, first), at, kind)
            done.append((k, F.col(last), new))
        o = self._out(v, t, source, inner, done, path)
        return df.withColumn(name, advance(s, o, t)), name, o.dtype

    def elements(self, df: DataFrame, states: str, t: T.DataType) -> tuple[DataFrame, str, T.DataType]:
        if _has_python(self):
            raise TypeError("a step that needs Python can't be two collections deep")
        return super().elements(df, states, t)

    def rows(self, df: DataFrame, v: Column, t: T.DataType, own: list[Column]) -> DataFrame:
        """For `iterate`: a row for each declared key, then for each extra one that is allowed."""
        got = self._source(v, t)
        if got is None:
            raise TypeError(f"a {t.simpleString()} has no keys")
        held, all_ = fresh(), fresh()
        df = df.withColumn(held, got[0])
        source, inner = F.col(held), got[1]
        parts = []
        row = lambda k, value, kind, issues: F.struct(k.alias("key"), _variant(value, kind).alias("value"), issues.alias("issues"))
        for k in self.steps:
            first, kind, _ = self._key(k, source, inner, F.lit(""))
            at = fresh()
            df, last, new = self.item(k).column(df.withColumn(at, first), at, kind)
            parts.append(F.array(row(F.lit(k), F.col(last)["value"], new, F.col(last)["issues"])))
        more, fields, _ = self._rest(source, inner, F.lit(""))
        for c, f in zip(more, fields, strict=True):
            if isinstance(inner, T.StructType):
                parts.append(F.array(row(F.lit(f.name), c, f.dataType, no_issues())))
            else:
                parts.append(F.transform(F.map_entries(c), lambda x: row(x["key"], x["value"], inner, no_issues())))
        out = df.where(source.isNotNull()).withColumn(all_, F.explode(F.concat(*parts)))
        return out.select(*own, F.col(all_)["key"].alias("key"), F.col(all_)["value"].alias("value"), F.col(all_)["issues"].alias("issues"))


def _variant(v: Column, t: T.DataType) -> Column:
    """Any value as a variant."""
    if isinstance(t, T.VariantType):
        return v
    return F.variant_get(F.to_variant_object(F.struct(v.alias("v"))), "$.v", "variant")


def iterate(df: DataFrame, column: str, step: object) -> DataFrame:
    """The lazy form of Each and Fields: a row for each element, with the columns of df, its place, value and issues.

    An array's elements come with pos, from 0; the entries of a map, and of a variant taken as an object, with key. With a
    Fields step, of a map, struct or variant: key, in the order of Fields, value as variant and issues; keys that aren't
    allowed have no row, those that must be there and aren't a null with the issue `missing`. A null has no rows.
    """
    t = df.schema[column].dataType
    own = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
    v = F.col("`" + column.replace("`", "``") + "`")
    step = to_step(step)
    if isinstance(step, Fields):
        return step.rows(df, v, t, own)
    first, one = fresh(), fresh()
    array = Each(None)._array(v, t)
    if array is not None and not (isinstance(t, T.VariantType) and isinstance(step, Each) and step.of == "map"):
        place, e = "pos", array[1]
        out = df.select(*own, F.posexplode(array[0]).alias(place, one))
        at = F.col(place).cast("string")
    else:
        entries = _entries(v, t)
        if entries is None:
            raise TypeError(f"a {t.simpleString()} has no elements of one type; give Fields")
        place, e = "key", entries[1]
        out = df.select(*own, F.explode(entries[0]).alias(place, one))
        at = F.col(place)
    inner = step.item() if isinstance(step, Each) else step
    out, last, _ = inner.column(out.withColumn(first, start(F.col(one), at)), first, e)
    return out.select(*own, place, F.col(last)["value"].alias("value"), F.col(last)["issues"].alias("issues"))


__all__ = ["Each", "Fields", "iterate", "key_text"]
