"""A query for each operator over the supplied tables, and the same in SQL.

The tables are mostly clean, so bad values are put in by expressions that both engines read alike. Most queries give
(id, cleaned, codes): the cleaned value as text and its issues as path:code, joined by commas.
"""

from __future__ import annotations

import logging
import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.macros import Macro, Registry, is_step, macro, steps_in
from tamis.operators import Array, Base64Decode, ByteArray, ByteString, CaseFold, Choice, Date, Datetime, Decimal, Each, Empty, Fields, Int, IpAddress, JsonDecode, Length, Lookup, Max, MaxBytes, MaxLength, Min, MinLength, NoOp, NotEmpty, Optional, Regex, Required, Round, Split, Strip, Type, Unicode, Uuid, iterate
from tamis.plans.core import Called, Outcome, Step
from tamis.plans.runner import Handler, Invalid, Log, Runner, Sink, apply, assert_step, check
from tamis.sources.tables import log, read, split
from tamis.streaming.quarantine import clean


@dataclass(frozen=True)
class Case:
    """x: the value, in SQL of both engines, over table; step: made when asked; out: cleaned as text, for Spark; value and
    codes: the same from x, for DuckDB."""

    table: str
    key: str
    x: str
    step: Callable
    out: str
    value: str
    codes: str = "''"
    duck: str | None = None  # x for DuckDB, where it must be written in another way

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, f"{sf_dir}/{self.table}.parquet").selectExpr(f"{self.key} AS id", f"{self.x} AS x")
        codes = F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",")
        return apply(rows, "x", self.step()).withColumn("codes", codes).selectExpr("id", f"{self.out} AS cleaned", "codes")

    def sql(self) -> str:
        return f"SELECT id, {self.value} AS cleaned, {self.codes} AS codes FROM (SELECT {self.key} AS id, {self.duck or self.x} AS x FROM {self.table}) t"


@macro
def code_of(n: int):
    """Text of n characters at most that is there."""
    return Required | MaxLength(n)


class Even(Step):
    """A step of one's own, from columns: the value is even."""

    def tests(self, v: Column, t: T.DataType) -> list:
        return [(v.try_cast("long") % 2 != 0 if isinstance(t, T.NumericType) else v.isNotNull(), "odd", "is odd")]


class Backwards(Called):
    """A step of one's own, in Python: text of n characters at least, from its end."""

    def __init__(self, n: int):
        self.python = lambda text: (text[::-1], None) if len(text) >= n else (None, "short")

    def needs(self, v: Column, t: T.DataType) -> Column:
        return v

    def finish(self, v: Column, t: T.DataType, got: Column, path: Column) -> Outcome:
        return self.outcome([(got["code"].isNotNull(), "short", "is too short")], got["value"], T.StringType(), v, t, path)


class Shorter(Each):
    """Each element, whatever the step says, has four characters at most."""

    def item(self) -> Step:
        return super().item() | MaxLength(4)


class Strict(Fields):
    """One key has a step of its own beside that declared."""

    def item(self, key: str) -> Step:
        return super().item(key) | (MaxLength(6) if key == "priority" else None)


def _registry() -> Registry:
    known = Registry("tamis.steps")
    known.register("Code", code_of)
    known.register("Even", Even)
    return known


NUMBER = "decimal(28,6)"
BIG = "CASE c_custkey % 3 WHEN 1 THEN '1000000000000000' WHEN 2 THEN '99999999999999999999' ELSE '99999999999999999999.9999995' END"
LINE = "l_orderkey * 10 + l_linenumber"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
DIRTY_NUMBER = "CASE WHEN l_orderkey % 11 = 0 THEN 'NaN' WHEN l_orderkey % 13 = 0 THEN 'abc' WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN '-Infinity' ELSE CAST(CAST(l_extendedprice AS decimal(18,2)) AS {text}) END"
NUMBER_CODES = "CASE WHEN x IN ('NaN', '-Infinity') THEN ':not_finite' WHEN x = 'abc' THEN ':not_numeric' ELSE '' END"
PLAIN = "CASE WHEN {} THEN x END"
JSON = "CASE WHEN event_id % 7 = 0 THEN '{{\"k\": ' WHEN event_id % 5 = 0 THEN '{{\"z\": 1}}' WHEN event_id % 3 = 0 THEN '{{\"k\": \"a\", \"y\": 2}}' ELSE props END"


def _text(x: str) -> tuple[str, str]:
    return x.format(text="string"), x.format(text="varchar")


def _cases() -> dict[str, Case]:
    number, number_duck = _text(DIRTY_NUMBER)
    half, half_duck = _text("CASE WHEN l_orderkey % 11 = 0 THEN 'x' ELSE CAST(CAST(l_linenumber AS decimal(10,3)) / 8 AS {text}) END")
    whole, whole_duck = _text("CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_linenumber AS {text}) || '.00' WHEN l_orderkey % 5 = 0 THEN CAST(l_linenumber AS {text}) || '.5' WHEN l_orderkey % 7 = 0 THEN CAST(l_linenumber AS {text}) || 'E2' WHEN l_orderkey % 11 = 0 THEN 'n' ELSE CAST(l_linenumber AS {text}) END")
    dirty = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderpriority END"
    part = "CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END"
    padded = "CASE WHEN p_partkey % 3 = 0 THEN '  ' || p_name || chr(9) ELSE chr(10) || p_name || '   ' END"
    stamp = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
    stamped = "CASE WHEN event_id % 7 = 0 THEN 'soon' WHEN event_id % 3 = 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") || '-05:00' ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END"
    stamped_duck = f"CASE WHEN event_id % 7 = 0 THEN 'soon' WHEN event_id % 3 = 0 THEN {stamp} || '-05:00' ELSE {stamp} END"
    moment = "CASE WHEN x = 'soon' THEN NULL WHEN x LIKE '%-05:00' THEN CAST(substr(x, 1, 19) AS timestamp) + INTERVAL 5 HOUR ELSE CAST(x AS timestamp) - INTERVAL 8 HOUR END"
    hexes_duck = "CASE WHEN doc_id % 7 = 0 THEN 'urn:uuid:' || md5(text) WHEN doc_id % 5 = 0 THEN substr(md5(text), 2) WHEN doc_id % 3 = 0 THEN upper(md5(text)) ELSE '{' || md5(text) || '}' END"
    hexes = hexes_duck.replace("md5(text)", "md5(CAST(text AS binary))")
    bare = "replace(replace(replace(lower(x), 'urn:uuid:', ''), '{', ''), '}', '')"
    dashed = f"substr({bare}, 1, 8) || '-' || substr({bare}, 9, 4) || '-' || substr({bare}, 13, 4) || '-' || substr({bare}, 17, 4) || '-' || substr({bare}, 21)"
    address = "CAST({a} AS {text}) || '.' || CAST({b} AS {text}) || '.1.' || CAST(c_custkey % 260 AS {text})"
    address = _text(address.replace("{a}", "c_nationkey").replace("{b}", "(c_custkey % 300)"))
    json_, json_duck = JSON.format(), JSON.format()
    good = "(json_valid(x))"
    k = "json_extract_string(x, '$.k')"
    json_codes = f"CASE WHEN NOT {good} THEN ':not_json' ELSE concat_ws(',', CASE WHEN NOT json_exists(x, '$.k') THEN 'k:missing' WHEN try_cast({k} AS integer) IS NULL THEN 'k:not_numeric' WHEN try_cast({k} AS integer) < 10 THEN 'k:too_small' END, CASE WHEN json_exists(x, '$.y') THEN 'y:unexpected' END, CASE WHEN json_exists(x, '$.z') THEN 'z:unexpected' END) END"
    text = "doc_id"
    b64 = "CASE WHEN doc_id % 5 = 0 THEN CAST('+-' || base64(CAST(text AS binary)) AS binary) ELSE CAST(replace(base64(CAST(text AS binary)), '=', '') AS binary) END"
    mixed = "CASE p_partkey % 4 WHEN 0 THEN '\"' || p_name || '\"' WHEN 1 THEN CAST(p_size AS string) WHEN 2 THEN '[1]' END"
    messy = "CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', chr({zw}) || chr(13) || chr(10)) ELSE 'e' || chr({acute}) || text END"
    return {
        "ref_required": Case("orders", "o_orderkey", dirty, lambda: Required, "cleaned", "nullif(x, '')", "CASE WHEN x IS NULL OR x = '' THEN ':empty' ELSE '' END"),
        "ref_decimal": Case("lineitem", LINE, number, lambda: Decimal, f"cast(cast(cleaned as {NUMBER}) as string)", f"CAST(CASE WHEN {NUMBER_CODES} = '' THEN CAST(x AS {NUMBER}) END AS varchar)", NUMBER_CODES, number_duck),
        "ref_max_precision": Case("lineitem", LINE, half, lambda: Decimal(2), f"cast(cast(cleaned as {NUMBER}) as string)", f"CAST(CASE WHEN x <> 'x' THEN CAST(round_even(CAST(x AS decimal(18,6)), 2) AS {NUMBER}) END AS varchar)", "CASE WHEN x = 'x' THEN ':not_numeric' ELSE '' END", half_duck),
        "ref_int": Case("lineitem", LINE, whole, lambda: Int, "cast(cleaned as string)", "CASE WHEN x <> 'n' AND x NOT LIKE '%.5' THEN CAST(CAST(CAST(x AS double) AS bigint) AS varchar) END", "CASE WHEN x = 'n' THEN ':not_numeric' WHEN x LIKE '%.5' THEN ':not_int' ELSE '' END", whole_duck),
        "ref_max": Case("events", "event_id", "value", lambda: Max(50.0), "cleaned", PLAIN.format("x <= 50"), "CASE WHEN x > 50 THEN ':too_big' ELSE '' END"),
        "ref_min": Case("events", "event_id", "value", lambda: Min(50.0), "cleaned", PLAIN.format("x >= 50"), "CASE WHEN x < 50 THEN ':too_small' ELSE '' END"),
        "ref_max_exclusive": Case("lineitem", LINE, "l_linenumber", lambda: macro(Max, exclusive=True)(4), "cleaned", PLAIN.format("x < 4"), "CASE WHEN x >= 4 THEN ':too_big' ELSE '' END"),
        "ref_min_exclusive": Case("lineitem", LINE, "l_linenumber", lambda: Min(4, exclusive=True), "cleaned", PLAIN.format("x > 4"), "CASE WHEN x <= 4 THEN ':too_small' ELSE '' END"),
        "ref_round": Case("customer", "c_custkey", "CAST(c_acctbal AS decimal(18,2))", lambda: Round("0.25"), f"cast(cast(cleaned as {NUMBER}) as string)", f"CAST(CAST(sign(x) * floor(CAST(abs(x) * 4 + 0.5 AS decimal(28,6))) / 4 AS {NUMBER}) AS varchar)"),
        "ref_round_floor": Case("customer", "c_custkey", "CAST(c_acctbal AS decimal(18,2))", lambda: Round(5, "ROUND_FLOOR", int), "cast(cleaned as string)", "CAST(CAST(floor(CAST(x AS double) / 5) * 5 AS bigint) AS varchar)"),
        "ref_choice": Case("customer", "c_custkey", "c_mktsegment", lambda: Choice(["BUILDING", "MACHINERY"]), "cleaned", PLAIN.format("x IN ('BUILDING', 'MACHINERY')"), "CASE WHEN x NOT IN ('BUILDING', 'MACHINERY') THEN ':not_valid_choice' ELSE '' END"),
        "ref_length": Case("part", "p_partkey", "p_name", lambda: Length(11), "cleaned", PLAIN.format("length(x) = 11"), "CASE WHEN length(x) > 11 THEN ':too_long' WHEN length(x) < 11 THEN ':too_short' ELSE '' END"),
        "ref_max_length": Case("part", "p_partkey", "p_name", lambda: MaxLength(11), "cleaned", PLAIN.format("length(x) <= 11"), "CASE WHEN length(x) > 11 THEN ':too_long' ELSE '' END"),
        "ref_min_length": Case("part", "p_partkey", "p_name", lambda: MinLength(11), "cleaned", PLAIN.format("length(x) >= 11"), "CASE WHEN length(x) < 11 THEN ':too_short' ELSE '' END"),
        "ref_empty": Case("part", "p_partkey", part, lambda: Empty, "cleaned", PLAIN.format("x = ''"), "CASE WHEN x <> '' THEN ':not_empty' ELSE '' END"),
        "ref_not_empty": Case("part", "p_partkey", part, lambda: NotEmpty, "cleaned", "nullif(x, '')", "CASE WHEN x = '' THEN ':empty' ELSE '' END"),
        "ref_optional": Case("part", "p_partkey", part, lambda: Optional("none"), "cleaned", "coalesce(nullif(x, ''), 'none')"),
        "ref_noop": Case("part", "p_partkey", part, lambda: NoOp, "cleaned", "x"),
        "ref_type": Case("part", "p_partkey", f"parse_json({mixed})", lambda: Type(str), "variant_get(cleaned, '$', 'string')", "CASE WHEN id % 4 = 0 THEN x END", "CASE WHEN id % 4 = 0 OR id % 4 = 3 THEN '' ELSE ':wrong_type' END", "p_name"),
        "ref_type_exact": Case("part", "p_partkey", f"parse_json({mixed})", lambda: Type([int, list], allow_subclass=False), "to_json(cleaned)", "CASE WHEN id % 4 = 1 THEN CAST(x AS varchar) WHEN id % 4 = 2 THEN '[1]' END", "CASE WHEN id % 4 = 0 THEN ':wrong_type' ELSE '' END", "p_size"),
        "ref_type_column": Case("part", "p_partkey", "p_size", lambda: Type((int, str)), "cleaned", "x"),
        "ref_array": Case("part", "p_partkey", f"parse_json({mixed})", lambda: Array, "to_json(cleaned)", "CASE WHEN id % 4 = 2 THEN '[1]' END", "CASE WHEN id % 4 >= 2 THEN '' ELSE ':wrong_type' END", "p_name"),
        "ref_array_column": Case("part", "p_partkey", "split(p_name, ' ')", lambda: Array, "array_join(cleaned, '|')", "array_to_string(x, '|')", "''", "string_split(p_name, ' ')"),
        "ref_strip": Case("part", "p_partkey", padded, lambda: Strip, "cleaned", "trim(x, ' ' || chr(9) || chr(10))"),
        "ref_regex": Case("pages", "page_id", "url", lambda: Regex(r"[a-z]+\.(?:com|org)"), "array_join(cleaned, '|')", r"nullif(array_to_string(regexp_extract_all(x, '[a-z]+\.(?:com|org)'), '|'), '')", r"CASE WHEN regexp_matches(x, '[a-z]+\.(?:com|org)') THEN '' ELSE ':malformed' END"),
        "ref_split": Case("orders", "o_orderkey", "o_orderpriority", lambda: Split("-"), "array_join(cleaned, '|')", "array_to_string(string_split(x, '-'), '|')"),
        "ref_split_groups": Case("part", "p_partkey", "p_name", lambda: Split("( )"), "array_join(cleaned, '|')", "replace(x, ' ', '| |')"),
        "ref_split_keys": Case("orders", "o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || '-x' WHEN o_orderkey % 5 = 0 THEN 'one' ELSE o_orderpriority END", lambda: Split("-", ["rank", "name"]), "cleaned.rank || '/' || coalesce(cleaned.name, '')", "CASE WHEN len(string_split(x, '-')) <= 2 THEN string_split(x, '-')[1] || '/' || coalesce(string_split(x, '-')[2], '') END", "CASE WHEN len(string_split(x, '-')) > 2 THEN ':too_long' ELSE '' END"),
        "ref_casefold": Case("documents", text, "text", lambda: CaseFold, "md5(cast(cleaned as binary))", "md5(replace(lower(x), 'ß', 'ss'))"),
        "ref_unicode": Case("documents", text, messy.format(zw=8203, acute=769).replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')").replace("chr(769)", "decode(unhex('CC81'), 'UTF-8')"), lambda: Unicode, "md5(cast(cleaned as binary))", "md5(nfc_normalize(replace(replace(x, chr(8203), ''), chr(13) || chr(10), chr(10))))", "''", messy.format(zw=8203, acute=769)),
        "ref_bytestring": Case("documents", text, "text", lambda: ByteString, "md5(cleaned)", "md5(x)"),
        "ref_bytestring_latin": Case("part", "p_partkey", "encode(p_name || chr(233), 'ISO-8859-1')", lambda: ByteString("iso-8859-1"), "md5(cleaned)", "md5(x || 'é')", "''", "p_name"),
        "ref_wrong_encoding": Case("part", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN encode(p_name || chr(233), 'ISO-8859-1') ELSE encode(p_name || chr(233), 'UTF-8') END", lambda: Unicode, "cleaned", "CASE WHEN id % 3 <> 0 THEN x || 'é' END", "CASE WHEN id % 3 = 0 THEN ':wrong_encoding' ELSE '' END", "p_name"),
        "ref_unicode_greek": Case("part", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN unhex('E1FF') ELSE unhex('E1E2') END", lambda: Unicode("iso-8859-7"), "cleaned", "CASE WHEN id % 3 <> 0 THEN 'αβ' END", "CASE WHEN id % 3 = 0 THEN ':wrong_encoding' ELSE '' END", "p_name"),
        "ref_bytearray_greek": Case("part", "p_partkey", "CASE WHEN p_partkey % 3 = 0 THEN p_name || 'я' ELSE p_name || 'α' END", lambda: ByteArray("iso-8859-7"), "hex(cleaned)", "CASE WHEN id % 3 <> 0 THEN hex(encode(x)) || 'E1' END", "CASE WHEN id % 3 = 0 THEN ':bad_encoding' ELSE '' END", "p_name"),
        "ref_bytearray_numbers": Case("part", "p_partkey", "array(p_size, p_size * 6 - 20)", lambda: ByteArray, "hex(cleaned)", "CASE WHEN x * 6 - 20 BETWEEN 0 AND 255 THEN printf('%02X%02X', x, x * 6 - 20) END", "CASE WHEN x * 6 - 20 < 0 THEN '1:too_small' WHEN x * 6 - 20 > 255 THEN '1:too_big' ELSE '' END", "p_size"),
        "ref_bytearray": Case("documents", text, "text", lambda: ByteArray("iso-8859-1"), "octet_length(cleaned)", "CASE WHEN NOT regexp_matches(x, '[^\\x{0}-\\x{FF}]') THEN length(x) END", "CASE WHEN regexp_matches(x, '[^\\x{0}-\\x{FF}]') THEN ':bad_encoding' ELSE '' END"),
        "ref_maxbytes": Case("part", "p_partkey", "p_name", lambda: MaxBytes(10, prefix="..."), "cast(cleaned as string)", "CASE WHEN length(x) <= 10 THEN x ELSE substr('...' || x, 1, 10) END", "CASE WHEN length(x) > 10 THEN ':too_long' ELSE '' END"),
        "ref_base64": Case("documents", text, b64, lambda: Base64Decode, "md5(cleaned)", "CASE WHEN id % 5 <> 0 THEN md5(x) END", "CASE WHEN id % 5 = 0 THEN ':not_base64' ELSE '' END", "text"),
        "ref_uuid": Case("documents", text, hexes, lambda: Uuid, "cleaned", f"CASE WHEN length({bare}) = 32 THEN {dashed} END", f"CASE WHEN length({bare}) <> 32 THEN ':not_uuid' ELSE '' END", hexes_duck),
        "ref_uuid_version": Case("documents", text, hexes, lambda: Uuid(4), "cleaned", f"CASE WHEN regexp_matches({bare}, '^[0-9a-f]{{12}}4[0-9a-f]{{3}}[89ab][0-9a-f]{{15}}$') THEN {dashed} END", f"CASE WHEN length({bare}) <> 32 THEN ':not_uuid' WHEN NOT regexp_matches({bare}, '^[0-9a-f]{{12}}4[0-9a-f]{{3}}[89ab]') THEN ':wrong_version' ELSE '' END", hexes_duck),
        "ref_ip": Case("customer", "c_custkey", address[0], lambda: IpAddress, "cleaned", PLAIN.format(f"regexp_matches(x, '^{OCTET}(\\.{OCTET}){{3}}$')"), f"CASE WHEN NOT regexp_matches(x, '^{OCTET}(\\.{OCTET}){{3}}$') THEN ':not_ip_address' ELSE '' END", address[1]),
        "ref_ipv6": Case("customer", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN '2001:0DB8:0:0:0:0:0:' || lower(hex(1 + c_custkey % 15)) ELSE 'x:' || c_name END", lambda: IpAddress(False, True), "cleaned", "CASE WHEN id % 3 = 0 THEN '2001:db8::' || lower(hex(1 + id % 15)) END", "CASE WHEN id % 3 <> 0 THEN ':not_ip_address' ELSE '' END", "c_name"),
        "ref_datetime": Case("events", "event_id", stamped, lambda: Datetime(8), "date_format(cleaned, 'yyyy-MM-dd HH:mm:ss')", f"strftime({moment}, '%Y-%m-%d %H:%M:%S')", "CASE WHEN x = 'soon' THEN ':not_datetime' ELSE '' END", stamped_duck),
        "ref_datetime_naive": Case("events", "event_id", stamped, lambda: Datetime(8, naive=True), "date_format(cleaned, 'yyyy-MM-dd HH:mm:ss')", f"strftime({moment}, '%Y-%m-%d %H:%M:%S')", "CASE WHEN x = 'soon' THEN ':not_datetime' ELSE '' END", stamped_duck),
        "ref_date": Case("events", "event_id", stamped, lambda: Date(8), "cast(cleaned as string)", f"strftime({moment}, '%Y-%m-%d')", "CASE WHEN x = 'soon' THEN ':not_date' ELSE '' END", stamped_duck),
        "ref_json_fields": Case("events", "event_id", json_, lambda: JsonDecode | Fields({"k": Int | Min(10)}, False, False), "cast(cleaned.k as string)", f"CASE WHEN {good} AND {json_codes} = '' THEN CAST(CAST({k} AS integer) AS varchar) WHEN {good} AND try_cast({k} AS integer) >= 10 THEN CAST(CAST({k} AS integer) AS varchar) END", json_codes, json_duck),
        "ref_each_array": Case("part", "p_partkey", "split(p_name, ' ')", lambda: Each(MaxLength(5)), "array_join(cleaned, '|', '-')", "array_to_string(list_transform(x, lambda w: CASE WHEN length(w) <= 5 THEN w ELSE '-' END), '|')", "array_to_string(list_filter(list_transform(range(len(x)), lambda i: CASE WHEN length(x[i + 1]) > 5 THEN i::varchar || ':too_long' END), lambda c: c IS NOT NULL), ',')", "string_split(p_name, ' ')"),
        "ref_each_only": Case("part", "p_partkey", "split(p_name, ' ')", lambda: Each(NoOp, only=[0]), "array_join(cleaned, '|', '-')", "array_to_string(list_transform(range(len(x)), lambda i: CASE WHEN i = 0 THEN x[i + 1] ELSE '-' END), '|')", "array_to_string(list_transform(range(1, len(x)), lambda i: i::varchar || ':unexpected'), ',')", "string_split(p_name, ' ')"),
        "ref_each_numbers": Case("embeddings", "vec_id", "embedding", lambda: Each(Min(0)), "size(filter(cleaned, v -> v is not null))", "len(list_filter(x, lambda v: v >= 0))", "array_to_string(list_filter(list_transform(range(len(x)), lambda i: CASE WHEN x[i + 1] < 0 THEN i::varchar || ':too_small' END), lambda c: c IS NOT NULL), ',')"),
        "ref_each_map": Case("orders", "o_orderkey", "map('status', o_orderstatus, 'priority', o_orderpriority)", lambda: Each(MaxLength(6)), "coalesce(cleaned['status'], '') || '|' || coalesce(cleaned['priority'], '')", "split_part(x, '|', 1) || '|' || CASE WHEN length(split_part(x, '|', 2)) <= 6 THEN split_part(x, '|', 2) ELSE '' END", "CASE WHEN length(split_part(x, '|', 2)) > 6 THEN 'priority:too_long' ELSE '' END", "o_orderstatus || '|' || o_orderpriority"),
        "ref_fields": Case("orders", "o_orderkey", "map('status', o_orderstatus, 'priority', o_orderpriority)", lambda: Fields({"status": Choice(["O", "F"]), "date": None}, ["status"], False), "cleaned.status", "CASE WHEN x IN ('O', 'F') THEN x END", "concat_ws(',', CASE WHEN x NOT IN ('O', 'F') THEN 'status:not_valid_choice' END, 'date:missing', 'priority:unexpected')", "o_orderstatus"),
        "ref_chain": Case("part", "p_partkey", part, lambda: Required | Strip | MaxLength(14) | Regex("^[a-m]") | Each(Choice(list("abcdefgh"))), "cleaned[0]", "CASE WHEN x <> '' AND length(x) <= 14 AND regexp_matches(x, '^[a-h]') THEN x[1] END", "CASE WHEN x IS NULL OR x = '' THEN ':empty' WHEN length(x) > 14 THEN ':too_long' WHEN NOT regexp_matches(x, '^[a-m]') THEN ':malformed' WHEN NOT regexp_matches(x, '^[a-h]') THEN '0:not_valid_choice' ELSE '' END"),
        "ref_round_big": Case("customer", "c_custkey", BIG, lambda: Round("0.000001"), "cast(cleaned as string)", "CASE WHEN id % 3 = 1 THEN '1000000000000000.000000000000000000' WHEN id % 3 = 2 THEN '99999999999999999999.000000000000000000' END", "CASE WHEN id % 3 = 0 THEN ':exception' ELSE '' END", "c_name"),
        "ref_round_half_even": Case("customer", "c_custkey", "CAST(c_acctbal AS decimal(18,2))", lambda: Round("0.5", "ROUND_HALF_EVEN"), f"cast(cast(cleaned as {NUMBER}) as string)", f"CAST(CAST(round_even(CAST(x * 2 AS decimal(18,6)), 0) / 2 AS {NUMBER}) AS varchar)"),
        "ref_exception": Case("part", "p_partkey", "p_name", lambda: Max(3), "cleaned", "CAST(NULL AS varchar)", "':exception'"),
        "ref_custom": Case("part", "p_partkey", "p_size", lambda: Even | Max(30), "cleaned", PLAIN.format("x % 2 = 0 AND x <= 30"), "CASE WHEN x % 2 <> 0 THEN ':odd' WHEN x > 30 THEN ':too_big' ELSE '' END"),
        "ref_custom_python": Case("part", "p_partkey", "p_name", lambda: Backwards(9), "cleaned", "CASE WHEN length(x) >= 9 THEN reverse(x) END", "CASE WHEN length(x) < 9 THEN ':short' ELSE '' END"),
        "ref_each_item": Case("part", "p_partkey", "split(p_name, ' ')", lambda: Shorter(MaxLength(9)), "array_join(cleaned, '|', '-')", "array_to_string(list_transform(x, lambda w: CASE WHEN length(w) <= 4 THEN w ELSE '-' END), '|')", "array_to_string(list_filter(list_transform(range(len(x)), lambda i: CASE WHEN length(x[i + 1]) > 4 THEN i::varchar || ':too_long' END), lambda c: c IS NOT NULL), ',')", "string_split(p_name, ' ')"),
        "ref_fields_item": Case("orders", "o_orderkey", "map('status', o_orderstatus, 'priority', o_orderpriority)", lambda: Strict({"status": Choice(["O", "F"]), "priority": NoOp}), "cleaned.status || '/' || coalesce(cleaned.priority, '')", "CASE WHEN split_part(x, '|', 1) IN ('O', 'F') THEN split_part(x, '|', 1) || '/' || CASE WHEN length(split_part(x, '|', 2)) <= 6 THEN split_part(x, '|', 2) ELSE '' END END", "concat_ws(',', CASE WHEN split_part(x, '|', 1) NOT IN ('O', 'F') THEN 'status:not_valid_choice' END, CASE WHEN length(split_part(x, '|', 2)) > 6 THEN 'priority:too_long' END)", "o_orderstatus || '|' || o_orderpriority"),
        "ref_registry": Case("part", "p_partkey", part, lambda: _registry().Code(12) | _registry()["Even"], "cleaned", "CAST(NULL AS varchar)", "CASE WHEN x IS NULL OR x = '' THEN ':empty' WHEN length(x) > 12 THEN ':too_long' ELSE ':odd' END"),
        "ref_macro": Case("part", "p_partkey", part, lambda: code_of(12) | NoOp, "cleaned", PLAIN.format("x <> '' AND length(x) <= 12"), "CASE WHEN x IS NULL OR x = '' THEN ':empty' WHEN length(x) > 12 THEN ':too_long' ELSE '' END"),
    }


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good and bad balances by market segment."""
    rows = read(spark, f"{sf_dir}/customer.parquet").selectExpr("c_mktsegment", "cast(cast(c_acctbal as decimal(18,2)) as string) AS balance")
    out = apply(rows, "balance", Required | Decimal | Min(0) | Max(5000) | Round("0.25"))
    return out.groupBy("c_mktsegment").agg(F.sum(F.when(F.col("is_valid"), 1).otherwise(0)).cast("long").alias("n_valid"), F.sum(F.when(F.col("is_valid"), 0).otherwise(1)).cast("long").alias("n_invalid"), F.sum("cleaned").cast("decimal(28,2)").cast("string").alias("total"))


FLAGSHIP_SQL = """SELECT c_mktsegment, CAST(sum(CASE WHEN b BETWEEN 0 AND 5000 THEN 1 ELSE 0 END) AS bigint) AS n_valid,
CAST(sum(CASE WHEN b BETWEEN 0 AND 5000 THEN 0 ELSE 1 END) AS bigint) AS n_invalid,
CAST(CAST(sum(CASE WHEN b BETWEEN 0 AND 5000 THEN CAST(floor(CAST(b * 4 + 0.5 AS decimal(28,6))) / 4 AS decimal(28,2)) END) AS decimal(28,2)) AS varchar) AS total
FROM (SELECT c_mktsegment, CAST(c_acctbal AS decimal(18,2)) AS b FROM customer) t GROUP BY c_mktsegment"""


def _customers(spark: SparkSession, sf_dir: str) -> Runner:
    rows = read(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal", F.struct("c_name", "c_mktsegment", F.col("c_acctbal").alias("balance")).alias("x"))
    return Runner(Fields({"c_mktsegment": Choice(["BUILDING", "MACHINERY"]), "balance": Min(0.0) | Max(5000.0)}, False, True), rows, "x")


CUSTOMER_ISSUES = """(SELECT c_custkey, 'c_mktsegment' AS path, 'not_valid_choice' AS code FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
UNION ALL SELECT c_custkey, 'balance', 'too_small' FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'balance', 'too_big' FROM customer WHERE c_acctbal > 5000) i"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).report().select("path", "code", F.col("n").cast("long").alias("n"))


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).errors().select("c_custkey", "path", "code")


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).valid().select("c_custkey", F.col("cleaned.balance").alias("balance"))


def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nations = read(spark, f"{sf_dir}/nation.parquet")
    out = apply(rows, "c_nationkey", Lookup(nations, "n_nationkey", "n_regionkey < 3"))
    return out.select("c_custkey", F.col("cleaned.n_name").alias("n_name"), F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


def _priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "o_orderstatus", "map('status', o_orderstatus, 'priority', o_orderpriority) AS x")


def _iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, f"{sf_dir}/part.parquet").selectExpr("p_partkey", "split(p_name, ' ') AS x")
    out = iterate(rows, "x", MaxLength(5))
    return out.select("p_partkey", "pos", "value", F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",").alias("codes"))


def _iterate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iterate(_priorities(spark, sf_dir), "x", MaxLength(6))
    return out.select("o_orderkey", "key", "value", F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


def _iterate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = iterate(_priorities(spark, sf_dir), "x", Fields({"status": Choice(["O", "F"]), "date": Required}, False, ["priority"]))
    return out.select("o_orderkey", "key", F.variant_get("value", "$", "string").alias("value"), F.array_join(F.transform("issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",").alias("codes"))


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strict run over rows that are all good."""
    rows = read(spark, f"{sf_dir}/customer.parquet").where("c_acctbal >= 0").select("c_custkey", "c_acctbal")
    return Runner(Min(0.0), rows, "c_acctbal", policy="strict").collect().select("c_custkey", "cleaned")


def _strict_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with bad rows raises the error type; what it says."""
    rows = read(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    try:
        check(Min(0.0), rows, "c_acctbal")
    except Invalid as e:
        return spark.createDataFrame([(type(e).__name__, issubclass(Invalid, ValueError), "too_small" in str(e))], "error string, is_value_error boolean, names_code boolean")
    return spark.createDataFrame([], "error string, is_value_error boolean, names_code boolean")


class _Lines(logging.Handler):
    def __init__(self):
        super().__init__()
        self.lines: list[str] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.lines.append(record.getMessage())


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a logger gets to read."""
    logger, lines = logging.Logger("issues"), _Lines()
    logger.addHandler(lines)
    r = _customers(spark, sf_dir)
    Runner(r.step, r.df, r.column, policy=Log(logger)).collect()
    return spark.createDataFrame([(x,) for x in lines.lines], "line string")


class _Nameless(Handler):
    """Puts a zero where a value is bad."""

    def value(self, value: Column, issues: Column, t: T.DataType) -> Column:
        return F.coalesce(value, F.lit(0).cast(t))


def _handler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A handler of one's own, which changes what stands for bad values."""
    rows = read(spark, f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    return Runner(Min(0.0), rows, "c_acctbal", policy=_Nameless).collect().select("c_custkey", "cleaned")


def _sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues handed on to a function, beside columns with the names of theirs."""
    rows = read(spark, f"{sf_dir}/events.parquet").selectExpr("event_id AS path", "value", "event_type AS code", "value > 50 AS is_valid")
    got: list[DataFrame] = []
    Runner(Max(50.0), rows, "value", policy=Sink(got.append)).collect()
    return got[0].selectExpr("path", "code", "is_valid", "path_ AS issue_path", "code_ AS issue_code")


def _error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _customers(spark, sf_dir).error_codes()
    return out.select("c_custkey", F.coalesce(F.array_join(F.col("codes")["balance"], ","), F.lit("")).alias("balance"), F.coalesce(F.array_join(F.col("codes")["c_mktsegment"], ","), F.lit("")).alias("segment"))


def _exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, f"{sf_dir}/customer.parquet").selectExpr("c_custkey", f"{BIG} AS x")
    return Runner(Round("0.000001"), rows, "x").exceptions().select("c_custkey", "code", "value")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = split(_customers(spark, sf_dir))
    return good.select("c_custkey", F.lit("good").alias("kind")).union(bad.select("c_custkey", F.lit("bad").alias("kind")).distinct())


def _helper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test helper over a table: it passes on what holds, and says so where it doesn't."""
    rows = read(spark, f"{sf_dir}/part.parquet").selectExpr("p_size", "CASE WHEN p_size <= 25 THEN p_size END AS want", "CASE WHEN p_size <= 25 THEN array() ELSE array(':too_big') END AS codes")
    out = []
    for most in (25, 24):
        try:
            assert_step(Max(most), rows, "p_size", "want", "codes")
            out.append((most, "passed"))
        except AssertionError:
            out.append((most, "failed"))
    return spark.createDataFrame(out, "most int, outcome string")


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts as a step, and as a macro."""
    things = {"Max": Max, "code_of": code_of, "Registry": Registry, "3": 3}
    return spark.createDataFrame([(n, is_step(x) is True, isinstance(x, Macro)) for n, x in things.items()], "name string, is_step boolean, is_macro boolean")


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps that a module defines."""
    import tamis.operators.dates as module

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        names = [n for n, _ in steps_in(module) if n in ("Date", "Datetime")]
    return spark.createDataFrame([(n, len(said)) for n in names], "name string, warnings int")


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same plan cleans a stream; here a table."""
    rows = read(spark, f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    log(Runner(Max(25), rows, "p_size"), logging.Logger("quiet"), logging.DEBUG)
    return clean(rows, "p_size", Max(25)).select("p_partkey", "cleaned", "is_valid")


def _lookup_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with a map, and with several rows for a key."""
    nations = read(spark, f"{sf_dir}/nation.parquet").selectExpr("n_regionkey", "n_name", "map('n', n_nationkey) AS m")
    rows = read(spark, f"{sf_dir}/region.parquet").select("r_regionkey")
    return apply(rows, "r_regionkey", Lookup(nations, "n_regionkey")).selectExpr("r_regionkey", "cleaned.n_name AS n_name", "cleaned.m['n'] AS n")


MORE = {
    "ref_flagship": (_flagship, FLAGSHIP_SQL),
    "ref_report": (_report, f"SELECT path, code, count(*) AS n FROM {CUSTOMER_ISSUES} GROUP BY path, code"),
    "ref_errors": (_errors, f"SELECT c_custkey, path, code FROM {CUSTOMER_ISSUES}"),
    "ref_valid": (_valid, "SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000"),
    "ref_iterate": (_iterate, "SELECT p_partkey, CAST(i AS integer) AS pos, CASE WHEN length(w) <= 5 THEN w END AS value, CASE WHEN length(w) > 5 THEN i || ':too_long' ELSE '' END AS codes FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part) t"),
    "ref_iterate_map": (_iterate_map, "SELECT o_orderkey, key, CASE WHEN length(v) <= 6 THEN v END AS value, CASE WHEN length(v) > 6 THEN 'too_long' ELSE '' END AS codes FROM (SELECT o_orderkey, 'status' AS key, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders) t"),
    "ref_iterate_fields": (_iterate_fields, "SELECT o_orderkey, 'status' AS key, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS value, CASE WHEN o_orderstatus IN ('O', 'F') THEN '' ELSE 'status:not_valid_choice' END AS codes FROM orders UNION ALL SELECT o_orderkey, 'date', NULL, 'date:missing' FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, '' FROM orders"),
    "ref_strict": (_strict, "SELECT c_custkey, c_acctbal AS cleaned FROM customer WHERE c_acctbal >= 0"),
    "ref_strict_stops": (_strict_stops, "SELECT 'Invalid' AS error, true AS is_value_error, true AS names_code WHERE (SELECT min(c_acctbal) FROM customer) < 0"),
    "ref_log": (_log, f"SELECT path || ': ' || code || ' (' || count(*) || ' times)' AS line FROM {CUSTOMER_ISSUES} GROUP BY path, code"),
    "ref_handler": (_handler, "SELECT c_custkey, greatest(c_acctbal, 0) AS cleaned FROM customer"),
    "ref_sink": (_sink, "SELECT event_id AS path, event_type AS code, true AS is_valid, '' AS issue_path, 'too_big' AS issue_code FROM events WHERE value > 50"),
    "ref_error_codes": (_error_codes, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'too_small' WHEN c_acctbal > 5000 THEN 'too_big' ELSE '' END AS balance, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'not_valid_choice' ELSE '' END AS segment FROM customer"),
    "ref_exceptions": (_exceptions, f"SELECT c_custkey, 'exception' AS code, {BIG} AS value FROM customer WHERE c_custkey % 3 = 0"),
    "ref_split_rows": (_split, "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN 0 AND 5000 THEN 'good' ELSE 'bad' END AS kind FROM customer"),
    "ref_helper": (_helper, "SELECT 25 AS most, 'passed' AS outcome UNION ALL SELECT 24, CASE WHEN (SELECT count(*) FROM part WHERE p_size = 25) > 0 THEN 'failed' ELSE 'passed' END"),
    "ref_kinds": (_kinds, "SELECT * FROM (VALUES ('Max', true, false), ('code_of', true, true), ('Registry', false, false), ('3', false, false)) t(name, is_step, is_macro)"),
    "ref_scan": (_scan, "SELECT * FROM (VALUES ('Date', 1), ('Datetime', 1)) t(name, warnings)"),
    "ref_stream_plan": (_reports, "SELECT p_partkey, CASE WHEN p_size <= 25 THEN p_size END AS cleaned, p_size <= 25 AS is_valid FROM part"),
    "ref_lookup_kept": (_lookup_kept, "SELECT r_regionkey, n_name, n_nationkey AS n FROM region LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS r FROM nation) t ON r_regionkey = n_regionkey AND r = 1"),
    "ref_lookup": (_lookup, "SELECT c_custkey, n_name, CASE WHEN n_name IS NULL THEN 'not_found' ELSE '' END AS codes FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: case.run for name, case in _cases().items()} | {name: f for name, (f, _) in MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql() for name, case in _cases().items()} | {name: sql for name, (_, sql) in MORE.items()}
