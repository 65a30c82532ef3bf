"""Each step over a column of cases: (value, cleaned value, [path:code])."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tamis.functions.macros import macro
from tamis.operators import Array, Base64Decode, ByteArray, ByteString, CaseFold, Choice, Date, Datetime, Decimal, Each, Empty, Fields, Int, IpAddress, JsonDecode, Length, Max, MaxBytes, MaxLength, Min, MinLength, NoOp, NotEmpty, Optional, Regex, Required, Round, Split, Strip, Type, Unicode, Uuid
from tamis.plans.core import Chain, to_step
from tamis.plans.runner import Invalid, Runner, apply, check

NULL = (None, None, [])
ID = "3f2504e0-4f89-11d3-9a0c-0305e82c3301"

CASES = {
    "decimal": (Decimal, "string", [NULL, ("3.14", D("3.14"), []), ("1_0", D(10), []), (" 5 ", D(5), []), ("2.8E-12", D("2.8E-12"), []), ("abc", None, [":not_numeric"]), ("", None, [":not_numeric"]), ("NaN", None, [":not_finite"]), ("+Inf", None, [":not_finite"]), ("-inf", None, [":not_finite"]), ("1e400", None, [":exception"])]),
    "decimal precision": (Decimal(3), "string", [("3.1415926", D("3.142"), []), ("0.0005", D(0), []), ("0.0015", D("0.002"), [])]),
    "decimal places of a number": (Decimal(D("0.01")), "string", [("0.125", D("0.12"), [])]),
    "decimal of float": (Decimal, "double", [(1.5, D("1.5"), []), (float("nan"), None, [":not_finite"]), (float("inf"), None, [":not_finite"])]),
    "decimal of bool": (Decimal, "boolean", [(True, D(1), []), (False, D(0), []), NULL]),
    "decimal of bytes": (Decimal, "binary", [(b"1", None, [":wrong_type"]), NULL]),
    "decimal of tuple": (Decimal, "struct<sign:int,digits:array<int>,exp:int>", [((0, [4, 2], -1), D("4.2"), []), ((1, [4], 0), D(-4), []), NULL]),
    "int": (Int, "string", [NULL, ("42.0000000000000", D(42), []), ("2.6E4", D(26000), []), ("42.01", None, [":not_int"]), ("-0.0", D(0), []), ("-7", D(-7), []), ("1E-3", None, [":not_int"]), ("1.00000000000000000001", None, [":not_int"]), ("x", None, [":not_numeric"]), ("1E2000", None, [":exception"]), ("12345678901234567890123456789", D("12345678901234567890123456789"), [])]),
    "int of double": (Int, "double", [(1.0, D(1), []), (2.5, None, [":not_int"]), (float("nan"), None, [":not_finite"])]),
    "int of bool": (Int, "boolean", [(True, D(1), [])]),
    "max": (Max(5), "int", [NULL, (8, None, [":too_big"]), (5, 5, [])]),
    "max exclusive": (Max(5.0, exclusive=True), "double", [(5.0, None, [":too_big"]), (4.9, 4.9, [])]),
    "max text": (Max("Foo"), "string", [("foo", None, [":too_big"]), ("Foo", "Foo", [])]),
    "max other type": (Max(3), "string", [("x", None, [":exception"]), NULL]),
    "min": (Min(5), "int", [(4, None, [":too_small"]), (5, 5, []), NULL]),
    "round": (Round("5"), "string", [("42", D(40), []), ("x", None, [":not_numeric"]), NULL]),
    "round tenth": (Round("0.1"), "string", [("2.775", D("2.8"), []), ("-2.775", D("-2.8"), [])]),
    "round fraction": (Round("5.5"), "string", [("42", D(44), [])]),
    "round twenty": (Round("20"), "string", [("471.9", D(480), []), ("469.99", D(460), [])]),
    "round big": (Round("0.000001"), "string", [("1000000000000000", D(10**15), []), ("99999999999999999999.9999995", None, [":exception"]), ("1e30", None, [":exception"]), ("-1000000000000000.0000005", D("-1000000000000000.000001"), [])]),
    "round big half": (Round("0.5"), "string", [("99999999999999999999", D(10**20 - 1), []), ("99999999999999999999.8", None, [":exception"])]),
    "round half even": (Round("0.5", "ROUND_HALF_EVEN"), "string", [("0.25", D(0), []), ("0.75", D(1), []), ("-1.25", D(-1), []), ("1.3", D("1.5"), [])]),
    "round away": (Round(3, "ROUND_UP"), "double", [(3.1, D(6), []), (-3.1, D(-6), []), (3.0, D(3), [])]),
    "round floor of decimal": (Round(5, "ROUND_FLOOR", int), "decimal(18,2)", [(D("-0.01"), D(-5), []), (D("9.99"), D(5), [])]),
    "round up": (Round(1, "ROUND_CEILING"), "string", [("0.00000000001", D(1), [])]),
    "round half down": (Round(1, "ROUND_HALF_DOWN"), "string", [("2.5", D(2), []), ("-2.5", D(-2), []), ("2.6", D(3), [])]),
    "round 05up": (Round(1, "ROUND_05UP"), "string", [("2.5", D(2), []), ("0.2", D(1), []), ("5.1", D(6), []), ("-5.1", D(-6), []), ("5", D(5), [])]),
    "round text": (Round("0.25", result_type=str), "string", [("1.3", "1.25", [])]),
    "choice": (Choice(["Rye", "Oat"]), "string", [NULL, ("Oat", "Oat", []), ("oat", None, [":not_valid_choice"])]),
    "no choice": (Choice([]), "string", [NULL, ("x", None, [":not_valid_choice"])]),
    "empty": (Empty, "string", [NULL, ("", "", []), ("a", None, [":not_empty"])]),
    "empty array": (Empty, "array<int>", [([], [], []), ([1], None, [":not_empty"]), NULL]),
    "empty number": (Empty, "int", [(0, None, [":not_empty"]), NULL]),
    "not empty": (NotEmpty, "string", [NULL, ("", None, [":empty"]), ("a", "a", [])]),
    "not empty or null": (NotEmpty(allow_none=False), "string", [(None, None, [":empty"]), ("", None, [":empty"])]),
    "not empty number": (NotEmpty, "int", [(0, 0, []), NULL]),
    "required": (Required, "map<string,int>", [(None, None, [":empty"]), ({}, None, [":empty"]), ({"a": 1}, {"a": 1}, [])]),
    "length": (Length(2), "string", [NULL, ("abc", None, [":too_long"]), ("a", None, [":too_short"]), ("\U0001f600b", "\U0001f600b", [])]),
    "length number": (Length(2), "int", [(3, None, [":wrong_type"]), NULL]),
    "max length": (MaxLength(2), "binary", [(b"abc", None, [":too_long"]), (b"ab", bytearray(b"ab"), [])]),
    "min length": (MinLength(2), "array<int>", [([1], None, [":too_short"]), ([1, 2], [1, 2], [])]),
    "min length number": (MinLength(2), "int", [(3, None, [":exception"]), NULL]),
    "noop": (NoOp, "string", [NULL, ("a", "a", [])]),
    "type": (Type(int), "string", [("1", None, [":wrong_type"]), NULL]),
    "type bool": (Type(int), "boolean", [(True, True, [])]),
    "type exact": (Type(int, allow_subclass=False), "boolean", [(True, None, [":wrong_type"])]),
    "types": (Type((str, int)), "int", [(1, 1, [])]),
    "array": (Array, "array<int>", [([1], [1], []), NULL]),
    "array of text": (Array, "string", [("ab", None, [":wrong_type"]), NULL]),
    "array of map": (Array, "map<string,int>", [({"a": 1}, None, [":wrong_type"])]),
    "ip": (IpAddress, "string", [NULL, ("127.0.0.1", "127.0.0.1", []), ("127.1", None, [":not_ip_address"]), ("256.0.0.1", None, [":not_ip_address"]), ("127.0.0.1/32", None, [":not_ip_address"]), ("::1", None, [":not_ip_address"]), ("", None, [":not_ip_address"])]),
    "ip both": (IpAddress(True, True), "string", [NULL, ("127.0.0.1", "127.0.0.1", []), ("2001:0DB8:0:0:0:0:0:1", "2001:db8::1", []), ("x", None, [":not_ip_address"])]),
    "ip bytes": (IpAddress(True, True), "binary", [(b"127.0.0.1", None, [":wrong_type"]), NULL]),
    "datetime": (Datetime, "string", [NULL, ("2015-05-11T14:56:58-0500", dt.datetime(2015, 5, 11, 19, 56, 58), []), ("2015-05-11", dt.datetime(2015, 5, 11), []), ("2015-5-1 3:04", dt.datetime(2015, 5, 1, 3, 4), []), ("2015", None, [":not_datetime"]), ("10:30", None, [":not_datetime"]), ("2015-13-01", None, [":not_datetime"])]),
    "datetime zone": (Datetime(12), "string", [("2015-05-11", dt.datetime(2015, 5, 10, 12), [])]),
    "datetime naive": (Datetime(naive=True), "string", [("2015-05-11T14:56:58-0500", dt.datetime(2015, 5, 11, 19, 56, 58), [])]),
    "datetime lenient": (Datetime(lenient=True), "string", [("May 11, 2015 3pm", dt.datetime(2015, 5, 11, 15), []), ("2015-05-11", dt.datetime(2015, 5, 11), []), ("soon", None, [":not_datetime"]), NULL]),
    "datetime number": (Datetime, "int", [(3, None, [":exception"]), NULL]),
    "date": (Date, "string", [("2015-05-11T19:56:58-05:00", dt.date(2015, 5, 12), []), ("x", None, [":not_date"]), NULL]),
    "date zone": (Date(8), "string", [("2015-05-11 02:00:00", dt.date(2015, 5, 10), [])]),
    "date of date": (Date(8), "date", [(dt.date(2015, 5, 11), dt.date(2015, 5, 11), []), NULL]),
    "unicode": (Unicode, "string", [NULL, ("Amélie", "Amélie", []), ("a\x00​b\r\r\n", "ab\n\n", []), ("\U0001f600", "\U0001f600", [])]),
    "unicode as it is": (Unicode(normalize=False), "string", [("é\r\n", "é\r\n", [])]),
    "unicode bytes": (Unicode, "binary", [(b"\xe9", None, [":wrong_encoding"]), (b"ok", "ok", []), NULL]),
    "unicode latin": (Unicode("iso-8859-1"), "binary", [(b"\xe9", "é", []), NULL]),
    "unicode bool": (Unicode, "boolean", [(True, "1", []), (False, "0", [])]),
    "byte string": (ByteString, "string", [("é", bytearray(b"\xc3\xa9"), []), NULL]),
    "byte string latin": (ByteString("iso-8859-1"), "binary", [(b"\xe9", bytearray(b"\xc3\xa9"), [])]),
    "max bytes": (MaxBytes(13), "string", [("зимний сад", bytearray("зимний ".encode()), [":too_long"]), ("ab", bytearray(b"ab"), []), NULL]),
    "max bytes prefix": (MaxBytes(4, prefix="xx"), "string", [("abcdef", bytearray(b"xxab"), [":too_long"]), ("abc", bytearray(b"abc"), [])]),
    "max bytes whole": (MaxBytes(2), "string", [("中文", bytearray(b""), [":too_long"])]),
    "max bytes no cut": (MaxBytes(2, truncate=False), "string", [("abc", None, [":too_long"])]),
    "max bytes utf-16": (MaxBytes(6, encoding="utf-16"), "string", [("abc", bytearray("ab".encode("utf-16")), [":too_long"]), ("a", bytearray("a".encode("utf-16")), [])]),
    "byte array": (ByteArray, "array<int>", [([7, -3, 255, 300, 0, 256], None, ["1:too_small", "3:too_big", "5:too_big"]), ([1, 2], bytearray(b"\x01\x02"), []), ([1, None], None, ["1:exception"]), ([], bytearray(b""), []), NULL]),
    "byte array latin": (ByteArray("iso-8859-1"), "string", [("é", bytearray(b"\xe9"), []), ("я", None, [":bad_encoding"]), NULL]),
    "byte array greek": (ByteArray("iso-8859-7"), "string", [("αβ", bytearray(b"\xe1\xe2"), []), ("я", None, [":bad_encoding"]), NULL]),
    "base64": (Base64Decode, "binary", [NULL, (b"--___w==", bytearray(b"\xfb\xef\xff\xff"), []), (b"SGVsbG8", bytearray(b"Hello"), []), (b"SGVs bG8====", bytearray(b"Hello"), []), (b"+-_/_w==", None, [":not_base64"]), (b"A", None, [":not_base64"]), (b"$", None, [":not_base64"])]),
    "base64 text": (Base64Decode, "string", [("SGVsbG8", None, [":wrong_type"])]),
    "case fold": (CaseFold, "string", [NULL, ("Großer FLUSS", "grosser fluss", []), ("ﬀ ſ ΐ Ꭰꭰ", "ﬀ ſ ΐ Ꭰꭰ".casefold(), []), ("\u1e9e\u0345", "\u1e9e\u0345".casefold(), []), ("İstanbul", "i̇stanbul", []), ("ΣΑΣ", "σασ", []), ("ﬁ", "fi", [])]),
    "regex": (Regex(r"\btest\b"), "string", [("a test test", ["test", "test"], []), ("no", None, [":malformed"]), NULL]),
    "split": (Split(":"), "string", [("a:b:", ["a", "b", ""], []), ("", [""], []), NULL]),
    "split groups": (Split(r"([-\d]+)"), "string", [("foo-12-bar", ["foo", "-12-", "bar"], []), NULL]),
    "split keys": (Split(":", ["a", "b"]), "string", [("x:y", ("x", "y"), []), ("x", ("x", None), []), ("x:y:z", None, [":too_long"]), NULL]),
    "strip": (Strip, "string", [("  a b ​\n", "a b", []), ("", "", []), NULL]),
    "strip one end": (Strip(None), "string", [(" a ", " a", [])]),
    "uuid": (Uuid, "string", [NULL, (ID, ID, []), ("{3F2504E0-4F89-11D3-9A0C-0305E82C3301}", ID, []), ("urn:uuid:" + ID, ID, []), ("12", None, [":not_uuid"])]),
    "uuid version": (Uuid(4), "string", [(ID, None, [":wrong_version"])]),
    "optional": (Optional("d"), "string", [("", "d", []), (None, "d", []), ("x", "x", [])]),
    "chain stops": (Required | MaxLength(3) | Choice(["a"]), "string", [("foobar", None, [":too_long"]), ("bb", None, [":not_valid_choice"]), ("a", "a", []), (None, None, [":empty"])]),
    "chain over null": (Optional("x") | MaxLength(3), "string", [(None, "x", [])]),
    "each": (Each(Int | Max(5)), "array<string>", [(["4", "x", "9", None], [D(4), None, None, None], ["1:not_numeric", "2:too_big"]), ([], [], []), NULL]),
    "each of text": (Each(Choice(["a"])), "string", [("ab", ["a", None], ["1:not_valid_choice"])]),
    "each of number": (Each(Int), "int", [(3, None, [":wrong_type"]), NULL]),
    "each map": (Each(Int), "map<string,string>", [({"a": "1", "b": "x"}, {"a": D(1), "b": None}, ["b:not_numeric"]), NULL]),
    "each only keys": (Each(Int, only=["a"]), "map<string,string>", [({"a": "1", "b": "2"}, {"a": D(1)}, ["b:unexpected"])]),
    "each only indexes": (Each(Required, only=[0, 2]), "array<string>", [(["a", "b", ""], ["a", None, None], ["1:unexpected", "2:empty"])]),
    "each in each": (Each(Each(Int)), "array<array<string>>", [([["1", "x"], ["2"]], [[D(1), None], [D(2)]], ["0.1:not_numeric"])]),
    "each in python": (Each(Unicode | MaxLength(1)), "array<string>", [(["é", "abc", None], ["é", None, None], ["1:too_long"]), NULL]),
    "fields": (Fields({"a": Int, "b": None}, True, ["z"]), "map<string,string>", [({"a": "1", "z": "9", "y": "8"}, (D(1), None, {"z": "9"}), ["y:unexpected"]), NULL]),
    "fields missing": (Fields({"a": Required, "b": None}, ["a"], True), "map<string,string>", [({}, (None, None, {}), ["a:empty", "b:missing"])]),
    "fields of struct": (Fields({"n": Min(3)}, True, False), "struct<n:int,m:int>", [((2, 1), (None,), ["n:too_small", "m:unexpected"]), NULL]),
    "fields of text": (Fields({"n": NoOp}), "string", [("x", None, [":wrong_type"]), NULL]),
    "fields in fields": (JsonDecode | Fields({"id": Required | Int, "a": Fields({"t": Required | Unicode}, True, False)}, False, False), "string", [('{"id": 3, "a": {"t": "x"}}', (D(3), ("x",)), []), ('{"id": null, "z": 1}', (None, None), ["id:empty", "a:missing", "z:unexpected"]), ('{"id": 4, "a": {}}', (D(4), (None,)), ["a.t:empty"]), ('{"a":', None, [":not_json"]), ("[]", None, [":wrong_type"]), ("null", None, []), ("", None, [":not_json"]), ("{} x", None, [":not_json"])]),
    "json decoder": (JsonDecode(lambda text: text.split("=")) | Each(MaxLength(1)), "string", [("a=bb", ["VariantVal"], ["1:too_long"])]),
}


@pytest.mark.parametrize("name", [n for n in CASES if n != "json decoder"])
def test_cases(spark, name):
    step, kind, cases = CASES[name]
    df = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(cases)], f"i int, v {kind}")
    out = apply(df, "v", step).orderBy("i").collect()
    for (value, cleaned, codes), row in zip(cases, out, strict=True):
        assert [f"{i.path}:{i.code}" for i in row.issues] == codes, value
        got = row.cleaned
        assert (_plain(got) == _plain(cleaned)), (value, got)
        assert row.is_valid == (not codes)


def _plain(x):
    if isinstance(x, tuple):
        return tuple(_plain(v) for v in x)
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    return list(map(_plain, x)) if isinstance(x, list) else x


def test_nan_passes_limits(spark):
    df = spark.createDataFrame([(float("nan"),)], "v double")
    assert apply(df, "v", Max(5.0) | Min(1.0)).first().is_valid


def test_json_decoder(spark):
    df = spark.createDataFrame([("a=bb",)], "v string")
    row = apply(df, "v", JsonDecode(lambda text: text.split("=")) | Each(MaxLength(1))).first()
    assert [f"{i.path}:{i.code}" for i in row.issues] == ["1:too_long"]


def test_variants(spark):
    texts = ['[4, "NaN", 3.14, "FOO", ""]', '{"a": 1}', "null", '"x"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.parse_json("t").alias("v"))
    rows = apply(df, "v", Each(Int)).orderBy("i").collect()
    assert rows[0].cleaned == [D(4), None, None, None, None]
    assert [f"{i.path}:{i.code}" for i in rows[0].issues] == ["1:not_finite", "2:not_int", "3:not_numeric", "4:not_numeric"]
    assert [i.code for r in rows[1:] for i in r.issues] == ["wrong_type", "wrong_type"]
    rows = apply(df, "v", Each(Int, of="map")).orderBy("i").collect()
    assert rows[1].cleaned == {"a": D(1)} and rows[1].is_valid
    assert [r.is_valid for r in apply(df, "v", Array).orderBy("i").collect()] == [True, False, True, False]
    assert [r.is_valid for r in apply(df, "v", Type("mapping")).orderBy("i").collect()] == [False, True, True, False]
    assert [r.is_valid for r in apply(df, "v", Length(1)).orderBy("i").collect()] == [False, True, True, True]
    assert [r.is_valid for r in apply(df, "v", Required).orderBy("i").collect()] == [True, True, False, True]


STEPS = [Decimal, Int, Round, Max(3), Min(3), Choice([1]), Empty, NotEmpty, Length(1), MaxLength(1), MinLength(1), NoOp, Type(str), Array, IpAddress, IpAddress(True, True), Date, Datetime, Unicode, ByteString, MaxBytes(3), ByteArray, Base64Decode, CaseFold, JsonDecode, Regex("a"), Split("a"), Strip, Uuid, Optional, Each(Int), Fields({"a": Int})]


@pytest.mark.parametrize("kind", ["string", "int", "binary", "array<string>", "map<string,string>"])
def test_null_passes(spark, kind):
    df = spark.createDataFrame([(None,)], f"v {kind}")
    for step in STEPS:
        row = apply(df, "v", step).first()
        assert row.issues == [] and row.cleaned is None, step


def test_chains(spark):
    df = spark.createDataFrame([("foobar",), ("a",), (None,)], "v string")
    a, b, c = to_step(Required), MaxLength(3), Choice(["a"])
    left, right = (a | b) | c, a | (b | c)
    assert apply(df, "v", left).collect() == apply(df, "v", right).collect()
    assert len((a | b).steps) == 2 and isinstance(a | None, Chain)
    assert isinstance(Required | Int, Chain) and isinstance(None | Chain(a), Chain)
    with pytest.raises(TypeError):
        Required | 3


def test_long_chain_plans_fast(spark):
    df = spark.createDataFrame([("x" * 9,)], "v string")
    chain = Chain(*[Strip() | MaxLength(10 + i) for i in range(15)])
    assert apply(df, "v", chain).first().is_valid
    assert apply(df.select(F.array("v").alias("v")), "v", Each(chain)).first().is_valid


def test_build_errors():
    for make in (lambda: Round(0), lambda: Round(-1), lambda: Round(1, "UP"), lambda: IpAddress(False, False), lambda: Each(Int, of="x")):
        with pytest.raises(ValueError):
            make()
    with pytest.raises(TypeError):
        Fields({}, allow_extra_keys="abc")
    with pytest.raises(LookupError):
        Unicode("no-such")
    with pytest.raises(TypeError):
        Type(3)


def test_runner(spark):
    df = spark.createDataFrame([(1, {"a": "x", "b": ""}), (2, {"a": "1", "b": "q"})], "i int, v map<string,string>")
    r = Runner(Fields({"a": Int, "b": Required}), df, "v")
    assert r.collect() is r.collect()
    assert [x.i for x in r.valid().collect()] == [2] and [x.i for x in r.invalid().collect()] == [1]
    assert sorted((x.path, x.code) for x in r.errors().collect()) == [("a", "not_numeric"), ("b", "empty")]
    assert r.error_codes().orderBy("i").first().codes == {"a": ["not_numeric"], "b": ["empty"]}
    assert sorted(tuple(x) for x in r.report().collect()) == [("a", "not_numeric", 1), ("b", "empty", 1)]
    with pytest.raises(ValueError):
        Runner(Int, df, "v", policy="x")


def test_clashing_names(spark):
    """Columns that the runner adds give way to those of the input, whatever their names."""
    df = spark.createDataFrame([("x", "a", "b", 1, True, 2.5, "p")], "`cleaned` string, path string, code string, `a.b` int, is_valid boolean, issues double, _issue string")
    r = Runner(Int, df, "cleaned")
    assert r.names == ("cleaned_", "issues_", "is_valid_") and r.collect().first()["cleaned"] == "x"
    assert r.valid().count() == 0 and r.invalid().count() == 1 and [tuple(x) for x in r.report().collect()] == [("", "not_numeric", 1)]
    row = r.errors().first()
    assert (row["path"], row["code"], row["path_"], row["code_"], row["a.b"]) == ("a", "b", "", "not_numeric", 1)
    assert "value" not in r.errors(with_context=False).columns and r.error_codes().first()["codes"] == {"": ["not_numeric"]}
    assert Runner(Int, df, "a.b").valid().first()["a.b"] == 1 and r.exceptions().count() == 0


def test_conditions_stay_above_steps(spark):
    """A condition on is_valid doesn't multiply the steps below it."""
    r = Runner(Required | Decimal | Int | Max(9) | Round("0.25"), spark.createDataFrame([("3",)], "v string"), "v")
    plan = r.valid()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("trim(") == 1 and r.valid().count() == 1


def test_strict(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    assert check(Int, df.where("v = '1'"), "v") == [D(1)]
    with pytest.raises(Invalid) as e:
        check(Int, df, "v")
    assert "not_numeric" in str(e.value)


def test_macros_and_registry(spark):
    from tamis.functions.macros import Registry, is_step, steps_in

    @macro
    def code(n=2):
        return Required | MaxLength(n)

    df = spark.createDataFrame([("abc",), ("a",)], "v string")
    assert [r.is_valid for r in apply(df, "v", code).collect()] == [False, True]
    assert [r.is_valid for r in apply(df, "v", code(3) | Choice(["a"])).collect()] == [False, True]
    strict_max = macro(Max, exclusive=True)
    numbers = spark.createDataFrame([(3,), (2,)], "v int")
    assert [r.is_valid for r in apply(numbers, "v", strict_max(3)).collect()] == [False, True]
    assert [r.is_valid for r in apply(numbers, "v", strict_max(3, exclusive=False)).collect()] == [True, True]
    ext = Registry("tamis.none")
    ext.register("Code", code)
    assert list(ext) == ["Code"] and ext.Code is code and len(ext) == 1
    with pytest.raises(AttributeError):
        ext.Nothing
    with pytest.raises(TypeError):
        ext.register("X", int)
    assert is_step(Max) is True and is_step(3) == "is no class"
    import tamis.operators.numbers as numbers_

    with pytest.warns(DeprecationWarning):
        assert "Int" in dict(steps_in(numbers_))
