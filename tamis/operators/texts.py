"""Steps that make text, bytes and what is read from text."""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Callable, Iterable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.native import FLAGS, folded, kind_of, length_of, line_feeds, without_controls
from tamis.operators.predicates import _text
from tamis.plans.core import Called, Outcome, Step, below, issue, no_issues, shown

#: Fixed value: encodings that Spark decodes and encodes itself.
NATIVE = {"utf-8": "UTF-8", "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1"}


def _is_utf8(encoding: str) -> bool:
    return codecs.lookup(encoding).name == "utf-8"


def _plain(v: Column, t: T.DataType) -> Column:
    """Any value but bytes as text."""
    if isinstance(t, T.BooleanType):
        return v.cast("int").cast("string")
    if isinstance(t, T.VariantType):
        kind = kind_of(v)
        return F.when(kind.rlike("^BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("int").cast("string")).when(kind.rlike("^(ARRAY|OBJECT)"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(v)
    return v.cast("string")


class Unicode(Called):
    """Text, from bytes in the encoding or from any other value.

    normalize takes out control and unassigned characters other than white space, composes (NFC), and makes line ends line
    feeds. Only texts with characters from U+0300 on go through Python, for NFC; bytes of encodings other than UTF-8 go
    through Python whole.
    """

    def __init__(self, encoding: str = "utf-8", normalize: bool = True):
        codecs.lookup(encoding)
        self.encoding, self.normalize = encoding, normalize
        self.python = self._call()

    def _call(self) -> Callable:
        encoding, compose = self.encoding, self.normalize

        def run(v: object) -> tuple[str | None, str | None]:
            if isinstance(v, (bytes, bytearray)):
                try:
                    v = bytes(v).decode(encoding)
                except UnicodeDecodeError:
                    return None, "wrong_encoding"
            return (unicodedata.normalize("NFC", v) if compose else v), None

        return run

    def _native(self, t: T.DataType) -> bool:
        return not isinstance(t, T.BinaryType) or _is_utf8(self.encoding)

    def _decoded(self, v: Column, t: T.DataType) -> Column:
        text = F.try_validate_utf8(v.cast("string")) if isinstance(t, T.BinaryType) else _plain(v, t)
        return without_controls(text) if self.normalize else text

    def needs(self, v: Column, t: T.DataType) -> Column:
        if not self._native(t):
            return v
        text = self._decoded(v, t)
        return F.when(text.rlike("[^\\x{0}-\\x{2FF}]"), text) if self.normalize else F.lit(None).cast("string")

    def finish(self, v: Column, t: T.DataType, got: Column, path: Column) -> Outcome:
        if self._native(t):
            text = F.coalesce(got["value"], self._decoded(v, t))
            bad = v.isNotNull() & text.isNull() if isinstance(t, T.BinaryType) else F.lit(False)
            text = line_feeds(text) if self.normalize else text
        else:
            text = line_feeds(without_controls(got["value"])) if self.normalize else got["value"]
            bad = F.coalesce(got["code"].isNotNull(), F.lit(False))
        return self.made(F.when(bad, "wrong_encoding"), text, v, t, path)

    def made(self, code: Column, text: Column, v: Column, t: T.DataType, path: Column) -> Outcome:
        return Outcome(F.when(code.isNull(), text), F.when(code.isNotNull(), F.array(issue(path, code, f"is not encoded as {self.encoding}", self.name, shown(v, t)))).otherwise(no_issues()), T.StringType())


class ByteString(Unicode):
    """UTF-8 bytes of what Unicode makes; `encoding` is that of bytes that come in."""

    def __init__(self, encoding: str = "utf-8", normalize: bool = False):
        super().__init__(encoding, normalize)

    def made(self, code: Column, text: Column, v: Column, t: T.DataType, path: Column) -> Outcome:
        o = super().made(code, text, v, t, path)
        return Outcome(F.encode(o.value, "UTF-8"), o.issues, T.BinaryType())


class MaxBytes(Unicode):
    """Bytes in the encoding, at most max_bytes of them.

    A longer value is an issue; with truncate its place is taken by prefix and value, cut at a character's end. Text is
    normalised first, as Unicode does; the prefix counts only where something is cut.
    """

    def __init__(self, max_bytes: int, truncate: bool = True, prefix: str = "", encoding: str = "utf-8"):
        self.max_bytes, self.truncate, self.prefix = max_bytes, truncate, prefix
        self.result = T.StringType() if _is_utf8(encoding) else T.BinaryType()
        super().__init__(encoding, True)

    def _call(self) -> Callable:
        if _is_utf8(self.encoding):
            return super()._call()
        encoding, most, truncate, prefix = self.encoding, self.max_bytes, self.truncate, self.prefix

        def run(v: object) -> tuple[bytes | None, str | None]:
            if isinstance(v, (bytes, bytearray)):
                try:
                    v = bytes(v).decode(encoding)
                except UnicodeDecodeError:
                    return None, "wrong_encoding"
            text = unicodedata.normalize("NFC", regex.sub(r"[\p{C}--\s]+", "", v, flags=regex.V1))
            text = regex.sub(r"\r\n?", "\n", text)
            raw = text.encode(encoding)
            if len(raw) <= most:
                return raw, None
            if not truncate:
                return None, "too_long"
            # the longest whole beginning that fits
            whole, low, high = prefix + text, 0, len(prefix + text)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if len(whole[:middle].encode(encoding)) <= most else (low, middle - 1)
            return (whole[:low].encode(encoding) if low else b""), "too_long"

        return run

    def needs(self, v: Column, t: T.DataType) -> Column:
        if _is_utf8(self.encoding):
            return super().needs(v, t)
        return v if isinstance(t, T.BinaryType) else _plain(v, t)

    def finish(self, v: Column, t: T.DataType, got: Column, path: Column) -> Outcome:
        wrong = v.isNotNull() & F.lit(not isinstance(t, (T.StringType, T.BinaryType, T.VariantType)))
        if isinstance(t, T.VariantType):
            wrong = v.isNotNull() & ~kind_of(v).rlike("^(STRING|BINARY|VOID)")
        if _is_utf8(self.encoding):
            text = line_feeds(F.coalesce(got["value"], self._decoded(v, t)))
            raw = F.encode(text, "UTF-8")
            bad = v.isNotNull() & raw.isNull()
            long = F.octet_length(raw) > self.max_bytes
            cut = F.lit(None).cast("binary")
            if self.truncate:
                whole = F.encode(F.concat(F.lit(self.prefix), text), "UTF-8")
                cut = F.coalesce(*[F.encode(F.try_validate_utf8(F.substring(whole, 1, n).cast("string")), "UTF-8") for n in range(self.max_bytes, max(self.max_bytes - 4, -1), -1)])
            code = F.when(wrong, "wrong_type").when(bad, "wrong_encoding").when(long, "too_long")
            value = F.when(code.isNull(), raw).when(code == "too_long", cut)
        else:
            code = F.when(wrong, "wrong_type").otherwise(got["code"])
            value = F.when(~F.coalesce(wrong, F.lit(False)), got["value"])
        message = F.when(code == "too_long", f"is longer than {self.max_bytes} bytes").when(code == "wrong_type", "is neither text nor bytes").otherwise(f"is not encoded as {self.encoding}")
        return Outcome(value, F.when(code.isNotNull(), F.array(issue(path, code, message, self.name, shown(v, t)))).otherwise(no_issues()), T.BinaryType())


class ByteArray(Called):
    """Bytes, from text in the encoding, from bytes, or from an array of whole numbers from 0 to 255. Faults of an array
    are reported at its elements. Encodings other than UTF-8, ASCII and Latin-1 run in Python."""

    result = T.BinaryType()

    def __init__(self, encoding: str = "utf-8"):
        self.encoding = codecs.lookup(encoding).name
        self.python = self._call()

    def _call(self) -> Callable:
        encoding = self.encoding

        def run(text: str) -> tuple[bytes | None, str | None]:
            try:
                return text.encode(encoding), None
            except UnicodeEncodeError:
                return None, "bad_encoding"

        return run

    def _in_python(self, t: T.DataType) -> bool:
        return self.encoding not in NATIVE and isinstance(t, T.StringType)

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        if isinstance(t, T.ArrayType):
            return self._numbers(v, t, path)
        if self.encoding not in NATIVE and isinstance(t, (T.StringType, T.VariantType)):
            return super().compile(v, t, path)
        if isinstance(t, T.VariantType):
            array = kind_of(v).rlike("^ARRAY")
            a = self._numbers(F.when(array, F.try_variant_get(v, "$", "array<variant>")), T.ArrayType(t), path)
            o = Step.compile(self, F.when(~array, v), t, path)
            return Outcome(F.when(array, a.value).otherwise(o.value), F.when(array, a.issues).otherwise(o.issues), o.dtype)
        return Step.compile(self, v, t, path)

    def column(self, df, state, t):
        return super().column(df, state, t) if self._in_python(t) else Step.column(self, df, state, t)

    def elements(self, df, states, t):
        return super().elements(df, states, t) if self._in_python(t) else Step.elements(self, df, states, t)

    def needs(self, v: Column, t: T.DataType) -> Column:
        return v

    def finish(self, v: Column, t: T.DataType, got: Column, path: Column) -> Outcome:
        return self.outcome([(got["code"].isNotNull(), "bad_encoding", f"can't be encoded as {self.encoding}")], got["value"], T.BinaryType(), v, t, path)

    def tests(self, v: Column, t: T.DataType) -> list:
        if isinstance(t, T.BinaryType):
            return []
        text, wrong = _text(v, t)
        highest = {"ascii": r"[^\x{0}-\x{7F}]", "iso8859-1": r"[^\x{0}-\x{FF}]"}.get(self.encoding)
        return [(wrong, "wrong_type", "is neither bytes nor text"), *([(text.rlike(highest), "bad_encoding", f"can't be encoded as {self.encoding}")] if highest else [])]

    def convert(self, v: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        if isinstance(t, T.BinaryType):
            return v, t
        text = _text(v, t)[0]
        fits = F.when(text.rlike("[^\\x{0}-\\x{7F}]"), F.lit("")).otherwise(text) if self.encoding == "ascii" else F.when(text.rlike("[^\\x{0}-\\x{FF}]"), F.lit("")).otherwise(text) if self.encoding == "iso8859-1" else text
        return F.encode(fits, NATIVE.get(self.encoding, "UTF-8")), T.BinaryType()

    def _numbers(self, v: Column, t: T.ArrayType, path: Column) -> Outcome:
        e = t.elementType

        def fault(x: Column, i: Column) -> Column:
            if isinstance(e, T.VariantType):
                number = F.when(kind_of(x).rlike("^(BIGINT|INT|SMALLINT|TINYINT|BOOLEAN)"), F.try_variant_get(x, "$", "bigint"))
                null, wrong = x.isNull() | (kind_of(x) == "VOID"), number.isNull()
            elif isinstance(e, (T.IntegralType, T.BooleanType)):
                number, null, wrong = x.cast("long"), x.isNull(), F.lit(False)
            else:
                number, null, wrong = F.lit(None).cast("long"), x.isNull(), F.lit(True)
            code = F.when(null, "exception").when(wrong, "wrong_type").when(number < 0, "too_small").when(number > 255, "too_big")
            return F.when(code.isNotNull(), issue(below(path, i), code, "is not a byte", self.name, shown(x, e)))

        faults = F.coalesce(F.filter(F.transform(v, fault), lambda x: x.isNotNull()), no_issues())
        number = lambda x: F.try_variant_get(x, "$", "bigint") if isinstance(e, T.VariantType) else x.cast("long") if isinstance(e, (T.IntegralType, T.BooleanType)) else F.lit(0).cast("long")
        raw = F.unhex(F.array_join(F.transform(v, lambda x: F.lpad(F.hex(number(x)), 2, "0")), ""))
        return Outcome(F.when(F.size(faults) == 0, raw), faults, T.BinaryType())


class _OnText(Step):
    """Takes text; all else has the wrong type."""

    def tests(self, v: Column, t: T.DataType) -> list:
        text, wrong = _text(v, t)
        return [(wrong, "wrong_type", "is not text"), *self.bad(text)]

    def bad(self, text: Column) -> list:
        return []

    def convert(self, v: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        return self.made(_text(v, t)[0])

    def made(self, text: Column) -> tuple[Column, T.DataType]:
        return text, T.StringType()


class Base64Decode(Step):
    """Bytes from base64 text in bytes, of the standard or the URL-safe alphabet but not both. White space and missing or
    excess padding are forgiven."""

    def stages(self, t: T.DataType) -> list[Callable[[Column], Column]]:
        if not isinstance(t, T.BinaryType):
            return []

        def bare(v: Column) -> Column:
            text = F.regexp_replace(F.try_validate_utf8(v.cast("string")), r"[ \t\n\x0B\f\r]+", "")
            return F.struct(v.isNotNull().alias("there"), F.rtrim(text, F.lit("=")).alias("bare"))

        def raw(x: Column) -> Column:
            bare = x["bare"]
            known = bare.rlike(r"\A(?:[A-Za-z0-9+/]*|[A-Za-z0-9_-]*)\z") & (F.char_length(bare) % 4 != 1)
            padded = F.concat(F.translate(bare, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.char_length(bare), F.lit(4))))
            return F.struct(x["there"].alias("there"), F.when(known, F.try_to_binary(padded, F.lit("base64"))).alias("raw"))

        return [bare, raw]

    def judge(self, v: Column, t: T.DataType, got: Column) -> tuple[list, Column, T.DataType]:
        if not self.stages(t):
            return [(v.isNotNull(), "wrong_type", "is not bytes")], F.lit(None).cast("binary"), T.BinaryType()
        return [(got["there"] & got["raw"].isNull(), "not_base64", "is not base64")], got["raw"], T.BinaryType()


class CaseFold(_OnText):
    """Text folded for comparison without case: ß becomes ss."""

    def made(self, text: Column) -> tuple[Column, T.DataType]:
        return folded(text), T.StringType()


class JsonDecode(Called):
    """A variant from JSON text. JSON null becomes null. NaN, endless numbers and objects that name a key twice are no JSON
    here. decoder: a function from text to anything that json.dumps can write, for other dialects; it runs in Python."""

    #: Fixed value: what a whole JSON text looks like from outside. What follows a complete value is not forgiven.
    WHOLE = r"(?s)\A\s*(?:\{.*\}|\[.*\]|\"(?:[^\"\\]++|\\.)*+\"|-?[0-9][0-9.eE+-]*|true|false|null)\s*\z"

    def __init__(self, decoder: Callable | None = None):
        self.decoder = decoder
        self.python = self._call()

    def _call(self) -> Callable:
        decoder = self.decoder

        def run(text: str) -> tuple[str | None, str | None]:
            try:
                return json.dumps(decoder(text)), None
            except ValueError:
                return None, "not_json"

        return run

    def stages(self, t: T.DataType) -> list[Callable[[Column], Column]]:
        def read(v: Column) -> Column:
            text = _text(v, t)[0]
            return F.struct(text.isNotNull().alias("there"), F.when(text.rlike(self.WHOLE), F.try_parse_json(text)).alias("value"))

        return [read]

    def judge(self, v: Column, t: T.DataType, got: Column) -> tuple[list, Column, T.DataType]:
        value, wrong = got["value"], _text(v, t)[1]
        tests = [(wrong, "wrong_type", "is not text"), (got["there"] & value.isNull(), "not_json", "is not JSON")]
        return tests, F.when(~F.is_variant_null(value), value), T.VariantType()

    def compile(self, v: Column, t: T.DataType, path: Column) -> Outcome:
        return Called.compile(self, v, t, path) if self.decoder else Step.compile(self, v, t, path)

    def column(self, df, state, t):
        return Called.column(self, df, state, t) if self.decoder else Step.column(self, df, state, t)

    def element(self, states, t):
        return Step.element(self, states, t) if self.decoder else Step.element(self, states, t)

    def elements(self, df, states, t):
        return Called.elements(self, df, states, t) if self.decoder else Step.elements(self, df, states, t)

    def needs(self, v: Column, t: T.DataType) -> Column:
        return _text(v, t)[0]

    def finish(self, v: Column, t: T.DataType, got: Column, path: Column) -> Outcome:
        there = F.struct(_text(v, t)[0].isNotNull().alias("there"), F.try_parse_json(got["value"]).alias("value"))
        return self.outcome(*self.judge(v, t, there), v, t, path)


def _pattern(pattern: object) -> str:
    """A pattern's text with its flags; compiled patterns of re and regex are taken by their attributes."""
    if isinstance(pattern, str):
        return FLAGS + pattern
    text, flags = pattern.pattern, getattr(pattern, "flags", 0)
    marks = "".join(c for c, f in (("i", re.IGNORECASE), ("m", re.MULTILINE), ("s", re.DOTALL), ("x", re.VERBOSE)) if flags & f)
    return (f"(?{marks})" if marks else "") + FLAGS + text


def _groups(pattern: object) -> int:
    return regex.compile(pattern if isinstance(pattern, str) else pattern.pattern).groups


class Regex(_OnText):
    """All whole matches of the pattern, as an array; without any the value is malformed."""

    def __init__(self, pattern: object):
        self.pattern = _pattern(pattern)

    def bad(self, text: Column) -> list:
        return [(~text.rlike(self.pattern), "malformed", "doesn't match the pattern")]

    def made(self, text: Column) -> tuple[Column, T.DataType]:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), T.ArrayType(T.StringType())


class Split(Called):
    """Text split at matches of the pattern, what its groups caught included. keys name the parts: a struct, with nulls for
    parts that are missing; more parts than keys are too many. Patterns with groups or that match nothing run in Python."""

    result = T.ArrayType(T.StringType())

    def __init__(self, pattern: object, keys: Iterable[str] | None = None):
        self.source = pattern if isinstance(pattern, str) else pattern.pattern
        self.flags = 0 if isinstance(pattern, str) else pattern.flags & (2 | 8 | 16 | 64)
        self.pattern, self.keys = _pattern(pattern), None if keys is None else list(keys)
        self.in_python = _groups(pattern) > 0 or regex.fullmatch(self.source, "") is not None
        self.python = self._call()

    def _call(self) -> Callable:
        source, flags = self.source, self.flags
        return lambda text: (regex.compile(source, flags | regex.V1).split(text), None)

    def compile(self, v, t, path):
        return super().compile(v, t, path) if self.in_python else self.finish(v, t, None, path)

    def column(self, df, state, t):
        return super().column(df, state, t) if self.in_python else Step.column(self, df, state, t)

    def elements(self, df, states, t):
        return super().elements(df, states, t) if self.in_python else Step.elements(self, df, states, t)

    def needs(self, v: Column, t: T.DataType) -> Column:
        return _text(v, t)[0]

    def finish(self, v: Column, t: T.DataType, got: Column | None, path: Column) -> Outcome:
        text, wrong = _text(v, t)
        parts = got["value"] if self.in_python else F.split(text, self.pattern, -1)
        code = F.when(wrong, "wrong_type")
        new: T.DataType = T.ArrayType(T.StringType())
        value = parts
        if self.keys is not None:
            code = code.when(F.size(parts) > len(self.keys), "too_long")
            new = T.StructType([T.StructField(k, T.StringType()) for k in self.keys])
            value = F.when(parts.isNotNull(), F.struct(*[F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(self.keys)]))
        message = F.when(code == "wrong_type", "is not text").otherwise("has too many parts")
        return Outcome(F.when(code.isNull(), value), F.when(code.isNotNull(), F.array(issue(path, code, message, self.name, shown(v, t)))).otherwise(no_issues()), new)


class Strip(_OnText):
    """Text without what the patterns match at its start and end; by default white space and unprintable characters. A
    false pattern leaves that end alone. The patterns are anchored as they are: an alternation is not grouped."""

    def __init__(self, leading: str | None = r"[\p{C}\s]+", trailing: str | None = r"[\p{C}\s]+"):
        self.leading, self.trailing = leading, trailing

    def made(self, text: Column) -> tuple[Column, T.DataType]:
        if self.leading:
            text = F.regexp_replace(text, F.lit(f"{FLAGS}^{self.leading}"), F.lit(""))
        if self.trailing:
            text = F.regexp_replace(text, F.lit(f"{FLAGS}{self.trailing}$"), F.lit(""))
        return text, T.StringType()


class Uuid(Step):
    """A UUID in its canonical form, from text with or without dashes, braces or the urn:uuid: prefix."""

    def __init__(self, version: int | None = None):
        self.version = version

    def stages(self, t: T.DataType) -> list[Callable[[Column], Column]]:
        def digits(v: Column) -> Column:
            text = F.replace(F.replace(_text(v, t)[0], F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
            return F.lower(F.replace(F.btrim(text, F.lit("{}")), F.lit("-"), F.lit("")))

        return [digits]

    def judge(self, v: Column, t: T.DataType, got: Column) -> tuple[list, Column, T.DataType]:
        tests = [(_text(v, t)[1], "wrong_type", "is not text"), (~got.rlike(r"\A[0-9a-f]{32}\z"), "not_uuid", "is not a UUID")]
        if self.version is not None:
            tests.append((~got.rlike(rf"\A[0-9a-f]{{12}}{self.version:x}[0-9a-f]{{3}}[89ab]"), "wrong_version", f"is not a version {self.version} UUID"))
        dashed = F.concat_ws("-", *[F.substring(got, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
        return tests, F.when(got.isNotNull(), dashed), T.StringType()


class Optional(Step):
    """The default in place of a null or empty value."""

    def __init__(self, default: object = None):
        self.default = default

    def convert(self, v: Column, t: T.DataType) -> tuple[Column, T.DataType]:
        n = length_of(v, t)
        empty = v.isNull() if n is None else v.isNull() | (n == 0)
        if isinstance(t, T.VariantType):
            return F.when(F.coalesce(empty | F.is_variant_null(v), F.lit(False)), F.parse_json(F.lit(json.dumps(self.default)))).otherwise(v), t
        default = F.lit(self.default)
        if isinstance(self.default, (dict,)):
            default = F.create_map(*[F.lit(x) for p in self.default.items() for x in p]) if self.default else F.create_map()
        return F.when(F.coalesce(empty, F.lit(False)), default.cast(t)).otherwise(v), t


__all__ = ["Base64Decode", "ByteArray", "ByteString", "CaseFold", "JsonDecode", "MaxBytes", "Optional", "Regex", "Split", "Strip", "Unicode", "Uuid"]
