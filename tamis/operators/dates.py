"""Steps that make dates and times, in UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.functions.native import kind_of
from tamis.operators.predicates import _text
from tamis.plans.core import Called, Outcome, Step, issue, no_issues, shown

#: A full date, with or without a time and a zone.
ISO = r"\A\s*([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:[T ]\s*([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?))?\s*(Z|z|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?)?\s*\z"
#: What fills in parts that a lenient text leaves out.
DEFAULT = datetime(1970, 1, 1)


def offset(zone: object) -> str:
    """A zone as Spark writes it after a time: from hours east of UTC, a tzinfo with a fixed offset, a name, or None (UTC)."""
    if zone is None:
        return "+00:00"
    if isinstance(zone, str):
        return " " + zone
    if isinstance(zone, tzinfo):
        if (name := getattr(zone, "key", None)) is not None:
            return " " + name
        zone = zone.utcoffset(None).total_seconds() / 3600
    minutes = round(float(zone) * 60)
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


class Datetime(Called):
    """A time in UTC: timestamp, or with naive timestamp_ntz.

    Text must hold a full date in ISO order; a text without zone is in `timezone`. A timestamp without zone is, too.
    lenient reads any wording that dateutil does, in Python; parts left out are those of 1970-01-01.
    """

    code, kind = "not_datetime", "a date and time"

    def __init__(self, timezone: object = None, naive: bool = False, lenient: bool = False):
        self.zone, self.naive, self.lenient = offset(timezone), naive, lenient
        self.python = self._call(timezone)

    def _call(self, zone: object):
        def run(text: str) -> tuple[str | None, str | None]:
            from zoneinfo import ZoneInfo

            from dateutil.parser import parse

            try:
                t = parse(text, default=DEFAULT)
            except OverflowError:
                return None, "exception"
            except ValueError:
                return None, self.code
            if t.tzinfo is None:
                z = timezone.utc if zone is None else ZoneInfo(zone) if isinstance(zone, str) else zone if isinstance(zone, tzinfo) else timezone(timedelta(hours=float(zone)))
                t = t.replace(tzinfo=z)
            return t.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f+00:00"), None

        return run

    def compile(self, v, t, path):
        return super().compile(v, t, path) if self.lenient else self.finish(v, t, None, path)

    def column(self, df, state, t):
        return super().column(df, state, t) if self.lenient else Step.column(self, df, state, t)

    def elements(self, df, states, t):
        return super().elements(df, states, t) if self.lenient else Step.elements(self, df, states, t)

    def needs(self, v: Column, t: T.DataType) -> Column:
        text, _ = _text(v, t)
        return F.when(self._iso(text).isNull(), text)

    def _iso(self, text: Column) -> Column:
        part = lambda n: F.regexp_extract(text, ISO, n)
        zone = F.regexp_replace(F.regexp_replace(part(3), "^(?:[zZ]|UTC|GMT)$", "+00:00"), r"^([+-]\d\d):?(\d\d)?$", "$1:$2")
        zone = F.when(zone == "", self.zone).otherwise(F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone))
        clock = F.when(part(2) == "", "00:00:00").when(part(2).rlike("^[0-9]+:[0-9]+$"), F.concat(part(2), F.lit(":00"))).otherwise(part(2))
        return F.when(text.rlike(ISO), F.concat(part(1), F.lit("T"), clock, zone).try_cast("timestamp"))

    def when(self, v: Column, t: T.DataType, got: Column | None) -> Column:
        """The value as a timestamp; null where it is none."""
        if isinstance(t, T.TimestampType):
            return v
        if isinstance(t, (T.TimestampNTZType, T.DateType)):
            return F.concat(v.cast("timestamp_ntz").cast("string"), F.lit(self.zone)).try_cast("timestamp")
        text, _ = _text(v, t)
        return self._iso(text) if got is None else F.coalesce(self._iso(text), got["value"].try_cast("timestamp"))

    def utc(self, at: Column) -> Column:
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz"))

    def made(self, v: Column, t: T.DataType, at: Column) -> tuple[Column, T.DataType]:
        return (self.utc(at), T.TimestampNTZType()) if self.naive else (at, T.TimestampType())

    def finish(self, v: Column, t: T.DataType, got: Column | None, path: Column) -> Outcome:
        known = isinstance(t, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.VariantType))
        at = self.when(v, t, got) if known else F.lit(None).cast("timestamp")
        # numbers and the like are no text to read
        wrong = F.lit(not known) if not isinstance(t, T.VariantType) else ~kind_of(v).rlike("^(STRING|VOID)")
        said = got["code"] if got is not None else F.lit(None).cast("string")
        there = v.isNotNull() & (~kind_of(v).rlike("^VOID") if isinstance(t, T.VariantType) else F.lit(True))
        code = F.when(there & wrong, "exception").when(there & at.isNull(), F.coalesce(said, F.lit(self.code)))
        value, new = self.made(v, t, at)
        return Outcome(F.when(code.isNull(), value), F.when(code.isNotNull(), F.array(issue(path, code, f"is not {self.kind}", self.name, shown(v, t)))).otherwise(no_issues()), new)


class Date(Datetime):
    """A date: that of the time in UTC. Dates stay as they are."""

    code, kind = "not_date", "a date"

    def when(self, v: Column, t: T.DataType, got: Column | None) -> Column:
        return v.cast("timestamp") if isinstance(t, T.DateType) else super().when(v, t, got)

    def made(self, v: Column, t: T.DataType, at: Column) -> tuple[Column, T.DataType]:
        return (v if isinstance(t, T.DateType) else F.to_date(self.utc(at))), T.DateType()


__all__ = ["Date", "Datetime"]
