"""All steps."""

from tamis.operators.collections import Each, Fields, iterate
from tamis.operators.dates import Date, Datetime
from tamis.operators.lookups import Lookup
from tamis.operators.numbers import Decimal, Int, Round
from tamis.operators.predicates import Array, Choice, Empty, IpAddress, Length, Max, MaxLength, Min, MinLength, NoOp, NotEmpty, Required, Type
from tamis.operators.texts import Base64Decode, ByteArray, ByteString, CaseFold, JsonDecode, MaxBytes, Optional, Regex, Split, Strip, Unicode, Uuid

__all__ = ["Array", "Base64Decode", "ByteArray", "ByteString", "CaseFold", "Choice", "Date", "Datetime", "Decimal", "Each", "Empty", "Fields", "Int", "IpAddress", "JsonDecode", "Length", "Lookup", "Max", "MaxBytes", "MaxLength", "Min", "MinLength", "NoOp", "NotEmpty", "Optional", "Regex", "Required", "Round", "Split", "Strip", "Type", "Unicode", "Uuid", "iterate"]
