"""JSON text columns."""

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from workloom.session import last_key_wins, ship_package

#: Parsed documents hold numbers of up to 38 digits exactly.
_LONG_NUMBER = "[0-9.]{39}"
#: Numbers of more digits than this are left as they were written.
_MOST_DIGITS = 131_072
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def canonical_payload(text: Column | str) -> Column:
    """JSON with sorted keys and no spare spaces, so equal documents are equal strings.

    The last of repeated keys counts. Numbers of any length keep all their digits; a document with one above 38
    digits writes all its numbers without exponent. Null for text that is not JSON. Sets `last_key_wins`.
    """
    text = F.col(text) if isinstance(text, str) else text
    last_key_wins(SparkSession.active())
    document = F.try_parse_json(text)
    return with_long_numbers(F.to_json(document), F.when(document.isNotNull(), text))


def with_long_numbers(canonical: Column, text: Column, field: str | None = None) -> Column:
    """`canonical`, or for texts with numbers above 38 digits the same with all digits.

    With `field`, `canonical` is the member of `text` that `fields` calls so. Texts without such numbers reach
    Python as nulls.
    """
    ship_package(SparkSession.active())

    @F.pandas_udf("string")
    def exact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else exact_json(t, field))

    return F.coalesce(exact(F.when(F.regexp_like(text, F.lit(_LONG_NUMBER)), text)), canonical)


class _Number(str):
    """A number as it was written."""


def exact_json(text: str, field: str | None = None) -> str | None:
    """The first JSON value in `text`, or its last member whose folded name is `field`, in canonical form."""
    reader = json.JSONDecoder(parse_int=_Number, parse_float=_Number,
                              object_pairs_hook=(lambda pairs: pairs) if field else dict)
    try:
        value, _ = reader.raw_decode(text.lstrip(" \t\r\n"))
    except (ValueError, RecursionError):
        return None
    if field is None:
        return _write(value)
    found = [v for k, v in value if k.replace("ſ", "s").lower() == field]
    return _write(found[-1]) if found else None


def _write(value) -> str:
    if isinstance(value, _Number):
        return _plain(value)
    if isinstance(value, list) and value and isinstance(value[0], tuple):
        value = dict(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_write(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_write, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _plain(number: str) -> str:
    value = Decimal(number)
    if abs(value.adjusted()) > _MOST_DIGITS:
        return str(number)
    digits = format(value, "f")
    if "." in digits:
        digits = digits.rstrip("0").rstrip(".")
    return "0" if digits == "-0" else digits


def entries(text: Column, kind: str = "map<string,variant>") -> Column:
    """The members of the JSON object at the start of `text`, in their order and with repeated keys; else null.

    Needs `last_key_wins` for objects inside members that repeat a key.
    """
    return F.map_entries(F.from_json(text, kind, _STRICT))


def fields(members: Column, name: str) -> Column:
    """The values, in order, of the members whose name is `name` in any case."""
    named = F.filter(members, lambda m: F.lower(F.translate(m["key"], "ſ", "s")) == name)
    return F.transform(named, lambda m: m["value"])


def is_text_or_null(values: Column) -> Column:
    """Whether no value is anything but a text or a JSON null."""
    return F.forall(values, lambda v: v.isNull() | F.schema_of_variant(v).isin("STRING", "VOID"))


def last_text(values: Column) -> Column:
    """The last text among `values`, empty if there is none: a JSON null changes nothing."""
    texts = F.filter(values, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.try_element_at(texts, F.lit(-1)).cast("string"), F.lit(""))
