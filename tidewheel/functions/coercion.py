"""Turning loosely typed values into those of a sink's columns, and JSON text into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Epoch numbers below this count seconds, others milliseconds.
SECONDS_BELOW = (1 << 32) - 1


def epoch_time(n: Column) -> Column:
    """A time without zone from epoch seconds or milliseconds, told apart by size."""
    n = n.cast("long")
    return F.when(n < SECONDS_BELOW, F.timestamp_seconds(n)).otherwise(F.timestamp_millis(n)).cast("timestamp_ntz")


def text_time(s: Column) -> Column:
    """A time from text to the second (19 characters), to the millisecond (23) or longer; null for other texts."""
    plain = F.left(F.replace(s, F.lit("T"), F.lit(" ")), F.lit(26))
    return F.when(F.length(s) >= 19, plain.try_cast("timestamp_ntz"))


# What stands for a null in a column without nulls, by type.
DEFAULTS = {"string": "", "tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "boolean": False}
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def number(value: Column, kind: str, default: bool = True) -> Column:
    """A number or a string as a number of a type; too large whole numbers keep their low bits; what is none is the default."""
    if kind in _BITS:
        exact = value.try_cast("decimal(30,6)")
        whole = F.when(exact < 0, F.ceil(exact)).otherwise(F.floor(exact)).cast("decimal(38,0)")
        span = F.lit(str(1 << _BITS[kind])).cast("decimal(20,0)")
        low = F.pmod(whole, span)
        out = F.when(low >= F.lit(str(1 << (_BITS[kind] - 1))).cast("decimal(20,0)"), low - span).otherwise(low).cast(kind)
    else:
        out = value.try_cast(kind)
    return F.coalesce(out, F.lit(DEFAULTS[kind]).cast(kind)) if default else out


def with_default(value: Column, kind: str) -> Column:
    """value as the type, or the type's default for null."""
    return F.coalesce(value.try_cast(kind), F.lit(DEFAULTS[kind]).cast(kind))


def each_number(values: Column, kind: str) -> Column:
    """The elements of an array as numbers; an array that is null is empty."""
    return F.coalesce(F.transform(values, lambda v: number(v, kind)), F.array().cast(f"array<{kind}>"))


def each_value(values: Column, kind: str) -> Column:
    """The values of a map from strings as numbers; a map that is null is empty."""
    return F.coalesce(F.transform_values(values, lambda _, v: number(v, kind)), F.create_map().cast(f"map<string, {kind}>"))


def json_row(text: Column, schema: str | StructType) -> Column:
    """A struct from JSON text. Missing fields and JSON nulls are null, numbers in quotes count as numbers, and objects,
    arrays and numbers in string fields keep their JSON text. If the text is no object or a value does not fit, all
    fields are null; the row stays."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    loose = "struct<" + ",".join(f"`{f.name}`:string" for f in kinds.fields) + ">"
    row = F.from_json(text, loose, {"mode": "PERMISSIVE", "allowSingleQuotes": "true", "allowUnquotedControlChars": "true", "primitivesAsString": "true"})
    is_object = F.trim(text).startswith("{")
    parsed = F.when(is_object & row.isNotNull(), row)

    def typed(r: Column) -> Column:
        fits, fields = F.lit(True), []
        for f in kinds.fields:
            value = r[f.name] if f.dataType.simpleString() == "string" else r[f.name].try_cast(f.dataType)
            fits = fits & (r[f.name].isNull() | value.isNotNull())
            fields.append((f.name, value))
        return F.struct(*[F.when(fits, value).alias(name) for name, value in fields])

    # as an element of an array the parsed row has a name, and is not parsed again for each field
    return F.get(F.transform(F.array(parsed), typed), 0)


def json_checked(text: Column, schema: str | StructType, fail_on_missing: bool = False, ignore_errors: bool = False) -> Column:
    """json_row that tells good rows from bad ones. A text that is no object, a value that does not fit its field, and with
    fail_on_missing a field that is not there, stop the query; with ignore_errors the struct is null instead."""
    kinds = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    row, keys = json_row(text, kinds), F.json_object_keys(text)
    bad = keys.isNull()
    for f in kinds.fields:
        there = F.array_contains(keys, F.lit(f.name))
        if fail_on_missing:
            bad = bad | ~there
        bad = bad | (there & F.get_json_object(text, f"$.{f.name}").isNotNull() & row[f.name].isNull())
    bad = F.coalesce(bad, F.lit(True))
    if ignore_errors:
        return F.when(~bad, row)
    said = F.concat(F.lit("no row of the schema: "), F.coalesce(F.left(text, F.lit(200)), F.lit("null")))
    return F.when(bad, F.raise_error(said).cast(kinds)).otherwise(row)
