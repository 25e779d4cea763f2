"""Rows of any depth as plain JSON text, byte for byte as a standard writer spaces it, and what they weigh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Characters that JSON names by a letter.
_NAMED = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"))
_OTHERS = tuple(chr(c) for c in range(32) if chr(c) not in "\n\r\t\b\f")


def _text(value: Column) -> Column:
    out = value
    for c, named in _NAMED:
        out = F.replace(out, F.lit(c), F.lit(named))
    control = out
    for c in _OTHERS:
        control = F.replace(control, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    # hardly any text has the other control characters
    out = F.when(F.regexp_like(out, F.lit(r"[\x00-\x1f]")), control).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def _number(value: Column) -> Column:
    """A double in the digits that Spark's cast gives: plain from 1e-4 up to 1e16, else with an exponent of two digits
    or more. Casts of a few doubles (some powers and the smallest numbers) have a digit more than the shortest form."""
    digits = value.cast("string")
    mantissa, exponent = F.regexp_extract(digits, r"^(-?[0-9.]+)(?:E(-?\d+))?$", 1), F.coalesce(F.regexp_extract(digits, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    figures = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), "[-.]", "")
    sign, head = F.when(F.startswith(mantissa, F.lit("-")), "-").otherwise(""), F.length(F.regexp_extract(mantissa, r"^-?(\d+)", 1))
    point = head + exponent  # digits before the point
    size = F.length(figures)
    shifted = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), figures))
        .when(point >= size, F.concat(figures, F.repeat(F.lit("0"), point - size), F.lit(".0")))
        .otherwise(F.concat(F.left(figures, point), F.lit("."), F.substring(figures, point + 1, size)))
    )
    power = F.concat(F.left(figures, F.lit(1)), F.when(size > 1, F.concat(F.lit("."), F.substring(figures, F.lit(2), size))).otherwise(""), F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    wide = (exponent != 0) & ((point > 16) | (point < -3))
    written = F.when(exponent == 0, mantissa).when(wide, F.concat(sign, power)).otherwise(F.concat(sign, shifted))
    return F.when(F.isnan(value), "NaN").when(value == float("inf"), "Infinity").when(value == float("-inf"), "-Infinity").otherwise(written)


def plain(value: Column, kind: S.DataType) -> Column:
    """JSON text of a value of this type: ", " and ": " between parts, nulls kept, fields in their order, keys of maps sorted,
    dates and times in ISO form, characters beyond ASCII as they are, binary in hexadecimal digits."""
    if isinstance(kind, S.StructType):
        fields = [F.concat(_text(F.lit(f.name)), F.lit(": "), plain(value.getField(f.name), f.dataType)) for f in kind.fields]
        out = F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    elif isinstance(kind, S.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: plain(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, S.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("k"), plain(e["value"], kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_text(e["k"]), F.lit(": "), e["v"])), ", "), F.lit("}"))
    elif isinstance(kind, (S.DoubleType, S.FloatType)):
        out = _number(value.cast("double") if isinstance(kind, S.DoubleType) else value.cast("string").cast("double"))
    elif isinstance(kind, (S.IntegralType, S.BooleanType, S.DecimalType)):
        out = value.cast("string")
    elif isinstance(kind, (S.TimestampType, S.TimestampNTZType)):
        seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        out = _text(F.concat(F.when(micros == "000000", seconds).otherwise(F.concat_ws(".", seconds, micros)), F.lit("+00:00" if isinstance(kind, S.TimestampType) else "")))
    elif isinstance(kind, S.BinaryType):
        out = _text(F.lower(F.hex(value)))
    elif isinstance(kind, (S.StringType, S.DateType, S.NullType)):
        out = _text(value.cast("string"))
    else:
        raise TypeError(f"no JSON form of {kind.simpleString()}")
    return F.coalesce(out, F.lit("null"))


def payload_size(value: Column, kind: S.DataType) -> Column:
    """Characters of a value's JSON text: what it takes of the budget of a request."""
    return F.length(plain(value, kind)).cast("long")
