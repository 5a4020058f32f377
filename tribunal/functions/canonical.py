"""Canonical JSON as a column: keys sorted, no blanks, ASCII only, and the shortest decimals that read back as the same number.

The text is that of json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True) for the same value, so that digests agree with those of
other tools. The form is compiled from the column's type; nothing runs in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructType

_WHOLE = (ByteType, ShortType, IntegerType, LongType)
#: The short escapes of JSON.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _unit(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def _escaped(c: Column) -> Column:
    """A character that doesn't stand for itself; those beyond 16 bits are two units."""
    code = F.ascii(c).cast("long")
    far = code - 0x10000
    two = F.concat(_unit(F.shiftright(far, 10) + 0xD800), _unit(far.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
    out = F.when(c.between(" ", "~"), c).when(code < 0x10000, _unit(code)).otherwise(two)
    short = F.lit(None).cast("string")
    for k, v in _SHORT.items():
        short = F.when(c == k, v).otherwise(short)
    return F.coalesce(short, out)


def json_text(x: Column) -> Column:
    """A string as JSON in ASCII."""
    escaped = F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), _escaped), "")
    plain = ~x.rlike(r'[^ -~]|["\\]')
    return F.concat(F.lit('"'), F.when(plain, x).otherwise(escaped), F.lit('"'))


def json_number(x: Column) -> Column:
    """A double as its shortest decimal: of 15, 16 or 17 digits the first that reads back, without zeros at its end. Subnormal ones may need fewer.

    Of two decimals of 16 digits that both read back, the one nearer to the platform's own 17 digits is taken, whose last digit may be wrong: of doubles of
    random bits, about one in 100,000 so gets the other decimal of the same length.
    """

    def written(s: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(F.split_part(s, F.lit("e"), F.lit(1)), "[-.]", ""), "0+$", "")
        return _with(F.struct(digits.alias("d"), F.split_part(s, F.lit("e"), F.lit(2)).cast("int").alias("e")), placed)

    def placed(p: Column) -> Column:
        d, e = p["d"], p["e"]
        n = F.length(d)
        whole = F.when(n > e + 1, F.concat(F.substr(d, F.lit(1), e + 1), F.lit("."), F.substr(d, e + 2))).otherwise(F.concat(F.rpad(d, e + 1, F.lit("0")), F.lit(".0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        tail = F.when(n > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise(F.lit(""))
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        far = F.concat(F.substr(d, F.lit(1), F.lit(1)), tail, F.lit("e"), power)
        return F.when((e >= 0) & (e < 16), whole).when((e < 0) & (e >= -4), small).otherwise(far)

    size = F.abs(x)
    reads_back = lambda s: F.when(s.cast("double") == size, s)
    of = lambda k: F.format_string(f"%.{k - 1}e", size)

    def beside(s: Column) -> list[Column]:
        """The decimals of 16 digits on either side of one of 17, whose last digit the platform's own conversion may have wrong."""
        power = F.concat(F.lit("e"), F.split_part(s, F.lit("e"), F.lit(2)))
        low = F.regexp_replace(F.substr(s, F.lit(1), F.lit(17)), "[.]", "").cast("long")
        write = lambda n: F.concat(F.substr(n.cast("string"), F.lit(1), F.lit(1)), F.lit("."), F.substr(n.cast("string"), F.lit(2)), power)
        nearer = F.substr(s, F.lit(18), F.lit(1)).cast("int") + low.bitwiseAND(F.lit(1))  # of a 5, the even one
        below, above = (F.when(n < 10**16, write(n)) for n in (low, low + 1))
        return [F.when(nearer > 5, above).otherwise(below), F.when(nearer > 5, below).otherwise(above)]

    sixteen = _with(of(17), lambda s: F.coalesce(*map(reads_back, beside(s))))
    usual = F.coalesce(reads_back(of(15)), sixteen, of(17))
    shortest = F.when(size < 2.2250738585072014e-308, F.coalesce(*[reads_back(of(k)) for k in range(1, 18)])).otherwise(usual)
    below = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    finite = F.concat(below, F.when(x == 0, "0.0").otherwise(written(shortest)))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").otherwise(finite)


def canonical_json(x: Column, kind: DataType | str) -> Column:
    """x, of this type (or its DDL), as canonical JSON. Keys of maps must be strings; types without a form in JSON are refused."""
    if isinstance(kind, str):
        kind = DataType.fromDDL(kind)
    if isinstance(kind, NullType):
        return F.lit("null")
    if isinstance(kind, StringType):
        out = json_text(x)
    elif isinstance(kind, BooleanType):
        out = F.when(x, "true").otherwise("false")
    elif isinstance(kind, _WHOLE):
        out = x.cast("string")
    elif isinstance(kind, (DoubleType, FloatType)):
        out = json_number(x.cast("double"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda e: canonical_json(e, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType) and isinstance(kind.keyType, StringType):
        pairs = F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(json_text(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType)))
        out = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, StructType):
        import json

        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [p for n, f in enumerate(fields) for p in (F.lit(("," if n else "") + json.dumps(f.name) + ":"), canonical_json(x[f.name], f.dataType))]
        out = F.concat(F.lit("{"), *parts, F.lit("}"))
    else:
        raise TypeError(f"{kind.simpleString()} has no form in JSON")
    return F.when(x.isNull(), "null").otherwise(out)
