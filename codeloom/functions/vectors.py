"""Column functions on vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def _same(a: Column, b: Column, value: Column) -> Column:
    """The value, null where either vector is; vectors of different lengths are an error."""
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vector lengths differ")))


def l2(a: Column, b: Column) -> Column:
    return _same(a, b, F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(a, b, lambda x, y: F.abs(x - y)))


def dot(a: Column, b: Column) -> Column:
    return _same(a, b, _sum(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two array<tinyint>."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.cast("int").bitwiseXOR(y.cast("int")).bitwiseAND(255)))
    return _same(a, b, F.aggregate(bits, F.lit(0), lambda s, v: s + v))


def add(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x + y))


def sub(a: Column, b: Column) -> Column:
    return _same(a, b, F.zip_with(a, b, lambda x, y: x - y))


def cut(v: Column, start: int, end: int) -> Column:
    """Components start..end - 1, from 0."""
    if start < 0 or end <= start:
        raise ValueError("0 <= start < end is asked for")
    return F.when(F.size(v) >= end, F.slice(v, start + 1, end - start)).otherwise(F.raise_error(F.lit("the slice ends beyond the vector")))


def normalize(v: Column) -> Column:
    """Of unit length; a zero vector becomes NaN throughout."""
    norm = F.sqrt(dot(v, v))
    scaled = lambda n: F.transform(v, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / n))
    return F.element_at(F.transform(F.array(norm), scaled), 1)


def quantize_int8(v: Column) -> Column:
    """Components in -1..1 to -128..127."""
    step = 2.0 / 255.0

    def one(x: Column) -> Column:
        raw = (x.cast("double") + 1.0) / step - 128.0
        whole = F.when(raw >= 0, F.floor(raw)).otherwise(F.ceil(raw))
        return F.greatest(F.lit(-128), F.least(F.lit(127), whole)).cast("tinyint")

    return F.transform(v, one)


def quantize_bits(v: Column) -> Column:
    """Bit i is set where component i is above 0, the lowest bit first, eight to a byte."""
    whole = F.when(F.size(v) % 8 == 0, v).otherwise(F.raise_error(F.lit("the length is no multiple of 8")))

    def byte(k: Column) -> Column:
        bits = [F.when(F.get(v, 8 * k + i) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(8)]
        total = bits[0]
        for b in bits[1:]:
            total = total + b
        return F.when(total > 127, total - 256).otherwise(total).cast("tinyint")

    return F.transform(F.sequence(F.lit(0), (F.size(whole) / 8).cast("int") - 1), byte)


def from_json(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def to_json(v: Column) -> Column:
    """Six decimals a component; NaN and null as null."""
    one = lambda x: F.when(x.isNull() | F.isnan(x), F.lit("null")).otherwise(F.format_string("%.6f", x.cast("double")))
    return F.concat(F.lit("["), F.array_join(F.transform(v, one), ","), F.lit("]"))


def score_of_distance(d: Column) -> Column:
    """The cosine of unit vectors at an L2 distance."""
    return F.lit(1.0) - d * d / 2.0


def length(v: Column) -> Column:
    """The number of components of a vector; null of null."""
    return F.when(v.isNotNull(), F.size(v))


def kind(element_type: str) -> str:
    """How vectors of an element type are stored: float32, int8 or bit."""
    return {"float": "float32", "double": "float32", "tinyint": "int8", "byte": "int8", "binary": "bit"}[element_type]
