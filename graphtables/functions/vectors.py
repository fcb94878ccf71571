"""Vector functions over array columns, JVM-side: similarities, relation operators, quantization."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(x: Column, then) -> Column:
    """``then(x)``, with x worked out once however often it is used."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def negative_squared_distance(a: Column | str, b: Column | str) -> Column:
    return -F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


SIMILARITIES = {"dot": dot, "cosine": cosine, "euclidean": negative_squared_distance}


def l2_normalize(a: Column | str) -> Column:
    """The vector over its length, which is worked out once; zero vectors stay."""
    a = _col(a)
    return _let(F.greatest(norm(a), F.lit(1e-12)), lambda n: F.transform(a, lambda x: x / n))


def translate(a: Column | str, r: Column | str) -> Column:
    """Relation operator of translating models: a + r."""
    return F.zip_with(_col(a), _col(r), lambda x, y: x + y)


def diagonal(a: Column | str, r: Column | str) -> Column:
    """a * r, by component."""
    return F.zip_with(_col(a), _col(r), lambda x, y: x * y)


def complex_diagonal(a: Column | str, r: Column | str) -> Column:
    """Complex product by component; the first half holds real parts, the second imaginary ones."""
    a, r = _col(a), _col(r)
    half = F.floor(F.size(a) / 2).cast("int")
    real_a, imag_a, real_r, imag_r = F.slice(a, 1, half), F.slice(a, half + 1, half), F.slice(r, 1, half), F.slice(r, half + 1, half)
    sub, add = (lambda x, y: x - y), (lambda x, y: x + y)
    return F.concat(F.zip_with(diagonal(real_a, real_r), diagonal(imag_a, imag_r), sub), F.zip_with(diagonal(real_a, imag_r), diagonal(imag_a, real_r), add))


def linear(a: Column | str, matrix: Column | str) -> Column:
    """matrix (array of rows) times a."""
    return F.transform(_col(matrix), lambda row: dot(row, a))


RELATION_OPERATORS = {"translation": translate, "diagonal": diagonal, "complex_diagonal": complex_diagonal, "linear": linear, "identity": lambda a, r: _col(a)}


def feature_array(*columns: Column | str) -> Column:
    """Scalars and arrays, in order, as one array<float>; null features count as 0."""
    parts = [F.coalesce(F.flatten(F.array(_as_array(c))), F.array(F.lit(0.0).cast("float"))) for c in columns]
    return F.concat(*parts) if parts else F.array().cast("array<float>")


def _as_array(c: Column | str) -> Column:
    return F.array(F.coalesce(_col(c).cast("float"), F.lit(0.0).cast("float")))


def codes(features: Column | str, bits: int, low: Column | float, high: Column | float) -> Column:
    """Quantized codes of 1, 2, 4 or 8 bits: one bit is x > 0; else the clipped value scaled to 2^bits - 1, rounded half to even. A value
    that isn't finite fails the query that reads it."""
    if bits not in (1, 2, 4, 8):
        raise ValueError(f"codes have 1, 2, 4 or 8 bits, not {bits}")
    finite = lambda x: ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    features = _col(features)
    features = F.when(F.forall(features, lambda x: x.isNull() | finite(x)), features).otherwise(F.raise_error(F.lit("features to quantize are not finite")))
    if bits == 1:
        return F.transform(features, lambda x: (x > 0).cast("int"))
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.transform(features, lambda x: F.rint((F.least(F.greatest(x.cast("double"), lo), hi) - lo) / (hi - lo) * float((1 << bits) - 1)).cast("int"))


def pack(code: Column | str, bits: int) -> Column:
    """Codes packed to bytes, the first in the high bits, zeros filled in on the right."""
    per = 8 // bits

    def packed(code: Column) -> Column:
        def byte(i: Column) -> Column:
            out = F.lit(0)
            for k in range(per):
                at = i * per + k
                out = out + F.when(at < F.size(code), F.get(code, at)).otherwise(0) * (1 << (8 - bits * (k + 1)))
            return F.lpad(F.hex(out), 2, "0")

        count = F.ceil(F.size(code) / per).cast("int")
        hexes = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), byte)).otherwise(F.array().cast("array<string>"))
        return F.unhex(F.array_join(hexes, ""))

    return _let(_col(code), packed)


def unpack(packed: Column | str, bits: int, n: int) -> Column:
    """The first n codes of packed bytes."""
    per = 8 // bits

    def codes_of(text: Column) -> Column:
        def code(i: Column) -> Column:
            byte = F.conv(F.substring(text, (F.floor(i / per) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2.0), 8 - bits * (i % per + 1))).cast("int") % (1 << bits)

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), code)

    return _let(F.hex(_col(packed)), codes_of)


def dequantize(code: Column | str, bits: int, low: float, high: float) -> Column:
    """Values of codes; with one bit ``low`` and ``high`` are the means of the non-positive and the positive values."""
    if bits == 1:
        return F.transform(_col(code), lambda x: F.when(x == 1, F.lit(high)).otherwise(F.lit(low)))
    return F.transform(_col(code), lambda x: F.lit(low) + x / float((1 << bits) - 1) * (high - low))
