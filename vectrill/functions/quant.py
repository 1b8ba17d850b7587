"""Quantization codecs over arrays of codes. Decoding is lossy where the scale isn't kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectrill.functions.vector import Vec, absolute, bounds, let, maximum, vec


def _peak(a: Vec) -> Column:
    return maximum(absolute(a))


def to_int8(a: Vec) -> Column:
    """round-half-even(x * 127 / max|x|), as small integers; zeros stay zeros."""
    return let(_peak(a), lambda m: F.transform(vec(a), lambda x: F.when(m == 0, 0.0).otherwise(F.rint(x * 127.0 / m)).cast("tinyint")))


def from_int8(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double") / 127.0)


def to_uint8(a: Vec) -> Column:
    return let(bounds(a), lambda b: F.transform(vec(a), lambda x: F.when(b["hi"] == b["lo"], 0.0).otherwise(F.rint((x - b["lo"]) * 255.0 / (b["hi"] - b["lo"]))).cast("smallint")))


def from_uint8(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double") / 255.0)


def to_int4(a: Vec) -> Column:
    """round-half-even(x * 7 / max|x|) + 8, from 1 to 15."""
    return let(_peak(a), lambda m: F.transform(vec(a), lambda x: (F.when(m == 0, 0.0).otherwise(F.rint(x * 7.0 / m)) + 8).cast("tinyint")))


def from_int4(c: Column) -> Column:
    return F.transform(c, lambda x: (x.cast("double") - 8) / 7.0)


def to_ternary(a: Vec) -> Column:
    """2 above a third of max|x|, 1 below minus that, else 0."""
    return let(_peak(a) / 3.0, lambda t: F.transform(vec(a), lambda x: F.when(x > t, 2).when(x < -t, 1).otherwise(0).cast("tinyint")))


def from_ternary(c: Column) -> Column:
    return F.transform(c, lambda x: F.when(x == 2, 1.0).when(x == 1, -1.0).otherwise(0.0))


def to_binary(a: Vec) -> Column:
    """One bit an element: whether it is positive."""
    return F.transform(vec(a), lambda x: (x > 0).cast("tinyint"))


def from_binary(c: Column) -> Column:
    return F.transform(c, lambda x: F.when(x == 1, 1.0).otherwise(-1.0))


def pack_bits(bits: Column) -> Column:
    """Bits, lowest first, as 64-bit words."""
    words = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(bits) / 64).cast("int") - 1, F.lit(0)))

    def word(w: Column) -> Column:
        part = F.slice(bits, w * 64 + 1, F.lit(64))
        at = F.transform(part, lambda x, i: F.when(x == 1, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(at, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

    return F.transform(words, word)


def packed_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def bit_hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _truncate(x: Column, bits: int, low: int, high: int) -> Column:
    """Keeps `bits` of the mantissa by truncation; exponents below low become 0, above high saturate."""
    e = F.floor(F.log2(F.abs(x))).cast("int")
    unit = F.pow(F.lit(2.0), (e - bits).cast("double"))
    kept = F.signum(x) * F.floor(F.abs(x) / unit) * unit
    most = (2.0 - 2.0**-bits) * 2.0**high
    return F.when(x == 0, 0.0).when(e < low, 0.0).when(e > high, F.signum(x) * most).otherwise(kept)


def to_fp16(a: Vec) -> Column:
    """Values a truncating half-precision codec keeps; underflow becomes 0."""
    return F.transform(vec(a), lambda x: _truncate(x, 10, -14, 15))


def to_fp8_e4m3(a: Vec) -> Column:
    return F.transform(vec(a), lambda x: _truncate(x, 3, -6, 7))


def to_fp8_e5m2(a: Vec) -> Column:
    return F.transform(vec(a), lambda x: _truncate(x, 2, -14, 15))


def quantize_between(a: Vec, low: Vec, high: Vec) -> Column:
    """int8 codes -128 .. 127 of each element's place between its dimension's bounds."""
    z = F.arrays_zip(vec(a).alias("x"), vec(low).alias("l"), vec(high).alias("h"))
    return F.transform(z, lambda t: (F.when(t["h"] == t["l"], 0.0).otherwise(F.rint(F.least(F.greatest((t["x"] - t["l"]) / (t["h"] - t["l"]), F.lit(0.0)), F.lit(1.0)) * 255)) - 128).cast("tinyint"))


def dequantize_between(c: Column, low: Vec, high: Vec) -> Column:
    z = F.arrays_zip(c.alias("c"), vec(low).alias("l"), vec(high).alias("h"))
    return F.transform(z, lambda t: t["l"] + (t["c"].cast("double") + 128) / 255 * (t["h"] - t["l"]))


ENCODE = {"int8": to_int8, "uint8": to_uint8, "int4": to_int4, "ternary": to_ternary, "binary": to_binary, "fp16": to_fp16, "fp8_e4m3": to_fp8_e4m3, "fp8_e5m2": to_fp8_e5m2}
DECODE = {"int8": from_int8, "uint8": from_uint8, "int4": from_int4, "ternary": from_ternary, "binary": from_binary, "fp16": lambda c: c, "fp8_e4m3": lambda c: c, "fp8_e5m2": lambda c: c}
BITS = {"int8": 8, "uint8": 8, "int4": 4, "ternary": 2, "binary": 1, "fp16": 16, "fp8_e4m3": 8, "fp8_e5m2": 8}


def quantize(a: Vec, method: str = "int8") -> Column:
    return ENCODE[method](a)


def dequantize(c: Column, method: str = "int8") -> Column:
    return DECODE[method](c)


def auto_quantize(a: Vec, goal: str = "balanced") -> Column:
    """memory: int4, balanced: int8, quality: fp16."""
    return quantize(a, {"memory": "int4", "compression": "int4", "balanced": "int8", "quality": "fp16", "accuracy": "fp16"}[goal])


def _restored(a: Vec, method: str) -> Column:
    """Decoded with the scale that the code itself drops."""
    d = dequantize(quantize(a, method), method)
    if method in ("int8", "int4", "ternary"):
        return let(_peak(a), lambda m: F.transform(d, lambda x: x * m))
    return let(bounds(a), lambda b: F.transform(d, lambda x: b["lo"] + x * (b["hi"] - b["lo"]))) if method == "uint8" else d


def analyze(a: Vec, method: str = "int8") -> Column:
    """Struct of mse, mae, max_error, compression_ratio, relative_error against the decoded vector."""
    x = vec(a)
    err = F.zip_with(x, _restored(a, method), lambda p, q: F.abs(p - q))
    n = F.size(x)

    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda s, v: s + v)

    size = total(absolute(a))
    return F.struct(
        (total(F.transform(err, lambda e: e * e)) / n).alias("mse"), (total(err) / n).alias("mae"), F.array_max(err).alias("max_error"),
        F.lit(32.0 / BITS[method]).alias("compression_ratio"), F.when(size > 0, total(err) / n / size).otherwise(0.0).alias("relative_error"),
    )
