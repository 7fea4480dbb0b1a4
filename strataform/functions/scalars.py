"""Column expressions: rounding, clamping, vectors, sets, hashes and space-filling codes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up_half(x: Column, digits: int = 0) -> Column:
    """Halves go up, so -2.5 gives -2."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low=0.0, high=1.0) -> Column:
    """NaN counts as low."""
    return F.when(F.isnan(x), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def ratio(a: Column, b: Column, otherwise=0.0) -> Column:
    """a / b where b is positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(otherwise))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is shorter than 1e-12."""
    size = norm(a) * norm(b)
    return F.when(size > 1e-12, dot(a, b) / size).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x / F.when(size > 0, size).otherwise(F.lit(1.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def codes(s: Column) -> Column:
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a32(s: Column) -> Column:
    """32-bit FNV-1a over character codes: the offset basis and prime are fixed values of the hash."""
    return F.aggregate(codes(s), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def hash31(s: Column) -> Column:
    """The 31-multiplier string hash, as a signed 32-bit integer."""
    h = F.aggregate(codes(s), F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(F.lit(4294967295)))
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)


def bucket100(s: Column) -> Column:
    return F.abs(hash31(s)) % 100


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9, in order, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def text_embedding(text: Column, dims: int = 8) -> Column:
    """Tokens hashed into a few dimensions and scaled to unit length: byte i of three-bit steps of each hash, less a half."""
    hashes = F.transform(tokens(text), fnv1a32)

    def part(i: int) -> Column:
        return F.aggregate(hashes, F.lit(0.0), lambda a, h: a + (F.shiftrightunsigned(h, 3 * i).bitwiseAND(F.lit(255)) / 255.0 - 0.5))

    return unit(F.array(*(part(i) for i in range(dims))))


def _spread(x: Column, bits: int) -> Column:
    """The bits of x, three places apart."""
    return sum((F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")), 3 * i) for i in range(1, bits)), x.bitwiseAND(F.lit(1).cast("long")))


def morton30(x: Column, y: Column, z: Column) -> Column:
    """Ten bits an axis of coordinates in 0..1; x in the highest place of each three."""
    cell = lambda v: F.greatest(F.lit(0), F.least(F.lit(1023), F.floor(v * 1024))).cast("long")
    return F.shiftleft(_spread(cell(x), 10), 2) + F.shiftleft(_spread(cell(y), 10), 1) + _spread(cell(z), 10)


def morton63(x: Column, y: Column, z: Column) -> Column:
    """21 bits an axis of non-negative integers; x in the lowest place of each three."""
    return _spread(x.cast("long"), 21) + F.shiftleft(_spread(y.cast("long"), 21), 1) + F.shiftleft(_spread(z.cast("long"), 21), 2)


_MASK = 4294967295


def fnv1a64(data: Column) -> Column:
    """64-bit FNV-1a over bytes, as 16 hex digits; the offset basis and prime are fixed values of the hash.

    The state is two halves of 32 bits, so products stay within 64: the prime is 2^40 + 0x1b3.
    """
    raw = F.coalesce(data.cast("binary"), F.lit("").cast("binary"))
    digits = F.hex(raw)
    n = F.octet_length(raw)
    each = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))

    def step(h, b):
        x = h["lo"].bitwiseXOR(b)
        low = x * 0x1B3
        high = h["hi"] * 0x1B3 + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("hi"), low.bitwiseAND(F.lit(_MASK)).alias("lo"))

    out = F.aggregate(each, start, step)
    return F.concat(*(F.lower(F.lpad(F.hex(out[k]), 8, "0")) for k in ("hi", "lo")))


def times32(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two unsigned 32-bit numbers."""
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_MASK))


def mulberry32(seed: Column, draw: Column) -> Column:
    """Draw number `draw`, from 0, of a 32-bit generator, in 0..1: its state is a count, so any draw can be had by itself. Increment and mixing steps are fixed values."""
    first = seed.cast("long").bitwiseAND(F.lit(_MASK))
    first = F.when(first == 0, F.lit(1)).otherwise(first)
    s = (first + times32((draw + 1).cast("long").bitwiseAND(F.lit(_MASK)), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(F.lit(_MASK))
    t = times32(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + times32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_MASK)))
    return t.bitwiseXOR(F.shiftright(t, 14)) / 4294967296.0


def halton(index: Column, base: int, digits: int = 40) -> Column:
    """The point of a low-discrepancy sequence: the index's digits in the base, mirrored at the point."""
    places = F.array(*(F.lit(float(base**k)) for k in range(digits) if base**k < 2**53))
    return F.aggregate(places, F.lit(0.0), lambda a, p: a + F.floor(index / p) % base / (p * base))


def seeded_vector(seed: Column, dims: int = 8) -> Column:
    """A unit vector that follows from a text: its 32-bit hash mixed once more for each number. The multiplier is a fixed value."""
    start = F.struct(fnv1a32(seed).alias("h"), F.array().cast("array<double>").alias("v"))

    def step(a, _):
        h = times32(a["h"].bitwiseXOR(F.shiftright(a["h"], 13)), F.lit(0x5BD1E995).cast("long"))
        return F.struct(h.alias("h"), F.array_append(a["v"], h / 4294967295.0 * 2 - 1).alias("v"))

    return unit(F.aggregate(F.sequence(F.lit(1), F.lit(dims)), start, step)["v"])


def rounded_key(parts: list[Column], step: float) -> Column:
    """Coordinates as whole steps, in one text: equal keys for points within the same step."""
    return F.concat_ws("|", *(F.floor(p / step + 0.5).cast("long").cast("string") for p in parts))
