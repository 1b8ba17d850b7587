"""Vector distances, arithmetic, comparisons, casts and batch forms as column expressions.

Vectors are arrays of numbers. Everything is computed in double precision. A null vector or a
null element gives null; vectors of different lengths give null in distances and arithmetic
and false in comparisons, as documented per function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Column | str | Sequence[float]
#: Literal vectors up to this length are unrolled into one generated expression.
UNROLL = 128
TOLERANCE = 1e-6


def vec(v: Vec) -> Column:
    """A column of doubles from a column, its name, or literal numbers."""
    if isinstance(v, str):
        v = F.col(v)
    if isinstance(v, Column):
        return v.cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in v]) if len(v) else F.array().cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once: an expression named inside a lambda runs for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pairs(a: Vec, b: Vec, f: Callable[[Column, Column], Column]) -> Column:
    """Sum of f over pairs of elements. Against a literal the loop is unrolled, which keeps the
    whole expression in generated code; higher-order functions are interpreted."""
    for x, y, swap in ((a, b, False), (b, a, True)):
        if not isinstance(y, (Column, str)) and 0 < len(y) <= UNROLL:
            e = F.col(x) if isinstance(x, str) else x
            if not isinstance(e, Column):
                break
            terms = [(f(F.lit(float(q)), F.get(e, F.lit(i)).cast("double")) if swap else f(F.get(e, F.lit(i)).cast("double"), F.lit(float(q)))) for i, q in enumerate(y)]
            return F.when(F.size(e) == len(y), reduce(lambda s, t: s + t, terms))
    a, b = vec(a), vec(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, f)))


def squared_l2_distance(a: Vec, b: Vec) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def l2_distance(a: Vec, b: Vec) -> Column:
    return F.sqrt(squared_l2_distance(a, b))


def inner_product(a: Vec, b: Vec) -> Column:
    """The dot product itself, not its negative."""
    return _pairs(a, b, lambda x, y: x * y)


def neg_inner_product(a: Vec, b: Vec) -> Column:
    """For ascending order: the largest product comes first."""
    return -inner_product(a, b)


def cosine_distance(a: Vec, b: Vec) -> Column:
    """1 - cosine; 1 where either norm is 0."""
    n = norm(a) * norm(b)
    dot = inner_product(a, b)
    return F.when(dot.isNull(), None).when(n == 0, 1.0).otherwise(1 - dot / n)


def l1_distance(a: Vec, b: Vec) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def hamming_distance(a: Vec, b: Vec) -> Column:
    """How many elements differ."""
    return _pairs(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)).cast("int")


def chebyshev_distance(a: Vec, b: Vec) -> Column:
    a, b = vec(a), vec(b)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0)))


def minkowski_distance(a: Vec, b: Vec, p: float) -> Column:
    if not 0 < p < float("inf"):
        raise ValueError("p must be positive and finite")
    if p == 1:
        return l1_distance(a, b)
    if p == 2:
        return l2_distance(a, b)
    if p > 1e10:
        return chebyshev_distance(a, b)
    return F.pow(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1.0 / p))


def _nonzero(x: Column) -> Column:
    return F.abs(x) > 1e-10


def _counts(a: Vec, b: Vec) -> tuple[Column, Column, Column]:
    def n(cond) -> Column:
        return _pairs(a, b, lambda x, y: F.when(cond(x, y), 1.0).otherwise(0.0))

    return n(lambda x, y: _nonzero(x) & _nonzero(y)), n(lambda x, y: _nonzero(x)), n(lambda x, y: _nonzero(y))


def jaccard_distance(a: Vec, b: Vec) -> Column:
    """Over the positions that aren't zero; 0 where both have none."""
    both, p, q = _counts(a, b)
    return F.when(p + q - both == 0, 0.0).otherwise(1 - both / (p + q - both))


def dice_distance(a: Vec, b: Vec) -> Column:
    """0 where both vectors are zero, 1 where exactly one is."""
    both, p, q = _counts(a, b)
    return F.when(p + q == 0, 0.0).otherwise(1 - 2 * both / (p + q))


def mahalanobis_distance(a: Vec, b: Vec, inverse_variance: Vec) -> Column:
    """With a diagonal covariance, given by each dimension's inverse variance."""
    a, b, w = vec(a), vec(b), vec(inverse_variance)
    d = F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda x, y: x * y)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) == F.size(w)), F.sqrt(_sum(d)))


DISTANCES: dict[str, Callable[..., Column]] = {
    "l2": l2_distance, "euclidean": l2_distance, "cosine": cosine_distance, "inner_product": inner_product, "dot": inner_product, "l1": l1_distance, "manhattan": l1_distance,
    "hamming": hamming_distance, "chebyshev": chebyshev_distance, "squared_l2": squared_l2_distance, "jaccard": jaccard_distance, "dice": dice_distance,
}


def distance(a: Vec, b: Vec, metric: str = "l2", p: float = 3.0) -> Column:
    """One entry to all metrics; minkowski takes p."""
    if metric == "minkowski":
        return minkowski_distance(a, b, p)
    if metric not in DISTANCES:
        raise ValueError(f"unknown metric {metric}")
    return DISTANCES[metric](a, b)


def ordering(a: Vec, b: Vec, metric: str = "l2", p: float = 3.0) -> Column:
    """As distance, but smaller is always nearer."""
    return neg_inner_product(a, b) if metric in ("inner_product", "dot") else distance(a, b, metric, p)


def similarity(a: Vec, b: Vec, metric: str = "cosine") -> Column:
    """cosine: 1 - distance; dot: the product; others: 1 / (1 + distance)."""
    if metric == "cosine":
        return 1 - cosine_distance(a, b)
    if metric in ("dot", "inner_product"):
        return inner_product(a, b)
    return 1 / (1 + distance(a, b, metric))


# ---- arithmetic within and between vectors


def dims(a: Vec) -> Column:
    return F.size(a if isinstance(a, Column) else F.col(a) if isinstance(a, str) else vec(a))


def norm(a: Vec) -> Column:
    if not isinstance(a, (Column, str)):
        return F.lit(sum(float(x) ** 2 for x in a) ** 0.5)
    return F.sqrt(_sum(F.transform(vec(a), lambda x: x * x)))


def normalize(a: Vec) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.when(n == 0, vec(a)).otherwise(F.transform(vec(a), lambda x: x / n)))


def concat(a: Vec, b: Vec) -> Column:
    return F.concat(vec(a), vec(b))


def _each(a: Vec, b: Vec, f) -> Column:
    a, b = vec(a), vec(b)
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def add(a: Vec, b: Vec) -> Column:
    return _each(a, b, lambda x, y: x + y)


translate = add


def sub(a: Vec, b: Vec) -> Column:
    return _each(a, b, lambda x, y: x - y)


def mul(a: Vec, s: float | Column) -> Column:
    return F.transform(vec(a), lambda x: x * s)


def hadamard(a: Vec, b: Vec) -> Column:
    return _each(a, b, lambda x, y: x * y)


scale = hadamard


def divide(a: Vec, b: Vec) -> Column:
    """A zero divisor is an error."""
    return _each(a, b, lambda x, y: F.when(y == 0, F.raise_error(F.lit("division by zero"))).otherwise(x / y))


def cross_product(a: Vec, b: Vec) -> Column:
    """Of three dimensions only; null otherwise."""
    a, b = vec(a), vec(b)

    def term(i: int, j: int) -> Column:
        return a[i] * b[j] - a[j] * b[i]

    return F.when((F.size(a) == 3) & (F.size(b) == 3), F.array(term(1, 2), term(2, 0), term(0, 1)))


def percentile(a: Vec, p: float) -> Column:
    """The lower element at p * (n - 1), without interpolation."""
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    v = F.array_sort(vec(a))
    return F.get(v, F.floor((F.size(v) - 1) * F.lit(float(p)) + F.lit(1e-9)).cast("int"))


def median(a: Vec) -> Column:
    return percentile(a, 0.5)


def quantile(a: Vec, ps: Sequence[float]) -> Column:
    return F.array(*[percentile(a, p) for p in ps])


def filter_mask(a: Vec, mask: Column) -> Column:
    """The elements whose mask is true."""
    return F.transform(F.filter(F.arrays_zip(vec(a).alias("v"), mask.alias("m")), lambda z: z["m"]), lambda z: z["v"])


def where(cond: Vec, value: Vec, otherwise: float) -> Column:
    """value where cond isn't 0, else the constant."""
    return _each(cond, value, lambda c, v: F.when(c != 0, v).otherwise(F.lit(float(otherwise))))


def get(a: Vec, i: int) -> Column:
    """Element from 0; null out of range."""
    return F.get(vec(a), F.lit(i))


def set_at(a: Vec, i: int, value: float) -> Column:
    return F.transform(vec(a), lambda x, k: F.when(k == i, F.lit(float(value))).otherwise(x))


def slice_of(a: Vec, start: int, end: int) -> Column:
    """Elements start to end - 1, from 0."""
    return F.slice(vec(a), start + 1, max(end - start, 0))


def append(a: Vec, x: float) -> Column:
    return F.array_append(vec(a), F.lit(float(x)))


def prepend(x: float, a: Vec) -> Column:
    return F.array_prepend(vec(a), F.lit(float(x)))


def absolute(a: Vec) -> Column:
    return F.transform(vec(a), F.abs)


def square(a: Vec) -> Column:
    return F.transform(vec(a), lambda x: x * x)


def square_root(a: Vec) -> Column:
    """A negative element is an error."""
    return F.transform(vec(a), lambda x: F.when(x < 0, F.raise_error(F.lit("square root of a negative number"))).otherwise(F.sqrt(x)))


def power(a: Vec, p: float) -> Column:
    return F.transform(vec(a), lambda x: F.pow(x, F.lit(float(p))))


def element_sum(a: Vec) -> Column:
    return _sum(vec(a))


def mean(a: Vec) -> Column:
    return element_sum(a) / dims(a)


def variance(a: Vec) -> Column:
    """Of the population."""
    return let(mean(a), lambda m: _sum(F.transform(vec(a), lambda x: (x - m) * (x - m)))) / dims(a)


def stddev(a: Vec) -> Column:
    return F.sqrt(variance(a))


def minimum(a: Vec) -> Column:
    return F.array_min(vec(a))


def maximum(a: Vec) -> Column:
    return F.array_max(vec(a))


def bounds(a: Vec) -> Column:
    return F.struct(minimum(a).alias("lo"), maximum(a).alias("hi"))


def clip(a: Vec, low: float, high: float) -> Column:
    return F.transform(vec(a), lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def standardize(a: Vec) -> Column:
    """Population z-scores; zeros where the deviation is 0."""
    both = F.struct(mean(a).alias("m"), stddev(a).alias("s"))
    return let(both, lambda b: F.transform(vec(a), lambda x: F.when(b["s"] == 0, 0.0).otherwise((x - b["m"]) / b["s"])))


def minmax_normalize(a: Vec) -> Column:
    """To [0, 1]; 0.5 where all elements are equal."""
    return let(bounds(a), lambda b: F.transform(vec(a), lambda x: F.when(b["hi"] == b["lo"], 0.5).otherwise((x - b["lo"]) / (b["hi"] - b["lo"]))))


def preprocess(a: Vec, method: str = "normalize", low: float = -1.0, high: float = 1.0) -> Column:
    ways = {"normalize": normalize, "standardize": standardize, "minmax": minmax_normalize, "clip": lambda v: clip(v, low, high)}
    if method not in ways:
        raise ValueError(f"unknown method {method}")
    return ways[method](a)


# ---- comparisons


def eq(a: Vec, b: Vec) -> Column:
    """Same length, every element within 1e-6; NaN equals NaN."""
    a, b = vec(a), vec(b)
    close = F.forall(F.zip_with(a, b, lambda x, y: (F.isnan(x) & F.isnan(y)) | (F.abs(x - y) <= TOLERANCE)), lambda x: F.coalesce(x, F.lit(False)))
    return (F.size(a) == F.size(b)) & close


def ne(a: Vec, b: Vec) -> Column:
    return ~eq(a, b)


def _lex(op) -> Callable[[Vec, Vec], Column]:
    def f(a: Vec, b: Vec) -> Column:
        a, b = vec(a), vec(b)
        return (F.size(a) == F.size(b)) & op(a, b)

    return f


#: Lexicographic; false for different lengths.
lt, le, gt, ge = (_lex(op) for op in (lambda a, b: a < b, lambda a, b: a <= b, lambda a, b: a > b, lambda a, b: a >= b))


def hash_of(a: Vec) -> Column:
    return F.xxhash64(vec(a))


def nearer(a: Vec, b: Vec, ref: Vec, metric: str = "l2", op: str = "<") -> Column:
    """Compares two vectors by their distance to a third: op is <, <=, =, >= or >."""
    x, y = distance(a, ref, metric), distance(b, ref, metric)
    return {"<": x < y, "<=": x <= y, "=": x == y, ">=": x >= y, ">": x > y}[op]


def assert_vector_equal(a: Vec, b: Vec, tolerance: float = 1e-4) -> Column:
    return chebyshev_distance(a, b) <= tolerance


# ---- batches: arrays of vectors


def _vectors(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<array<double>>")


def distance_batch(vectors: Column | str, query: Vec, metric: str = "l2") -> Column:
    return F.transform(_vectors(vectors), lambda v: distance(v, vec(query), metric))


def normalize_batch(vectors: Column | str) -> Column:
    return F.transform(_vectors(vectors), normalize)


def sum_batch(vectors: Column | str) -> Column:
    v = _vectors(vectors)
    return F.aggregate(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.element_at(v, 1), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))


def avg_batch(vectors: Column | str) -> Column:
    return let(F.size(_vectors(vectors)), lambda n: F.transform(sum_batch(vectors), lambda x: x / n))


# ---- casts


def parse(text: Column | str) -> Column:
    """'[1,2,3]' or '{1,2,3}' to a vector; null if malformed."""
    t = F.col(text) if isinstance(text, str) else text
    return F.from_json(F.translate(F.trim(t), "{}", "[]"), "array<double>")


def to_text(a: Vec) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", F.transform(vec(a), lambda x: F.when(x == F.rint(x), x.cast("bigint").cast("string")).otherwise(x.cast("string")))), F.lit("]"))


def to_array(a: Vec, kind: str = "double") -> Column:
    return vec(a).cast(f"array<{kind}>")


def cast_dimension(a: Vec, n: int) -> Column:
    """Cut or padded with zeros to n elements."""
    v = vec(a)
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), n)), 1, n)


def checked(a: Vec, n: int) -> Column:
    """The vector if it has n elements; otherwise an error, as a typed column would raise."""
    v = vec(a)
    return F.when(F.size(v) == n, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {n} dimensions, not "), F.size(v).cast("string"))))


# ---- sparse vectors: maps from position to value


def to_sparse(a: Vec) -> Column:
    """map<int,double> of the elements that aren't 0."""
    pairs = F.filter(F.transform(vec(a), lambda x, i: F.struct(i.alias("key"), x.alias("value"))), lambda p: p["value"] != 0)
    return F.map_from_entries(pairs)


def to_dense(m: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def sparse_zip(a: Column, b: Column, f) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))


def sparse_add(a: Column, b: Column) -> Column:
    return sparse_zip(a, b, lambda x, y: x + y)


def sparse_sub(a: Column, b: Column) -> Column:
    return sparse_zip(a, b, lambda x, y: x - y)


def sparse_mul(a: Column, s: float) -> Column:
    return F.transform_values(a, lambda k, x: x * s)


def sparse_norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(F.map_values(a), lambda x: x * x)))


def sparse_normalize(a: Column) -> Column:
    return let(sparse_norm(a), lambda n: F.transform_values(a, lambda k, x: F.when(n == 0, x).otherwise(x / n)))


def sparse_inner_product(a: Column, b: Column) -> Column:
    return _sum(F.map_values(sparse_zip(a, b, lambda x, y: x * y)))


def sparse_l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.map_values(sparse_zip(a, b, lambda x, y: (x - y) * (x - y)))))


def sparse_l1_distance(a: Column, b: Column) -> Column:
    return _sum(F.map_values(sparse_zip(a, b, lambda x, y: F.abs(x - y))))


def sparse_cosine_distance(a: Column, b: Column) -> Column:
    n = sparse_norm(a) * sparse_norm(b)
    return F.when(n == 0, 1.0).otherwise(1 - sparse_inner_product(a, b) / n)


def sparse_eq(a: Column, b: Column) -> Column:
    """Same positions, every value within 1e-6."""
    same = F.array_sort(F.map_keys(a)) == F.array_sort(F.map_keys(b))
    return same & F.forall(F.map_values(sparse_zip(a, b, lambda x, y: F.abs(x - y))), lambda d: d <= TOLERANCE)
