"""Positional collections as array columns: access, mutation, numeric vectors and bit sets, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def at(arr: Column, i: int | Column) -> Column:
    """Element i from 0; an error outside."""
    return F.element_at(arr, _int(i) + 1)


def safe_at(arr: Column, i: int | Column, default: Column) -> Column:
    inside = (_int(i) >= 0) & (_int(i) < F.size(arr))
    return F.when(inside, F.get(arr, _int(i))).otherwise(default)


def _int(i: int | Column) -> Column:
    return i if isinstance(i, Column) else F.lit(i)


def set_at(arr: Column, i: int | Column, v: Column) -> Column:
    return F.transform(arr, lambda x, j: F.when(j == _int(i), v).otherwise(x))


def update_at(arr: Column, i: int | Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(arr, lambda x, j: F.when(j == _int(i), f(x)).otherwise(x))


def set_all(arr: Column, v: Column) -> Column:
    return F.transform(arr, lambda x: v)


def swap(arr: Column, i: int | Column, v: Column) -> Column:
    """{old, value}: the element at i, and the array with v in its place; one slot is written."""
    return F.struct(at(arr, i).alias("old"), set_at(arr, i, v).alias("value"))


def insert_at(arr: Column, i: int, v: Column) -> Column:
    return F.array_insert(arr, i + 1, v)


def erase_at(arr: Column, i: int | Column) -> Column:
    """{old, value}: the element at i, and the array without it."""
    return F.struct(at(arr, i).alias("old"), F.filter(arr, lambda x, j: j != _int(i)).alias("value"))


def fill(n: int | Column, v: Column) -> Column:
    return F.array_repeat(v, _int(n))


def fill_by(n: int, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f) if n else F.array()


def shuffled(arr: Column, seed: int) -> Column:
    """A permutation that is the same each time: by hashes of value, place and seed."""
    keyed = F.transform(arr, lambda x, j: F.struct(F.xxhash64(x, j, F.lit(seed)).alias("h"), j.alias("j"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def zip_by(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, f)


def _sized(a: Column, b: Column, v: Column) -> Column:
    return F.when(F.size(a) == F.size(b), v).otherwise(F.raise_error(F.lit("vectors of different sizes")).cast("double"))


def _numeric(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    guarded = F.zip_with(a, b, f)
    return F.when(F.size(a) == F.size(b), guarded).otherwise(F.array(F.raise_error(F.lit("vectors of different sizes")).cast("double")))


def add(a: Column, b: Column) -> Column:
    return _numeric(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return _numeric(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return _sized(a, b, F.aggregate(product, F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column) -> Column:
    """Euclidean."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return _sized(a, b, F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x)))


def scale(a: Column, c: float | Column) -> Column:
    return F.transform(a, lambda x: x * c)


def to_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def zero_vector(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def hashed_vector(n: int, seed: Column) -> Column:
    """n numbers from 0 to 1 that depend on the seed only."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.pmod(F.xxhash64(seed, i), F.lit(1 << 52)) / F.lit(float(1 << 52)))


def bits(members: Column) -> Column:
    """A bit set as the sorted array of its members."""
    return F.array_sort(F.array_distinct(members))


def insert_bit(b: Column, i: int | Column) -> Column:
    return F.array_sort(F.array_union(b, F.array(_int(i))))


def erase_bit(b: Column, i: int | Column) -> Column:
    return F.array_remove(b, _int(i))


def member_bit(b: Column, i: int | Column) -> Column:
    return F.array_contains(b, _int(i))


def iterate_bits(b: Column) -> Column:
    """A row for each member."""
    return F.explode(b)


def array_size(a: Column) -> Column:
    return F.size(a)


def fold_bits(b: Column, zero: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(b, zero, f)
