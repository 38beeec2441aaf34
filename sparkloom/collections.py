"""Collections as objects: a DataFrame with the method set of its kind. Methods that give a collection of the same kind return one; others
return DataFrames. The work is done by the functions of `sparkloom.operators`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row

from sparkloom.operators import bag, indexed, joins, keyed, ordered, poly, sets, versioned


class Collection:
    """A bag."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _with(self, df: DataFrame):
        new = object.__new__(type(self))
        new.__dict__ = self.__dict__ | {"df": df}
        return new

    def size(self) -> int:
        return self.df.count()

    def clear(self):
        return self._with(bag.clear(self.df))

    def insert(self, *rows: tuple):
        return self._with(bag.insert(self.df, *rows))

    def extend(self, other):
        return self._with(bag.extend(self.df, other.df))

    combine = extend

    def update(self, old: tuple, new: tuple):
        return self._with(bag.update(self.df, old, new))

    def erase(self, row: tuple):
        return self._with(bag.erase(self.df, row))

    def map(self, **columns: Column):
        return self._with(bag.project(self.df, **columns))

    def filter(self, *predicates: Column):
        return self._with(bag.keep(self.df, *predicates))

    def fold(self, **aggregates: Column) -> Row:
        return bag.fold(self.df, **aggregates).first()

    def group_by(self, keys: list[str], **aggregates: Column) -> DataFrame:
        return bag.group_by(self.df, keys, **aggregates)

    def group_by_contiguous(self, key: Column, slots: int, zero: dict, **aggregates: Column) -> DataFrame:
        return bag.group_by_contiguous(self.df, key, slots, zero, **aggregates)

    def join(self, other: Collection, on: Column, how: str = "inner") -> DataFrame:
        return joins.theta_join(self.df, other.df, on, how)

    def equijoin(self, other: Collection, keys: list[str], how: str = "inner") -> DataFrame:
        return self.df.join(other.df, keys, how)

    def ext(self, items: Column, name: str, *carry: str) -> DataFrame:
        return bag.ext(self.df, items, name, *carry)

    def iterate(self, f) -> None:
        bag.iterate(self.df, f)


class Seq(Collection):
    """A bag with an order given by columns."""

    def __init__(self, df: DataFrame, order: list[str]):
        super().__init__(df)
        self.order = order

    def peek(self) -> Row | None:
        return bag.peek(self.df, self.order)

    def at(self, i: int) -> DataFrame:
        return bag.at(self.df, self.order, i)

    def safe_at(self, i: int, default: tuple) -> DataFrame:
        return bag.safe_at(self.df, self.order, i, default)

    def pop(self):
        return self._with(bag.pop(self.df, self.order))

    def split(self):
        return tuple(self._with(h) for h in bag.split(self.df, self.order))

    def sort(self, order: list[str]):
        new = self._with(self.df)
        new.order = order
        return new

    def rows(self) -> DataFrame:
        return bag.sort(self.df, self.order)

    def split_many(self, n: int) -> DataFrame:
        return bag.split_many(self.df, self.order, n)


class Set(Collection):
    def __init__(self, df: DataFrame):
        super().__init__(sets.as_set(df))

    def insert(self, *rows: tuple):
        return self._with(sets.insert(self.df, *rows))

    def erase(self, row: tuple):
        return self._with(sets.erase(self.df, row))

    def update(self, old: tuple, new: tuple):
        return self._with(sets.update(self.df, old, new))

    def union(self, other: Set):
        return self._with(sets.union(self.df, other.df))

    combine = extend = union

    def intersect(self, other: Set):
        return self._with(sets.intersect(self.df, other.df))

    def difference(self, other: Set):
        return self._with(sets.difference(self.df, other.df))

    def member(self, elements: DataFrame) -> DataFrame:
        return sets.member(self.df, elements)

    def is_subset_of(self, other: Set) -> bool:
        return sets.is_subset_of(self.df, other.df).first().is_subset

    def map(self, **columns: Column):
        return self._with(sets.project(self.df, **columns))


class _Ordered:
    def min(self) -> DataFrame:
        return ordered.least(self.df, self.key)

    def max(self) -> DataFrame:
        return ordered.greatest(self.df, self.key)

    def peek(self) -> Row | None:
        return ordered.peek(self.df, self.key)

    def lower_bound(self, bound) -> DataFrame:
        return ordered.lower_bound(self.df, self.key, bound)

    def upper_bound(self, bound) -> DataFrame:
        return ordered.upper_bound(self.df, self.key, bound)

    lookup_geq, lookup_gt = lower_bound, upper_bound

    def lookup_lt(self, k) -> DataFrame:
        return ordered.lookup_lt(self.df, self.key, k)

    def lookup_leq(self, k) -> DataFrame:
        return ordered.lookup_leq(self.df, self.key, k)

    def filter_lt(self, bound):
        return self._with(ordered.filter_lt(self.df, self.key, bound))

    def filter_gt(self, bound):
        return self._with(ordered.filter_gt(self.df, self.key, bound))

    def filter_leq(self, bound):
        return self._with(ordered.filter_leq(self.df, self.key, bound))

    def filter_geq(self, bound):
        return self._with(ordered.filter_geq(self.df, self.key, bound))

    def between(self, low, high):
        return self._with(ordered.between(self.df, self.key, low, high))

    def erase_before(self, bound):
        return self._with(ordered.erase_before(self.df, self.key, bound))

    def erase_after(self, bound):
        return self._with(ordered.erase_after(self.df, self.key, bound))


class Sorted(_Ordered, Collection):
    """A bag sorted by a column; repeats stay."""

    def __init__(self, df: DataFrame, key: str):
        Collection.__init__(self, df)
        self.key = key


class SortedSet(_Ordered, Set):
    def __init__(self, df: DataFrame, key: str):
        Set.__init__(self, df)
        self.key = key


class Map(Collection):
    """Rows with unique keys."""

    def __init__(self, df: DataFrame, keys: list[str]):
        super().__init__(df)
        self.keys = keys

    def lookup(self, probes: DataFrame, defaults: dict | None = None) -> DataFrame:
        return keyed.lookup(self.df, probes, self.keys, defaults)

    def member(self, probes: DataFrame) -> DataFrame:
        return keyed.member(self.df, probes, self.keys)

    def insert(self, *rows: tuple):
        return self._with(keyed.insert(self.df, self.df.sparkSession.createDataFrame(list(rows), self.df.schema), self.keys))

    def combine(self, other: Map):
        return self._with(keyed.combine(self.df, other.df, self.keys))

    extend = combine

    def update_key(self, rows: DataFrame):
        return self._with(keyed.update_key(self.df, rows, self.keys))

    def erase_key(self, probes: DataFrame):
        return self._with(keyed.erase_key(self.df, probes, self.keys))

    def erase_with(self, probes: DataFrame):
        left, gone = keyed.erase_with(self.df, probes, self.keys)
        return self._with(left), gone

    def insert_with(self, rows: DataFrame, **merge):
        return self._with(keyed.insert_with(self.df, rows, self.keys, **merge))

    def upsert_with(self, probes: DataFrame, absent: dict, present: dict):
        return self._with(keyed.upsert_with(self.df, probes, self.keys, absent, present))

    def update_with(self, probes: DataFrame, present: dict) -> DataFrame:
        return keyed.update_with(self.df, probes, self.keys, present)

    def project(self, key: dict, value: dict, seq: Column):
        new = self._with(keyed.project(self.df, key, value, seq))
        new.keys = list(key)
        return new

    def split(self):
        return tuple(self._with(h) for h in keyed.split(self.df, self.keys))

    def equijoin_fold(self, outer: DataFrame, **aggregates: Column) -> DataFrame:
        return keyed.equijoin_fold(outer, self.df, self.keys, **aggregates)


class SortedMap(_Ordered, Map):
    def __init__(self, df: DataFrame, key: str):
        Map.__init__(self, df, [key])
        self.key = key


class VMap(Collection):
    """A map with versions; bulk operators run on the frontier at a version."""

    def __init__(self, df: DataFrame, keys: list[str], vid: str = "vid"):
        super().__init__(df)
        self.keys, self.vid = keys, vid

    def at(self, v) -> Map:
        return Map(versioned.frontier(self.df, self.keys, self.vid, v), self.keys)

    def size(self, v) -> int:
        return versioned.size(self.df, self.keys, self.vid, v).first()[0]

    def total_size(self) -> int:
        return self.df.count()

    def lookup(self, v, probes: DataFrame) -> DataFrame:
        return versioned.lookup(self.df, self.keys, self.vid, v, probes)

    def lookup_before(self, probes: DataFrame, at: str) -> DataFrame:
        return versioned.lookup_before(self.df, self.keys, self.vid, probes, at)

    def insert(self, *rows: tuple):
        return self._with(versioned.insert(self.df, self.keys, self.vid, self.df.sparkSession.createDataFrame(list(rows), self.df.schema)))

    def erase(self, v, probes: DataFrame):
        return self._with(versioned.erase(self.df, self.keys, self.vid, v, probes))

    def upsert_before(self, v, probes: DataFrame, absent: dict, present: dict):
        return self._with(versioned.upsert_before(self.df, self.keys, self.vid, v, probes, absent, present))

    def update_after(self, v, **values: Column):
        return self._with(versioned.update_after(self.df, self.vid, v, **values))

    def erase_all_before(self, v):
        return self._with(versioned.erase_all_before(self.df, self.keys, self.vid, v))

    def peek_now(self) -> DataFrame:
        return versioned.peek_now(self.df, self.keys, self.vid)

    def fold_all(self, **aggregates: Column) -> Row:
        return versioned.fold_all(self.df, **aggregates).first()


class MultiIndexBag(Collection):
    def lookup_by(self, order: list[str], **key) -> DataFrame:
        return indexed.lookup_by(self.df, order, **key)

    def slice_by(self, **key):
        return self._with(indexed.slice_by(self.df, **key))

    def range_by(self, column: str, low, high):
        return self._with(indexed.range_by(self.df, column, low, high))

    def fold_slice_by(self, key: dict, **aggregates: Column) -> Row:
        return indexed.fold_slice_by(self.df, key, **aggregates).first()

    def fold_range_by(self, column: str, low, high, **aggregates: Column) -> Row:
        return indexed.fold_range_by(self.df, column, low, high, **aggregates).first()


class MultiIndexMap(MultiIndexBag, Map):
    def __init__(self, df: DataFrame, keys: list[str]):
        Map.__init__(self, df, keys)


class PolyBuffer(Collection):
    """A tagged union (seq, tag, a struct column per variant) of the variants named."""

    def __init__(self, df: DataFrame, variants: list[str]):
        super().__init__(df)
        self.variants = variants

    @classmethod
    def of(cls, variants: list[tuple[str, DataFrame, str]]) -> PolyBuffer:
        return cls(poly.union(variants), [n for n, _, _ in variants])

    def variant(self, name: str) -> DataFrame:
        return poly.variant(self.df, self.variants.index(name), name)

    def variant_range(self, name: str, low: int, high: int) -> DataFrame:
        return poly.variant_range(self.df, self.variants.index(name), name, low, high)

    def append(self, name: str, rows: DataFrame, seq: str):
        names = [*self.variants, *([] if name in self.variants else [name])]
        return PolyBuffer(poly.append(self.df, names.index(name), name, rows, seq), names)

    def tags(self) -> DataFrame:
        return poly.tag_counts(self.df)

    def runs(self) -> DataFrame:
        return poly.runs(self.df, ["seq"])

    def skip_all(self, name: str, at: int) -> int:
        return poly.skip_all(self.runs(), self.variants.index(name), at).first()["next"]

    def split_many(self, n: int) -> DataFrame:
        return bag.split_many(self.df, ["seq"], n)

    def byte_size(self) -> int:
        return poly.byte_size(self.df).first()["bytes"]
