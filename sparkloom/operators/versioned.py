"""Maps with versions: rows (keys..., vid, values...). The frontier at v holds, per key, the newest version strictly older than v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.operators.joins import asof_join


def _best(df: DataFrame, keys: list[str], vid: str) -> DataFrame:
    """The newest version per key. Key and version are unique, so each column goes by the version alone, which numbers let a hash
    aggregate do without sorting."""
    rest = [c for c in df.columns if c not in (*keys, vid)]
    newest = df.groupBy(*keys).agg(F.max(vid).alias("_v"), *[F.max_by(c, vid).alias(f"_{i}") for i, c in enumerate(rest)])
    return newest.select(*keys, F.col("_v").alias(vid), *[F.col(f"_{i}").alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def frontier(df: DataFrame, keys: list[str], vid: str, v) -> DataFrame:
    """What reads at v see; bulk operators run over this. Rows keep their own version."""
    return _best(df.where(F.col(vid) < v), keys, vid)


def size(df: DataFrame, keys: list[str], vid: str, v) -> DataFrame:
    """Keys with a version of at most v."""
    return df.where(F.col(vid) <= v).select(*keys).distinct().agg(F.count(F.lit(1)).alias("size"))


def total_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_size"))


def lookup(df: DataFrame, keys: list[str], vid: str, v, probes: DataFrame) -> DataFrame:
    """Entries of exactly that version."""
    return df.where(F.col(vid) == v).join(probes.select(*keys).distinct(), keys, "left_semi")


def lookup_before(df: DataFrame, keys: list[str], vid: str, probes: DataFrame, at: str) -> DataFrame:
    """Each probe (keys..., at, ...) with version and values of its key newest before `at`; null where there is none.

    An as-of join: probes meet no other version of their key.
    """
    return asof_join(probes, df, keys, at, vid, strict=True)


def upsert_before(df: DataFrame, keys: list[str], vid: str, v, probes: DataFrame, absent: dict[str, Column], present: dict[str, Column]) -> DataFrame:
    """For each probed key a new version v: `absent` if nothing is older, else `present` of the frontier entry."""
    seen = probes.select(*keys).distinct().join(frontier(df, keys, vid, v), keys, "left")
    rest = [c for c in df.columns if c not in (*keys, vid)]
    new = seen.select(*keys, F.lit(v).cast(df.schema[vid].dataType).alias(vid), *[F.when(F.col(vid).isNull(), absent[c]).otherwise(present[c]).alias(c) for c in rest])
    old = df.join(new.select(*keys, vid), [*keys, vid], "left_anti")
    return old.unionByName(new)


def update_after(df: DataFrame, vid: str, v, /, **values: Column) -> DataFrame:
    """New values for all versions strictly newer than v; late data correct the history after them."""
    return df.withColumns({c: F.when(F.col(vid) > v, e).otherwise(F.col(c)) for c, e in values.items()})


def peek_now(df: DataFrame, keys: list[str], vid: str) -> DataFrame:
    """The newest version of the least key."""
    least = F.min(F.struct(*keys))
    rest = [c for c in df.columns if c not in keys]
    newest = _best(df, keys, vid)
    return newest.agg(F.min_by(F.struct(*keys, *rest), F.struct(*keys)).alias("b"), least.alias("_")).where("b IS NOT NULL").select("b.*")


def erase_all_before(df: DataFrame, keys: list[str], vid: str, v) -> DataFrame:
    """Per key, versions older than the newest one of at most v are gone; that one and newer ones stay.

    The bound per key comes from partial aggregates and a join, not from a window over all versions of a key.
    """
    bound = df.where(F.col(vid) <= v).groupBy(*keys).agg(F.max(vid).alias("_bound"))
    joined = df.join(bound, keys, "left")
    return joined.where(F.col("_bound").isNull() | (F.col(vid) >= F.col("_bound"))).select(*df.columns)


def fold_all(df: DataFrame, /, **aggregates: Column) -> DataFrame:
    """Over every version of every key."""
    return df.agg(*[c.alias(n) for n, c in aggregates.items()])


def insert(df: DataFrame, keys: list[str], vid: str, rows: DataFrame) -> DataFrame:
    """Rows overwrite entries of their key and version."""
    return df.join(rows.select(*keys, vid), [*keys, vid], "left_anti").unionByName(rows)


def erase(df: DataFrame, keys: list[str], vid: str, v, probes: DataFrame) -> DataFrame:
    """Exactly that version of the probed keys is gone."""
    gone = probes.select(*keys).distinct().withColumn(vid, F.lit(v).cast(df.schema[vid].dataType))
    return df.join(gone, [*keys, vid], "left_anti")


def combine(a: DataFrame, b: DataFrame, keys: list[str], vid: str) -> DataFrame:
    """Union in which entries of b win for equal key and version."""
    return insert(a, keys, vid, b)
