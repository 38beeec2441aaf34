"""Differences between two copies of a table, field by field."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.session import cut

# Both ways of pairing give the least cost; these say which is the quicker.
DENSE = 64  # rows a side up to which a matrix of costs is taken
ARCS = 20_000_000  # rows times sets of fields up to which a network is taken for more rows than that


def min_cost_pairs(cost: list[list[int]]) -> list[tuple[int, int]]:
    """The pairing of rows with columns (each at most once, as many pairs as the shorter side) of least total cost.

    Shortest augmenting paths with potentials, O(n^2 m); by arrays if the matrix is one.
    """
    if not len(cost) or not len(cost[0]):
        return []
    n, m = len(cost), len(cost[0])
    if n > m:
        return sorted((i, j) for j, i in min_cost_pairs(cost.T if isinstance(cost, np.ndarray) else [list(c) for c in zip(*cost)]))
    if isinstance(cost, np.ndarray):
        return _min_cost_pairs_by_arrays(cost)
    big = float("inf")
    row_pot, col_pot, owner = [0] * n, [0] * m, [-1] * m
    for start in range(n):
        slack, back, done = [big] * m, [-1] * m, [False] * m
        row, col = start, -1
        while True:
            least, pick = big, -1
            base = 0 if col < 0 else slack[col]
            for j in range(m):
                if done[j]:
                    continue
                c = base + cost[row][j] - row_pot[row] - col_pot[j]
                if c < slack[j]:
                    slack[j], back[j] = c, col
                if slack[j] < least:
                    least, pick = slack[j], j
            col = pick
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        end = slack[col]
        row_pot[start] += end
        for j in range(m):
            if done[j] and j != col:
                row_pot[owner[j]] += end - slack[j]
                col_pot[j] += slack[j] - end
        while col >= 0:
            prev = back[col]
            owner[col] = start if prev < 0 else owner[prev]
            col = prev
    return sorted((owner[j], j) for j in range(m) if owner[j] >= 0)


def _min_cost_pairs_by_arrays(cost: np.ndarray) -> list[tuple[int, int]]:
    """The same for at most as many rows as columns; column 0 stands for the row to be placed."""
    n, m = cost.shape
    row_pot, col_pot, owner = np.zeros(n + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=np.int64)
    far = np.iinfo(np.int64).max // 4
    for row in range(1, n + 1):
        owner[0], col = row, 0
        slack, back, done = np.full(m + 1, far), np.zeros(m + 1, dtype=np.int64), np.zeros(m + 1, dtype=bool)
        while True:
            done[col] = True
            reach = cost[owner[col] - 1] - row_pot[owner[col]] - col_pot[1:]
            nearer = ~done[1:] & (reach < slack[1:])
            slack[1:][nearer], back[1:][nearer] = reach[nearer], col
            col = int(np.where(done[1:], far, slack[1:]).argmin()) + 1
            rise = slack[col]
            row_pot[owner[done]] += rise
            col_pot[done] -= rise
            slack[~done] -= rise
            if not owner[col]:
                break
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


class _Network:
    """Least-cost flow from left to right rows, each as often as it stands, costs being small whole numbers."""

    def __init__(self, left: list[int], right: list[int]):
        n, m = len(left), len(right)
        self.to, self.cap, self.cost, self.out = [], [], [], [[] for _ in range(n + m + 2)]
        self.n, self.source, self.sink = n, n + m, n + m + 1
        for i, c in enumerate(left):
            self.arc(self.source, i, c)
        for j, c in enumerate(right, n):
            self.arc(j, self.sink, c)

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, u: int, v: int, cap: int = 1 << 60, cost: int = 0) -> None:
        self.out[u].append(len(self.to))
        self.out[v].append(len(self.to) + 1)
        self.to += (v, u)
        self.cap += (cap, 0)
        self.cost += (cost, -cost)

    def fill(self, below: int) -> None:
        """Sends units along cheapest paths for as long as a path costs less than `below`; one round for each cost."""
        pot = [0] * len(self.out)
        while (by := self._distances(pot, below - pot[self.sink] - 1)) is not None:
            for v, x in enumerate(by):
                pot[v] += x
            while self._block(pot):
                pass

    def _distances(self, pot: list[int], most: int) -> list[int] | None:
        """By how much each potential rises: reduced distances up to the sink's; None if that is over `most`."""
        far = most + 1
        dist, at = [far] * len(self.out), [[] for _ in range(far)]
        to, cap, cost, out = self.to, self.cap, self.cost, self.out
        if most < 0:
            return None
        dist[self.source] = 0
        at[0].append(self.source)
        for d, todo in enumerate(at):
            for u in todo:  # grows meanwhile
                if dist[u] != d:
                    continue
                for e in out[u]:
                    if cap[e]:
                        x = d + cost[e] + pot[u] - pot[to[e]]
                        if x < dist[to[e]]:
                            dist[to[e]] = x
                            at[x].append(to[e])
            if dist[self.sink] <= d:
                return [min(x, d) for x in dist]
        return None

    def _block(self, pot: list[int]) -> bool:
        """Fills the shortest paths of arcs without reduced cost; False if there is none."""
        to, cap, cost, out = self.to, self.cap, self.cost, self.out
        level = [-1] * len(out)
        level[self.source], row = 0, [self.source]
        while row and level[self.sink] < 0:
            new = []
            for u in row:
                for e in out[u]:
                    v = to[e]
                    if cap[e] and level[v] < 0 and not cost[e] + pot[u] - pot[v]:
                        level[v] = level[u] + 1
                        new.append(v)
            row = new
        if level[self.sink] < 0:
            return False
        place = [0] * len(out)
        path, u = [], self.source
        while True:
            if u == self.sink:
                units = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= units
                    cap[e ^ 1] += units
                path, u = [], self.source
            while place[u] < len(out[u]):
                e = out[u][place[u]]
                v = to[e]
                if cap[e] and level[v] == level[u] + 1 and not cost[e] + pot[u] - pot[v]:
                    path.append(e)
                    u = v
                    break
                place[u] += 1
            else:
                if not path:
                    return True
                u = to[path.pop() ^ 1]
                place[u] += 1

    def pairs(self) -> list[tuple[int, int, int]]:
        got = []
        place = [0] * len(self.out)  # arcs before it carry nothing
        for i in range(self.n):
            while self.cap[2 * i + 1]:
                u, path = i, [2 * i]
                while self.n > u or u > self.sink:
                    while (e := self.out[u][place[u]]) & 1 or not self.cap[e ^ 1]:
                        place[u] += 1
                    path.append(e)
                    u = self.to[e]
                units = min(self.cap[e ^ 1] for e in path)
                for e in path:
                    self.cap[e ^ 1] -= units
                got.append((i, u - self.n, units))
        return got


def least_differing_pairs(ls: list[tuple], rs: list[tuple], tol: list[float | None], left: list[int] | None = None, right: list[int] | None = None) -> list[tuple[int, int, int]]:
    """The pairing of `min_cost_pairs` with the number of differing fields as cost, without a matrix, so for any number of rows; (left row, right
    row, copies). left and right tell how often each row stands, 1 without them.

    Rows that agree in a set of fields meet in one node of a network, an arc to it costs the number of the other fields. Values
    with a tolerance meet in the nodes of a tree over the sorted values of a side, as being near is not transitive. As two rows can always be
    paired at the cost of all fields, cheapest paths take only as many rounds as there are fields; rows that no such path
    reaches agree with nothing free and are paired by order.
    """
    size = len(tol)
    left, right = left or [1] * len(ls), right or [1] * len(rs)
    net = _Network(left, right)
    norm = lambda v: "nan" if isinstance(v, float) and v != v else ("", v)
    sides = [[tuple(norm(v) for v in row) for row in side] for side in (ls, rs)]
    for chosen in (c for k in range(size, 0, -1) for c in combinations(range(size), k)):
        plain, near = [c for c in chosen if tol[c] is None], [c for c in chosen if tol[c] is not None]
        groups: dict[tuple, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
        for side, (rows, keys) in enumerate(zip((ls, rs), sides)):
            for i, (row, key) in enumerate(zip(rows, keys)):
                if all(row[c] is None or math.isfinite(row[c]) for c in near):
                    groups[(*[key[c] for c in plain], *[row[c] is None for c in near])][side].append(i)
        for key, (a, b) in groups.items():
            if not a or not b:
                continue
            some = [c for c, null in zip(near, key[len(plain) :]) if not null]
            _meet(net, ls, rs, a, b, [(c, tol[c]) for c in some], size - len(chosen))
    net.fill(size)
    pairs = net.pairs()
    left, right = _unpaired(pairs, left, right)
    i = j = 0
    while i < len(left) and j < len(right):
        if units := min(left[i], right[j]):
            pairs.append((i, j, units))
            left[i] -= units
            right[j] -= units
        i, j = i + (not left[i]), j + (not right[j])
    return sorted(pairs)


def _unpaired(pairs: list[tuple[int, int, int]], left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
    left, right = list(left), list(right)
    for i, j, units in pairs:
        left[i] -= units
        right[j] -= units
    return left, right


def _matrix_pairs(ls: list[tuple], rs: list[tuple], tol: list[float | None], left: list[int], right: list[int]) -> list[tuple[int, int, int]]:
    """The same by a matrix with a row or column for each copy."""
    a, b = ([i for i, c in enumerate(counts) for _ in range(c)] for counts in (left, right))
    if max(len(a), len(b)) <= DENSE:
        cost = [[sum(not _same_py(v, w, t) for v, w, t in zip(ls[i], rs[j], tol)) for j in b] for i in a]
    else:
        cost = np.zeros((len(a), len(b)), dtype=np.int16)
        for c, t in enumerate(tol):
            x, y = [ls[i][c] for i in a], [rs[j][c] for j in b]
            if t is None:
                code: dict = {}
                x, y = (np.array([code.setdefault("nan" if isinstance(v, float) and v != v else ("", v), len(code)) for v in side]) for side in (x, y))
                cost += x[:, None] != y
            else:
                gone = [np.array([v is None for v in side], dtype=bool) for side in (x, y)]
                x, y = (np.array([math.nan if v is None else float(v) for v in side]) for side in (x, y))
                with np.errstate(invalid="ignore"):
                    cost += ~((np.abs(x[:, None] - y) < t) | (gone[0][:, None] & gone[1]))
    return [(i, j, n) for (i, j), n in sorted(Counter((a[x], b[y]) for x, y in min_cost_pairs(cost)).items())]


def _meet(net: _Network, ls: list[tuple], rs: list[tuple], a: list[int], b: list[int], near: list[tuple[int, float]], cost: int) -> None:
    """Paths at `cost` from rows a to rows b that are near each other in the fields `near`."""
    if not near:
        hub = net.node()
        for i in a:
            net.arc(i, hub, cost=cost)
        for j in b:
            net.arc(hub, net.n + j)
        return
    (c, t), *more = near
    by: dict = defaultdict(list)
    for j in b:
        by[rs[j][c]].append(j)
    values = sorted(by)
    nodes: dict[int, int] = {}

    def reach(x: int) -> int:
        """The node over all values below place x of a binary tree whose leaves begin at len(values)."""
        if x not in nodes:
            nodes[x] = net.node()
            for v in (net.n + j for j in by[values[x - len(values)]]) if x >= len(values) else (reach(2 * x), reach(2 * x + 1)):
                net.arc(nodes[x], v)
        return nodes[x]

    for i in a:
        v = ls[i][c]
        lo = bisect_left(values, True, key=lambda w: v - w < t)
        hi = bisect_left(values, True, key=lambda w: not w - v < t)
        if more:
            for j in (j for w in values[lo:hi] for j in by[w]):
                if all(_same_py(ls[i][m], rs[j][m], u) for m, u in more):
                    net.arc(i, net.n + j, 1, cost)
            continue
        lo, hi = lo + len(values), hi + len(values)
        while lo < hi:
            if lo & 1:
                net.arc(i, reach(lo), cost=cost)
                lo += 1
            if hi & 1:
                hi -= 1
                net.arc(i, reach(hi), cost=cost)
            lo, hi = lo // 2, hi // 2


def _same(a: Column, b: Column, tolerance: float | None) -> Column:
    """Whether two values of a field are the same; null is the same as null only."""
    both_null = a.isNull() & b.isNull()
    equal = (a == b) if tolerance is None else (F.abs(a - b) < tolerance) & ~F.isnan(a - b)
    return both_null | F.coalesce(equal, F.lit(False))


def _same_py(a, b, tolerance: float | None) -> bool:
    if a is None or b is None:
        return a is b
    return a == b if tolerance is None else abs(a - b) < tolerance


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    fields: list[str],
    trim: tuple[str, ...] = (),
    tolerance: dict[str, float] | None = None,
    distinct: bool = False,
    names: tuple[str, str] = ("left_only", "right_only"),
) -> DataFrame:
    """Rows missing on either side and fields that differ: (keys..., field, left_value, right_value, copies).

    field is names[0] or names[1] for a key on one side only; names[0] + "_extra" or names[1] + "_extra" for
    copies of a key that is on both sides but more often on one; else the name of a field that differs in a pair of rows, with both
    values as text. copies counts equal results.

    Method: equal rows of both sides cancel by multiplicity (distinct=True: each different row counts once); what is
    left is paired within its key by the assignment of least total count of differing fields, however many rows a key has
    (`least_differing_pairs`). The different leftovers of one key, with their numbers of copies, are paired in one task.

    Fields in `trim` lose surrounding blanks. tolerance: numbers differ unless |difference| is below it, so not-a-number
    and infinite values differ from everything, equal ones too; without a tolerance they equal themselves. -0.0 equals 0.0.
    Null differs from a value and equals null, in keys also. Other columns don't matter. Empty tables are fine.
    """
    tolerance = tolerance or {}
    kinds = {c: left.schema[c].dataType for c in [*keys, *fields]}
    l, r = (_side(t, keys, fields, trim, kinds, i) for i, t in enumerate((left, right)))
    k, f = [f"k{i}" for i in range(len(keys))], [f"f{i}" for i in range(len(fields))]
    tol = [tolerance.get(c) for c in fields]
    rows = l.unionByName(r).groupBy(*k, *f).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    if distinct:
        rows = rows.withColumns({"n0": F.least("n0", F.lit(1)), "n1": F.least("n1", F.lit(1))})
    selfsame = reduce(Column.__and__, [_same(F.col(c), F.col(c), t) for c, t in zip(f, tol) if t is not None], F.lit(True))
    both = F.when(selfsame, F.least("n0", "n1")).otherwise(0)
    rows = rows.withColumn("both", both).withColumns({"left": F.col("n0") - F.col("both"), "right": F.col("n1") - F.col("both")})
    per_key = rows.groupBy(*k).agg(*[F.sum(c).alias(f"all_{c}") for c in ("n0", "n1", "left", "right")])
    per_key = per_key.where("all_left > 0 OR all_right > 0")

    one_side = per_key.where("all_n0 = 0 OR all_n1 = 0").select(
        *k, F.when(F.col("all_n1") == 0, names[0]).otherwise(names[1]).alias("field"), *_no_values(), (F.col("all_n0") + F.col("all_n1")).alias("copies")
    )
    shared = per_key.where("all_n0 > 0 AND all_n1 > 0")
    on = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in k])
    loose = rows.where("left > 0 OR right > 0").alias("a").join(shared.alias("b"), on).select("a.*")
    loose = cut(loose)
    out = one_side.unionByName(_exact(loose, k, f, fields, tol, names))
    out = out.groupBy(*k, "field", "left_value", "right_value").agg(F.sum("copies").alias("copies"))
    return out.select(*[F.col(a).alias(b) for a, b in zip(k, keys)], "field", "left_value", "right_value", "copies")


def _side(t: DataFrame, keys: list[str], fields: list[str], trim: tuple[str, ...], kinds: dict[str, T.DataType], side: int) -> DataFrame:
    def value(c: str) -> Column:
        v = F.col(c).cast(kinds[c])
        v = F.trim(v) if c in trim else v
        return v + F.lit(0.0) if isinstance(kinds[c], T.DoubleType | T.FloatType) else v

    chosen = [value(c).alias(f"k{i}") for i, c in enumerate(keys)] + [value(c).alias(f"f{i}") for i, c in enumerate(fields)]
    return t.select(*chosen, F.lit(1 - side).cast("long").alias("n0"), F.lit(side).cast("long").alias("n1"))


def _no_values() -> list[Column]:
    return [F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")]


def _pair_rows(pairs: DataFrame, k: list[str], f: list[str], fields: list[str], tol: list[float | None]) -> DataFrame:
    """Differing fields of pairs that stand in columns l and r, n times."""
    found = F.array(*[
        F.when(~_same(F.col(f"l.{c}"), F.col(f"r.{c}"), t), F.struct(F.lit(name).alias("field"), F.col(f"l.{c}").cast("string").alias("left_value"), F.col(f"r.{c}").cast("string").alias("right_value")))
        for c, name, t in zip(f, fields, tol)
    ])
    return pairs.select(*k, "n", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("d")).select(*k, "d.*", F.col("n").alias("copies"))


def _extra(names: tuple[str, str]) -> Column:
    return F.when(F.col("l").isNotNull(), names[0] + "_extra").otherwise(names[1] + "_extra").alias("field")


def _exact(loose: DataFrame, k: list[str], f: list[str], fields: list[str], tol: list[float | None], names: tuple[str, str]) -> DataFrame:
    """Leftovers paired at least cost; the different ones of a key are one row."""
    kept = lambda side: F.collect_list(F.when(F.col(side) > 0, F.struct(*f, F.col(side).alias("n"))))
    groups = loose.groupBy(*k).agg(kept("left").alias("ls"), kept("right").alias("rs"))
    single = (F.size("ls") == 1) & (F.size("rs") == 1) & (F.col("ls")[0]["n"] == 1) & (F.col("rs")[0]["n"] == 1)
    easy = groups.where(single).select(*k, F.col("ls")[0].alias("l"), F.col("rs")[0].alias("r"), F.lit(1).cast("long").alias("n"))
    hard = groups.where(~single)
    plan = F.pandas_udf(lambda ls, rs: _assign(ls, rs, f, tol), "array<struct<i: int, j: int, n: bigint>>")
    rows = F.transform(plan("ls", "rs"), lambda p: F.struct(F.get("ls", p.i).alias("l"), F.get("rs", p.j).alias("r"), p.n.alias("n")))
    paired = hard.select(*k, F.explode(rows).alias("p")).select(*k, "p.*")  # only the pair goes with each row, not the lists
    both = easy.unionByName(paired.where(F.col("l").isNotNull() & F.col("r").isNotNull()))
    alone = paired.where(F.col("l").isNull() | F.col("r").isNull()).select(*k, _extra(names), *_no_values(), F.col("n").alias("copies"))
    return _pair_rows(both, k, f, fields, tol).unionByName(alone)


def _assign(ls: pd.Series, rs: pd.Series, f: list[str], tol: list[float | None]) -> pd.Series:
    out = []
    for a, b in zip(ls, rs):
        x, y = ([tuple(_value(row, c) for c in f) for row in side] for side in (a, b))
        left, right = ([int(_value(row, "n")) for row in side] for side in (a, b))
        pairs = best_pairs(x, y, tol, left, right)
        left, right = _unpaired(pairs, left, right)
        spare = [(i, -1, c) for i, c in enumerate(left) if c] + [(-1, j, c) for j, c in enumerate(right) if c]
        out.append([{"i": i, "j": j, "n": n} for i, j, n in [*pairs, *spare]])
    return pd.Series(out)


def best_pairs(ls: list[tuple], rs: list[tuple], tol: list[float | None], left: list[int], right: list[int]) -> list[tuple[int, int, int]]:
    """The pairing of least cost, by a matrix for few rows, or for so many fields that their sets are too many, else by a network."""
    dense = max(sum(left), sum(right)) <= DENSE or (len(ls) + len(rs)) << len(tol) > ARCS
    return (_matrix_pairs if dense else least_differing_pairs)(ls, rs, tol, left, right)


def _value(row, name: str):
    v = row[name] if isinstance(row, dict) else getattr(row, name)
    return None if v is pd.NaT else v
