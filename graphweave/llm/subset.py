"""Choosing a varied subset: cluster-feature trees merged over partitions, Ward linkage, the record nearest each centre."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import cut, lookup, parallelism

#: Dimensions of the random projection of a record's set of members.
DIMS = 64
#: Leaf entries that a tree keeps at most: LEAVES, or LEAVES_A_GROUP for each group wanted if these are more.
LEAVES, LEAVES_A_GROUP = 512, 4
#: Children of a node.
BRANCHES = 24
#: Trees merged by one task.
FAN_IN = 16
#: Most groups formed by one linkage, which holds a matrix of (LEAVES_A_GROUP * MAX_GROUPS) ** 2. A larger subset is
#: first divided into coarse groups that need about PART_GROUPS each.
MAX_GROUPS, PART_GROUPS = 2000, 200
#: Points inserted at once.
BATCH = 4096
#: Records for which a task with trees of its own pays: a tree's first entries cost the same however few follow.
TASK_RECORDS = 20_000

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def project(flat: np.ndarray, sizes: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Unit vectors: the sum of a random sign vector of each member hash, so that a dot product estimates the cosine of two sets."""
    out = np.zeros((len(sizes), dims))
    if len(flat):
        values, inverse = np.unique(flat, return_inverse=True)
        bits = _mix(values ^ np.uint64(0x51ED270B)) if dims <= 64 else None
        signs = ((bits[:, None] >> np.arange(dims, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1
        full = np.flatnonzero(sizes > 0)
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(signs[inverse], starts, axis=0)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class _Node:
    __slots__ = ("leaf", "n", "ls", "ss", "count", "children")

    def __init__(self, leaf: bool, dims: int):
        self.leaf, self.count = leaf, 0
        self.n, self.ls, self.ss = np.zeros(BRANCHES + 1), np.zeros((BRANCHES + 1, dims)), np.zeros(BRANCHES + 1)
        self.children: list[_Node] = []

    def add(self, n: float, ls: np.ndarray, ss: float, child: _Node | None = None) -> None:
        i = self.count
        self.n[i], self.ls[i], self.ss[i] = n, ls, ss
        self.count += 1
        if child is not None:
            self.children.append(child)

    def nearest(self, x: np.ndarray) -> int:
        c = self.ls[: self.count] / self.n[: self.count, None]
        d = c - x
        return int(np.argmin(np.einsum("ij,ij->i", d, d)))

    def total(self) -> tuple[float, np.ndarray, float]:
        k = self.count
        return self.n[:k].sum(), self.ls[:k].sum(axis=0), self.ss[:k].sum()


class CFTree:
    """Cluster features (count, linear sum, square sum) in a height-balanced tree; a leaf entry's radius stays within the threshold.

    When there are more leaf entries than max_leaves, the threshold grows and the tree is built again from its entries."""

    def __init__(self, dims: int, max_leaves: int, threshold: float = 0.0):
        self.dims, self.max_leaves, self.threshold = dims, max_leaves, threshold
        self.root, self.leaves = _Node(True, dims), 0

    def insert(self, n: float, ls: np.ndarray, ss: float) -> None:
        split = self._insert(self.root, n, ls, ss)
        if split is not None:
            old, self.root = self.root, _Node(False, self.dims)
            for part in (old, split):
                self.root.add(*part.total(), part)
        if self.leaves > self.max_leaves:
            self._rebuild()

    def insert_all(self, n: np.ndarray, ls: np.ndarray, ss: np.ndarray) -> None:
        """Many clusters at once: those that leaf entries absorb within the threshold go there by one product of matrices, the others one by one."""
        for at in range(0, len(n), BATCH):
            m, x, y = n[at : at + BATCH], ls[at : at + BATCH], ss[at : at + BATCH]
            rest = np.ones(len(m), bool)
            if self.leaves > 1 and self.threshold > 0:
                nodes = self._leaf_nodes()
                owner = np.repeat(np.arange(len(nodes)), [k.count for k in nodes])
                slot = np.concatenate([np.arange(k.count) for k in nodes])
                en, els, ess = (np.concatenate([getattr(k, f)[: k.count] for k in nodes]) for f in ("n", "ls", "ss"))
                c = els / en[:, None]
                near = ((c * c).sum(axis=1)[None] - 2 * (x / m[:, None]) @ c.T).argmin(axis=1)
                more_n, more_ls, more_ss = np.bincount(near, m, len(en)), np.zeros_like(els), np.bincount(near, y, len(en))
                np.add.at(more_ls, near, x)
                sum_n, sum_ls = en + more_n, els + more_ls
                fits = (ess + more_ss) / sum_n - (sum_ls * sum_ls).sum(axis=1) / (sum_n * sum_n) <= self.threshold + 1e-12
                rest = ~fits[near]
                for i in np.unique(near[~rest]):
                    node, k = nodes[owner[i]], slot[i]
                    node.n[k], node.ls[k], node.ss[k] = sum_n[i], sum_ls[i], ess[i] + more_ss[i]
                self._refresh(self.root)
            for i in np.flatnonzero(rest):
                self.insert(float(m[i]), x[i], float(y[i]))

    def _leaf_nodes(self) -> list[_Node]:
        found, work = [], [self.root]
        while work:
            node = work.pop()
            if node.leaf:
                found.append(node)
            else:
                work.extend(node.children)
        return found

    def _refresh(self, node: _Node) -> tuple:
        if not node.leaf:
            for i, child in enumerate(node.children):
                node.n[i], node.ls[i], node.ss[i] = self._refresh(child)
        return node.total()

    def _insert(self, node: _Node, n: float, ls: np.ndarray, ss: float) -> _Node | None:
        x = ls / n
        if node.count:
            i = node.nearest(x)
            if node.leaf:
                m, sum_, square = node.n[i] + n, node.ls[i] + ls, node.ss[i] + ss
                if max(0.0, square / m - float(sum_ @ sum_) / (m * m)) <= self.threshold + 1e-12:
                    node.n[i], node.ls[i], node.ss[i] = m, sum_, square
                    return None
            else:
                split = self._insert(node.children[i], n, ls, ss)
                node.n[i], node.ls[i], node.ss[i] = node.children[i].total()
                if split is None:
                    return None
                node.add(*split.total(), split)
                return self._split(node) if node.count > BRANCHES else None
        node.add(n, ls, ss)
        self.leaves += 1
        return self._split(node) if node.count > BRANCHES else None

    def _split(self, node: _Node) -> _Node:
        k = node.count
        c = node.ls[:k] / node.n[:k, None]
        d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        a, b = np.unravel_index(int(d.argmax()), d.shape)
        far = d[b] < d[a]
        far[a], far[b] = False, True
        if a == b:
            far = np.arange(k) >= k // 2
        other = _Node(node.leaf, self.dims)
        n, ls, ss, children = node.n[:k].copy(), node.ls[:k].copy(), node.ss[:k].copy(), node.children
        node.count, node.children = 0, []
        for i in range(k):
            (other if far[i] else node).add(n[i], ls[i], ss[i], None if node.leaf else children[i])
        return other

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(np.concatenate([getattr(k, f)[: k.count] for k in self._leaf_nodes()]) for f in ("n", "ls", "ss"))

    def _rebuild(self) -> None:
        n, ls, ss = self.entries()
        c = ls / n[:, None]
        sample = c[:: max(1, len(c) // 256)]
        d = ((sample[:, None] - c[None, :]) ** 2).sum(axis=2)
        d[d <= 1e-12] = np.inf
        near = d.min(axis=1)
        near = near[np.isfinite(near)]
        grown = float(np.quantile(near, 0.25)) / 4 if len(near) else 0.0
        tree = CFTree(self.dims, self.max_leaves, max(self.threshold * 1.5, grown, 1e-9))
        for i in range(len(n)):
            tree.insert(float(n[i]), ls[i], float(ss[i]))
        self.root, self.leaves, self.threshold = tree.root, tree.leaves, tree.threshold


def ward_groups(n: np.ndarray, ls: np.ndarray, k: int) -> np.ndarray:
    """Group of each entry after agglomerating by Ward linkage down to k groups; ties to the first entries."""
    m = len(n)
    group, n, c = np.arange(m), n.astype(float).copy(), ls / n[:, None]
    cost = ((c[:, None] - c[None]) ** 2).sum(axis=2) * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(cost, np.inf)
    alive = m
    best, who = cost.min(axis=1), cost.argmin(axis=1)
    while alive > k:
        i = int(best.argmin())
        j = int(who[i])
        i, j = min(i, j), max(i, j)
        c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
        n[i] += n[j]
        group[group == j] = i
        cost[j], cost[:, j] = np.inf, np.inf
        live = np.isfinite(cost[i])
        live[i] = False
        d = np.full(m, np.inf)
        d[live] = ((c[live] - c[i]) ** 2).sum(axis=1) * n[live] * n[i] / (n[live] + n[i])
        cost[i], cost[:, i] = d, d
        best[j] = np.inf
        stale = np.flatnonzero((who == i) | (who == j))
        better = d < best
        best[better], who[better] = d[better], i
        for s in {*stale.tolist(), i}:
            if s != j:
                who[s] = int(cost[s].argmin())
                best[s] = cost[s, who[s]]
        alive -= 1
    return np.unique(group, return_inverse=True)[1]


_CF_DDL = "cell int, part int, n double, ls array<double>, ss double"


def quotas(scatter: dict[int, float], supply: dict[int, int], seats: int) -> dict[int, int]:
    """Seats of each part of a job: one each, the others by the root of its scatter (highest quotients), none above its supply."""
    got = {k: 1 for k in supply}
    weight = {k: max(scatter.get(k, 0.0), 1e-12) ** 0.5 for k in supply}
    heap = [(-weight[k] / 3, k) for k in supply if supply[k] > 1]
    heapq.heapify(heap)
    left = seats - len(got)
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        got[k] += 1
        left -= 1
        if got[k] < supply[k]:
            heapq.heappush(heap, (-weight[k] / (2 * got[k] + 1), k))
    return got


def _vectors(b: pa.RecordBatch, dims: int) -> np.ndarray:
    m = b.column("members")
    return project(m.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.diff(m.offsets.to_numpy()).astype(np.int64), dims)


def _by_cell(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Cells of a batch with their rows."""
    cells = b.column("cells")
    row, flat = np.repeat(np.arange(b.num_rows), np.diff(cells.offsets.to_numpy())), cells.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) > 0])) if len(flat) else []
    for i, j in zip(first, [*first[1:], len(flat)]):
        yield int(flat[order[i]]), row[order[i:j]]


class _Centres:
    """Finds group centres of cells (sets of records) by cluster-feature trees, and the nearest centre of each record."""

    def __init__(self, spark, dims: int):
        self.spark, self.dims = spark, dims

    def find(self, rows: DataFrame, groups: dict[int, int], floor: int) -> dict[int, np.ndarray]:
        """Centres of each cell: the number wanted, or fewer where it has fewer different records. rows: members, cells."""
        dims, limit = self.dims, {c: max(floor, LEAVES_A_GROUP * k) for c, k in groups.items()}

        def dump(c: int, tree: CFTree, part: int) -> pd.DataFrame:
            n, ls, ss = tree.entries()
            return pd.DataFrame({"cell": np.int32(c), "part": np.int32(part), "n": n, "ls": list(ls), "ss": ss})

        def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees: dict[int, CFTree] = {}
            for b in batches:
                x = _vectors(b, dims)
                for c, at in _by_cell(b):
                    if c in limit:
                        points, n = np.unique(x[at], axis=0, return_counts=True)
                        trees.setdefault(c, CFTree(dims, limit[c])).insert_all(n.astype(float), points * n[:, None], (points * points).sum(axis=1) * n)
            for c, t in trees.items():
                yield pa.RecordBatch.from_pandas(dump(c, t, TaskContext.get().partitionId()), preserve_index=False)

        def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            tree = CFTree(dims, limit[int(key[0])])
            tree.insert_all(pdf["n"].to_numpy(), np.stack(pdf["ls"].to_list()), pdf["ss"].to_numpy())
            return dump(int(key[0]), tree, int(key[1]))

        parts = cut(rows.select("members", "cells").mapInArrow(summarise, _CF_DDL))
        last = parts.agg(F.max("part")).first()[0] or 0
        while last > 0:
            parts = cut(parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("cell", "part").applyInPandas(merge, _CF_DDL))
            last //= FAN_IN

        def linkage(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            n, ls = pdf["n"].to_numpy(), np.stack(pdf["ls"].to_list())
            order = np.lexsort((*ls.T[::-1], -n))
            n, ls = n[order], ls[order]
            g = ward_groups(n, ls, min(groups[int(key[0])], len(n)))
            size, sums = np.bincount(g, n), np.zeros((g.max() + 1, dims))
            np.add.at(sums, g, ls)
            return pd.DataFrame({"cell": np.int32(key[0]), "centre": np.arange(len(size), dtype=np.int32), "c": list(sums / size[:, None])})

        # a centre a record wanted: their number is the sum of the jobs' sizes
        found = parts.groupBy("cell").applyInPandas(linkage, "cell int, centre int, c array<double>").collect()
        out: dict[int, list] = {}
        for r in sorted(found, key=lambda r: (r["cell"], r["centre"])):
            out.setdefault(r["cell"], []).append(r["c"])
        return {c: np.array(x) for c, x in out.items()}

    def nearest(self, rows: DataFrame, centres: dict[int, np.ndarray], keep: list[str]) -> DataFrame:
        """A row (cell, keep, centre, d) for each record and cell with centres."""
        shared, dims = self.spark.sparkContext.broadcast(centres), self.dims

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _vectors(b, dims)
                for cell, at in _by_cell(b):
                    c = shared.value.get(cell)
                    if c is None:
                        continue
                    d = np.maximum(0, (x[at] ** 2).sum(axis=1)[:, None] - 2 * x[at] @ c.T + (c**2).sum(axis=1)[None])
                    near, pick = d.argmin(axis=1), pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), cell, np.int32)), *(b.column(k).take(pick) for k in keep), pa.array(near.astype(np.int32)), pa.array(np.round(d[np.arange(len(at)), near], 9))],
                        names=["cell", *keep, "centre", "d"],
                    )

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
        return rows.select(*dict.fromkeys([*keep, "members", "cells"])).mapInArrow(assign, f"cell int, {kinds}, centre int, d double")


def choose_varied(df: DataFrame, jobs: DataFrame, *, record: str, group: str, members: str, dims: int = DIMS) -> DataFrame:
    """(job_id, run_name, record, centre, group_size): for each job its number of records, one near each of that many group centres.

    df has a row per record: its id, its group and an array of 64-bit hashes of its set's members. jobs has rows (job_id,
    run_name, subset_size); a null run_name takes all groups; a job of null or non-positive size gives no rows; where
    the size reaches the supply all records come out, each its own centre. Records are told apart by group and id.

    Method: sets become unit vectors by a random projection. Each task inserts its vectors into a cluster-feature tree
    per job, whose leaf entries are all that leaves it; trees are merged FAN_IN at a time into one; its entries are
    agglomerated by Ward linkage and cut at the wanted number of groups; each record goes to the nearest centre and the
    nearest record of each centre is chosen, ties by the record's hash. A size above MAX_GROUPS is reached in two steps:
    the same method gives coarse groups, each gets its part of the size by the root of its scatter, and is then grouped
    by the method on its own. Where a centre is nearest to no record (there are fewer different sets than wanted, or
    rounding), the record farthest from its own centre is taken instead, of other sets than those chosen as long as
    there are any. centre numbers the groups of a job.

    Null ids and groups are values of their own; repeated rows of a record count once (any of them is taken); null and
    empty sets are the zero vector; empty tables give no rows; other columns are ignored."""
    spark = df.sparkSession
    plan = [(int(r["job_id"]), r["run_name"], int(r["subset_size"])) for r in jobs.select("job_id", "run_name", "subset_size").distinct().collect() if r["subset_size"] and r["subset_size"] > 0]
    kinds = {c: df.schema[c].dataType.simpleString() for c in (record, group)}
    if not plan:
        return spark.createDataFrame([], f"job_id int, run_name {kinds[group]}, record {kinds[record]}, centre int, group_size bigint")
    rows = df.select(F.col(group).alias("run_name"), F.col(record).alias("record"), F.col(members).cast("array<bigint>").alias("members"))
    # a number of partitions by records, not bytes: the steps that follow work much for each byte
    tasks = max(1, min(parallelism(spark), -(-df.count() // TASK_RECORDS)))
    rows = rows.repartition(tasks, "run_name", "record").groupBy("run_name", "record").agg(F.max(F.coalesce("members", F.array().cast("array<bigint>"))).alias("members"))
    choice = F.array(*[F.when(F.lit(run is None) | (F.col("run_name") == F.lit(run)), F.lit(j)) for j, run, _ in plan])
    rows = rows.withColumn("cells", F.filter(choice, lambda x: x.isNotNull())).where(F.size("cells") > 0)
    rows = cut(rows.select("run_name", "record", "members", "cells", F.xxhash64("run_name", "record").alias("tie"), F.xxhash64("members").alias("set_id")))
    supply = {r["job_id"]: r["count"] for r in rows.select(F.explode("cells").alias("job_id")).groupBy("job_id").count().collect()}
    grouped = {j: k for j, _, k in plan if supply.get(j, 0) > k}
    whole = [j for j, _, k in plan if 0 < supply.get(j, 0) <= k]
    out = rows.select(F.explode("cells").alias("job_id"), "run_name", "record").where(F.col("job_id").isin(whole))
    out = out.select("job_id", "run_name", "record", F.lit(None).cast("int").alias("centre"), F.lit(1).cast("bigint").alias("group_size"))
    if not grouped:
        return out
    work, keep = _Centres(spark, dims), ["run_name", "record", "tie", "set_id"]
    small, large = {j: k for j, k in grouped.items() if k <= MAX_GROUPS}, {j: k for j, k in grouped.items() if k > MAX_GROUPS}
    tables, job_of = [], {j: j for j in small}
    if small:
        tables.append(work.nearest(rows, work.find(rows, small, LEAVES), keep))
    source, base = rows, max(j for j, _, _ in plan) + 1
    while large:
        coarse = cut(work.nearest(source, work.find(source, {c: min(MAX_GROUPS, max(2, -(-k // PART_GROUPS))) for c, k in large.items()}, LEAVES), [*keep, "members"]))
        found = coarse.groupBy("cell", "centre").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("scatter")).collect()  # at most MAX_GROUPS rows a cell
        numbers, groups, again = [], {}, {}
        for c, k in large.items():
            mine = sorted((r for r in found if r["cell"] == c), key=lambda r: r["centre"])
            got = quotas({r["centre"]: r["scatter"] for r in mine}, {r["centre"]: r["n"] for r in mine}, k)
            for r in mine:
                numbers.append((c, r["centre"], base))
                job_of[base] = job_of.get(c, c)
                wanted = got[r["centre"]]
                if wanted > MAX_GROUPS and len(mine) > 1:
                    again[base] = wanted
                else:  # a cell that can't be divided holds one point
                    groups[base] = min(wanted, MAX_GROUPS)
                base += 1
        named = spark.createDataFrame(numbers, "cell int, centre int, number int")
        source = cut(lookup(coarse.drop("d"), named, ["cell", "centre"], len(numbers)).select(*keep, "members", F.array("number").alias("cells")))
        tables.append(work.nearest(source, work.find(source, groups, 1), keep))
        large = again
    near = functools.reduce(DataFrame.unionByName, tables)
    named = spark.createDataFrame(list(job_of.items()), "cell int, job_id int")
    near = cut(lookup(near, named, ["cell"], len(job_of)))
    chosen = near.groupBy("job_id", "cell", "centre").agg(F.min_by(F.struct(*keep), F.struct("d", "tie")).alias("x"), F.count(F.lit(1)).alias("group_size"))
    if len(job_of) > len(grouped) or len(tables) > 1:  # centres are numbered within their part: number them within the job
        chosen = chosen.withColumn("centre", (F.col("cell").cast("bigint") * MAX_GROUPS + F.col("centre")).cast("int"))
        near = near.withColumn("centre", (F.col("cell").cast("bigint") * MAX_GROUPS + F.col("centre")).cast("int"))
    chosen = cut(chosen.select("job_id", "x.*", "centre", "group_size"))
    have = {r["job_id"]: r["count"] for r in chosen.groupBy("job_id").count().collect()}
    picks = chosen.select("job_id", "run_name", "record", "centre", "group_size")
    for j, k in grouped.items():
        short = k - have.get(j, 0)
        if short <= 0:
            continue
        mine, taken = near.where(F.col("job_id") == j), chosen.where(F.col("job_id") == j)
        # at most subset_size rows are taken already
        left = lookup(mine, taken.select("tie"), ["tie"], k, "left_anti")
        fresh = lookup(left, taken.select("set_id").distinct(), ["set_id"], k, "left_anti").groupBy("set_id").agg(F.max_by(F.struct("run_name", "record", "tie", "centre", "d"), F.struct("d", "tie")).alias("x")).select("x.*")
        extra = cut(fresh.orderBy(F.desc("d"), "tie").limit(short))
        missing = short - extra.count()
        if missing > 0:
            rest = lookup(left, extra.select("tie"), ["tie"], k, "left_anti").orderBy(F.desc("d"), "tie").limit(missing)
            extra = extra.unionByName(rest.select(extra.columns))
        picks = picks.unionByName(extra.select(F.lit(j).alias("job_id"), "run_name", "record", "centre", F.lit(1).cast("bigint").alias("group_size")))
    return out.unionByName(picks)
