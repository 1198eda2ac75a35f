"""All similar pairs of set-valued records: sorted sketch forests with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import BROADCAST_ROWS, cut, parallelism

#: Distinct sets that may share a prefix in a tree before their neighbourhood deepens instead of being compared at this depth.
NEIGHBOURHOOD = 2000
#: Depth of the common prefix from which two sets are neighbours, in the first round and in those of crowded sets.
DEPTHS = (2, 4, 6, 8)
#: Rounds after which neighbourhoods that are still larger are compared whole, block against block.
LEVELS = 4
#: Pairs compared at once in a task.
CHUNK = 1 << 20
#: Bits of a set's bitmap; the others of the 64 hold its size up to SIZE_TOP.
BITMAP, SIZE_TOP = 56, 255

_MUL1, _MUL2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.uint64((1 << BITMAP) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def trees_for(threshold: float, depth: int, recall: float) -> int:
    """Trees after which a pair at the threshold has shared a prefix of this depth with the wanted probability."""
    p = threshold**depth
    return 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))


def value_bits(trees: int, depth: int) -> int:
    """Bits of each minhash value in a code: the tree's number and two values beyond the depth have to fit beside."""
    return (63 - (trees - 1).bit_length()) // (depth + 2)


def codes(flat: np.ndarray, sizes: np.ndarray, trees: int, depth: int, seed: int) -> np.ndarray:
    """(sets x trees) of sortable 63-bit codes: the tree's number, then the first depth + 2 minhash values of the set in that tree.

    The order of the codes of a tree is the lexicographic order of its signatures. Values are cut to value_bits, which
    only lets some more sets share a prefix."""
    bits = value_bits(trees, depth)
    out = np.empty((len(sizes), trees), np.int64)
    starts = np.cumsum(sizes) - sizes
    seeds = _mix(np.arange(1, trees * (depth + 2) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    for t in range(trees):
        code = np.full(len(sizes), t, np.uint64)
        for k in range(depth + 2):
            least = np.minimum.reduceat(_mix(flat ^ seeds[t * (depth + 2) + k]), starts)
            code = (code << np.uint64(bits)) | (_mix(least) >> np.uint64(64 - bits))
        out[:, t] = code.astype(np.int64)
    return out


def sketches(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Size (up to SIZE_TOP) and a bitmap of each set's members, in 64 bits."""
    starts = np.cumsum(sizes) - sizes
    bit = np.uint64(1) << (_mix(flat ^ np.uint64(0x51ED270B)) % np.uint64(BITMAP))
    return (np.minimum(sizes, SIZE_TOP).astype(np.uint64) << np.uint64(BITMAP)) | np.bitwise_or.reduceat(bit, starts)


def _possible(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether two sketched sets may reach the threshold. Each bit that only one has stands for a member the other hasn't."""
    n, m = (x >> np.uint64(BITMAP)).astype(np.int64), (y >> np.uint64(BITMAP)).astype(np.int64)
    both = np.minimum(n - np.bitwise_count(x & ~y & _LOW), m - np.bitwise_count(y & ~x & _LOW))
    return (both >= threshold * (n + m - both) - 1e-9) | (n == SIZE_TOP) | (m == SIZE_TOP)


def _index_pairs(first: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of each group of rows in a row, at most about CHUNK at a time."""
    for m in np.unique(lens):
        if m < 2:
            continue
        starts = first[lens == m]
        for k in range(0, m - 1, step := max(1, CHUNK // m)):
            a = np.repeat(np.arange(k, min(m - 1, k + step)), m - 1 - np.arange(k, min(m - 1, k + step)))
            b = np.concatenate([np.arange(i + 1, m) for i in range(k, min(m - 1, k + step))])
            at = max(1, CHUNK // len(a))
            for s in range(0, len(starts), at):
                yield (starts[s : s + at, None] + a).ravel(), (starts[s : s + at, None] + b).ravel()


_PAIR = pa.schema([("rid_a", pa.int64()), ("rid_b", pa.int64())])
_PAIR_DDL = "rid_a bigint, rid_b bigint"


def _neighbours(threshold: float, shift: int, cross: bool, limit: int | None):
    """Rows (code, rid, sketch, side, part) in order of code: candidate pairs among the sets of one prefix (code >> shift).

    Of a neighbourhood above the limit each member comes out as a pair with itself, and nothing is compared. part 0 is
    a whole neighbourhood or block within; 1 and 2 are the two blocks to be crossed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = None, None

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=_PAIR)

        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            prefix, rid, sketch, side, part = cols
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            lens = np.diff(np.concatenate([first, [len(prefix)]]))
            if limit is not None and (lens > limit).any():
                crowd = np.repeat(lens > limit, lens)
                yield out(rid[crowd], rid[crowd])
                first, lens = first[lens <= limit], lens[lens <= limit]
            found: list[np.ndarray] = []
            for i, j in _index_pairs(first, lens):
                ok = _possible(sketch[i], sketch[j], threshold) & ((part[i] != part[j]) | (part[i] == 0)) & (rid[i] != rid[j])
                if cross:
                    ok &= (side[i] | side[j]) == 3
                i, j = rid[i[ok]], rid[j[ok]]
                found.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))
            if found:
                a, b = np.unique(np.concatenate(found, axis=1), axis=1)
                yield out(a, b)

        for b in batches:
            cols = [b.column(c).to_numpy() for c in ("code", "rid", "sketch", "side", "part")]
            cols[0], cols[2] = cols[0] >> shift, cols[2].view(np.uint64)
            if over is not None:  # the rest of a crowded neighbourhood
                same = cols[0] == over
                if same.any():
                    yield out(cols[1][same], cols[1][same])
                    cols = [c[~same] for c in cols]
                if not len(cols[0]):
                    continue
                over = None
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            at = int(np.searchsorted(cols[0], cols[0][-1]))  # the last prefix may go on in the next batch
            if at:
                yield from flush([c[:at] for c in cols])
            held = [c[at:] for c in cols]
            if limit is not None and len(held[0]) > limit:
                yield out(held[1], held[1])
                held, over = None, held[0][0]
        if held is not None and len(held[0]):
            yield from flush(held)

    return run


_TREE_DDL = "code bigint, rid bigint, sketch bigint, side tinyint"


def _tree_rows(trees: int, depth: int, seed: int):
    """A row for each set and tree: no members, only the sortable code, the id and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                items = b.column("items")
                flat = items.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                sizes = np.diff(items.offsets.to_numpy()).astype(np.int64)
                code, sketch = codes(flat, sizes, trees, depth, seed), sketches(flat, sizes).view(np.int64)
                repeated = (np.repeat(x, trees) for x in (b.column("rid").to_numpy(), sketch, b.column("side").to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), *map(pa.array, repeated)], names=["code", "rid", "sketch", "side"])

    return run


def record_sets(df: DataFrame, record: str, member: str, min_size: int = 1, other: DataFrame | None = None) -> DataFrame:
    """(side, record, items): each record's set as sorted 64-bit hashes of its members.

    df has a row per record and member; nulls are ignored, repeated rows count once, records with fewer than min_size
    members are left out. side is 1, with another table 2 for its records."""

    def sets(x: DataFrame, side: int) -> DataFrame:
        x = x.select(F.col(record).alias("record"), F.col(member).alias("member"))
        x = x.where(F.col("record").isNotNull() & F.col("member").isNotNull())
        x = x.groupBy("record").agg(F.array_sort(F.collect_set(F.xxhash64("member"))).alias("items"))
        return x.where(F.size("items") >= min_size).select(F.lit(side).cast("tinyint").alias("side"), "record", "items")

    return sets(df, 1) if other is None else sets(df, 1).unionByName(sets(other, 2))


def class_links(classes: DataFrame, threshold: float, *, recall: float = 0.99999, cross: bool = False) -> DataFrame:
    """(rid_a, rid_b, common, whole) of pairs of different classes, rid_a < rid_b, with common / whole >= threshold.

    classes has a row (rid, items, side) for each distinct set; side 1, 2 or 3 says in which tables it is. In each of
    many independent trees the sets are ordered lexicographically by their minhash signatures; those whose signatures
    have a common prefix of the round's depth are neighbours and become candidates unless their sizes and bitmaps rule
    the threshold out (exact). There are as many trees as let a pair at the threshold meet with the wanted recall. A
    neighbourhood above NEIGHBOURHOOD deepens: its sets go on to a round of greater depth, with as many trees as the
    recall then takes. After the last round what is left is compared whole, block against block, so nothing is
    dropped. Members are fetched once, for the distinct candidates, and compared exactly."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    todo, parts, out = classes, parallelism(classes.sparkSession), None
    for level, depth in enumerate(DEPTHS[:LEVELS]):
        trees = trees_for(threshold, depth, recall)
        shift = value_bits(trees, depth) * 2
        rows = todo.select("rid", "items", "side").mapInArrow(_tree_rows(trees, depth, level + 1), _TREE_DDL)
        near = rows.repartition(parts, F.shiftright("code", shift)).sortWithinPartitions("code").withColumn("part", F.lit(0).cast("tinyint"))
        found = cut(near.mapInArrow(_neighbours(threshold, shift, cross, NEIGHBOURHOOD), _PAIR_DDL).distinct())
        pairs = found.where("rid_a < rid_b")
        out = pairs if out is None else out.unionByName(pairs)
        crowded = found.where("rid_a = rid_b").select(F.col("rid_a").alias("rid"))
        n = crowded.count()
        if not n:
            break
        todo = cut(todo.join(_maybe_broadcast(crowded, n), "rid", "left_semi"))
        if level + 1 == LEVELS:  # what is still crowded, by blocks
            rows = todo.select("rid", "items", "side").mapInArrow(_tree_rows(trees, depth, level + 1), _TREE_DDL).withColumn("prefix", F.shiftright("code", shift))
            sizes = cut(rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NEIGHBOURHOOD))
            large = rows.join(_maybe_broadcast(sizes, sizes.count()), "prefix")
            block = max(1, NEIGHBOURHOOD // 2)
            large = large.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
            large = large.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            part = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).cast("tinyint")
            large = large.select(F.xxhash64("prefix", F.least("i", "j"), F.greatest("i", "j")).alias("code"), "rid", "sketch", "side", part.alias("part"))
            large = large.repartition(parts, "code").sortWithinPartitions("code")
            out = out.unionByName(large.mapInArrow(_neighbours(threshold, 0, cross, None), _PAIR_DDL))
    return _verify(out.distinct(), classes, threshold)


def _verify(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(rid_a, rid_b, common, whole) of the candidates that reach the threshold by their members."""
    pairs = cut(pairs)
    n = pairs.count()
    for side in ("a", "b"):
        items = classes.select(F.col("rid").alias(f"rid_{side}"), F.col("items").alias(f"items_{side}"))
        pairs = (F.broadcast(pairs) if side == "a" and n <= BROADCAST_ROWS else pairs).join(items, f"rid_{side}")
    common = F.size(F.array_intersect("items_a", "items_b")).cast("bigint")
    out = pairs.select("rid_a", "rid_b", common.alias("common"), (F.size("items_a") + F.size("items_b")).cast("bigint").alias("both")).withColumn("whole", F.col("both") - F.col("common"))
    return out.where(F.col("common") >= F.lit(threshold) * F.col("whole") - 1e-9).select("rid_a", "rid_b", "common", "whole")


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def similar_records(df: DataFrame, record: str, member: str, threshold: float, *, min_size: int = 1, other: DataFrame | None = None, recall: float = 0.99999) -> tuple[DataFrame, DataFrame]:
    """Two tables: members (side, record, class_id, links) with a row per record, and class links (class_a, class_b, similarity), class_a < class_b.

    Records with equal sets share a class, whose class_id is the least of them (with another table a struct of side and
    record, the least by both); links counts the classes similar to the record's. With another table, only
    links between classes of both tables count. Sets are compared by Jaccard similarity; ties at the threshold count.
    Nulls are ignored, records without members have no set and no row, an empty table gives empty tables."""
    sets = cut(record_sets(df, record, member, min_size, other))
    name = F.col("record") if other is None else F.struct("side", "record")
    by = sets.groupBy("items").agg(F.min(name).alias("class_id"), F.expr("bit_or(side)").cast("tinyint").alias("side"))
    classes = cut(by.withColumn("rid", F.monotonically_increasing_id()))
    links = class_links(classes, threshold, recall=recall, cross=other is not None)
    names = classes.select("rid", "class_id")
    for side in ("a", "b"):
        links = links.join(names.select(F.col("rid").alias(f"rid_{side}"), F.col("class_id").alias(f"class_{side}")), f"rid_{side}")
    links = cut(links.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), (F.col("common") / F.col("whole")).alias("similarity")))
    ends = links.select(F.col("class_a").alias("class_id")).unionByName(links.select(F.col("class_b").alias("class_id")))
    degree = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    members = sets.join(classes.select("items", "class_id"), "items").select("side", "record", "class_id")
    return members.join(degree, "class_id", "left").select("side", "record", "class_id", F.coalesce("links", F.lit(0)).alias("links")), links


def record_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(record_a, record_b), record_a < record_b: all pairs of one table, those in a class and those of linked classes."""
    m = members.select("record", "class_id")
    pairs = links.select("class_a", "class_b").unionByName(links.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    same = m.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    pairs = pairs.unionByName(same)
    a, b = m.select(F.col("class_id").alias("class_a"), F.col("record").alias("record_a")), m.select(F.col("class_id").alias("class_b"), F.col("record").alias("record_b"))
    return pairs.join(a, "class_a").join(b, "class_b").where(F.col("record_a") < F.col("record_b")).select("record_a", "record_b")
