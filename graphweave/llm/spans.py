"""Spans that texts share: seeds, chains and alignments.

Positions and lengths count code points. A span of at least min_len characters that two texts share holds min_len - k + 1
windows of k characters; of each run of that many windows both texts take the one with the least hash as a seed, so they
take at least one seed in common at the same place of the span. Shared seeds are therefore a complete candidate search.
A seed in many texts is replaced by longer ones near its places, and those still in many texts by the whole windows of
min_len around them: there a span is found by its first window, which other characters precede in the two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweave.llm.align import FOUND_DDL, LEAST_ANCHORS, MORE, PASSAGE, REGION_DDL, SLICE_DDL, SPAN, aligned, by_pair, slices
from graphweave.session import BROADCAST_ROWS, cut, lookup, parallelism, small_batches

#: Characters of a seed, or four fifths of min_len if that is less.
SEED = 32
#: Texts with one seed up to which they are paired at once; more frequent ones are first narrowed to longer windows.
HOT_TEXTS = 64
#: Block of a group of texts that share a whole window, if the group is above HOT_TEXTS; blocks are paired with blocks.
BLOCK_TEXTS = 64
#: Characters first read beside a region, in min_len; where the texts still agree at its edge, FLANK_MORE times as many.
FLANK, FLANK_MORE = 2, 8
#: Occurrences of frequent seeds in a text up to which texts meet by each LEAST_ANCHORS of them in order.
FEW_SEEDS = 24
#: Parts of the rows that want pieces of one text.
WANT_PARTS = 64

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_powers: dict[str, np.ndarray] = {}


def _power(n: int, which: str) -> np.ndarray:
    held = _powers.get(which)
    if held is None or len(held) < n:
        size = 1 << max(16, int(n).bit_length())
        held = np.full(size, _BASE if which == "up" else _INVERSE, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        _powers[which] = held
    return held[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sums(points: np.ndarray) -> np.ndarray:
    """Prefix sums of the code points times powers of the base."""
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(0x51ED27)) * _power(len(points), "up"), out=sums[1:])
    return sums


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= _MUL
    h ^= h >> np.uint64(29)
    return h


def window_hashes(points: np.ndarray, k: int, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each window of k code points, equal for equal windows of any text."""
    n = len(points)
    if n < k:
        return np.empty(0, np.uint64)
    sums = _sums(points) if sums is None else sums
    return _mixed((sums[k:] - sums[:-k]) * _power(n - k + 1, "down"))


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op.reduce of each window of w values: suffixes and prefixes of blocks of w."""
    n, top = len(x), np.uint64(0xFFFFFFFFFFFFFFFF) if op is np.minimum else np.uint64(0)
    blocks = np.full(-(-n // w) * w, top, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    prefix = op.accumulate(blocks, axis=1).ravel()
    suffix = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(suffix[: n - w + 1], prefix[w - 1 : n])


def seeds(points: np.ndarray, k: int, w: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, later) of a text's seeds: the windows of least hash among any w in a row.

    Repetitive stretches give seeds in a row with equal hash, always a period apart; those after the first are marked later."""
    h = window_hashes(points, k, sums)
    if len(h) < w:
        return h[:0], np.empty(0, np.int64), np.empty(0, bool)
    least = _sliding(h, w, np.minimum)
    pad = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(pad, w, np.maximum) == h)
    v = h[at]
    return v, at, np.concatenate([np.zeros(min(1, len(v)), bool), (v[1:] == v[:-1]) & (np.diff(at) < w)])


_SEED = pa.schema([("grp", pa.int64()), ("h", pa.int64()), ("doc", pa.int64()), ("pos", pa.int32()), ("kind", pa.int8()), ("lft", pa.int32()), ("rgt", pa.int32())])
_SEED_DDL = "grp bigint, h bigint, doc bigint, pos int, kind tinyint, lft int, rgt int"
# kind: 0 seed, 1 later seed of a repetitive stretch, +2 hot occurrence on its way past the grouping, 4 note that the hash is hot


def _halves(sums: np.ndarray, at: np.ndarray, k: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the half characters before and after each window of k, 0 where the text has fewer."""
    left, right = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
    if half == 0:
        return left + 1, right + 1
    for out, start, has in ((left, at - half, at >= half), (right, at + k, at + k + half < len(sums))):
        p = start[has]
        h = _mixed((sums[p + half] - sums[p]) * _power(len(sums), "down")[p])
        out[has] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32) | 1
    return left, right


def _seed_rows(k: int, w: int, hot_texts: int, near: int | None = None):
    """Seeds of (doc, text); with near only those that may lie in one window of w + k - 1 with a seed of near characters at the places of a third column."""
    size = w + k - 1
    half = -(-(size - k) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            places = b.column(2) if near is not None else None
            for i, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                points = code_points(text.as_py())
                sums = _sums(points)
                h, at, rep = seeds(points, k, w, sums)
                if places is not None:
                    p = np.sort(places[i].values.to_numpy().astype(np.int64))
                    # of the places at or after at - (size - k), the first
                    nth = np.searchsorted(p, at - (size - k))
                    close = (nth < len(p)) & (p[np.minimum(nth, len(p) - 1)] <= at + size - near)
                    h, at, rep = h[close], at[close], rep[close]
                left, right = _halves(sums, at, k, half)
                parts.append((h, np.full(len(h), doc, np.int64), at.astype(np.int32), rep.astype(np.int8), left, right))
            if not parts:
                continue
            h, doc, pos, kind, left, right = (np.concatenate(x) for x in zip(*parts))
            h = h.view(np.int64)
            grp = h.copy()
            values, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
            hot = (counts > hot_texts)[inverse]
            if hot.any():
                texts = np.unique(np.stack([inverse[hot], doc[hot]]), axis=1)[0]
                busy = np.bincount(texts, minlength=len(values)) > hot_texts
                hot = busy[inverse]
                kind = np.where(hot, kind + 2, kind).astype(np.int8)
                grp = np.where(hot, grp ^ (doc * np.int64(0x5851F42D4C957F2D & 0x7FFFFFFFFFFFFFFF)), grp)
                note = values[busy]
                grp, h = np.concatenate([grp, note]), np.concatenate([h, note])
                none = np.zeros(len(note), np.int32)
                doc, pos = np.concatenate([doc, np.full(len(note), -1, np.int64)]), np.concatenate([pos, none - 1])
                kind = np.concatenate([kind, np.full(len(note), 4, np.int8)])
                left, right = np.concatenate([left, none]), np.concatenate([right, none])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (grp, h, doc, pos, kind, left, right)], schema=_SEED)

    return run


_MATCH = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("pa", pa.int32()), ("pb", pa.int32()), ("size", pa.int32()), ("sure", pa.bool_()), ("h", pa.int64())])
_MATCH_DDL = "a bigint, b bigint, pa int, pb int, size int, sure boolean, h bigint"


def _matches(size: int, hot_texts: int):
    """Rows of _SEED in order of (grp, h): pairs of occurrences in different texts; occurrences of hot seeds come out with b null, their hash as h, the half windows' as pb and size, and sure unless they are later seeds of a stretch.

    A match is sure if the half window before or after it agrees too: of a common window of min_len one half does.
    Of two repetitive stretches the first seed of each meets all of the other, with the length for which both go on: a
    match on every diagonal they have."""

    def emit(cols, first):
        """Whole groups."""
        h, doc, pos, kind, left, right = cols
        lens = np.diff(np.concatenate([first, [len(h)]]))
        hot_group = np.maximum.reduceat(kind, first) >= 4
        out, waiting = [], 0
        for i, n in zip(first[(lens > 1) | hot_group], lens[(lens > 1) | hot_group]):
            s = slice(i, i + n)
            d, p, q, lf, rg = doc[s], pos[s], kind[s], left[s], right[s]
            real = q < 2
            texts = len(np.unique(d[real]))
            if q.max() >= 4 or texts > hot_texts:
                out.append((d[real], None, p[real], lf[real], rg[real], h[s][real], q[real] & 1 == 0))
            elif texts > 1:
                order = np.lexsort((p, d))
                d, p, q, lf, rg = d[order], p[order], q[order], lf[order], rg[order]
                stretch = np.cumsum(q & 1 == 0)
                rest = p[np.searchsorted(stretch, stretch, "right") - 1] - p
                later = np.flatnonzero(q & 1)
                lead = np.flatnonzero(q & 1 == 0)
                for x, y in [tuple(lead[z] for z in np.triu_indices(len(lead), 1)), *((np.full(len(later), z), later) for z in lead if len(later))]:
                    x, y = x[d[x] != d[y]], y[d[x] != d[y]]
                    swap = d[x] > d[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    sure = ((lf[x] == lf[y]) & (lf[x] != 0)) | ((rg[x] == rg[y]) & (rg[x] != 0))
                    out.append((d[x], d[y], p[x], p[y], (size + np.minimum(rest[x], rest[y])).astype(np.int32), sure))
                    waiting += len(x)
                    if waiting > 1 << 18:
                        yield from rows(out)
                        out, waiting = [], 0
        past = kind & 2 != 0
        if past.any():
            out.append((doc[past], None, pos[past], left[past], right[past], h[past], kind[past] & 1 == 0))
        yield from rows(out)

    def rows(out):
        cols = [[] for _ in _MATCH]
        for a, b, u, v, n, last, *lead in out:  # last: whether sure, of hot occurrences the hash
            none = pa.nulls(len(a), pa.int64())
            row = (pa.array(a), none, pa.array(u), pa.array(v), pa.array(n), pa.array(*lead), pa.array(last)) if b is None else (pa.array(a), pa.array(b), pa.array(u), pa.array(v), pa.array(n), pa.array(last), none)
            for c, x in zip(cols, row):
                c.append(x)
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], schema=_MATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(c).to_numpy() for c in _SEED.names]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            cut_at = change[-1] if len(change) else 0
            if cut_at:
                yield from emit([c[:cut_at] for c in cols[1:]], np.concatenate([[0], change[:-1]]).astype(np.int64))
            held = [x[cut_at:] for x in cols]
            if len(held[0]) > 4096 and len(np.unique(held[2])) > hot_texts:  # a hot group: pass it on and remember
                real = held[4] < 2
                yield from rows([(held[2][real], None, held[3][real], held[5][real], held[6][real], held[1][real], held[4][real] & 1 == 0)])
                none = np.array([-1], np.int32)
                held = [held[0][:1], held[1][:1], np.array([-1]), none, np.array([4], np.int8), none, none]
        if held is not None and len(held[0]):
            yield from emit(held[1:], np.zeros(1, np.int64))

    return run


def _whole_windows(k: int, min_len: int):
    """(doc, text, at): all min_len windows that hold one of the seeds at these places, with the character before (-1 at the text's start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, at in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                points = code_points(text.as_py())
                h = window_hashes(points, min_len)
                if not len(h):
                    continue
                p = at.values.to_numpy().astype(np.int64)
                inside = np.zeros(len(h) + 1, np.int64)
                np.add.at(inside, np.clip(p - (min_len - k), 0, len(h)), 1)
                np.add.at(inside, np.clip(p + 1, 0, len(h)), -1)
                starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
                before = np.concatenate([[-1], points.astype(np.int32)])[starts]
                yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), pa.array(np.full(len(starts), doc, np.int64)), pa.array(starts.astype(np.int32)), pa.array(before.astype(np.int32))], names=["h", "doc", "pos", "before"])

    return run


class SharedSpans:
    """What texts share: exact spans of at least min_len characters, and fuzzy passages.

    docs: rows with an id (bigint) and a text. Of rows with equal text one stands for all (class_id = least id). Rows
    with null id or text and texts below min_len have no spans. A repeated id must have one text; its repeated rows
    count once. An empty table gives empty tables; other columns are ignored. Texts are compared whole.

    Method: shared seeds of seed_len characters are joined by hash; the matches of a pair of texts are chained with gap
    costs through a Fenwick tree; of each chain that may hold a span of min_len, or has several seeds, both texts' characters are
    fetched and aligned: seeds are compared character by character and extended until the texts differ, gaps are aligned
    by edit distance, ends grow over single differences. Exact spans are complete (see the module's text). For
    passages the seeds in more than hot_texts texts are matched too, in all pairs of texts that may have a chain of them."""

    def __init__(self, docs: DataFrame, doc: str = "doc_id", text: str = "text", min_len: int = 250, seed_len: int | None = None, hot_texts: int = HOT_TEXTS, identity: float = 0.8):
        self.min_len = min_len
        self.k = seed_len or max(1, min(SEED, min_len * 4 // 5))
        if not 1 <= self.k <= min_len:
            raise ValueError("seed_len must be from 1 to min_len")
        self.long_k = max(self.k, min_len * 4 // 5)
        self.hot_texts, self.identity = hot_texts, identity
        self.spark = docs.sparkSession
        self.docs = docs.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= min_len))
        self._aligned: dict[tuple[bool, bool], DataFrame] = {}

    @cached_property
    def members(self) -> DataFrame:
        """(class_id, doc) of texts with a copy: rows point to the least id of their text; a class is never gathered. Equal texts have equal keys (96 bits and the length)."""
        key = [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), F.length("text").alias("chars")]
        ids = self.docs.select("doc", *key)
        first = ids.groupBy("k1", "k2", "chars").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return cut(ids.join(first, ["k1", "k2", "chars"]).select("class_id", "doc").distinct())

    @cached_property
    def _representatives(self) -> tuple[DataFrame, DataFrame | None]:
        """The texts that stand for their class; if the copies are too many to broadcast, all texts and the ids to drop later."""
        copies = self.members.where("doc != class_id").select("doc")
        n = copies.count()
        if n == 0:
            return self.docs, None
        if n <= BROADCAST_ROWS:
            return self.docs.join(F.broadcast(copies), "doc", "left_anti"), None
        return self.docs, copies

    def _grouped(self, rows: DataFrame, size: int) -> DataFrame:
        near = rows.repartition(parallelism(self.spark), "grp", "h").sortWithinPartitions("grp", "h", "doc")
        return cut(near.mapInArrow(_matches(size, self.hot_texts), _MATCH_DDL))

    def _places(self, hot: DataFrame) -> DataFrame:
        """(doc, text, at): the places of hot seeds with a half window beside them that another text has too; without one no window of min_len is shared there."""
        halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("pb").alias("v")), F.struct(F.lit(1).alias("side"), F.col("size").alias("v"))))
        keys = hot.select(F.col("a").alias("doc"), F.col("pa").alias("pos"), "h", halves.alias("x")).select("doc", "pos", "h", "x.side", "x.v").where("v != 0")
        shared = cut(keys.groupBy("h", "side", "v").agg((F.min("doc") < F.max("doc")).alias("shared")).where("shared").drop("shared"))
        kept = lookup(keys, shared, ["h", "side", "v"], shared.count(), "left_semi")
        places = cut(kept.groupBy("doc").agg(F.collect_set("pos").alias("at")))
        return self._texts_for(places).select("doc", "text", "at")

    @cached_property
    def _seeded(self) -> tuple[DataFrame, DataFrame]:
        """(matches of seeds in few texts, occurrences of those in many)."""
        with small_batches(self.spark):
            texts, drop = self._representatives
            rows = texts.select("doc", "text").mapInArrow(_seed_rows(self.k, self.min_len - self.k + 1, self.hot_texts), _SEED_DDL)
            if drop is not None:
                rows = rows.join(drop, "doc", "left_anti").select(_SEED.names)
            found = self._grouped(rows, self.k)
        return found.where(F.col("b").isNotNull()).drop("h"), found.where(F.col("b").isNull())

    @cached_property
    def _found(self) -> tuple[DataFrame, DataFrame | None]:
        """(matches of seeds in few texts, all windows of min_len around the others)."""
        matches, hot = self._seeded
        with small_batches(self.spark):
            if hot.isEmpty():
                return matches, None
            rows = self._places(hot).mapInArrow(_seed_rows(self.long_k, self.min_len - self.long_k + 1, self.hot_texts, self.k), _SEED_DDL)
            found = self._grouped(rows, self.long_k)
            matches, hot = matches.unionByName(found.where(F.col("b").isNotNull()).drop("h")), found.where(F.col("b").isNull())
            if hot.isEmpty():
                return matches, None
            windows = self._places(hot).mapInArrow(_whole_windows(self.long_k, self.min_len), "h bigint, doc bigint, pos int, before int")
            return matches, cut(windows)

    def _first_windows(self, rows: DataFrame) -> DataFrame:
        """Matches of whole windows where a span begins: other characters precede it in the two texts, or none."""
        # elsewhere the window before is shared by the same texts, and the span begins further left
        groups = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("before").alias("b0"), F.max("before").alias("b1"))
        groups = cut(groups.where("d0 < d1 AND (b0 < b1 OR b0 = -1)").select("h", "n"))
        rows = rows.join(groups, "h").withColumn("blocks", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int")).withColumn("i", F.pmod(F.xxhash64("doc", "pos"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = rows.where("i <= j").select("h", "i", "j", F.col("doc").alias("x"), F.col("pos").alias("px"), F.col("before").alias("bx"))
        right = rows.where("i >= j").select("h", F.col("j").alias("i"), F.col("i").alias("j"), F.col("doc").alias("y"), F.col("pos").alias("py"), F.col("before").alias("by"))
        begins = (F.col("bx") != F.col("by")) | (F.col("bx") == -1)
        pairs = left.join(right, ["h", "i", "j"]).where(begins & ((F.col("x") < F.col("y")) | ((F.col("i") != F.col("j")) & (F.col("x") != F.col("y")))))
        first = F.col("x") < F.col("y")
        return pairs.select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("px")).otherwise(F.col("py")).alias("pa"),
            F.when(first, F.col("py")).otherwise(F.col("px")).alias("pb"), F.lit(self.min_len).alias("size"), F.lit(True).alias("sure"),
        )

    @cached_property
    def _frequent(self) -> DataFrame | None:
        """Matches of seeds in many texts, for all pairs of texts with a chain that may be worth an alignment; None without such seeds.

        Such a pair has a match of a rarer seed, a sure one, or LEAST_ANCHORS frequent seeds in the same order. Texts of at
        most FEW_SEEDS meet by these; with a text of more, those that have one in common after each text's most frequent
        LEAST_ANCHORS - 1, in one order for all texts, are passed over."""
        rows = self._seeded[1]
        if rows.isEmpty():
            return None
        hot = rows.select(F.col("a").alias("doc"), F.col("pa").alias("pos"), "h", F.col("pb").alias("lft"), F.col("size").alias("rgt"), F.col("sure").alias("lead")).distinct()
        in_order = Window.partitionBy("doc", "h").orderBy("pos")
        hot = hot.withColumn("nth", F.row_number().over(in_order)).withColumn("stretch", F.sum(F.col("lead").cast("int")).over(in_order))
        hot = cut(hot.withColumn("rest", F.max("pos").over(Window.partitionBy("doc", "h", "stretch")) - F.col("pos")))
        held = hot.where(F.col("nth") <= LEAST_ANCHORS)  # further ones of a hash change nothing about LEAST_ANCHORS in common
        held = held.join(held.groupBy("h", "nth").agg(F.count(F.lit(1)).alias("n")), ["h", "nth"])
        held = held.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("n"), "h", "nth"))).where(F.col("place") >= LEAST_ANCHORS)
        halves = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("lft").alias("v")), F.struct(F.lit(1).alias("side"), F.col("rgt").alias("v"))))
        sure = hot.select("doc", "h", halves.alias("x")).where("x.v != 0").select(F.xxhash64("h", "x.side", "x.v").alias("key"), "doc")
        sizes = hot.groupBy("doc").agg(F.count(F.lit(1)).alias("seeds"))
        few, many = sizes.where(F.col("seeds") <= FEW_SEEDS).where(F.col("seeds") >= LEAST_ANCHORS).select("doc"), sizes.where(F.col("seeds") > FEW_SEEDS).select("doc")
        run = last = hot.join(few, "doc").select("doc", F.col("pos").alias("at"), F.array("h").alias("run"))
        for _ in range(LEAST_ANCHORS - 1):
            run = run.join(last.select("doc", F.col("at").alias("then"), F.col("run").alias("more")), "doc").where("at < then").select("doc", F.col("then").alias("at"), F.concat("run", "more").alias("run"))
        pairs = self._together(run.select(F.xxhash64("run").alias("key"), "doc").unionByName(sure))
        busy = held.join(many, "doc", "left_semi").select("h", "nth", F.col("doc").alias("y"))
        mixed = busy.join(held.select("h", "nth", F.col("doc").alias("x")), ["h", "nth"]).where("x != y")
        pairs = pairs.unionByName(mixed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        pairs = cut(pairs.unionByName(self._found[0].select("a", "b")).distinct())
        x, y = (hot.select(F.col("doc").alias(d), "h", *[F.col(c).alias(f"{c}_{d}") for c in ("pos", "lft", "rgt", "lead", "rest")]) for d in "ab")
        same = F.lit(False)
        for c in ("lft", "rgt"):
            same = same | (F.col(f"{c}_a") == F.col(f"{c}_b")) & (F.col(f"{c}_a") != 0)
        met = pairs.join(x, "a").join(y, ["b", "h"]).where(F.col("lead_a") | F.col("lead_b"))
        return met.select("a", "b", F.col("pos_a").alias("pa"), F.col("pos_b").alias("pb"), (F.least("rest_a", "rest_b") + self.k).cast("int").alias("size"), same.alias("sure"))

    def _together(self, rows: DataFrame) -> DataFrame:
        """(a, b), a < b: texts with a key in common; the texts of a key meet in pairs of blocks."""
        rows = cut(rows.distinct())
        rows = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK_TEXTS).cast("int"))
        rows = rows.withColumn("i", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        left = rows.where("i <= j").select("key", "i", "j", F.col("doc").alias("x"))
        right = rows.where("i >= j").select("key", F.col("j").alias("i"), F.col("i").alias("j"), F.col("doc").alias("y"))
        pairs = left.join(right, ["key", "i", "j"]).where((F.col("x") < F.col("y")) | ((F.col("i") != F.col("j")) & (F.col("x") != F.col("y"))))
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def _align(self, hot: bool, fuzzy: bool = False) -> DataFrame:
        """Rows of FOUND for all matches, or for those of seeds in few texts only; with fuzzy also for chains of seeds in many."""
        matches, windows = self._found
        fuzzy = fuzzy and self._frequent is not None
        hot = (fuzzy, hot or windows is None)
        if hot in self._aligned:
            return self._aligned[hot]
        if hot[1] and windows is not None:
            matches = matches.unionByName(self._first_windows(windows))
        if fuzzy:
            matches = matches.unionByName(self._frequent)
        flank, out = self.min_len * FLANK, None
        near = matches.distinct().repartition(parallelism(self.spark), "a", "b").sortWithinPartitions("a", "b")
        with small_batches(self.spark):
            todo = cut(near.mapInArrow(by_pair(self.min_len, flank), REGION_DDL))
            while True:
                grown = cut(self._read(todo, flank))
                done = grown.where(F.col("kind") != MORE)
                out = done if out is None else out.unionByName(done)
                again = grown.where(F.col("kind") == MORE).select("a", "b", "region")
                if again.isEmpty():
                    break
                todo, flank = todo.join(again, ["a", "b", "region"], "left_semi"), flank * FLANK_MORE
        self._aligned[hot] = out
        return out

    def _read(self, regions: DataFrame, flank: int) -> DataFrame:
        """The regions aligned with flank characters beside them."""
        key = ["a", "b", "region"]

        def want(side: int, doc: str) -> DataFrame:
            lo, hi = (F.col(f"{doc}0") - flank).alias("lo"), (F.col(f"{doc}1") + flank).alias("hi")
            return regions.select(F.col(doc).alias("doc"), F.struct(*key, F.lit(side).alias("side"), lo, hi).alias("w"))

        wanted = want(0, "a").unionByName(want(1, "b")).groupBy("doc", F.pmod(F.xxhash64("w"), F.lit(WANT_PARTS)).alias("part")).agg(F.collect_list("w").alias("wanted"))
        sides = self._texts_for(wanted).select("text", "wanted").mapInArrow(slices, SLICE_DDL)
        both = sides.groupBy(*key).agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{n}{s}") for s in (0, 1) for c, n in (("first", "from"), ("chars", "text"), ("ends", "ends"))])
        both = regions.select(*key, "anchors").join(both, key)
        return both.select(*key, "anchors", "from0", "text0", "ends0", "from1", "text1", "ends1").mapInArrow(aligned(self.min_len, self.identity), FOUND_DDL)

    def _texts_for(self, wanted: DataFrame) -> DataFrame:
        texts = self._representatives[0]
        ids = cut(wanted.select("doc").distinct())
        if ids.count() <= BROADCAST_ROWS:
            texts = texts.join(F.broadcast(ids), "doc", "left_semi")
        return texts.dropDuplicates(["doc"]).join(wanted, "doc")

    def exact(self, hot: bool = True) -> DataFrame:
        """(a, b, start_a, start_b, chars): maximal spans of at least min_len between representatives, a < b."""
        rows = self._align(hot).where(F.col("kind") == SPAN)
        return rows.select("a", "b", F.col("x0").alias("start_a"), F.col("y0").alias("start_b"), (F.col("x1") - F.col("x0")).alias("chars")).distinct()

    def passages(self) -> DataFrame:
        """(a, b, from_a, to_a, from_b, to_b, edits, identity): aligned chains of at least min_len characters and the wanted identity.

        identity is 1 - edits / length of the longer side. Of passages that overlap in both texts by more than half the longer one is given."""
        rows = self._align(True, fuzzy=True).where(F.col("kind") == PASSAGE).select("a", "b", F.col("x0").alias("from_a"), F.col("x1").alias("to_a"), F.col("y0").alias("from_b"), F.col("y1").alias("to_b"), "edits").distinct()
        return rows.withColumn("identity", 1 - F.col("edits") / F.greatest(F.col("to_a") - F.col("from_a"), F.col("to_b") - F.col("from_b")))

    def classes(self) -> DataFrame:
        """(class_id, doc) of all texts that have a copy."""
        return self.members.select("class_id", "doc")

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b), doc_a < doc_b: all documents that share a span, copies included."""
        links = self.exact().select("a", "b").distinct()
        own = self.members.select("class_id", "doc")
        a = links.join(own.select(F.col("class_id").alias("a"), F.col("doc").alias("x")), "a", "left").withColumn("x", F.coalesce("x", "a"))
        both = a.join(own.select(F.col("class_id").alias("b"), F.col("doc").alias("y")), "b", "left").withColumn("y", F.coalesce("y", "b")).select("x", "y")
        copies = own.select("class_id", F.col("doc").alias("x")).join(own.select("class_id", F.col("doc").alias("y")), "class_id").where("x < y").select("x", "y")
        return both.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).unionByName(copies.select(F.col("x").alias("doc_a"), F.col("y").alias("doc_b")))

    def shares(self) -> DataFrame:
        """(doc, chars, shared_chars, share): each document of at least min_len characters, how much of it other documents hold.

        A character counts if a window of min_len around it is in another document. Windows in many texts count by their
        occurrences, without pairs of texts. A document with a copy is shared whole."""
        e = self.exact(hot=False)
        sides = e.select(F.col("a").alias("class_id"), F.col("start_a").alias("s"), "chars").unionByName(e.select(F.col("b").alias("class_id"), F.col("start_b").alias("s"), "chars"))
        windows = self._found[1]
        if windows is not None:
            held = windows.groupBy("h").agg((F.min("doc") < F.max("doc")).alias("shared")).where("shared").select("h")
            sides = sides.unionByName(windows.join(held, "h", "left_semi").select(F.col("doc").alias("class_id"), F.col("pos").alias("s"), F.lit(self.min_len).alias("chars")))
        iv = sides.groupBy("class_id", "s").agg(F.max(F.col("s") + F.col("chars")).alias("e"))
        order = Window.partitionBy("class_id").orderBy("s")
        before = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), before))
        covered = iv.withColumn("fresh", fresh).groupBy("class_id").agg(F.sum("fresh").alias("covered"))
        docs = self.docs.select("doc", F.length("text").cast("bigint").alias("chars")).distinct()
        docs = docs.join(self.members.select("doc", "class_id", F.lit(True).alias("copied")), "doc", "left").withColumn("class_id", F.coalesce("class_id", "doc"))
        shared = F.when(F.col("copied"), F.col("chars")).otherwise(F.coalesce("covered", F.lit(0)).cast("bigint"))
        return docs.join(covered, "class_id", "left").select("doc", "chars", shared.alias("shared_chars"), (shared / F.col("chars")).alias("share"))
