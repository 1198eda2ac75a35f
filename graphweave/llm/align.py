"""Chaining and aligning the matches of two texts: collinear chains, exact spans, fuzzy passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Cost of a character of gap in a chain, against 1 for a matched one.
GAP_COST = 0.02
#: An alignment of a gap takes at most this share of the gap in edits (at least MIN_EDITS); a gap that needs more ends the passage.
EDIT_SHARE, MIN_EDITS, MAX_EDITS = 0.4, 32, 200
#: What an edit costs when a passage grows beyond its last anchor, how far its score may fall below the best, and the edits tried.
EDIT_COST, DROP, REACH_EDITS = 8, 40, 24
#: Anchors without a long exact half that make a chain worth an alignment.
LEAST_ANCHORS = 3


class _Prefix:
    """Fenwick tree of prefix maxima with the index that attains them."""

    def __init__(self, n: int):
        self.n, self.best, self.who = n, [-1e300] * (n + 1), [-1] * (n + 1)

    def put(self, i: int, v: float, who: int) -> None:
        i += 1
        while i <= self.n:
            if v > self.best[i]:
                self.best[i], self.who[i] = v, who
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Over the positions below i."""
        v, who = -1e300, -1
        while i > 0:
            if self.best[i] > v:
                v, who = self.best[i], self.who[i]
            i -= i & -i
        return v, who


def merge_diagonals(pa_: np.ndarray, pb: np.ndarray, size: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors on one diagonal that overlap or touch become one segment: (start in a, start in b, length, whether one is marked)."""
    order = np.lexsort((pa_, pa_ - pb))
    x, y, n, r = pa_[order], pb[order], size[order], rep[order]
    diag, end = x - y, x + n
    new = np.ones(len(x), bool)
    if len(x) > 1:
        nth = np.cumsum(np.concatenate([[False], diag[1:] != diag[:-1]])) * (1 << 33)
        furthest = np.maximum.accumulate(end + nth) - nth  # of the diagonal so far
        new[1:] = (diag[1:] != diag[:-1]) | (x[1:] > furthest[:-1])
    first = np.flatnonzero(new)
    return x[first], y[first], np.maximum.reduceat(end, first) - x[first], np.logical_or.reduceat(r, first)


def chains(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> list[list[int]]:
    """Segments in collinear chains, the best first: matched length less GAP_COST for each character of gap in either text.

    The best predecessor of each segment comes from a Fenwick tree over the places in b. Chains are read back from their
    ends by falling score; one that runs into a segment of a better chain begins after it, so each segment is in one."""
    if len(x) == 1:
        return [[0]]
    order = np.lexsort((y, x))
    places = np.unique(np.concatenate([y, y + n]))
    at_y, at_end = np.searchsorted(places, y), np.searchsorted(places, y + n)
    by_end = np.argsort(x + n, kind="stable").tolist()
    xs, ys, ns, starts, ends = x.tolist(), y.tolist(), n.tolist(), at_y.tolist(), at_end.tolist()
    tree, score, back, at = _Prefix(len(places)), [0.0] * len(xs), [-1] * len(xs), 0
    for i in order.tolist():
        while at < len(by_end) and xs[by_end[at]] + ns[by_end[at]] <= xs[i]:  # segments that ended before this one begins
            j = by_end[at]
            tree.put(ends[j], score[j] + GAP_COST * (xs[j] + ys[j] + 2 * ns[j]), j)
            at += 1
        v, j = tree.top(starts[i] + 1)
        gain = v - GAP_COST * (xs[i] + ys[i]) if j >= 0 else 0.0
        score[i], back[i] = ns[i] + max(0.0, gain), j if gain > 0 else -1
    taken, out = [False] * len(xs), []
    for i in sorted(range(len(xs)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not taken[i]:
            taken[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


REGION = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.int32()), ("a0", pa.int32()), ("a1", pa.int32()), ("b0", pa.int32()), ("b1", pa.int32()), ("anchors", pa.binary())])
REGION_DDL = "a bigint, b bigint, region int, a0 int, a1 int, b0 int, b1 int, anchors binary"


def chained(x: np.ndarray, y: np.ndarray, n: np.ndarray, sure: np.ndarray, min_len: int, flank: int) -> list[tuple[int, int, int, int, np.ndarray]]:
    """The chains worth an alignment, by region: (a0, a1, b0, b1, anchors), anchors being rows (x, y, length, chain).

    A chain is worth it if one of its anchors is sure (it may be part of an exact span of min_len) or if it has
    LEAST_ANCHORS and covers min_len. A region is a rectangle of both texts whose characters are needed together; a
    chain that lies within flank of an earlier region becomes part of it."""
    x, y, n, sure = merge_diagonals(x, y, n, sure)
    trim = np.minimum(min_len // 16, n // 8)  # neighbours may overlap a little by chance
    boxes, parts = np.empty((0, 4), np.int64), []
    for c, chain in enumerate(chains(x + trim, y + trim, n - 2 * trim)):
        i = np.array(chain)
        a0, a1, b0, b1 = int(x[i[0]]), int((x[i] + n[i]).max()), int(y[i[0]]), int((y[i] + n[i]).max())
        if not sure[i].any() and not (len(i) >= LEAST_ANCHORS and max(a1 - a0, b1 - b0) >= min_len):
            continue
        rows = np.stack([x[i], y[i], n[i], np.full(len(i), c)], axis=1)
        fits = np.flatnonzero((boxes[:, 0] - flank <= a0) & (a1 <= boxes[:, 1] + flank) & (boxes[:, 2] - flank <= b0) & (b1 <= boxes[:, 3] + flank)) if len(boxes) else []
        if len(fits):
            k = int(fits[0])
            boxes[k] = min(a0, boxes[k, 0]), max(a1, boxes[k, 1]), min(b0, boxes[k, 2]), max(b1, boxes[k, 3])
            parts[k].append(rows)
        else:
            boxes = np.concatenate([boxes, [[a0, a1, b0, b1]]])
            parts.append([rows])
    return [(*map(int, box), np.concatenate(p)) for box, p in zip(boxes, parts)]


def by_pair(min_len: int, flank: int):
    """Rows (a, b, pa, pb, size, sure) in order of (a, b) to the regions of each pair."""

    def pairs(cols: list[np.ndarray], first: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in REGION]
        held = 0
        ends = np.append(first[1:], len(cols[0]))
        # a pair without a sure match and with few has no chain worth an alignment
        worth = (ends - first >= LEAST_ANCHORS) | np.logical_or.reduceat(cols[5].astype(bool), first) if len(first) else np.zeros(0, bool)
        for i, j in zip(first[worth].tolist(), ends[worth].tolist()):
            u, v, n = (c[i:j].astype(np.int64) for c in cols[2:5])
            for k, (a0, a1, b0, b1, anchors) in enumerate(chained(u, v, n, cols[5][i:j].astype(bool), min_len, flank)):
                for o, value in zip(out, (cols[0][i], cols[1][i], k, a0, a1, b0, b1, anchors.astype(np.int32).tobytes())):
                    o.append(value)
                held += len(anchors) + 8
            if held > 1 << 17:
                yield batch(out)
                out, held = [[] for _ in REGION], 0
        if held:
            yield batch(out)

    def batch(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, REGION)], schema=REGION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "pa", "pb", "size", "sure")]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            at = change[-1] if len(change) else 0
            if at:
                yield from pairs([c[:at] for c in cols], np.concatenate([[0], change[:-1]]).astype(np.int64))
            held = [c[at:] for c in cols]
        if held is not None and len(held[0]):
            yield from pairs(held, np.zeros(1, np.int64))

    return run


def common(x: str, y: str) -> int:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def ahead(x: str, y: str, i: int, j: int) -> int:
    """How far x from i and y from j agree."""
    n, step = 0, 64
    while True:
        s, t = x[i + n : i + n + step], y[j + n : j + n + step]
        c = common(s, t)
        n += c
        if c < step:
            return n
        step = min(step * 4, 1 << 16)


def edits(x: str, y: str, most: int) -> int | None:
    """Edit distance of both texts if it is at most most: the furthest reach on each diagonal for 0, 1, 2, ... edits."""
    n, m = len(x), len(y)
    if abs(n - m) > most:
        return None
    if not n or not m:
        return max(n, m)
    reach = {0: ahead(x, y, 0, 0)}
    if n == m and reach[0] == n:
        return 0
    for d in range(1, most + 1):
        further = {}
        for k in range(max(-d, -m), min(d, n) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            i = min(i, n, m + k)
            if i < 0 or i - k < 0:
                continue
            further[k] = i + ahead(x, y, i, i - k)
        reach = further
        if reach.get(n - m) == n:
            return d
    return None


def grow(x: str, y: str, i: int, j: int) -> tuple[int, int, int, bool]:
    """How far a passage goes on from x[i], y[j] although single characters differ: (more of x, more of y, edits, whether a text ended)."""
    n, m = len(x) - i, len(y) - j
    first = ahead(x, y, i, j)
    best, reach, ended = (first, first, first, 0), {0: first}, first == min(n, m)
    for d in range(1, REACH_EDITS + 1):
        if ended or not reach:
            break
        further, top = {}, -1e9
        for k in range(-d, d + 1):
            u = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            if u < 0 or u - k < 0 or u > n or u - k > m:
                continue
            u += ahead(x, y, i + u, j + u - k)
            further[k] = u
            score = (2 * u - k) / 2 - EDIT_COST * d
            top = max(top, score)
            if score > best[0]:
                best = (score, u, u - k, d)
                ended = u == n or u - k == m
        reach = further
        if top < best[0] - DROP:
            break
    return best[1], best[2], best[3], ended


def align(x: str, y: str, x_open: tuple[bool, bool], y_open: tuple[bool, bool], anchors: np.ndarray, min_len: int, identity: float) -> tuple[list[tuple], list[tuple], bool]:
    """(exact spans (x, y, length), passages (x0, x1, y0, y1, edits), whether more of the texts is needed).

    x, y: the characters of a region; x_open, y_open: whether the text goes on before and after it. anchors: rows (x, y,
    length, chain) in them. Each anchor's own characters are compared and it is extended until the texts differ; the gaps
    of a chain are aligned, a chain is split where that takes too many edits, and its ends grow over single differences.
    Passages are taken longest first; one of which more than half is in earlier ones in both texts is left out."""
    back_x, back_y, nx, ny = x[::-1], y[::-1], len(x), len(y)
    runs: dict[int, list[list[int]]] = {}  # by diagonal: start, end, best chain
    more = False
    for u, v, n, c in sorted(map(tuple, anchors.tolist())):
        seen = runs.setdefault(u - v, [])
        if seen and seen[-1][1] >= u + n:
            seen[-1][2] = min(seen[-1][2], c)
            continue
        if x[u : u + n] != y[v : v + n]:
            continue
        left, right = ahead(back_x, back_y, nx - u, ny - v), n + ahead(x, y, u + n, v + n)
        a0, a1, b0, b1 = u - left, u + right, v - left, v + right
        more |= (a0 == 0 and x_open[0] or b0 == 0 and y_open[0]) or (a1 == nx and x_open[1] or b1 == ny and y_open[1])
        if more:
            return [], [], True
        seen.append([a0, a1, c])
    spans, passages, segments = [], [], {}
    for k, found in runs.items():
        for a0, a1, c in found:
            segments.setdefault(c, []).append((a0, a0 - k, a1 - a0))
            if a1 - a0 >= min_len:
                spans.append((a0, a0 - k, a1 - a0))
    for chain in segments.values():
        now = None
        for u, v, n in sorted(chain):
            if now is not None:
                over = max(0, now[1] - u, now[3] - v)
                if over >= n:
                    continue
                gap = edits(x[now[1] : u + over], y[now[3] : v + over], min(MAX_EDITS, max(MIN_EDITS, int(EDIT_SHARE * max(u + over - now[1], v + over - now[3])))))
                if gap is not None:
                    now = [now[0], u + n, now[2], v + n, now[4] + gap]
                    continue
                passages.append(now)
            now = [u, u + n, v, v + n, 0]
        if now is not None:
            passages.append(now)
    out: set[tuple] = set()
    known_x, known_y = np.zeros(nx, bool), np.zeros(ny, bool)
    for x0, x1, y0, y1, d in sorted(passages, key=lambda p: p[0] - p[1]):
        if known_x[x0:x1].sum() * 2 > x1 - x0 and known_y[y0:y1].sum() * 2 > y1 - y0:
            continue
        du, dv, e, ended = grow(x, y, x1, y1)
        if ended and (x1 + du == nx and x_open[1] or y1 + dv == ny and y_open[1]):
            return [], [], True
        x1, y1, d = x1 + du, y1 + dv, d + e
        du, dv, e, ended = grow(back_x, back_y, nx - x0, ny - y0)
        if ended and (x0 == du and x_open[0] or y0 == dv and y_open[0]):
            return [], [], True
        x0, y0, d = x0 - du, y0 - dv, d + e
        longer = max(x1 - x0, y1 - y0)
        if longer >= min_len and d <= (1 - identity) * longer:
            out.add((x0, x1, y0, y1, d))
            known_x[x0:x1], known_y[y0:y1] = True, True
    return spans, sorted(out), False


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.int32()), ("kind", pa.int8()), ("x0", pa.int32()), ("x1", pa.int32()), ("y0", pa.int32()), ("y1", pa.int32()), ("edits", pa.int32())])
FOUND_DDL = "a bigint, b bigint, region int, kind tinyint, x0 int, x1 int, y0 int, y1 int, edits int"
#: kinds of rows of FOUND
SPAN, PASSAGE, MORE = 0, 1, 2


def aligned(min_len: int, identity: float):
    """(a, b, region, anchors, from0, text0, ends0, from1, text1, ends1) to rows of FOUND; MORE asks for wider flanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in FOUND]

            def put(*row):
                for o, v in zip(out, row):
                    o.append(v)

            for i in range(b.num_rows):
                a_, b_, region, blob, f0, t0, e0, f1, t1, e1 = (c[i].as_py() for c in b.columns)
                rows = np.frombuffer(blob, np.int32).reshape(-1, 4) - np.array([f0, f1, 0, 0], np.int32)
                spans, passages, more = align(t0, t1, (f0 > 0, not e0), (f1 > 0, not e1), rows, min_len, identity)
                if more:
                    put(a_, b_, region, MORE, 0, 0, 0, 0, 0)
                for u, v, n in spans:
                    put(a_, b_, region, SPAN, u + f0, u + f0 + n, v + f1, v + f1 + n, 0)
                for x0, x1, y0, y1, d in passages:
                    put(a_, b_, region, PASSAGE, x0 + f0, x1 + f0, y0 + f1, y1 + f1, d)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, FOUND)], schema=FOUND)

    return run


SLICE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("region", pa.int32()), ("side", pa.int32()), ("first", pa.int32()), ("chars", pa.string()), ("ends", pa.bool_())])
SLICE_DDL = "a bigint, b bigint, region int, side int, first int, chars string, ends boolean"
#: Characters of slices in a batch.
SLICE_BATCH = 1 << 21


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, wanted: list of (a, b, region, side, lo, hi)) to those parts of the text."""
    out: list[list] = [[] for _ in SLICE]
    held = 0
    for b in batches:
        for text, wanted in zip(b.column(0), b.column(1)):
            t = text.as_py()
            for w in wanted.as_py():
                lo = max(0, w["lo"])
                part = t[lo : w["hi"]]
                for o, v in zip(out, (w["a"], w["b"], w["region"], w["side"], lo, part, w["hi"] >= len(t))):
                    o.append(v)
                held += len(part) + 50
                if held > SLICE_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SLICE)], schema=SLICE)
                    out, held = [[] for _ in SLICE], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, SLICE)], schema=SLICE)
