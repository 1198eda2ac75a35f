"""Flat tables from deeply nested records: vectorised structural indexing of JSON text, and native explodes of arrays.

The index of a block of payloads is built with whole-array operations: a bitmap of the quotes that delimit strings, whose
running parity says what lies in a string; bitmaps of brackets and delimiters outside; a prefix sum of the brackets gives
the nesting level of each delimiter; sorting the delimiters by (payload, level) puts those of one container side by
side, from which the spans of all elements follow. The same index decides whether a payload is complete: the order of its
tokens, the pairs of brackets, the escapes and the literals are checked as arrays. Only the bitmaps are as long as the
text, a byte each; numbers are kept for tokens alone.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays of an annotation that become tables of their own.
KINDS = ("segments_info", "nodes", "links")
#: Bytes of payload indexed at once; a longer payload is a block of its own.
BLOCK = 4 << 20

# classes of bytes outside strings: fixed values of the format
_OTHER, _OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR, _COMMA, _COLON, _SPACE, _QUOTE = range(9)
_CLASS = np.zeros(256, np.uint8)
for _text, _class in (("{", _OPEN_OBJ), ("}", _CLOSE_OBJ), ("[", _OPEN_ARR), ("]", _CLOSE_ARR), (",", _COMMA), (":", _COLON), ("\t\n\r ", _SPACE), ('"', _QUOTE)):
    _CLASS[list(_text.encode())] = _class
_BACK = 92
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_WORDS = [np.frombuffer(w, np.uint8) for w in (b"true", b"false", b"null")]
# states of a number: 0 begin, 1 minus, 2 zero, 3 digits, 4 point, 5 fraction, 6 e, 7 sign of e, 8 exponent, 9 none
_STEP = np.full((10, 256), 9, np.uint8)
for _from, _bytes, _to in ((0, b"-", 1), (0, b"0", 2), (0, b"123456789", 3), (1, b"0", 2), (1, b"123456789", 3), (3, b"0123456789", 3), (2, b".", 4), (3, b".", 4), (4, b"0123456789", 5), (5, b"0123456789", 5),
                           (2, b"eE", 6), (3, b"eE", 6), (5, b"eE", 6), (6, b"+-", 7), (6, b"0123456789", 8), (7, b"0123456789", 8), (8, b"0123456789", 8)):
    _STEP[_from, list(_bytes)] = _to
_NUMBER = np.isin(np.arange(10), (2, 3, 5, 8))


_U = re.compile(r"\\(?:u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)")


def _character(m: re.Match) -> str:
    c = json.loads(f'"{m[0]}"') if m[0][1] == "u" else m[0]
    return m[0] if len(m[0]) == 2 or c < " " or c in '"\\' or "\ud800" <= c <= "\udfff" else c


def is_json(text: bytes | str | None) -> bool:
    """Whether the text is one complete JSON value (NaN and Infinity are none)."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return bool(raw) and len(Index([raw]).kept) == 1


class Index:
    """Containers and elements of the complete payloads among texts.

    kept: which texts are complete; payload i below is text kept[i]. Containers (objects and arrays): c_open, c_close
    (positions in buf), c_level, c_parent (element, -1 at the top), c_payload. Elements (array elements and object
    members): e_box (container), e_no (position in it), e_start, e_end (value's span, blanks trimmed), key_from, key_to
    (span of the raw key; -1 in arrays)."""

    def __init__(self, texts: list[bytes]):
        self.kept = np.arange(len(texts))
        while True:
            self.buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)  # a blank after each keeps them apart
            self.bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
            bad = self._scan()
            if not bad.any():
                break
            texts, self.kept = [t for t, x in zip(texts, bad) if not x], self.kept[~bad]
        self._elements()

    def _owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def _scan(self) -> np.ndarray:
        """Finds the tokens; which payloads are incomplete. Stops at the first kind of fault, as it may hide others."""
        buf, n = self.buf, len(self.bounds) - 1
        back = np.flatnonzero(buf == _BACK)
        first = np.concatenate([[True], np.diff(back) > 1]) if len(back) else np.zeros(0, bool)
        nth = np.arange(len(back)) - np.maximum.accumulate(np.where(first, np.arange(len(back)), 0)) if len(back) else back
        escapes = back[nth % 2 == 0]  # the odd ones of a run of backslashes
        quotes = np.flatnonzero(buf == 34)
        quotes = quotes[~np.isin(quotes - 1, escapes, assume_unique=True)] if len(escapes) else quotes
        bad = np.bincount(self._owner(quotes), minlength=n) % 2 == 1
        if bad.any():
            return bad
        mark = np.zeros(len(buf), np.uint8)
        mark[quotes] = 1
        inside = np.bitwise_xor.accumulate(mark).view(bool) if len(buf) else mark.view(bool)  # from the opening quote to before the closing one
        opening, closing = quotes[::2], quotes[1::2]
        # strings: no control characters, known escapes
        wrong = np.flatnonzero((buf < 32) & inside)
        bad[self._owner(wrong)] = True
        escapes = escapes[inside[escapes]]
        wrong = escapes[~_ESCAPED[buf[escapes + 1]]]
        bad[self._owner(wrong)] = True
        points = escapes[buf[escapes + 1] == 117]
        for k in range(2, 6):
            at = np.minimum(points + k, len(buf) - 1)
            bad[self._owner(points[~_HEX[buf[at]]])] = True
        # tokens: structural characters, strings, literals
        kind = _CLASS[buf]
        kind[inside] = _SPACE
        kind[closing] = _SPACE
        other = kind == _OTHER
        starts = np.flatnonzero(other[1:] & ~other[:-1]) + 1
        starts = np.concatenate([[0], starts]) if len(other) and other[0] else starts
        stops = np.flatnonzero(other[:-1] & ~other[1:]) + 1  # a blank is last
        bad[self._owner(starts[~self._literal(starts, stops)])] = True
        blank = kind == _SPACE
        blank[inside] = False
        blank[closing] = False
        mark[:] = (kind > _OTHER) & (kind < _SPACE)
        mark[opening] = 1
        mark[starts] = 1
        kind[opening] = _QUOTE
        tokens = np.flatnonzero(mark).astype(np.int32 if len(buf) < 1 << 31 else np.int64)
        del mark, other, inside, quotes, opening, closing, starts, stops
        sort = kind[tokens]
        del kind
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(np.searchsorted(tokens, self.bounds)))
        opens, closes = (sort == _OPEN_OBJ) | (sort == _OPEN_ARR), (sort == _CLOSE_OBJ) | (sort == _CLOSE_ARR)
        balance = np.bincount(owner[opens], minlength=n) - np.bincount(owner[closes], minlength=n)
        bad |= (balance != 0) | (np.bincount(owner, minlength=n) == 0)
        if bad.any():
            return bad
        level = np.cumsum(opens.astype(np.int8) - closes.astype(np.int8), dtype=np.int32) + closes
        inner = (opens | closes | (sort == _COMMA) | (sort == _COLON))
        bad[owner[inner & (level < 1)]] = True
        if bad.any():
            return bad
        # structural tokens by payload, level and place
        at = np.flatnonzero(inner).astype(np.int32)
        at = at[np.argsort(owner[at].astype(np.int64) * (int(level.max(initial=0)) + 1) + level[at], kind="stable").astype(np.int32)]  # by place within
        is_open = opens[at]
        box = np.cumsum(is_open, dtype=np.int32) - 1
        object_ = np.zeros(len(tokens), bool)
        if len(at):
            opener = sort[at][is_open][box]
            object_[at] = opener == _OPEN_OBJ
            wrong = closes[at] & (sort[at] != opener + 1)
            bad[owner[at[wrong]]] = True
        # the order of the tokens
        edge = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        before = np.where(edge, 255, np.concatenate([[255], sort[:-1]])) if len(sort) else sort
        last = np.concatenate([edge[1:], [True]]) if len(edge) else edge
        after = np.where(last, 255, np.concatenate([sort[1:], [255]])) if len(sort) else sort
        starts_value = opens | (sort == _QUOTE) | (sort == _OTHER)
        in_object = np.concatenate([[False], object_[:-1]]) if len(sort) else object_
        key = (sort == _QUOTE) & ((before == _OPEN_OBJ) | ((before == _COMMA) & in_object))
        ends_value = closes | (sort == _OTHER) | ((sort == _QUOTE) & ~key)
        ended = np.concatenate([[False], ends_value[:-1]]) & ~edge if len(sort) else ends_value
        ok = np.where(
            ended, np.isin(sort, (_COMMA, _CLOSE_OBJ, _CLOSE_ARR)) & inner,
            np.where(
                sort == _COLON, np.concatenate([[False], key[:-1]]) & ~edge,
                np.where(before == _OPEN_OBJ, key | (sort == _CLOSE_OBJ), np.where(before == _OPEN_ARR, starts_value | (sort == _CLOSE_ARR), np.where((before == _COMMA) & in_object, key, starts_value))),
            ),
        ) if len(sort) else ended
        ok &= ~key | (after == _COLON)
        ok &= ~last | ends_value
        bad[owner[~ok]] = True
        if not bad.any():
            self._tokens = (tokens[at], sort[at], level[at], owner[at], is_open, box)
            self._blank = blank
            step = np.diff(blank.view(np.int8), prepend=0, append=0)
            self._blank_from, self._blank_to = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return bad

    def _literal(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Which of these runs of characters are numbers, true, false or null."""
        size, ok = stops - starts, np.zeros(len(starts), bool)
        for w in _WORDS:
            same = np.flatnonzero(size == len(w))
            ok[same] |= (self.buf[starts[same, None] + np.arange(len(w))] == w).all(axis=1)
        live, state, k = np.flatnonzero(~ok), np.zeros(int((~ok).sum()), np.uint8), 0
        while len(live):
            state = _STEP[state, self.buf[starts[live] + k]]
            k += 1
            done = size[live] == k
            ok[live[done]] = _NUMBER[state[done]]
            go = ~done & (state != 9)
            live, state = live[go], state[go]
        return ok

    def _skip(self, at: np.ndarray) -> np.ndarray:
        """The first places from at on that aren't blank."""
        i = np.searchsorted(self._blank_from, at, "right") - 1
        within = (i >= 0) & (at < self._blank_to[np.maximum(i, 0)]) if len(self._blank_from) else np.zeros(len(at), bool)
        return np.where(within, self._blank_to[np.maximum(i, 0)] if len(self._blank_to) else 0, at)

    def _trim(self, end: np.ndarray) -> np.ndarray:
        """The last ends up to end after which only blanks follow."""
        i = np.searchsorted(self._blank_from, end - 1, "right") - 1
        within = (i >= 0) & (end - 1 < self._blank_to[np.maximum(i, 0)]) if len(self._blank_from) else np.zeros(len(end), bool)
        return np.where(within, self._blank_from[np.maximum(i, 0)] if len(self._blank_from) else 0, end)

    def _elements(self) -> None:
        tok, ch, lvl, own, is_open, box = self._tokens
        self.c_open, self.c_close = tok[is_open], tok[(ch == _CLOSE_OBJ) | (ch == _CLOSE_ARR)]
        self.c_level, self.c_payload = lvl[is_open], own[is_open]
        plain = np.flatnonzero(ch != _COLON).astype(np.int32)
        nth = np.flatnonzero((ch[plain] != _CLOSE_OBJ) & (ch[plain] != _CLOSE_ARR))
        begins, ends = plain[nth], plain[nth + 1] if len(nth) else nth
        start, end, e_box = tok[begins] + 1, tok[ends], box[begins]
        member = begins + 1 < ends
        colon = np.where(member, tok[np.minimum(begins + 1, max(0, len(tok) - 1))], -1) if len(tok) else begins
        key = start
        start, end = self._skip(np.where(member, colon + 1, start)), self._trim(end)
        full = end > start  # else an empty container
        first = np.concatenate([[True], e_box[1:] != e_box[:-1]]) if len(e_box) else np.zeros(0, bool)
        run = np.arange(len(e_box)) - np.maximum.accumulate(np.where(first, np.arange(len(e_box)), 0)) if len(e_box) else e_box
        self.e_box, self.e_no, self.e_start, self.e_end = e_box[full], run[full], start[full], end[full]
        member, key, colon = member[full], key[full], colon[full]
        self.key_from, self.key_to = np.where(member, self._skip(key) + 1, -1), np.where(member, self._trim(colon) - 1, -1)
        by_start = np.argsort(self.e_start, kind="stable")
        self.c_parent = np.full(len(self.c_open), -1, np.int64)
        if len(by_start):
            at_e = np.searchsorted(self.e_start[by_start], self.c_open)
            hit = (at_e < len(by_start)) & (self.e_start[by_start][np.minimum(at_e, len(by_start) - 1)] == self.c_open)
            self.c_parent[hit] = by_start[at_e[hit]]

    def text(self, start: int, end: int) -> bytes:
        """The characters there without blanks outside strings, \\u escapes as the characters they mean where these may stand in a string."""
        part, blank = self.buf[start:end], self._blank[start:end]
        raw = (part[~blank] if blank.any() else part).tobytes()
        return _U.sub(_character, raw.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass") if b"\\u" in raw else raw

    def key_is(self, word: str) -> np.ndarray:
        """Which elements are object members of this name."""
        raw = np.frombuffer(word.encode(), np.uint8)
        size = self.key_to - self.key_from
        out = np.zeros(len(size), bool)
        same = np.flatnonzero((self.key_from >= 0) & (size == len(raw)))
        if len(same):
            out[same] = (self.buf[self.key_from[same][:, None] + np.arange(len(raw))] == raw).all(axis=1)
        return out

    def paths(self, elements: np.ndarray, base: list[str]) -> list[str]:
        """Path of each element: base of its payload, then .key or [position] for each level."""
        known: dict[int, str] = {}

        def of_box(c: int) -> str:
            chain = []
            while c not in known:
                chain.append(c)
                e = int(self.c_parent[c])
                if e < 0:
                    break
                c = int(self.e_box[e])
            for c in reversed(chain):
                e = int(self.c_parent[c])
                known[c] = base[int(self.c_payload[c])] if e < 0 else known[int(self.e_box[e])] + step(e)
            return known[chain[0] if chain else c]

        def step(e: int) -> str:
            k = int(self.key_from[e])
            return f"[{int(self.e_no[e])}]" if k < 0 else "." + self.buf[k : int(self.key_to[e])].tobytes().decode("utf-8", "replace")

        return [of_box(int(self.e_box[e])) + step(e) for e in elements.tolist()]


def _text_json(raw: bytes) -> bytes | None:
    """What a JSON string literal holds if that begins like an object or array; whether it is complete shows when it is indexed."""
    if raw[1:].lstrip()[:1] not in (b"{", b"[", b"\\"):
        return None
    inner = json.loads(raw).strip()
    return inner.encode("utf-8", "surrogatepass") if inner[:1] in ("{", "[") else None


def child_spans(texts: list[bytes], kinds: tuple[str, ...] = KINDS, whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str] | None, list[bytes] | None]]:
    """Arrays (payload, ann_no, kind, child_no, path, body) of the objects in arrays named as a kind, in complete payloads; path and body if whole."""
    # what a text is: the payload itself (ann -1), or a text inside an annotation, there the value of a kind, one element of it (child >= 0) or neither (kind -1)
    work = [(t, i, -1, -1, -1, "$") for i, t in enumerate(texts)]
    while work:
        x = Index([w[0] for w in work])
        work = [work[i] for i in x.kept]
        base = [w[5] for w in work]
        rec, ann0, kind0, child0 = (np.array([w[j] for w in work], np.int64) for j in (1, 2, 3, 4))
        work = []
        n_c, n_e = len(x.c_open), len(x.e_start)
        if not n_c:
            continue
        pay, e_pay = x.c_payload, x.c_payload[x.e_box]
        is_obj = x.buf[x.c_open] == 123
        kind_e = np.full(n_e, -1, np.int64)
        for k, word in enumerate(KINDS):
            kind_e[x.key_is(word)] = k
        named = x.key_is("annotations")
        # annotation number of each container and element, from the outer levels to the inner ones
        c_ann, e_ann = np.where(x.c_level == 1, ann0[pay], -1), np.full(n_e, -1, np.int64)
        c_list = np.zeros(n_c, bool)
        level_e = x.c_level[x.e_box]
        by_c, by_e = np.argsort(x.c_level, kind="stable"), np.argsort(level_e, kind="stable")
        top = int(x.c_level.max())
        cuts_c, cuts_e = np.searchsorted(x.c_level[by_c], np.arange(1, top + 2)), np.searchsorted(level_e[by_e], np.arange(1, top + 2))
        for level in range(1, top + 1):
            c_now = by_c[cuts_c[level - 1] : cuts_c[level]]
            c_now = c_now[x.c_parent[c_now] >= 0]
            up = x.c_parent[c_now]
            of_list = named[up] & (level_e[up] == 1) & (ann0[pay[c_now]] < 0)
            c_ann[c_now] = np.where(of_list & is_obj[c_now], 0, e_ann[up])
            c_list[c_now] = of_list & ~is_obj[c_now]
            e_now = by_e[cuts_e[level - 1] : cuts_e[level]]
            e_ann[e_now] = np.where(c_list[x.e_box[e_now]], x.e_no[e_now], c_ann[x.e_box[e_now]])
        has = x.c_parent >= 0
        c_kind = np.full(n_c, -1, np.int64)
        c_kind[has] = kind_e[x.c_parent[has]]
        c_kind[x.c_level == 1] = kind0[pay[x.c_level == 1]]
        wanted = np.array([k in kinds for k in (*KINDS, None)])  # -1 is none
        # lone objects: the value of a kind, or a text that is one element
        lone = np.flatnonzero(is_obj & (c_kind >= 0) & (c_ann >= 0) & wanted[c_kind])
        child = np.where((x.c_level[lone] == 1) & (child0[pay[lone]] >= 0), child0[pay[lone]], 0)
        if len(lone):
            paths = bodies = None
            if whole:
                up = x.c_parent[lone]
                inner = iter(x.paths(up[up >= 0], base))
                paths = [base[pay[c]] if u < 0 else next(inner) for c, u in zip(lone, up)]
                bodies = [x.text(a, b + 1) for a, b in zip(x.c_open[lone], x.c_close[lone])]
            yield rec[pay[lone]], c_ann[lone], c_kind[lone], child, paths, bodies
        in_array = ~is_obj[x.e_box] & (c_kind[x.e_box] >= 0) & (e_ann >= 0) & ~((x.c_level[x.e_box] == 1) & (child0[e_pay] >= 0))
        e = np.flatnonzero(in_array & (x.buf[x.e_start] == 123) & wanted[c_kind[x.e_box]]) if n_e else np.zeros(0, np.int64)
        if len(e):
            bodies = [x.text(a, b) for a, b in zip(x.e_start[e], x.e_end[e])] if whole else None
            yield rec[e_pay[e]], e_ann[e], c_kind[x.e_box[e]], x.e_no[e], x.paths(e, base) if whole else None, bodies
        if not n_e:
            continue
        # strings that may hold JSON
        maybe = (x.buf[x.e_start] == 34) & ((e_ann >= 0) | (named & (level_e == 1) & (ann0[e_pay] < 0)))
        second = x.buf[np.minimum(x.e_start + 1, len(x.buf) - 1)]
        found = np.flatnonzero(maybe & (np.isin(second, (123, 91, _BACK)) | (_CLASS[second] == _SPACE)))
        for e, path in zip(found.tolist(), x.paths(found, base) if whole else [""] * len(found)):
            inner = _text_json(x.buf[x.e_start[e] : x.e_end[e]].tobytes())
            if inner is None:
                continue
            p = e_pay[e]
            if e_ann[e] < 0:  # the list of annotations is itself a text
                work.append((b'{"annotations":' + inner + b"}", int(rec[p]), -1, -1, -1, base[p]))
            elif in_array[e]:
                work.append((inner, int(rec[p]), int(e_ann[e]), int(c_kind[x.e_box[e]]), int(x.e_no[e]), path))
            else:
                work.append((inner, int(rec[p]), int(e_ann[e]), int(kind_e[e]), -1, path))


def _blocks(payloads: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
    rows, texts, size = [], [], 0
    for i, p in enumerate(payloads):
        raw = p.as_buffer().to_pybytes() if p.is_valid else b""
        if raw:
            if size + len(raw) > BLOCK and rows:
                yield rows, texts
                rows, texts, size = [], [], 0
            rows.append(i)
            texts.append(raw)
            size += len(raw)
    if rows:
        yield rows, texts


def nested_children(df: DataFrame, record: str, payload: str, body: bool = True, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(record_id, ann_no, kind, child_no, path, body): one row per JSON object in an array called segments_info, nodes or links,
    at any depth in an annotation of the payload. path says where it lies in the payload, so that the row of an object
    around it is the one whose path begins its own; body is its JSON text without blanks between tokens. With body=False one row (record_id, ann_no,
    kind, child_no) per place.

    A payload's annotations are the elements of its member annotations; ann_no and child_no are 0-based positions.
    Elements that aren't objects take a position but give no row; a lone object counts as a list of one; text holding
    JSON counts as its content. Null, empty and incomplete payloads give no row, repeated payloads of a record give
    their rows once, different ones all of theirs. Records without id keep a null id. Other columns of df are ignored.
    kinds restricts the arrays taken."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(KINDS)
        for batch in batches:
            ids = batch.column(0)
            for rows, texts in _blocks(batch.column(1)):
                at = np.array(rows)
                for rec, ann, kind, child, paths, bodies in child_spans(texts, kinds, body):
                    columns = [ids.take(pa.array(at[rec])), pa.array(ann, pa.int32()), names.take(pa.array(kind)), pa.array(child, pa.int32())]
                    if body:
                        columns += [pa.array(paths, pa.string()), pa.array([b.decode("utf-8", "replace") for b in bodies], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["record_id", "ann_no", "kind", "child_no", "path", "body"][: len(columns)])

    of = df.schema[record].dataType.simpleString()
    rows = df.select(F.col(record).alias("record_id"), F.col(payload).cast("string").alias("payload")).where(F.col("payload").isNotNull())
    more = ", path string, body string" if body else ""
    return rows.mapInArrow(expand, f"record_id {of}, ann_no int, kind string, child_no int{more}").distinct()


def child_tables(children: DataFrame) -> dict[str, DataFrame]:
    """The children of nested_children as typed tables segments_info, nodes and links, each row keyed by record_id, ann_no, child_no and path.

    A field that is missing or not of its type is null; numbers written as text count as numbers."""

    def number(name: str, kind: str):
        return F.expr(f"try_cast(get_json_object(body, '$.{name}') AS {kind})").alias(name)

    def text(name: str):
        return F.get_json_object("body", f"$.{name}").alias(name)

    fields = {
        "segments_info": [number("id", "bigint"), number("category_id", "int"), number("area", "bigint"), number("iscrowd", "int")],
        "nodes": [number("id", "bigint"), text("label")],
        "links": [number("s", "bigint"), number("r", "bigint"), text("pos")],
    }
    return {k: children.where(F.col("kind") == k).select("record_id", "ann_no", "child_no", "path", *cols).distinct() for k, cols in fields.items()}


def flatten(df: DataFrame, keys: dict[str, str], array: str, order: str, fields: list[str]) -> DataFrame:
    """The elements of a typed array column as rows: keys (result name -> column), child_no and the elements' fields.

    Of several deliveries of one key the last by order counts (ties: the first by the array's hash); null and empty
    arrays give no rows; null elements take a position but give no row. A null key is a key of its own."""
    columns = [F.col(c).alias(n) for n, c in keys.items()]
    rows = df.select(*columns, F.col(array).alias("__items"), F.struct(F.col(order), F.xxhash64(F.to_json(F.struct(array)))).alias("__by"))
    last = rows.groupBy(*keys).agg(F.max_by("__items", "__by").alias("__items"))
    out = last.select(*keys, F.posexplode("__items").alias("child_no", "__x")).where(F.col("__x").isNotNull())
    return out.select(*keys, "child_no", *[F.col(f"__x.{f}").alias(f) for f in fields])
