"""Frequency of every distinct value: heavy-light aggregation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.session import BROADCAST_ROWS, cut, lookup

#: Counters of a task's summary, from which heavy terms are found.
COUNTERS = 4096
#: At most so many terms are counted in local arrays; their number bounds what is broadcast.
HEAVY_TERMS = 4096
#: A longer term is never counted as heavy, which bounds the broadcast in bytes too.
HEAVY_CHARS = 256
#: Distinct light terms a task holds before it passes their counts on.
LIGHT_TERMS = 1 << 17


COUNTS = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])


def _batch_counts(b: pa.RecordBatch) -> Iterator[tuple[str | None, pa.Array, np.ndarray, np.ndarray]]:
    """Of a batch (field, terms, n): by field the distinct terms, the occurrences (each listed term n times) and the records of each."""
    terms, fields = b.column("terms"), b.column("field").dictionary_encode()
    flat = terms.flatten().dictionary_encode()
    row = np.repeat(np.arange(b.num_rows), np.diff(terms.offsets.to_numpy()))
    code = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    times = b.column("n").to_numpy(zero_copy_only=False)
    of = fields.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for f in np.unique(of):
        mine = (of[row] == f) & (code >= 0)
        k, r = code[mine], row[mine]
        used, slot = np.unique(k, return_inverse=True)
        occurrences = np.zeros(len(used), np.int64)
        np.add.at(occurrences, slot, times[r])
        records = np.bincount(np.unique(r * (len(flat.dictionary) + 1) + k) % (len(flat.dictionary) + 1), minlength=len(flat.dictionary) + 1)[used] if len(used) else occurrences
        yield (None if f < 0 else fields.dictionary[int(f)].as_py()), flat.dictionary.take(pa.array(used)), occurrences, records


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's most frequent terms with lower bounds of their records: a frequent-items summary of COUNTERS counters."""
    held: dict[tuple, int] = {}
    for b in batches:
        for f, terms, _, records in _batch_counts(b):
            short = pc.less_equal(pc.utf8_length(terms), HEAVY_CHARS).to_numpy(zero_copy_only=False)
            for t, n in zip(terms.filter(pa.array(short)).to_pylist(), records[short].tolist()):
                held[f, t] = held.get((f, t), 0) + n
        if len(held) > COUNTERS:  # what the first counter beyond the bound has is taken from all
            over = sorted(held.values(), reverse=True)[COUNTERS]
            held = {k: n - over for k, n in held.items() if n > over}
    yield pa.RecordBatch.from_pydict({"field": [k[0] for k in held], "term": [k[1] for k in held], "n": list(held.values())}, schema=pa.schema([("field", pa.string()), ("term", pa.string()), ("n", pa.int64())]))


def heavy_terms(rows: DataFrame, limit: int = HEAVY_TERMS) -> list[tuple[str, str]]:
    """The (field, term) that lead the merged summaries of all tasks, at most limit. rows: (field, terms, n), or (field, term) each a record."""
    if "terms" not in rows.columns:
        rows = rows.select("field", F.array("term").alias("terms"))
    if "n" not in rows.columns:
        rows = rows.withColumn("n", F.lit(1).cast("bigint"))
    merged = rows.select("field", "terms", "n").mapInArrow(_summaries, "field string, term string, n bigint").groupBy("field", "term").agg(F.sum("n").alias("n"))
    return [(r[0], r[1]) for r in merged.where(F.col("n") > 1).orderBy(F.desc("n"), "field", "term").limit(limit).collect()]


def _counter(top: list[tuple[str, str]]):
    """Counts of the heavy terms in arrays, of which only the totals leave the task; of the others by what a task can hold."""
    slots: dict[str | None, dict[str, int]] = {}
    for i, (f, t) in enumerate(top):
        slots.setdefault(f, {})[t] = i
    sets = {f: (pa.array(list(x), pa.string()), np.array(list(x.values()))) for f, x in slots.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, records = np.zeros(len(top), np.int64), np.zeros(len(top), np.int64)
        light: dict[tuple, list[int]] = {}

        def leave() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in light.items()]
            light.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), COUNTS)] if rows else [pa.array([], f.type) for f in COUNTS], schema=COUNTS)

        for b in batches:
            for f, terms, n, r in _batch_counts(b):
                rest = np.ones(len(terms), bool)
                if f in sets:
                    names, ids = sets[f]
                    at = pc.index_in(terms, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
                    hit = at >= 0
                    occurrences[ids[at[hit]]] += n[hit]  # terms are distinct in a batch
                    records[ids[at[hit]]] += r[hit]
                    rest = ~hit
                for t, x, y in zip(terms.filter(pa.array(rest)).to_pylist(), n[rest].tolist(), r[rest].tolist()):
                    have = light.setdefault((f, t), [0, 0])
                    have[0] += x
                    have[1] += y
            if len(light) > LIGHT_TERMS:
                yield leave()
        yield leave()
        seen = np.flatnonzero(records)
        yield pa.RecordBatch.from_arrays([pa.array([top[i][0] for i in seen], pa.string()), pa.array([top[i][1] for i in seen], pa.string()), pa.array(occurrences[seen]), pa.array(records[seen])], schema=COUNTS)

    return count


def unite_deliveries(df: DataFrame, field: str, record: str, terms: str) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (field, terms, n) whose terms are those of a record, each record's deliveries counted once, and totals (field, all_records).

    df has a row per delivery with an array of terms (null ones are ignored, repeated ones count). Deliveries with the
    same terms in any order are one; of different ones each term counts as often as the one that has it most often.
    A null record is a record of its own; records without terms count in the totals. One shuffle of the records."""
    rows = df.select(F.col(field).alias("field"), F.col(record).alias("record"), F.array_sort(F.array_compact(F.coalesce(terms, F.array().cast("array<string>")))).alias("terms"))
    united = cut(rows.groupBy("field", "record").agg(F.min("terms").alias("terms"), F.max("terms").alias("other")))
    totals = united.groupBy("field").agg(F.count(F.lit(1)).alias("all_records"))
    one = F.lit(1).cast("bigint").alias("n")
    same = united.where(F.col("terms") == F.col("other")).select("field", "terms", one)
    mixed = united.where(F.col("terms") != F.col("other")).select(F.col("field").alias("f"), F.col("record").alias("r"))
    n = mixed.count()
    if not n:
        return same, totals
    on = F.col("field").eqNullSafe(F.col("f")) & F.col("record").eqNullSafe(F.col("r"))
    parts = rows.join(F.broadcast(mixed) if n <= BROADCAST_ROWS else mixed, on, "left_semi")
    delivery = F.xxhash64(F.to_json("terms"))
    parts = parts.select("field", "record", delivery.alias("delivery"), "terms").dropDuplicates(["field", "record", "delivery"]).select("field", "record", "delivery", F.explode("terms").alias("term"))
    parts = parts.groupBy("field", "record", "delivery", "term").agg(F.count(F.lit(1)).alias("n")).groupBy("field", "record", "term").agg(F.max("n").alias("n"))
    return same.unionByName(cut(parts.select("field", F.array("term").alias("terms"), "n"))), totals


def record_term_frequencies(rows: DataFrame, *, heavy: int = HEAVY_TERMS) -> DataFrame:
    """(field, term, occurrences, records) of every distinct term of each field, from rows (field, terms, n) that are a record each.

    A record may also be several rows that have no term in common. Method: each task keeps a bounded frequent-items
    summary over all its rows, the merged summaries name the heavy terms; these are counted in exact arrays, one per
    task, of which only the totals leave the task; only the other terms' counts are shuffled; both are united by one
    last sum. Which terms are taken as heavy has no influence on the result."""
    counts = rows.select("field", "terms", "n").mapInArrow(_counter(heavy_terms(rows, heavy)), "field string, term string, occurrences bigint, records bigint")
    return counts.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequencies(df: DataFrame, field: str, record: list[str], term: str, *, heavy: int = HEAVY_TERMS) -> DataFrame:
    """(field, term, occurrences, records) of every distinct term of each field, as record_term_frequencies does it.

    df has a row per occurrence; record names the columns that identify a record within its field. Terms are texts.
    Rows with null term are ignored, a null record column is a value of its own; repeated rows are occurrences in one
    record; an empty table gives no rows; other columns are ignored; terms of any length are counted. No record's rows
    are gathered; where they lie together already, give them as arrays to record_term_frequencies."""
    keys = [f"__r{i}" for i in range(len(record))]
    rows = df.select(F.col(field).alias("field"), *[F.col(c).alias(k) for c, k in zip(record, keys)], F.col(term).alias("term")).where(F.col("term").isNotNull())
    once = cut(rows.groupBy("field", *keys, "term").agg(F.count(F.lit(1)).alias("n")).select("field", F.array("term").alias("terms"), "n"))
    return record_term_frequencies(once, heavy=heavy)


def mark_terms(counts: DataFrame, totals: DataFrame, *, rare: int = 2, common: float = 0.2) -> DataFrame:
    """counts with a column mark: rare if at most so many records hold the term, common if at least this share of all do.

    totals has a row (field, all_records) per field, counting records without terms too. A term that is both is rare;
    one that is neither, and every term of a field without total that isn't rare, has a null mark."""
    n = F.col("records")
    mark = F.when(n <= rare, "rare").when(n >= F.lit(common) * F.col("all_records"), "common")
    return lookup(counts, totals, ["field"], totals.count(), "left").withColumn("mark", mark)
