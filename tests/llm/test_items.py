import itertools
import random
from collections import Counter

import numpy as np
import pytest

from graphweave.llm import cooccur, setjoin, termfreq
from graphweave.llm.cooccur import cooccurrences
from graphweave.llm.setjoin import record_pairs, similar_records
from graphweave.llm.termfreq import mark_terms, record_term_frequencies, term_frequencies, unite_deliveries


def pairs_of(rows):
    sets = {}
    for b, i in rows:
        if b is not None and i is not None:
            sets.setdefault(b, set()).add(i)
    n, both = Counter(), Counter()
    for s in sets.values():
        n.update(s)
        both.update(itertools.combinations(sorted(s), 2))
    return sets, n, both


def baskets(seed, n=300):
    r = random.Random(seed)
    rows = [(r.choice([1] * 40 + list(range(2, n)) + [None]), r.choice(["hot"] * 9 + [f"i{k}" for k in range(40)] + ["", None])) for _ in range(4000)]
    return rows + rows[:200]


def check_pairs(spark, rows, **options):
    got = {(x["item_a"], x["item_b"]): x for x in cooccurrences(spark.createDataFrame(rows, "b int, i string"), "b", "i", **options).collect()}
    sets, n, both = pairs_of(rows)
    least, lift = options.get("min_count", 1), options.get("min_lift", 0)
    want = {p: c for p, c in both.items() if c >= least and c * len(sets) >= lift * n[p[0]] * n[p[1]]}
    assert {p: x["n_ab"] for p, x in got.items()} == want
    for (a, b), x in got.items():
        c, total = want[a, b], len(sets)
        assert (x["n_a"], x["n_b"], x["baskets"]) == (n[a], n[b], total)
        assert x["lift"] == pytest.approx(c * total / (n[a] * n[b]))
        assert x["odds_ratio"] == pytest.approx((c + 0.5) * (total - n[a] - n[b] + c + 0.5) / ((n[a] - c + 0.5) * (n[b] - c + 0.5)))
    return got


def test_pairs_against_brute_force(spark):
    assert len(check_pairs(spark, baskets(1))) > 500
    check_pairs(spark, baskets(2), min_count=4, min_lift=2)


def test_pairs_with_split_baskets_and_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cooccur, "BLOCK_ITEMS", 5)
    check_pairs(spark, baskets(3))
    monkeypatch.setattr(cooccur, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(cooccur, "HEAD_ITEMS", 3)
    check_pairs(spark, baskets(4))


def test_pairs_of_odd_tables(spark):
    assert cooccurrences(spark.createDataFrame([], "b int, i string"), "b", "i").collect() == []
    assert cooccurrences(spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "b")], "b int, i string"), "b", "i").collect() == []
    long = "x" * 100_000
    df = spark.createDataFrame([(1, long, 0, 0, 0), (1, "", 0, 0, 0)], "basket int, item string, id int, n int, code int")
    x = cooccurrences(df, "basket", "item").first()
    assert (x["item_a"], x["item_b"], x["n_ab"]) == ("", long, 1)


def jaccard_pairs(sets, threshold, least):
    ok = {k: s for k, s in sets.items() if len(s) >= least}
    return {(a, b) for a, b in itertools.combinations(sorted(ok), 2) if len(ok[a] & ok[b]) >= threshold * len(ok[a] | ok[b]) - 1e-9}


def similar_sets(seed, n=120):
    r = random.Random(seed)
    base = [r.sample(range(200), r.randint(3, 15)) for _ in range(15)]
    sets = {}
    for k in range(n):
        s = set(r.choice(base))
        for _ in range(r.randint(0, 3)):
            s ^= {r.randint(0, 200)}
        sets[k] = s if r.random() < 0.9 else set(base[0])
    return sets


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_similar_sets_against_brute_force(spark, threshold):
    sets = similar_sets(1)
    rows = [(k, str(x)) for k, s in sets.items() for x in s] * 2 + [(None, "1"), (7, None)]
    members, links = similar_records(spark.createDataFrame(rows, "k int, v string"), "k", "v", threshold, min_size=3)
    got = [tuple(x) for x in record_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(sets, threshold, 3)
    assert members.count() == len([s for s in sets.values() if len(s) >= 3])


@pytest.mark.parametrize("levels", [1, 2])
def test_crowded_neighbourhoods_deepen_and_split(spark, monkeypatch, levels):
    monkeypatch.setattr(setjoin, "NEIGHBOURHOOD", 6)
    monkeypatch.setattr(setjoin, "LEVELS", levels)
    r = random.Random(9)
    sets = {k: set(range(20)) - set(r.sample(range(20), r.randint(0, 4))) for k in range(90)}
    rows = [(k, x) for k, s in sets.items() for x in s]
    got = {tuple(x) for x in record_pairs(*similar_records(spark.createDataFrame(rows, "k int, v int"), "k", "v", 0.6)).collect()}
    assert got == jaccard_pairs(sets, 0.6, 1)


def test_two_tables_and_odd_ones(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    b = spark.createDataFrame([(5, "x"), (5, "y"), (6, "q"), (7, "x"), (7, "y"), (7, "w")], "k int, v string")
    members, links = similar_records(a, "k", "v", 0.6, other=b)
    assert links.count() == 1 and {(x["side"], x["record"]) for x in members.where("links > 0").collect()} == {(1, 1), (2, 5), (2, 7)}
    members, links = similar_records(spark.createDataFrame([], "k int, v string"), "k", "v", 0.6)
    assert members.count() == 0 and links.count() == 0
    clash = spark.createDataFrame([(1, "a", 0, 0), (2, "a", 0, 0)], "record int, member string, side int, class_id int")
    members, links = similar_records(clash, "record", "member", 0.6)
    assert {tuple(x) for x in record_pairs(members, links).collect()} == {(1, 2)}


def test_frequencies_against_brute_force(spark):
    r = random.Random(4)
    rows = [(r.choice(["f", "g"]), r.choice([None, *range(50)]), r.choice(["hot"] * 20 + [f"t{k}" for k in range(300)] + ["", None, "L" * 5000])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "field string, r int, t string")
    for heavy in (5, 0, 4096):
        got = {(x["field"], x["term"]): (x["occurrences"], x["records"]) for x in term_frequencies(df, "field", ["r"], "t", heavy=heavy).collect()}
        want = {}
        for f, k, t in rows:
            if t is not None:
                want.setdefault((f, t), []).append(k)
        assert got == {k: (len(v), len(set(v))) for k, v in want.items()}


@pytest.mark.parametrize("heavy", [0, 2, 4096])
def test_deliveries_count_once(spark, heavy):
    rows = [("f", 1, ["a", "b", "a", None]), ("f", 1, ["a", None, "a", "b"]), ("f", 2, []), ("f", 3, None), ("f", 4, ["a", "c"]), ("f", 4, ["c", "c"]), ("f", None, ["a"]), ("f", None, ["a"]), ("g", 1, ["a", ""]), ("g", 1, ["x" * 5000])]
    df = spark.createDataFrame([(*x, 0) for x in rows], "field string, record int, terms array<string>, n int")
    united, totals = unite_deliveries(df, "field", "record", "terms")
    got = {(x["field"], x["term"]): (x["occurrences"], x["records"]) for x in record_term_frequencies(united, heavy=heavy).collect()}
    assert got == {("f", "a"): (4, 3), ("f", "b"): (1, 1), ("f", "c"): (2, 1), ("g", "a"): (1, 1), ("g", ""): (1, 1), ("g", "x" * 5000): (1, 1)}
    assert {tuple(x) for x in totals.collect()} == {("f", 5), ("g", 1)}
    united, totals = unite_deliveries(df.limit(0), "field", "record", "terms")
    assert record_term_frequencies(united).collect() == [] and totals.collect() == []


def test_heavy_terms_are_found_by_bounded_summaries(spark, monkeypatch):
    rows = [("f", i, "hot") for i in range(500)] + [("f", i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "field string, r int, term string").selectExpr("field", "term", "1L AS occurrences")
    assert ("f", "hot") in termfreq.heavy_terms(df, 3)


def test_marks_and_odd_tables(spark):
    counts = spark.createDataFrame([("f", "a", 9, 2), ("f", "b", 9, 3), ("f", "c", 9, 4), ("g", "d", 9, 1)], "field string, term string, occurrences bigint, records bigint")
    totals = spark.createDataFrame([("f", 20), ("g", 2)], "field string, all_records bigint")
    got = {x["term"]: x["mark"] for x in mark_terms(counts, totals).collect()}
    assert got == {"a": "rare", "b": None, "c": "common", "d": "rare"}  # rare goes before common
    empty = spark.createDataFrame([], "field string, r int, t string, term string, records int")
    assert term_frequencies(empty, "field", ["r"], "t").collect() == []


def test_crowded_group_passes_through_in_batches():
    import pyarrow as pa

    sketch = int(setjoin.sketches(np.array([1, 2], np.uint64), np.array([2]))[0].astype(np.int64))

    def batch(groups, first):
        n = len(groups)
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([sketch] * n, pa.int64()), pa.array([1] * n, pa.int8()), pa.array([0] * n, pa.int8())], names=["code", "rid", "sketch", "side", "part"])

    groups = [1] * 3 + [2] * 35_000 + [3] * 2
    batches = [batch(groups[i : i + 10_000], i) for i in range(0, len(groups), 10_000)]
    out = pa.Table.from_batches(list(setjoin._neighbours(0.6, 0, False, 100)(iter(batches)))).to_pylist()
    crowd, pairs = [x["rid_a"] for x in out if x["rid_a"] == x["rid_b"]], {(x["rid_a"], x["rid_b"]) for x in out if x["rid_a"] != x["rid_b"]}
    assert sorted(crowd) == list(range(3, 35_003)) and pairs == {(0, 1), (0, 2), (1, 2), (35_003, 35_004)}


def test_sketches_rule_out_no_similar_pair():
    r = random.Random(5)
    for _ in range(300):
        a = {r.randint(1, 60) for _ in range(r.randint(1, 300))}
        b = {x for x in a if r.random() < 0.8} | {r.randint(1, 90) for _ in range(r.randint(0, 3))} | {1}
        s = [setjoin.sketches(np.array(sorted(x), np.uint64), np.array([len(x)])) for x in (a, b)]
        for t in (0.5, 0.8, 1.0):
            assert setjoin._possible(s[0], s[1], t)[0] or len(a & b) < t * len(a | b) - 1e-9


def test_codes_order_signatures():
    flat, sizes = np.array([1, 2, 3, 1, 2, 3, 9, 8], np.uint64), np.array([3, 3, 2])
    code = setjoin.codes(flat, sizes, 26, 2, 1)
    assert (code[0] == code[1]).all() and (code >= 0).all() and len(np.unique(code[0] >> (4 * setjoin.value_bits(26, 2)))) == 26
    i, j = (np.concatenate(x) for x in zip(*setjoin._index_pairs(np.array([0, 3, 8]), np.array([3, 1, 4]))))
    assert sorted(zip(i.tolist(), j.tolist())) == [(0, 1), (0, 2), (1, 2), *itertools.combinations(range(8, 12), 2)]
