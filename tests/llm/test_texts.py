import itertools
import random

import numpy as np
import pytest

from graphweave.llm import packing, subset
from graphweave.llm.align import chains, edits, grow, merge_diagonals
from graphweave.llm.mixing import mix, sainte_lague
from graphweave.llm.packing import Limits, best_fit, pack, pack_report
from graphweave.llm.spans import SharedSpans, code_points, seeds, window_hashes
from graphweave.llm.subset import CFTree, choose_varied, ward_groups
from graphweave.llm.tokens import count, encoder, token_sizes, vocabulary_dir


def brute_pairs(texts, n):
    grams = {}
    for d, t in texts:
        if t is not None:
            for i in range(len(t) - n + 1):
                grams.setdefault(t[i : i + n], set()).add(d)
    return {p for s in grams.values() for p in itertools.combinations(sorted(s), 2)}


def brute_shared(texts, n):
    out = {}
    for d, t in texts:
        held = {x[i : i + n] for e, x in texts if e != d and x for i in range(len(x) - n + 1)}
        mark = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - n + 1):
            if t[i : i + n] in held:
                mark[i : i + n] = True
        out[d] = int(mark.sum())
    return out


def corpus(seed, n=40, letters="abcdefghijklmnopqrstuvwxyz ä\U0001f600"):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(letters) for _ in range(k))
    common = [word(k) for k in (12, 19, 20, 21, 25, 40, 80)]
    texts = []
    for d in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(common) if r.random() < 0.5 else word(r.randint(0, 60)))
        texts.append((d, "".join(parts)))
    return texts + [(n, texts[3][1]), (n + 1, texts[3][1]), (n + 2, None), (n + 3, ""), (n + 4, common[6]), (n + 5, common[6])]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot", [64, 3])
def test_shared_spans_against_brute_force(spark, seed, hot):
    texts = corpus(seed)
    s = SharedSpans(spark.createDataFrame(texts, "doc_id bigint, text string"), min_len=20, hot_texts=hot)
    got = [tuple(x) for x in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 20)
    for x in s.exact().collect():
        a, b = dict(texts)[x["a"]], dict(texts)[x["b"]]
        span = a[x["start_a"] : x["start_a"] + x["chars"]]
        assert len(span) >= 20 and span == b[x["start_b"] : x["start_b"] + x["chars"]]


def brute_spans(texts, n):
    """(a, b, start_a, start_b, chars) of all maximal spans, by walking every diagonal."""
    out = set()
    for (a, s), (b, t) in itertools.combinations(texts, 2):
        for shift in range(1 - len(t), len(s)):
            run = 0
            for i in range(max(0, shift), min(len(s), len(t) + shift) + 1):
                if i < min(len(s), len(t) + shift) and s[i] == t[i - shift]:
                    run += 1
                    continue
                if run >= n:
                    out.add((a, b, i - run, i - run - shift, run))
                run = 0
    return out


def spans_of(spark, texts, **options):
    return [tuple(x) for x in SharedSpans(spark.createDataFrame(texts, "doc_id bigint, text string"), **options).exact().collect()]


@pytest.mark.parametrize("hot", [64, 3])
def test_spans_of_any_length_in_any_group_are_whole(spark, hot):
    r = random.Random(11)
    word = lambda k: "".join(r.choice("abcdefgh ") for _ in range(k))
    header, footer, twice = word(300), word(45), word(30)
    texts = [(d, (word(d) if d % 2 else "") + header + word(5) + (twice + word(3)) * (1 + d % 2) + footer) for d in range(8)]
    texts.append((8, header[100:] + word(9)))
    got = spans_of(spark, texts, min_len=20, hot_texts=hot)
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts, 20)


@pytest.mark.parametrize("hot", [64, 1])
def test_periodic_texts_of_different_phase(spark, hot):
    r = random.Random(12)
    texts = []
    for period in (1, 2, 3, 4, 5):
        unit = "".join(r.choice("pqrstu") for _ in range(period))
        for n in (20, 23, 27, 60):
            shift = r.randrange(period)
            texts.append((len(texts), "".join(r.choice("abcdef") for _ in range(7)) + (unit * 99)[shift : shift + n] + "".join(r.choice("abcdef") for _ in range(7))))
    got = spans_of(spark, texts, min_len=20, hot_texts=hot)
    assert len(got) == len(set(got)) and set(got) == brute_spans(texts, 20)


def test_long_block_in_many_texts(spark):
    r = random.Random(13)
    word = lambda k: "".join(r.choice("abcdefgh \n") for _ in range(k))
    block, stretch = word(5000), "=" * 30_000
    texts = [(d, word(40 + d) + block + word(30)) for d in range(80)] + [(80, word(50) + stretch + word(9)), (81, stretch[:20_000] + word(70))]
    s = SharedSpans(spark.createDataFrame(texts, "doc_id bigint, text string"))
    got = {x["doc"]: x["shared_chars"] for x in s.shares().collect()}
    assert all(5000 <= got[d] <= 5012 for d in range(80)) and got[80] == 30_000 and got[81] == 20_000
    links = [tuple(x) for x in s.pairs().collect()]
    assert sorted(links) == [*itertools.combinations(range(80), 2), (80, 81)]


def test_fuzzy_passages(spark):
    r = random.Random(14)
    word = lambda k: "".join(r.choice("abcdefghijklmnop \n") for _ in range(k))
    base = word(3000)
    changed = "".join("Z" if i % 150 == 75 else c for i, c in enumerate(base))
    cut_out = base[:1000] + base[1010:2000] + "new text here" + base[2000:]
    texts = [(1, word(500) + base + word(400)), (2, word(90) + changed + word(700)), (3, word(3000)), (4, cut_out)]
    s = SharedSpans(spark.createDataFrame(texts, "doc_id bigint, text string"))
    rows = {(x["a"], x["b"]): x for x in s.passages().collect()}
    assert s.passages().count() == len(rows) and set(rows) == {(1, 2), (1, 4), (2, 4)}
    x = rows[1, 2]
    assert abs(x["from_a"] - 500) < 8 and abs(x["to_a"] - 3500) < 8 and 18 <= x["edits"] <= 26 and x["identity"] > 0.99
    assert 20 <= rows[1, 4]["edits"] <= 30 and rows[1, 4]["to_a"] - rows[1, 4]["from_a"] >= 2998
    assert {tuple(p) for p in s.pairs().collect()} == brute_pairs(texts, 250)


@pytest.mark.parametrize("rare", [0, 1])
def test_fuzzy_passages_of_seeds_in_many_texts(spark, rare):
    r = random.Random(16)
    word = lambda k: "".join(r.choice("abcdefghijklmnop \n") for _ in range(k))
    base, own = word(1500), word(400)
    other = lambda d: "".join(chr(0x4E00 + d) if (i + 17 * d) % 130 == 0 else c for i, c in enumerate(base))
    texts = [(d, word(80 + d) + other(d) + (own if rare and d in (3, 5) else "") + word(50)) for d in range(9)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    few, many = ({tuple(x) for x in SharedSpans(df, hot_texts=n).passages().collect()} for n in (2, 64))
    assert many and few == many


def test_edits_against_dynamic_programming():
    r = random.Random(15)
    for _ in range(200):
        x, y = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        row = list(range(len(y) + 1))
        for i, c in enumerate(x):
            row = [i + 1, *row[1:]] if not y else [n for n in _next(row, i, c, y)]
        assert edits(x, y, 20) == row[-1]
    assert edits("abc" * 50, "xyz" * 50, 8) is None and edits("a", "abcdefghijkl", 3) is None
    assert grow("same text X and more", "same text Y and more of", 0, 0)[:3] == (20, 20, 1)
    assert grow("abcdef", "qrstuv", 0, 0)[:3] == (0, 0, 0)


def _next(row, i, c, y):
    out = [i + 1]
    for j, d in enumerate(y):
        out.append(min(out[-1] + 1, row[j + 1] + 1, row[j] + (c != d)))
    return out


def test_shares_and_passages(spark):
    texts = corpus(3)
    s = SharedSpans(spark.createDataFrame(texts, "doc_id bigint, text string"), min_len=20)
    want = brute_shared(texts, 20)
    for x in s.shares().collect():
        assert x["shared_chars"] == want[x["doc"]] and 0 <= x["share"] <= 1
    for x in s.passages().collect():
        assert 0 < x["identity"] <= 1 and x["to_a"] > x["from_a"]


def test_repetitive_texts(spark):
    r = random.Random(6)
    texts = [(d, "".join(r.choice(["-" * r.randint(1, 70), "ab" * r.randint(1, 40), "xyz", "0. " * r.randint(1, 30)]) for _ in range(6))) for d in range(30)]
    got = {tuple(x) for x in SharedSpans(spark.createDataFrame(texts, "doc_id bigint, text string"), min_len=20).pairs().collect()}
    assert got == brute_pairs(texts, 20)


def test_spans_of_odd_tables(spark):
    empty = SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"), min_len=20)
    assert empty.pairs().collect() == [] and empty.shares().collect() == []
    t = "long text " * 50_000
    df = spark.createDataFrame([(1, t, 0, 0), (1, t, 0, 0), (2, "zz" + t + "q", 0, 0), (None, t, 0, 0)], "doc_id bigint, text string, h int, pos int")
    assert [tuple(x) for x in SharedSpans(df, min_len=250).pairs().collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        SharedSpans(df, min_len=10, seed_len=11)


def test_seeds_are_shared_by_all_long_spans():
    r = random.Random(7)
    for _ in range(50):
        a, b, mid = ("".join(r.choice("ab ") for _ in range(n)) for n in (r.randint(0, 60), r.randint(0, 60), 20))
        h1, h2 = (set(seeds(code_points(t), 16, 5)[0].tolist()) for t in (a + mid + b, b + mid + a))
        assert h1 & h2
    assert window_hashes(code_points("abcabc"), 3)[0] == window_hashes(code_points("abcabc"), 3)[3]


def test_chains_follow_the_order():
    x, y, n, _ = merge_diagonals(np.array([0, 2, 50, 100]), np.array([0, 2, 10, 40]), np.array([10, 10, 10, 10]), np.zeros(4, bool))
    assert sorted(zip(x, y, n)) == [(0, 0, 12), (50, 10, 10), (100, 40, 10)]
    assert chains(np.array([0, 20, 40]), np.array([0, 20, 5]), np.array([10, 10, 10])) == [[0, 1], [2]]
    assert chains(np.array([0, 20]), np.array([500, 20]), np.array([10, 10])) in ([[1], [0]], [[0], [1]])


def test_token_sizes(spark):
    encode = encoder(f"{vocabulary_dir()}/byte_bpe_50k.tiktoken").encode_ordinary
    texts = [(1, "import numpy as np\n"), (2, ""), (3, None), (4, "ü" * 3000), (None, "x"), (1, "import numpy as np\n")]
    df = spark.createDataFrame([(a, b, 5) for a, b in texts], "id int, text string, tokens int")
    got = sorted((tuple(x) for x in token_sizes(df, "text", ["id"]).collect()), key=str)
    assert got == sorted(((a, len(encode(b)) if b else 0) for a, b in texts), key=str)
    assert count(encode, "some words here\n\n  and more\n" * 90_000) == len(encode("some words here\n\n  and more\n" * 90_000))
    assert token_sizes(spark.createDataFrame([], "id int, text string"), "text", ["id"]).collect() == []


def check_packing(rows, sizes, cap):
    by, pieces = {}, {}
    for x in rows:
        by.setdefault(x["container_id"], []).append(x["n_tokens"])
        pieces.setdefault(x["doc_id"], []).append((x["piece_no"], x["start_token"], x["n_tokens"]))
    assert all(sum(v) <= cap for v in by.values())
    for d, n in sizes.items():
        p = sorted(pieces[d])
        assert [k for k, _, _ in p] == list(range(len(p))) and sum(t for _, _, t in p) == n
        assert [s for _, s, _ in p] == [k * cap for k in range(len(p))]
        if n <= cap:
            assert len(p) == 1
    return by


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 60)
    r = random.Random(1)
    sizes = {d: r.choice([0, 1, 5, 99, 100, 101, 350, r.randint(1, 100)]) for d in range(700)}
    rows = [(d, "a" if d % 3 else "b", n) for d, n in sizes.items()] + [(None, "a", 5), (900, None, None)]
    sizes_all = {**sizes, 900: 0}
    df = spark.createDataFrame(rows, "doc_id int, source string, tokens int")
    jobs = spark.createDataFrame([(1, None, 100), (2, "b", 64), (3, "none", 10), (4, None, None), (5, None, 0)], "job_id int, source string, capacity_tokens int")
    out = pack(df, jobs)
    rows = out.collect()
    assert {x["job_id"] for x in rows} == {1, 2}
    bins = check_packing([x for x in rows if x["job_id"] == 1], sizes_all, 100)
    check_packing([x for x in rows if x["job_id"] == 2], {d: n for d, n in sizes.items() if d % 3 == 0}, 64)
    assert len(bins) <= 1.02 * -(-sum(sizes.values()) // 100) + 2
    rep = {x["job_id"]: x for x in pack_report(out, jobs).collect()}
    assert rep[1]["containers"] == len(bins) and rep[1]["tokens"] == sum(sizes.values())
    assert pack(df.where("false"), jobs).collect() == [] and pack(df, jobs.where("false")).collect() == []


def test_packing_keeps_every_limit(spark):
    need = np.array([[5, 1, 25.0]] * 40)
    where = best_fit(need, np.array([100.0, 3.0, 1e9]), np.array([1.0, 0.1, 0.1]), "norm")
    assert np.bincount(where).max() == 3
    where = best_fit(need, np.array([100.0, 99.0, 50.0]), np.array([1.0, 0.1, 0.1]), "dot")
    assert np.bincount(where).max() == 2
    df = spark.createDataFrame([(i, "a", 5) for i in range(40)], "doc_id int, source string, tokens int")
    jobs = spark.createDataFrame([(1, None, 100)], "job_id int, source string, capacity_tokens int")
    out = pack(df, jobs, limits=Limits(docs_per_token=0.03, rule="dot"))
    assert out.groupBy("container_id").count().agg({"count": "max"}).first()[0] == 3
    twice = spark.createDataFrame([(1, "a", 60), (1, "a", 60)], "doc_id int, source string, tokens int")
    assert pack(twice, jobs).select("container_id").distinct().count() == 2  # repeated rows are items of their own


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_binding_limits(spark, monkeypatch, rule):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 80)
    r = random.Random(4)
    sizes = {d: r.choice([0, 3, 40, 60, 90, 100, 130, r.randint(1, 100)]) for d in range(500)}
    df = spark.createDataFrame([(d, "a", n) for d, n in sizes.items()], "doc_id int, source string, tokens int")
    jobs = spark.createDataFrame([(1, None, 100), (2, "a", 100)], "job_id int, source string, capacity_tokens int")
    limits = Limits(docs_per_token=0.03, attention=0.25, rule=rule)
    out = pack(df, jobs, limits=limits)
    rows = [x for x in out.collect() if x["job_id"] == 1]
    for v in check_packing(rows, sizes, 100).values():
        assert len([n for n in v if n]) <= 3 and (sum(n * n for n in v) <= 2500 or len(v) == 1)
    report = {x["job_id"]: x for x in pack_report(out, jobs, limits).collect()}
    assert report[1]["over"] == 0 and report[1]["alone_above"] == len([x for x in rows if x["n_tokens"] > 50]) and 0 < report[2]["docs_fill"] <= 1


def test_sainte_lague():
    assert sainte_lague({"a": 53, "b": 24, "c": 23}, 7) == {"a": 3, "b": 2, "c": 2}
    assert sainte_lague({"a": 1, "b": 1}, 4, {"a": 1}) == {"a": 1, "b": 3}
    assert sainte_lague({"a": 0, "b": None}, 4) == {"a": 0, "b": 0} and sainte_lague({}, 4) == {}


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["big"] * 8 + ["small", None]), r.randint(1, 50)) for i in range(6000)] + [(None, "big", 9), (7000, "big", None)]
    df = spark.createDataFrame(rows, "doc_id int, source string, tokens int")
    targets = spark.createDataFrame([(1, "big", 0.5, None, 0.2), (1, "small", 0.5, 2, 0.2), (1, "none", 1.0, 3, 0.2), (2, "big", 1.0, 4, 2.0), (3, "small", 1.0, 0, 0.1)], "mix_id int, source string, weight double, max_repeats int, budget_fraction double")
    drawn, report = mix(df, targets)
    got, rep = drawn.collect(), {(x["mix_id"], x["source"]): x for x in report.collect()}
    total = sum(n for i, s, n in rows if n and i is not None)
    small = sum(n for i, s, n in rows if s == "small")
    assert len({(x["mix_id"], x["doc_id"]) for x in got}) == len(got)
    assert max(x["copies"] for x in got if x["source"] == "small") <= 2 and not [x for x in got if x["mix_id"] == 3]
    assert rep[1, "none"]["tokens"] == 0 and rep[1, "small"]["tokens"] <= 2 * small
    assert rep[1, "big"]["tokens"] + rep[1, "small"]["tokens"] == pytest.approx(0.2 * total, rel=0.01)
    assert rep[2, "big"]["tokens"] == pytest.approx(2 * total, rel=0.01) and rep[2, "big"]["copies_max"] in (3, 2)
    again = {tuple(x) for x in mix(df, targets)[0].collect()}
    assert again == {tuple(x) for x in got}
    drawn, report = mix(df.where("false"), targets)
    assert drawn.collect() == [] and all(x["tokens"] == 0 for x in report.collect())


def test_feature_tree_keeps_sums():
    r = np.random.default_rng(1)
    pts = r.normal(size=(2000, 8))
    t = CFTree(8, 60)
    for p in pts:
        t.insert(1.0, p, float(p @ p))
    n, ls, ss = t.entries()
    assert len(n) <= 60 and n.sum() == 2000
    assert np.allclose(ls.sum(axis=0), pts.sum(axis=0)) and ss.sum() == pytest.approx((pts**2).sum())


def test_ward_against_brute_force():
    r = np.random.default_rng(2)
    x, n = r.normal(size=(30, 3)), r.integers(1, 5, 30).astype(float)
    groups = [[i] for i in range(30)]
    while len(groups) > 6:
        def cost(a, b):
            na, nb = n[a].sum(), n[b].sum()
            return na * nb / (na + nb) * ((((x[a] * n[a][:, None]).sum(axis=0) / na) - ((x[b] * n[b][:, None]).sum(axis=0) / nb)) ** 2).sum()
        i, j = min(itertools.combinations(range(len(groups)), 2), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[i] += groups.pop(j)
    got = ward_groups(n, x * n[:, None], 6)
    assert {frozenset(np.flatnonzero(got == g)) for g in set(got)} == {frozenset(g) for g in groups}


def test_larger_subsets_cover_all_themes(spark, monkeypatch):
    monkeypatch.setattr(subset, "MAX_GROUPS", 20)
    monkeypatch.setattr(subset, "PART_GROUPS", 8)
    r = random.Random(5)
    rows = []
    for i in range(2400):
        t = 0 if i < 1000 else i % 40
        rows.append(("run", i, [x for x in range(t * 10, t * 10 + 7) if r.random() < 0.9] or [t * 10]))
    df = spark.createDataFrame(rows, "run_name string, id int, m array<bigint>")
    jobs = spark.createDataFrame([(1, None, 60), (2, None, 150), (3, None, 20)], "job_id int, run_name string, subset_size int")
    out = choose_varied(df, jobs, record="id", group="run_name", members="m").collect()
    for j, k in ((1, 60), (2, 150), (3, 20)):
        ids = [x["record"] for x in out if x["job_id"] == j]
        themes = {rows[i][2][0] // 10 for i in ids}
        assert len(ids) == len(set(ids)) == k and len(themes) >= min(k, 40) - 3, (j, len(themes))


def test_quotas():
    assert subset.quotas({1: 100.0, 2: 4.0, 3: 0.0}, {1: 50, 2: 3, 3: 9}, 12) == {1: 9, 2: 2, 3: 1}
    assert subset.quotas({}, {1: 2}, 5) == {1: 2}


def test_batches_of_the_tree():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(c, 0.02, (400, 3)) for c in ((0, 0, 0), (1, 0, 0), (0, 1, 0))])
    tree = CFTree(3, 60)
    for i in range(0, len(x), 100):
        p = x[i : i + 100]
        tree.insert_all(np.ones(len(p)), p, (p * p).sum(axis=1))
    n, ls, ss = tree.entries()
    assert n.sum() == len(x) and np.allclose(ls.sum(axis=0), x.sum(axis=0)) and np.isclose(ss.sum(), (x * x).sum()) and len(n) <= 60
    assert (ss / n - ((ls / n[:, None]) ** 2).sum(axis=1) <= tree.threshold + 1e-9).all()
    assert np.allclose(tree.root.total()[1], x.sum(axis=0))


def test_varied_subset(spark, monkeypatch):
    r = random.Random(3)
    themes = [[k * 10 + i for i in range(6)] for k in range(5)]
    rows = []
    for i in range(400):  # one theme holds most records
        theme = themes[0] if i < 340 else themes[1 + i % 4]
        rows.append(("run" if i % 2 else "other", i, [x for x in theme if r.random() < 0.9] or theme))
    rows += rows[:50] + [("run", 900, None), (None, 901, [])]
    df = spark.createDataFrame(rows, "run_name string, id int, m array<bigint>").withColumn("members", subset.F.lit(1))
    jobs = spark.createDataFrame([(1, None, 5), (2, "run", 4), (3, "none", 4), (4, "other", 10_000 // 8), (5, None, 0), (6, None, None)], "job_id int, run_name string, subset_size int")
    out = choose_varied(df, jobs, record="id", group="run_name", members="m").collect()
    by = {}
    for x in out:
        by.setdefault(x["job_id"], []).append((x["run_name"], x["record"]))
    assert {k: len(v) for k, v in by.items()} == {1: 5, 2: 4, 4: 200} and all(len(set(v)) == len(v) for v in by.values())
    first = {i: m for _, i, m in rows}
    assert len({min(first[i] or [-10]) // 10 for _, i in by[1]}) >= 4  # not four times the large theme
    assert {x["run_name"] for x in out if x["job_id"] == 2} == {"run"}
    monkeypatch.setattr(subset, "MAX_GROUPS", 3)  # in the driver: fewer groups than records wanted
    more = choose_varied(df, spark.createDataFrame([(1, None, 9)], "job_id int, run_name string, subset_size int"), record="id", group="run_name", members="m")
    assert more.select("run_name", "record").distinct().count() == 9
    same = spark.createDataFrame([("r", i, [1, 2]) for i in range(30)], "run_name string, id int, m array<bigint>")
    picked = choose_varied(same, spark.createDataFrame([(1, None, 7)], "job_id int, run_name string, subset_size int"), record="id", group="run_name", members="m")
    assert picked.select("record").distinct().count() == 7  # equal records still fill the size
    assert choose_varied(df.where("false"), jobs, record="id", group="run_name", members="m").collect() == []
