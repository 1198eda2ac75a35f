import itertools
import math
import random

import numpy as np
import pytest

from graphweave.model import Graphs, flatten_graphs, nest
from graphweave.operators import evaluate, matching, mining, prs, prune
from graphweave.sources import graphs as files

NODES = {1: "1 person, 2 sky, 3 sea", 2: "1 person, 2 person, 3 sky", 3: "1 kite, 2 person, 3 sky", 4: "1 kite, 2 person, 3 sky, 4 person", 5: "1 clock, 2 wall", 6: "1 person, 2 sky"}
EDGES = {1: "1 below 2; 1 on 3; 3 below 2", 2: "1 side 2; 1 below 3; 2 below 3", 3: "1 inside 3; 1 above 2; 2 below 3", 4: "1 inside 3; 2 below 3; 4 below 3", 6: "1 side-down 2"}


def build(spark, nodes, edges, ids=None):
    return Graphs(
        spark.createDataFrame([(i,) for i in (ids or sorted({n[0] for n in nodes}))], "graph_id bigint"),
        spark.createDataFrame(nodes, "graph_id bigint, node_id int, label string"), spark.createDataFrame(edges, "graph_id bigint, s int, pos string, r int"),
    )


@pytest.fixture(scope="module")
def hand(spark):
    nodes = [(g, int(x.split()[0]), x.split()[1]) for g, t in NODES.items() for x in t.split(", ")]
    edges = [(g, int(x.split()[0]), x.split()[1], int(x.split()[2])) for g, t in EDGES.items() for x in t.split("; ")]
    return build(spark, nodes, edges)


def test_summary_of_the_hand_fixture(hand):
    p = prs.build(hand.triples())
    got = {(r["subj"], r["ref"]): (r["sup"], r["entropy"]) for r in prs.pairs(p).collect()}
    assert got == {
        ("kite", "person"): (1, 0), ("kite", "sky"): (2, 0), ("person", "person"): (1, 0), ("person", "sea"): (1, 0),
        ("person", "sky"): (7, pytest.approx(0.5916727785823275)), ("sea", "sky"): (1, 0),
    }
    th = prs.thresholds(p).first()
    assert th["minsup"] == 1 and th["max_entropy"] == pytest.approx(math.log(3))
    assert {(r["subj"], r["ref"]) for r in prs.pairs(prs.filter_prs(p, 2)).collect()} == {("kite", "sky"), ("person", "sky")}
    for r in prs.pairs(p).collect():
        assert math.copysign(1, r["entropy"]) == 1


def listed(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_pruning_of_the_hand_fixture(hand):
    p = prs.build(hand.triples())
    e = prune.edge_pruning(hand, prs.filter_prs(p, 2))
    assert listed(e.nodes, "graph_id", "node_id") == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3), (4, 4), (5, 1), (5, 2), (6, 1), (6, 2)]
    n = prune.node_pruning(e)
    assert listed(n.nodes, "graph_id", "node_id") == [(1, 1), (1, 2), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 1), (4, 3), (4, 4), (5, 1), (5, 2), (6, 1), (6, 2)]
    assert listed(n.edges, "graph_id", "s", "pos", "r") == [(1, 1, "below", 2), (2, 2, "below", 3), (3, 1, "inside", 3), (3, 2, "below", 3), (4, 1, "inside", 3), (4, 4, "below", 3), (6, 1, "side-down", 2)]


def test_likelihood_tells_missing_from_zero(spark, hand):
    p = prs.filter_prs(prs.build(hand.triples()), 2)
    more = build(spark, [(9, 1, "person"), (9, 2, "sky"), (9, 3, "sea")], [(9, 1, "around", 2), (9, 1, "on", 3)])
    assert listed(prs.likelihood(more.triples(), p), "r", "likelihood") == [(2, 0.0), (3, None)]


def test_nested_form_round_trip(hand, spark, tmp_path):
    files.write_graphs(hand, str(tmp_path / "g"))
    back = files.read_graphs(spark, str(tmp_path / "g"), lines=True)
    assert listed(back.nodes, "graph_id", "node_id", "label") == listed(hand.nodes, "graph_id", "node_id", "label")
    assert listed(back.edges, "graph_id", "s", "pos", "r") == listed(hand.edges, "graph_id", "s", "pos", "r")
    assert flatten_graphs(nest(hand)).graphs.count() == 6


def test_miner_text_round_trip(hand, spark):
    text = files.miner_text(hand)
    codes = files.label_codes(hand)
    lines = [(f"f{r['graph_id']}", i, x) for r in text.collect() for i, x in enumerate(r["block"].split("\n"))]
    _, nodes, edges = files.parse_miner_text(spark.createDataFrame(lines, "file string, no int, line string"), codes)
    assert nodes.count() == hand.nodes.where("graph_id <> 5").count() and edges.count() == hand.edges.count()


def canon(edges, labels, directed):
    used = sorted({x for s, _, r in edges for x in (s, r)})
    best = None
    for order in itertools.permutations(used):
        at = {n: i for i, n in enumerate(order)}
        if [labels[n] for n in order] != sorted(labels[n] for n in order):
            continue
        form = tuple(sorted((min(at[s], at[r]), p, max(at[s], at[r])) if not directed else (at[s], p, at[r]) for s, p, r in edges))
        best = form if best is None or form < best else best
    return tuple(sorted(labels[n] for n in used)), best


def brute_mining(graphs, minsup, most, directed):
    found = {}
    for g, (labels, edges) in graphs.items():
        forms = set()
        edges = sorted({(s, p, r) if directed or s < r else (r, p, s) for s, p, r in edges})
        for k in range(1, most + 1):
            for c in itertools.combinations(edges, k):
                seen, todo = {c[0][0], c[0][2]}, list(c[1:])
                while any(e[0] in seen or e[2] in seen for e in todo):
                    e = next(e for e in todo if e[0] in seen or e[2] in seen)
                    todo.remove(e)
                    seen |= {e[0], e[2]}
                if not todo:
                    forms.add(canon(c, labels, directed))
        for f in forms:
            found.setdefault(f, set()).add(g)
    return {f: len(s) for f, s in found.items() if len(s) >= minsup}


def random_graphs(seed, n=12):
    r = random.Random(seed)
    out = {}
    for g in range(n):
        labels = {i: r.choice("abc") for i in range(r.randint(2, 5))}
        edges = {(s, t): r.choice(["on", "by"]) for s in labels for t in labels if s != t and r.random() < 0.35}
        out[g] = (labels, [(s, p, t) for (s, t), p in edges.items()])
    return out


@pytest.mark.parametrize("directed", [True, False])
def test_mining_against_enumeration(spark, directed):
    graphs = random_graphs(5)
    g = build(spark, [(i, n, x) for i, (l, _) in graphs.items() for n, x in l.items()], [(i, *e) for i, (_, es) in graphs.items() for e in es])
    p = mining.frequent_subgraphs(g, 3, max_edges=3, directed=directed)
    import json

    got = {}
    for r in p.patterns.collect():
        labels, edges = json.loads(r["code"])
        form = tuple(sorted((min(int(a), int(b)), q, max(int(a), int(b))) if not directed else (int(a), q, int(b)) for a, q, b in edges))
        key = canon([(s, q, t) for s, q, t in form], dict(enumerate(labels)), directed)
        assert key not in got
        got[key] = r["sup"]
    assert got == brute_mining(graphs, 3, 3, directed)
    sups = [r["sup"] for r in p.patterns.orderBy("pattern_id").collect()]
    assert sups == sorted(sups, reverse=True)


def test_mining_goes_on_until_a_level_is_empty(spark):
    path = build(spark, [(g, i, "abcdef"[i]) for g in range(3) for i in range(6)], [(g, i, "on", i + 1) for g in range(3) for i in range(5)])
    kinds = mining.frequent_subgraphs(path, 3).patterns.groupBy("n_edges").count().collect()
    assert {x["n_edges"]: x["count"] for x in kinds} == {1: 5, 2: 4, 3: 3, 4: 2, 5: 1}


def test_compressing_extends_to_rarer_patterns(spark):
    nodes = [(g, i, "abc"[i]) for g in range(10) for i in range(3)]
    g = build(spark, nodes, [(g, 0, "on", 1) for g in range(10)] + [(g, 1, "on", 2) for g in range(7)])
    assert [tuple(x) for x in mining.compressing_subgraphs(g, 1, beam=1).patterns.select("sup", "n_edges").collect()] == [(7, 2)]


def brute_match(pl, pe, labels, edges, faithful):
    want = {(s, p, r) for s, p, r in pe}
    triples = {(pl[s], p, pl[r]) for s, p, r in pe}
    have = {(s, p, r) for s, p, r in edges if (labels[s], p, labels[r]) in triples}
    nodes = sorted(pl)
    for choice in itertools.permutations(labels, len(nodes)):
        f = dict(zip(nodes, choice))
        if any(pl[n] != labels[f[n]] for n in nodes):
            continue
        image = {(f[s], p, f[r]) for s, p, r in want}
        inner = {e for e in have if e[0] in choice and e[2] in choice}
        if image <= have and (not faithful or image == inner):
            return True
    return False


@pytest.mark.parametrize("faithful", [True, False])
def test_matching_and_overlap_against_enumeration(spark, faithful):
    graphs, patterns = random_graphs(7), {k: v for k, v in random_graphs(8, 10).items()}
    g = build(spark, [(i, n, x) for i, (l, _) in graphs.items() for n, x in l.items()], [(i, *e) for i, (_, es) in graphs.items() for e in es])
    usable = {}
    for k, (l, es) in patterns.items():
        es = es[:3]
        used = {x for s, _, r in es for x in (s, r)}
        if es:
            usable[k] = ({n: l[n] for n in used}, es)
    pn = spark.createDataFrame([(k, n, x) for k, (l, _) in usable.items() for n, x in l.items()], "pattern_id bigint, node int, label string")
    pe = spark.createDataFrame([(k, *e) for k, (_, es) in usable.items() for e in es], "pattern_id bigint, s int, pos string, r int")
    got = {(r["pattern_id"], r["graph_id"]): (r["cnt"], round(r["overlap"], 9)) for r in matching.coverage(g, pn, pe, faithful=faithful).collect()}
    want = {}
    for k, (pl, es) in usable.items():
        for i, (l, ge) in graphs.items():
            if set(pl.values()) <= set(l.values()):
                want[k, i] = (int(brute_match(pl, es, l, ge, faithful)), round(len(set(pl.values())) / len(set(l.values())), 9))
    assert got == want and any(c for c, _ in want.values())


@pytest.mark.parametrize("faithful", [True, False])
def test_matching_of_nodes_without_edge(spark, faithful):
    graphs = random_graphs(17)
    patterns = {k: (l, es[: k % 3]) for k, (l, es) in random_graphs(18, 24).items()}
    patterns[50], patterns[51], patterns[52] = ({0: "a", 1: "b", 2: "c", 3: "c"}, [(0, "on", 1)]), ({0: "a"}, []), ({0: "z", 1: "a"}, [])
    g = build(spark, [(i, n, x) for i, (l, _) in graphs.items() for n, x in l.items()], [(i, *e) for i, (_, es) in graphs.items() for e in es])
    pn = spark.createDataFrame([(k, n, x) for k, (l, _) in patterns.items() for n, x in l.items()], "pattern_id bigint, node int, label string")
    pe = spark.createDataFrame([(k, *e) for k, (_, es) in patterns.items() for e in es], "pattern_id bigint, s int, pos string, r int")
    got = {(r["pattern_id"], r["graph_id"]) for r in matching.matches(g, pn, pe, faithful=faithful).collect()}
    want = {(k, i) for k, (pl, es) in patterns.items() for i, (l, ge) in graphs.items() if brute_match(pl, es, l, ge, faithful)}
    assert got == want and any(k == 51 for k, _ in want) and any(not patterns[k][1] and len(patterns[k][0]) > 1 for k, _ in want)
    cells = {(r["pattern_id"], r["graph_id"]): r["cnt"] for r in matching.coverage(g, pn, pe, min_nodes=1, faithful=faithful).collect()}
    assert cells == {(k, i): int((k, i) in want) for k, (pl, _) in patterns.items() for i, (l, _) in graphs.items() if set(pl.values()) <= set(l.values())}


def test_canonical_codes_of_symmetric_graphs():
    import json

    r = random.Random(3)
    shapes = [[(0, i) for i in range(1, 13)], [(i, (i + 1) % 9) for i in range(9)], [(i, j) for i in range(4) for j in range(4, 8)], [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (0, 3)]]
    codes = set()
    for shape in shapes:
        n = max(max(e) for e in shape) + 1
        for directed in (True, False):
            own = set()
            for _ in range(5):
                at = r.sample(range(n), n)
                rows = [[at[i], "x", "on", at[j], "x"] if directed or r.random() < 0.5 else [at[j], "x", "on", at[i], "x"] for i, j in r.sample(shape, len(shape))]
                own.add(mining.canonical(json.dumps(rows), directed))
            assert len(own) == 1
            codes |= {(directed, *own)}
    assert len(codes) == 2 * len(shapes)


def test_patterns_of_any_size(spark):
    star = build(spark, [(g, i, "hub" if i == 0 else "leaf") for g in range(2) for i in range(12)], [(g, 0, "on", i) for g in range(2) for i in range(1, 10 + g)])
    sizes = sorted(r["n_nodes"] for r in mining.frequent_subgraphs(star, 2).patterns.collect())
    assert sizes == list(range(2, 11))


@pytest.mark.parametrize("n", [499, 500, 501, 750, 999, 1001])
def test_evenly_spaced_places(spark, n):
    got = [r["id"] for r in prune.evenly_spaced(spark.range(n), "id").orderBy("id").collect()]
    assert got == (sorted({round(x) for x in np.linspace(0, n - 1, 500)}) if n > 500 else list(range(n)))


def test_maximal_itemsets(spark):
    sets = {0: ("ab", 9), 1: ("a", 9), 2: ("abc", 5), 3: ("ab", 12), 4: ("d", 3), 5: ("abcd", 2)}
    p = spark.createDataFrame([(k, s) for k, (_, s) in sets.items()], "pattern_id bigint, sup bigint")
    n = spark.createDataFrame([(k, i, c) for k, (l, _) in sets.items() for i, c in enumerate(l)], "pattern_id bigint, node int, label string")
    first = {}
    for k, (l, s) in sets.items():
        first.setdefault(frozenset(l), s)
    want = {max((k for k, (m, _) in sets.items() if set(m) == set(l)), key=lambda k: (sets[k][1], -k)) for l, _ in sets.values() if not any(set(l) < o and s <= first[frozenset(l)] for o, s in first.items())}
    assert {r["pattern_id"] for r in mining.maximal_itemsets(p, n).collect()} == want


def test_diversity_against_pairs(spark):
    r = random.Random(2)
    sets = [(i, [r.choice("abcdef") for _ in range(r.randint(0, 4))]) for i in range(30)]
    df = spark.createDataFrame(sets, "id int, x array<string>")
    total = [1 - len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0 for i, (_, a) in enumerate(sets) for _, b in sets[:i]]
    assert evaluate.diversity(df, "id", "x").first()[0] == pytest.approx(np.mean(total))
    assert evaluate.diversity(df.where("id = 0"), "id", "x").first()[0] == (1.0 if sets[0][1] else 0.0)
    assert evaluate.diversity(df.where("id < 0"), "id", "x").collect() == []


def test_whole_runs_are_compared(spark, tmp_path):
    from graphweave.plans.pattern_queries import QUERIES

    schema = "run_name string, sup bigint, loaded_at int, g struct<graph:struct<name:string>, nodes:array<struct<id:int,label:string>>, links:array<struct<s:int,pos:string,r:int>>>"
    rows = [("run", 99 - i, 1, ((f"p{i:02}",), [(0, "a"), (1, "b" if i < 20 else "c")], [(0, "on", 1)])) for i in range(25)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/sgs.parquet")
    differ = 20 * 5 / 300  # of the pairs
    assert QUERIES["diversity_nodes"](spark, str(tmp_path)).first()["diversity"] == pytest.approx(differ * 2 / 3, abs=1e-6)
    assert QUERIES["diversity_edges"](spark, str(tmp_path)).first()["diversity"] == pytest.approx(differ, abs=1e-6)


def test_summaries_hold_patterns_of_any_size(spark, monkeypatch):
    from graphweave.plans import pattern_queries as Q

    path = build(spark, [(g, i, "abc"[i]) for g in range(30) for i in range(3)], [(g, i, "on", i + 1) for g in range(30) for i in range(2)])
    mined, held = Q._mined, {}
    monkeypatch.setattr(Q, "_mined", lambda spark, d, k, *a: held[k] if k in held else held.setdefault(k, mined(spark, d, k, *a)))
    monkeypatch.setattr(Q, "pruned", lambda spark, d: path)
    monkeypatch.setattr(Q, "load", lambda spark, d: path)
    run = lambda name: Q.QUERIES[name](spark, "").collect()
    assert run("summary_all")[0]["n_graphs"] == run("summary_metrics")[0]["n_graphs"] == 3
    assert len({x["code"] for x in run("first_match")}) == len({x["code"] for x in run("image_pairing")}) == 3
    assert [tuple(x) for x in run("maximal_itemsets")] == [("a,b,c", 30)] and len(run("coverage_whole")) == 90
    assert {x["minsup"]: x["patterns"] for x in run("fsm_sweep")} == {30: 3, 60: 0, 120: 0}


def test_medoid_far_from_the_mean(spark):
    from graphweave.operators.cluster import kmedoids

    r = random.Random(5)
    x = [r.random() for _ in range(300)] + [10 + r.random() for _ in range(100)]
    want = min(range(400), key=lambda i: (round(sum(abs(x[i] - y) for y in x), 9), i))
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(x)], "id bigint, v array<double>")
    assert {m["medoid"] for m in kmedoids(df, "id", "v", 1).collect()} == {want}


def test_empty_collection(spark):
    g = build(spark, [], [], ids=[1])
    p = prs.build(g.triples())
    assert p.count() == 0 and prune.prepare(g, p).nodes.count() == 0
    assert mining.frequent_subgraphs(g, 1).patterns.count() == 0


def test_names_and_supports(hand):
    assert mining.experiment_name("gspan", True, True, 0.01) == "sgs_eprune_nprune_gspan_01"
    assert mining.experiment_name("subdue", True, False, nsubs=100) == "sgs_eprune_subdue_100"
    assert mining.least_support(hand, 0.5) == 3  # five graphs have an edge
