"""Queries of the summary and pruning operators with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.model import POSITIONS, cut_graphs
from graphweave.operators import prs as P
from graphweave.operators import prune as G
from graphweave.plans.collection import SQL, load
from graphweave.session import cut

BASE = SQL.format(ceiling=repr(P.MAX_ENTROPY))
#: Label that the sample queries ask for.
LABEL, LABELS, PAIR = "pedestrian", ["pedestrian", "pavement", "skyline"], ("foliage", "skyline")
QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Registers a query by its name, with its SQL over the tables of the collection."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {BASE} {sql}"
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) + F.lit(0.0) for n in names})


def _prs(spark: SparkSession, d: str) -> DataFrame:
    return P.build(load(spark, d).triples())


@query("SELECT subj, ref, pos, n, sup, round(likelihood, 6) likelihood, round(entropy, 6) + 0.0 entropy FROM prs")
def prs_build(spark, d):
    return rounded(_prs(spark, d), "likelihood", "entropy")


@query("SELECT graph_id, subj, ref, pos, count(*) n FROM t GROUP BY ALL")
def prs_hist(spark, d):
    return P.graph_hist(load(spark, d).triples())


@query("SELECT minsup, round(max_entropy::DOUBLE, 6) max_entropy FROM th")
def prs_thresholds(spark, d):
    return rounded(P.thresholds(_prs(spark, d)), "max_entropy")


@query("SELECT subj, ref, pos, n, sup, round(likelihood, 6) likelihood, round(entropy, 6) + 0.0 entropy FROM f")
def prs_filtered(spark, d):
    return rounded(P.filter_prs(_prs(spark, d)), "likelihood", "entropy")


@query("SELECT subj, ref, sup, round(entropy, 6) + 0.0 entropy FROM pairs")
def prs_pairs(spark, d):
    return rounded(P.pairs(_prs(spark, d)), "entropy")


@query("""SELECT t.graph_id, t.s, t.r, t.subj, t.ref, t.pos, round(CASE WHEN x.sup IS NULL THEN NULL ELSE coalesce(f.likelihood, 0) END, 6) likelihood
    FROM t LEFT JOIN (SELECT DISTINCT subj, ref, sup FROM f) x USING (subj, ref) LEFT JOIN f USING (subj, ref, pos)""")
def link_likelihood(spark, d):
    g = load(spark, d)
    out = P.likelihood(g.triples(), P.filter_prs(P.build(g.triples())))
    return rounded(out.select("graph_id", "s", "r", "subj", "ref", "pos", "likelihood"), "likelihood")


@query("""SELECT subj, ref, pos, n, round_even(likelihood, 3) likelihood, round_even(entropy, 2) + 0.0 entropy FROM (SELECT *, count(*) OVER (PARTITION BY subj, ref) k FROM prs) WHERE likelihood > 1 / k""")
def prs_clean(spark, d):
    return P.clean(_prs(spark, d)).select("subj", "ref", "pos", "n", "likelihood", "entropy")


@query("""SELECT subj, ref, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY subj, ref ORDER BY n DESC, pos) k FROM prs) WHERE k <= 2""")
def prs_top_n(spark, d):
    return P.clean(_prs(spark, d), top=2).select("subj", "ref", "pos", "n")


@query("""SELECT subj, ref, pos, n, round(p, 6) likelihood, round(-sum(p * ln(p)) OVER (PARTITION BY subj, ref), 6) + 0.0 entropy FROM (
    SELECT subj, ref, CASE pos WHEN 'side-up' THEN 'side' WHEN 'side-down' THEN 'side' ELSE pos END pos, sum(n)::BIGINT n, sum(likelihood) p FROM prs GROUP BY ALL)""")
def prs_merge_labels(spark, d):
    out = P.merge_labels(_prs(spark, d), {"side-up": "side", "side-down": "side"}, base=math.e)
    return rounded(out.select("subj", "ref", "pos", "n", "likelihood", "entropy"), "likelihood", "entropy")


_MATRIX = f"""m AS (SELECT a.pos pos_a, b.pos pos_b FROM (SELECT unnest({list(POSITIONS)!r}) pos) a JOIN (SELECT unnest({list(POSITIONS)!r}) pos) b ON a.pos <= b.pos),
    mb AS (SELECT pos_a, pos_b, subj, ref, CASE WHEN pos = pos_b THEN pos_a ELSE pos END pos, sum(likelihood) p FROM prs, m GROUP BY ALL),
    mh AS (SELECT pos_a, pos_b, subj, ref, -sum(p * ln(p)) entropy FROM mb GROUP BY ALL),
    mm AS (SELECT pos_a, pos_b, count(*) FILTER (round(entropy, 9) <= {round(math.log(3), 9)!r}) low FROM mh GROUP BY ALL)"""


@query(f", {_MATRIX} SELECT * FROM mm")
def prs_merge_matrix(spark, d):
    return P.merge_matrix(_prs(spark, d), P.MAX_ENTROPY, list(POSITIONS))


@query(f", {_MATRIX} SELECT * FROM mm WHERE pos_a < pos_b ORDER BY low DESC, pos_a, pos_b LIMIT 5")
def prs_best_merges(spark, d):
    return P.best_merges(prs_merge_matrix(spark, d), 5)


@query("""SELECT subj, ref, sup FROM pairs, (SELECT quantile_cont(log10(sup), 0.25) a, quantile_cont(log10(sup), 0.75) b FROM pairs)
    WHERE log10(sup) < a - 1.5 * (b - a) OR log10(sup) > b + 1.5 * (b - a)""")
def prs_outliers(spark, d):
    return P.support_outliers(_prs(spark, d)).select("subj", "ref", "sup")


@query("SELECT subj label, sup, row_number() OVER (ORDER BY sup DESC, subj)::INT place FROM pairs WHERE subj = ref")
def cooccur_same_label(spark, d):
    return P.same_class(_prs(spark, d))


@query("""SELECT CASE WHEN x < 0 THEN 0 WHEN x >= 4 THEN 21 ELSE floor(x * 5)::INT + 1 END AS bin, count(*) n FROM (SELECT log10(sup) x FROM pairs) GROUP BY 1""")
def prs_sup_histogram(spark, d):
    return P.numeric_histogram(P.pairs(_prs(spark, d)).withColumn("x", F.log10("sup")), "x", 0, 4, 20)


@query("""SELECT subj, ref, pos, n FROM (SELECT *, count(*) OVER (PARTITION BY subj, ref) k FROM prs) WHERE likelihood > 1 / k AND (subj, ref) IN (
    SELECT (subj, ref) FROM pairs WHERE (subj, ref) IN (SELECT (subj, ref) FROM (SELECT *, count(*) OVER (PARTITION BY subj, ref) k FROM prs) WHERE likelihood > 1 / k AND pos = 'side')
    ORDER BY entropy, subj, ref LIMIT 1 OFFSET 3)""")
def prs_kth_with_position(spark, d):
    prs = P.build(load(spark, d).triples()).withColumn("entropy", F.round("entropy", 12))
    return P.kth_with_position(prs, "side", 3).select("subj", "ref", "pos", "n")


_PRUNED = """ke AS (SELECT t.* FROM t WHERE (subj, ref) IN (SELECT (subj, ref) FROM f)),
    lost AS (SELECT graph_id FROM (SELECT graph_id, count(*) c FROM e GROUP BY 1) LEFT JOIN (SELECT graph_id, count(*) k FROM ke GROUP BY 1) USING (graph_id) WHERE c > coalesce(k, 0)),
    kn AS (SELECT n.* FROM n WHERE graph_id NOT IN (SELECT graph_id FROM lost) OR (graph_id, node_id) IN (SELECT (graph_id, s) FROM ke UNION ALL SELECT (graph_id, r) FROM ke)),
    dd AS (SELECT graph_id, node_id, list_sort(list(DISTINCT d)) d FROM (SELECT graph_id, s node_id, 'out|' || pos || '|' || ref d FROM ke UNION ALL SELECT graph_id, r, 'in|' || pos || '|' || subj FROM ke) GROUP BY ALL),
    nn AS (SELECT graph_id, label, max(node_id) node_id FROM kn LEFT JOIN dd USING (graph_id, node_id) GROUP BY graph_id, label, coalesce(d, [])),
    ne AS (SELECT * FROM ke WHERE (graph_id, s) IN (SELECT (graph_id, node_id) FROM nn) AND (graph_id, r) IN (SELECT (graph_id, node_id) FROM nn))"""
PRUNED_SQL = _PRUNED


def pruned(spark: SparkSession, d: str, nodes: bool = True):
    g = cut_graphs(load(spark, d))
    return G.prepare(g, cut(P.build(g.triples())), nodes=nodes)


@query(f", {_PRUNED} SELECT graph_id, s, pos, r FROM ke")
def edge_pruned(spark, d):
    return pruned(spark, d, nodes=False).edges


@query(f", {_PRUNED} SELECT graph_id, node_id, label FROM kn")
def edge_pruned_nodes(spark, d):
    return pruned(spark, d, nodes=False).nodes


@query(f", {_PRUNED} SELECT graph_id, node_id, label FROM nn")
def node_pruned(spark, d):
    return pruned(spark, d).nodes


@query(f", {_PRUNED} SELECT graph_id, s, pos, r FROM ne")
def node_pruned_edges(spark, d):
    return pruned(spark, d).edges


@query(f", {_PRUNED} SELECT (SELECT count(*) FROM g) graphs, round((SELECT count(*) FROM e) / (SELECT count(*) FROM g), 6) avg_before, round((SELECT count(*) FROM ke) / (SELECT count(*) FROM g), 6) avg_after")
def edge_prune_stats(spark, d):
    return rounded(G.edge_stats(load(spark, d), pruned(spark, d, nodes=False)), "avg_before", "avg_after")


@query(f""", {_PRUNED} SELECT round(b / g, 6) avg_before, round(a / g, 6) avg_after, b - a removed, round(100.0 * (b - a) / b, 6) removed_pct
    FROM (SELECT (SELECT count(*) FROM kn) b, (SELECT count(*) FROM nn) a, (SELECT count(*) FROM g) g)""")
def node_prune_stats(spark, d):
    return rounded(G.node_stats(pruned(spark, d, nodes=False), pruned(spark, d)), "avg_before", "avg_after", "removed_pct")


@query("SELECT label, count(*) nodes, count(DISTINCT graph_id) graphs FROM n GROUP BY label")
def label_freq(spark, d):
    return G.label_frequency(load(spark, d).nodes)


@query(f""", w AS (SELECT * FROM n WHERE label IN {tuple(LABELS)}), k AS (SELECT graph_id FROM w GROUP BY 1 HAVING count(DISTINCT label) = {len(LABELS)})
    SELECT t.graph_id, s, subj, pos, ref, r FROM t JOIN k USING (graph_id) WHERE subj IN {tuple(LABELS)} AND ref IN {tuple(LABELS)}""")
def label_subset_graph(spark, d):
    return G.label_subset(load(spark, d), LABELS).triples()


@query("SELECT graph_id, s, CASE WHEN pos IN ('above', 'side-up') THEN 'higher' WHEN pos IN ('below', 'side-down') THEN 'lower' ELSE pos END pos, r FROM e")
def agg_edge_labels(spark, d):
    return G.coarse_positions(load(spark, d).edges)


@query(f"""SELECT graph_id, round(coalesce(b, -1), 6) best FROM g LEFT JOIN (SELECT graph_id, max(prs.likelihood) b FROM t JOIN prs USING (subj, ref, pos) WHERE subj = '{PAIR[0]}' AND ref = '{PAIR[1]}' GROUP BY 1) USING (graph_id)""")
def best_pair(spark, d):
    g = load(spark, d)
    return rounded(G.best_pair_likelihood(g, P.build(g.triples()), *PAIR), "best")


@query(f"SELECT graph_id FROM n WHERE label = '{LABEL}' GROUP BY 1 HAVING count(*) > 2")
def graphs_with_many(spark, d):
    return G.more_than(load(spark, d).nodes, LABEL, 2)


@query("SELECT graph_id, s, subj, pos, ref, r, round(prs.likelihood, 6) likelihood FROM t JOIN prs USING (subj, ref, pos) WHERE prs.likelihood > 0.5")
def positive_links(spark, d):
    g = load(spark, d)
    out = G.positive_relationships(g.triples(), P.build(g.triples()), 0.5)
    return rounded(out.select("graph_id", "s", "subj", "pos", "ref", "r", "likelihood"), "likelihood")


@query("SELECT row_number() OVER (ORDER BY x)::INT + 1 bins, round(log2(x), 6) bits, round(ln(x), 6) nats FROM (SELECT unnest([2, 3, 4]) x)")
def prs_reference_entropies(spark, d):
    return rounded(P.reference_entropies(spark), "bits", "nats")


@query("""SELECT graph_id FROM (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 k FROM g)
    WHERE (SELECT count(*) FROM g) <= 500 OR k IN (SELECT round_even(i * (((SELECT count(*) FROM g) - 1) / 499), 0)::BIGINT FROM range(500) r(i))""")
def evenly_spaced_graphs(spark, d):
    return G.evenly_spaced(load(spark, d).graphs, "graph_id", 500)
