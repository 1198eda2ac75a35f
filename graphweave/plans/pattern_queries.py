"""Queries of mining, matching and evaluation with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.terms import term
from graphweave.model import Graphs, cut_graphs
from graphweave.operators import evaluate as V
from graphweave.operators import matching as C
from graphweave.operators import mining as M
from graphweave.plans.collection import load
from graphweave.plans.graph_queries import BASE, PRUNED_SQL, pruned, rounded
from graphweave.session import cut

#: Support of a pattern as a share of the graphs with edges.
SHARE = 0.003
QUERIES: dict = {}
ORACLE: dict = {}

# undirected edges of the pruned graphs, direction rebuilt by label order; frequent one-edge patterns. At SHARE of the smaller tables
# no pattern of two edges is frequent, so that the SQL says all of the summaries too; the queries themselves have no bound of edges.
_SQL = f"""{BASE}, {PRUNED_SQL},
    ue AS (SELECT DISTINCT graph_id, CASE WHEN sw THEN r ELSE s END s, CASE WHEN sw THEN s ELSE r END r, CASE WHEN sw THEN ref ELSE subj END subj, pos, CASE WHEN sw THEN subj ELSE ref END "ref"
        FROM (SELECT *, subj > ref OR (subj = ref AND s > r) sw FROM ne WHERE s <> r)),
    ms AS (SELECT greatest(1, ceil({SHARE} * count(DISTINCT graph_id)))::BIGINT m FROM ne),
    f1 AS (SELECT subj, pos, "ref", count(DISTINCT graph_id) sup FROM ue GROUP BY ALL HAVING count(DISTINCT graph_id) >= (SELECT m FROM ms)),
    pt AS (SELECT row_number() OVER (ORDER BY sup DESC, subj, pos, "ref") - 1 pid, * FROM f1),
    gl AS (SELECT graph_id, count(DISTINCT label) total FROM nn GROUP BY 1),
    lab AS (SELECT DISTINCT graph_id, label FROM nn),
    cand AS (SELECT pt.*, a.graph_id FROM pt JOIN lab a ON a.label = subj JOIN lab b ON b.label = "ref" AND a.graph_id = b.graph_id),
    hit AS (SELECT DISTINCT graph_id, t.subj, t.pos, t."ref" FROM ne t WHERE s <> r AND (subj <> "ref" OR NOT EXISTS (SELECT 1 FROM ne u WHERE u.graph_id = t.graph_id AND u.s = t.r AND u.r = t.s AND u.pos = t.pos))),
    cells AS (SELECT cand.graph_id, pid, subj, pos, "ref", sup, (hit.graph_id IS NOT NULL)::INT cnt, (CASE WHEN subj = "ref" THEN 1 ELSE 2 END) / total overlap
        FROM cand LEFT JOIN hit USING (graph_id, subj, pos, "ref") JOIN gl USING (graph_id))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {_SQL}{'' if sql.startswith(',') else ' '}{sql}"
        return f

    return add


def _mined(spark: SparkSession, d: str, max_edges: int | None, minsup: int | None = None) -> tuple[Graphs, M.Patterns]:
    g = cut_graphs(pruned(spark, d))
    return g, M.frequent_subgraphs(g, minsup or M.least_support(g, SHARE), max_edges=max_edges)


def _named(p: M.Patterns) -> DataFrame:
    """One-edge patterns by their labels."""
    a = p.nodes.select("pattern_id", F.col("node").alias("s"), F.col("label").alias("subj"))
    b = p.nodes.select("pattern_id", F.col("node").alias("r"), F.col("label").alias("ref"))
    return p.patterns.where("n_edges = 1").select("pattern_id", "sup").join(p.edges, "pattern_id").join(a, ["pattern_id", "s"]).join(b, ["pattern_id", "r"]).select("pattern_id", "subj", "pos", "ref", "sup")


@query('SELECT subj, pos, "ref", sup FROM f1')
def fsm_1edge(spark, d):
    return _named(_mined(spark, d, 1)[1]).drop("pattern_id")


@query("""SELECT labels, e1, e2, count(DISTINCT graph_id) sup FROM (
    SELECT a.graph_id, array_to_string(list_sort([x.label, y.label, z.label]), ',') labels, least(a.k, b.k) e1, greatest(a.k, b.k) e2
    FROM (SELECT ue.*, subj || '|' || pos || '|' || "ref" k FROM ue) a JOIN (SELECT ue.*, subj || '|' || pos || '|' || "ref" k FROM ue) b
        ON a.graph_id = b.graph_id AND (a.s, a.pos, a.r) < (b.s, b.pos, b.r) AND (a.s IN (b.s, b.r) OR a.r IN (b.s, b.r)) AND NOT (least(a.s, a.r) = least(b.s, b.r) AND greatest(a.s, a.r) = greatest(b.s, b.r))
    JOIN nn x ON x.graph_id = a.graph_id AND x.node_id = a.s JOIN nn y ON y.graph_id = a.graph_id AND y.node_id = a.r
    JOIN nn z ON z.graph_id = a.graph_id AND z.node_id = (CASE WHEN b.s IN (a.s, a.r) THEN b.r ELSE b.s END)
    WHERE len(list_distinct([x.label, y.label, z.label])) = 3)
    GROUP BY ALL HAVING count(DISTINCT graph_id) >= 2""")
def fsm_2edge(spark, d):
    """Two-edge paths over three different labels."""
    _, p = _mined(spark, d, 2, minsup=2)
    a = p.nodes.select("pattern_id", F.col("node").alias("s"), F.col("label").alias("subj"))
    b = p.nodes.select("pattern_id", F.col("node").alias("r"), F.col("label").alias("ref"))
    kinds = p.edges.join(a, ["pattern_id", "s"]).join(b, ["pattern_id", "r"]).groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.concat_ws("|", "subj", "pos", "ref"))).alias("e"))
    labels = p.nodes.groupBy("pattern_id").agg(F.array_sort(F.collect_list("label")).alias("l"))
    rows = p.patterns.where("n_edges = 2 and n_nodes = 3").join(kinds, "pattern_id").join(labels, "pattern_id").where(F.size(F.array_distinct("l")) == 3)
    return rows.select(F.array_join("l", ",").alias("labels"), F.col("e")[0].alias("e1"), F.col("e")[1].alias("e2"), "sup")


@query("""SELECT labels, e[1] e1, e[2] e2, e[3] e3, count(DISTINCT graph_id) sup FROM (
    SELECT a.graph_id, list_sort([a.k, b.k, c.k]) e, list_distinct([a.s, a.r, b.s, b.r, c.s, c.r]) ns, array_to_string(list_sort(list_distinct([a.subj, a."ref", b.subj, b."ref", c.subj, c."ref"])), ',') labels,
        len(list_distinct([a.subj, a."ref", b.subj, b."ref", c.subj, c."ref"])) kinds, len(list_distinct([(least(a.s, a.r), greatest(a.s, a.r)), (least(b.s, b.r), greatest(b.s, b.r)), (least(c.s, c.r), greatest(c.s, c.r))])) links
    FROM uk a JOIN uk b ON a.graph_id = b.graph_id AND (a.s, a.pos, a.r) < (b.s, b.pos, b.r) JOIN uk c ON a.graph_id = c.graph_id AND (b.s, b.pos, b.r) < (c.s, c.pos, c.r))
    WHERE len(ns) = 4 AND kinds = 4 AND links = 3 GROUP BY ALL HAVING count(DISTINCT graph_id) >= 2""")
def fsm_3edge(spark, d):
    """Three connected edges over four different labels, in at least two of the graphs as they are."""
    p = M.frequent_subgraphs(cut_graphs(load(spark, d)), 2, max_edges=3)
    a = p.nodes.select("pattern_id", F.col("node").alias("s"), F.col("label").alias("subj"))
    b = p.nodes.select("pattern_id", F.col("node").alias("r"), F.col("label").alias("ref"))
    kinds = p.edges.join(a, ["pattern_id", "s"]).join(b, ["pattern_id", "r"]).groupBy("pattern_id").agg(F.array_sort(F.collect_list(F.concat_ws("|", "subj", "pos", "ref"))).alias("e"))
    labels = p.nodes.groupBy("pattern_id").agg(F.array_sort(F.collect_set("label")).alias("l"))
    rows = p.patterns.where("n_edges = 3 and n_nodes = 4").join(kinds, "pattern_id").join(labels, "pattern_id").where(F.size("l") == 4)
    return rows.select(F.array_join("l", ",").alias("labels"), *[F.col("e")[k].alias(f"e{k + 1}") for k in range(3)], "sup")


ORACLE["fsm_3edge"] = ORACLE["fsm_3edge"].replace("SELECT labels, e[1]", ", uk AS (SELECT *, subj || '|' || pos || '|' || \"ref\" k FROM (SELECT DISTINCT graph_id, CASE WHEN sw THEN r ELSE s END s, CASE WHEN sw THEN s ELSE r END r, CASE WHEN sw THEN ref ELSE subj END subj, pos, CASE WHEN sw THEN subj ELSE ref END \"ref\" FROM (SELECT *, subj > ref OR (subj = ref AND s > r) sw FROM t WHERE s <> r))) SELECT labels, e[1]", 1)


@query("""SELECT '[["' || subj || '","' || "ref" || '"],[[0,"' || pos || '",1]]]' AS code, sup, 2 n_nodes, 1 n_edges FROM f1""")
def fsm_k(spark, d):
    return _mined(spark, d, None)[1].patterns.select("code", "sup", "n_nodes", "n_edges")


@query()
def fsm_compressing(spark, d):
    return M.compressing_subgraphs(cut_graphs(pruned(spark, d)), 20).patterns


@query("SELECT m.x minsup, count(sup) patterns FROM (SELECT unnest([30, 60, 120]) x) m LEFT JOIN f1 ON sup >= x GROUP BY 1")
def fsm_sweep(spark, d):
    g = cut_graphs(pruned(spark, d))
    return M.sweep(g, [30, 60, 120]).select("minsup", "patterns")


@query("""SELECT labels, sup FROM (SELECT DISTINCT first_value(subj) OVER w a, first_value("ref") OVER w b, first_value(sup) OVER w sup, CASE WHEN subj = "ref" THEN subj ELSE subj || ',' || "ref" END labels FROM f1 WINDOW w AS (PARTITION BY subj, "ref" ORDER BY sup DESC)) i
    WHERE NOT EXISTS (SELECT 1 FROM f1 j WHERE i.a = i.b AND j.subj <> j."ref" AND i.a IN (j.subj, j."ref") AND (SELECT max(sup) FROM f1 k WHERE k.subj = j.subj AND k."ref" = j."ref") <= i.sup)""")
def maximal_itemsets(spark, d):
    _, p = _mined(spark, d, None)
    return M.maximal_itemsets(p.patterns, p.nodes).select(F.array_join("labels", ",").alias("labels"), "sup")


def _cells(spark, d, max_edges: int | None = 1):
    g, p = _mined(spark, d, max_edges)
    return g, p, cut(C.coverage(g, p.nodes, p.edges))


@query('SELECT graph_id, subj, pos, "ref", cnt, round(overlap, 6) overlap FROM cells')
def coverage_1edge(spark, d):
    _, p, cells = _cells(spark, d)
    return rounded(cells.join(_named(p).drop("sup"), "pattern_id").drop("pattern_id"), "overlap")


@query()
def coverage_2edge(spark, d):
    g, p = _mined(spark, d, 2, minsup=2)
    two = p.patterns.where("n_edges = 2").select("pattern_id")
    keep = lambda df: df.join(two, "pattern_id", "left_semi")
    return C.coverage(g, keep(p.nodes), keep(p.edges)).where("cnt > 0")


# the patterns of each run in the table sgs, their deliveries once
_RUNS = """WITH s0 AS (SELECT run_name, g.graph.name id, max(coalesce(sup, 0)) sup, arg_max(g.nodes, loaded_at) nodes, arg_max(g.links, loaded_at) links FROM sgs GROUP BY ALL),
    s AS (SELECT * FROM s0),
    nl AS (SELECT run_name, id, x.id node, nullif(trim(regexp_replace(lower(x.label), '[^a-z0-9]+', ' ', 'g')), '') label FROM (SELECT run_name, id, unnest(nodes) x FROM s)),
    el AS (SELECT run_name, id, x.s s, x.r r, nullif(trim(regexp_replace(lower(x.pos), '[^a-z0-9]+', ' ', 'g')), '') pos FROM (SELECT run_name, id, unnest(links) x FROM s)),
    it AS ({items}), l AS (SELECT s.run_name, s.id, coalesce(list(DISTINCT item) FILTER (item IS NOT NULL), []) l FROM s LEFT JOIN it ON it.run_name = s.run_name AND it.id = s.id GROUP BY ALL)
    SELECT a.run_name, round(avg(CASE WHEN len(a.l) > 0 AND len(b.l) > 0 THEN 1 - len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) ELSE 0 END), 6) diversity
    FROM l a JOIN l b ON a.run_name = b.run_name AND a.id < b.id GROUP BY 1
    UNION ALL SELECT run_name, max(len(l) > 0)::INT::DOUBLE FROM l GROUP BY 1 HAVING count(*) = 1"""


def _runs(spark, d):
    """(run_name, id, nodes, links) of the patterns of each run."""
    rows = spark.read.parquet(f"{d}/sgs.parquet").groupBy("run_name", F.col("g.graph.name").alias("id")).agg(F.max_by("g.nodes", "loaded_at").alias("nodes"), F.max_by("g.links", "loaded_at").alias("links"))
    return cut(rows)


def _diversity_nodes(runs):
    labels = F.array_compact(F.transform("nodes.label", lambda x: term(x)))
    return rounded(V.diversity(runs.withColumn("x", labels), "id", "x", ["run_name"]), "diversity")


def _diversity_edges(runs):
    def label(node):
        return term(F.filter("nodes", lambda n: n["id"] == node)[0]["label"])

    triples = F.array_compact(F.transform("links", lambda x: F.concat(label(x["s"]), F.lit("|"), term(x["pos"]), F.lit("|"), label(x["r"]))))
    return rounded(V.diversity(runs.withColumn("x", triples), "id", "x", ["run_name"]), "diversity")


@query()
def diversity_nodes(spark, d):
    return _diversity_nodes(_runs(spark, d))


@query()
def diversity_edges(spark, d):
    return _diversity_edges(_runs(spark, d))


ORACLE["diversity_nodes"] = _RUNS.replace("{items}", "SELECT run_name, id, label item FROM nl WHERE label IS NOT NULL")
ORACLE["diversity_edges"] = _RUNS.replace("{items}", "SELECT el.run_name, el.id, a.label || '|' || pos || '|' || b.label item FROM el JOIN nl a ON a.run_name = el.run_name AND a.id = el.id AND a.node = s JOIN nl b ON b.run_name = el.run_name AND b.id = el.id AND b.node = r WHERE pos IS NOT NULL AND a.label IS NOT NULL AND b.label IS NOT NULL")


@query(""", pl AS (SELECT pid, list_distinct([subj, "ref"]) l FROM pt),
    dv AS (SELECT avg(1 - len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l)))) x FROM pl a JOIN pl b ON a.pid < b.pid)
    SELECT (SELECT count(*) FROM pt) n_graphs, (SELECT count(DISTINCT (subj, "ref")) FROM pt) distinct_sets, round_even((SELECT count(DISTINCT (subj, "ref")) / count(*) FROM pt), 3) set_ratio,
    2.0::DOUBLE avg_nodes, 0.0::DOUBLE std_nodes, round_even((SELECT avg(len(l)) FROM pl), 2) avg_classes, (SELECT max(len(l)) FROM pl)::INT max_classes, round_even((SELECT avg(len(l) / 2) FROM pl), 2) distinct_node_ratio,
    round_even((SELECT count(*) FROM (SELECT graph_id FROM cells GROUP BY 1 HAVING max(cnt) > 0)) / (SELECT count(*) FROM g), 2) coverage,
    round_even((SELECT sum(o) FROM (SELECT max(overlap) o FROM cells GROUP BY graph_id)) / (SELECT count(*) FROM g), 2) coverage_overlap, round_even((SELECT x FROM dv), 2) diversity, 1.0::DOUBLE diversity_ne""")
def summary_metrics(spark, d):
    g, p, cells = _cells(spark, d, None)
    return V.summary(g, p.patterns, p.nodes, p.edges, cells)


@query()
def summary_all(spark, d):
    g, p, cells = _cells(spark, d, None)
    return V.summary(g, p.patterns, p.nodes, p.edges, cells, k=20)


@query(""", sz AS (SELECT graph_id, count(*) n FROM n GROUP BY 1), c AS (SELECT pid, subj, pos, "ref", graph_id, n FROM cells JOIN sz USING (graph_id) WHERE cnt > 0),
    m AS (SELECT *, round(abs(n - avg(n) OVER (PARTITION BY pid)), 9) k FROM c)
    SELECT '[["' || subj || '","' || "ref" || '"],[[0,"' || pos || '",1]]]' AS code, graph_id FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY k, graph_id) i FROM m) WHERE i = 1""")
def image_pairing(spark, d):
    _, p, cells = _cells(spark, d, None)
    sizes = load(spark, d).nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return V.represent(cells, sizes).join(p.patterns, "pattern_id").select("code", "graph_id")


@query("""SELECT min(k)::INT group_no, graph_id FROM (SELECT graph_id, CASE label WHEN 'rowboat' THEN 0 WHEN 'tram' THEN 1 WHEN 'kettle' THEN 2 END k FROM n) WHERE k IS NOT NULL GROUP BY graph_id""")
def subset_by_label(spark, d):
    return V.subset_by_labels(load(spark, d).nodes, [["rowboat"], ["tram"], ["kettle"]])


@query("""SELECT '[["' || subj || '","' || "ref" || '"],[[0,"' || pos || '",1]]]' AS code, graph_id FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY graph_id) k FROM cells WHERE cnt > 0) WHERE k <= 3""")
def first_match(spark, d):
    g, p = _mined(spark, d, None)
    return C.first_matches(g, p.nodes, p.edges, 3).join(p.patterns, "pattern_id").select("code", "graph_id")


@query("""SELECT '[["' || subj || '","' || "ref" || '"],[[0,"' || pos || '",1]]]' AS code, graph_id, cnt, round(overlap, 6) overlap FROM cells""")
def coverage_whole(spark, d):
    _, p, cells = _cells(spark, d, None)
    return rounded(cells.join(p.patterns, "pattern_id").select("code", "graph_id", "cnt", "overlap"), "overlap")


ORACLE["caption_search"] = "SELECT doc_id, term, md5(text) digest FROM documents, (SELECT unnest(['import', 'histogram', 'sensor']) term) WHERE contains(text, term)"


def caption_search(spark, d):
    out = V.caption_search(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id", "text", ["import", "histogram", "sensor"])
    return out.select("doc_id", "term", F.md5("text").alias("digest"))


QUERIES["caption_search"] = caption_search
