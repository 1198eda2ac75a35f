"""Queries of anomalies, panoptic quality, measures and retrieval with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.operators import anomaly as A
from graphweave.operators import metrics as V
from graphweave.operators import panoptic as Q
from graphweave.operators import prs as P
from graphweave.operators import retrieval as R
from graphweave.plans.collection import delivered, load
from graphweave.plans.graph_queries import BASE, rounded
from graphweave.session import cut

QUERIES: dict = {}
ORACLE: dict = {}

# segments of the table panoptic, and made-up predictions for them, each by plain arithmetic on id and area
_SEG = """sg AS (SELECT image_id, x.id segment_id, max(x.category_id) category_id, max(x.area) area, max(x.iscrowd) iscrowd
        FROM (SELECT image_id, unnest(segments_info) x FROM panoptic) WHERE x.category_id IS NOT NULL AND x.id IS NOT NULL GROUP BY ALL),
    pd AS (SELECT image_id, segment_id + 1 segment_id, CASE WHEN segment_id % 7 = 0 THEN category_id + 1 ELSE category_id END category_id FROM sg WHERE segment_id % 11 <> 0),
    it AS (SELECT image_id, segment_id gt, CASE WHEN segment_id % 11 <> 0 THEN segment_id + 1 ELSE 0 END pred, (area * (40 + segment_id % 60)) // 100 "inter" FROM sg
        UNION ALL SELECT image_id, segment_id, 0, area - (area * (40 + segment_id % 60)) // 100 FROM sg WHERE segment_id % 11 <> 0
        UNION ALL SELECT image_id, 0, segment_id + 1, 1 + (segment_id % 13) * area // 10 FROM sg WHERE segment_id % 11 <> 0),
    inr AS (SELECT image_id, gt, pred, sum("inter")::BIGINT "inter" FROM it GROUP BY ALL),
    pa AS (SELECT image_id, pred, sum("inter") p_area, coalesce(sum("inter") FILTER (gt = 0), 0) on_void FROM inr WHERE pred <> 0 GROUP BY ALL),
    tp AS (SELECT inr.image_id, gt, inr.pred, sg.category_id, "inter" / (p_area + area - "inter" - on_void) iou FROM inr JOIN sg ON sg.image_id = inr.image_id AND sg.segment_id = gt
        JOIN pd ON pd.image_id = inr.image_id AND pd.segment_id = inr.pred JOIN pa ON pa.image_id = inr.image_id AND pa.pred = inr.pred
        WHERE sg.category_id = pd.category_id AND iscrowd = 0 AND "inter" / (p_area + area - "inter" - on_void) > 0.5),
    cw AS (SELECT image_id, category_id, max(segment_id) gt FROM sg WHERE iscrowd = 1 GROUP BY ALL),
    st AS (SELECT image_id, category_id, 'tp' kind, pred segment_id, iou FROM tp
        UNION ALL SELECT image_id, category_id, 'fn', segment_id, NULL FROM sg WHERE iscrowd = 0 AND (image_id, segment_id) NOT IN (SELECT (image_id, gt) FROM tp)
        UNION ALL SELECT pd.image_id, pd.category_id, CASE WHEN (on_void + coalesce(inr."inter", 0)) / p_area > 0.5 THEN 'ignored' ELSE 'fp' END, pd.segment_id, NULL
            FROM pd LEFT JOIN pa ON pa.image_id = pd.image_id AND pa.pred = pd.segment_id LEFT JOIN cw ON cw.image_id = pd.image_id AND cw.category_id = pd.category_id
            LEFT JOIN inr ON inr.image_id = pd.image_id AND inr.gt = cw.gt AND inr.pred = pd.segment_id WHERE (pd.image_id, pd.segment_id) NOT IN (SELECT (image_id, pred) FROM tp)),
    qm AS (SELECT image_id, category_id, count(*) FILTER (kind = 'tp') tp, count(*) FILTER (kind = 'fp') fp, count(*) FILTER (kind = 'fn') fn, coalesce(sum(iou), 0) iou FROM st GROUP BY ALL),
    qc AS (SELECT category_id, sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn, sum(iou) iou FROM qm GROUP BY ALL HAVING sum(tp + fp + fn) > 0)"""
_PQ = "iou / (tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn) pq, CASE WHEN tp > 0 THEN iou / tp ELSE 0 END sq, tp / (tp + 0.5::DOUBLE * fp + 0.5::DOUBLE * fn) rq"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def segments(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/panoptic.parquet").select("image_id", F.explode("segments_info").alias("x"))
    x = x.select("image_id", F.col("x.id").alias("segment_id"), F.col("x.category_id").alias("category_id"), F.col("x.area").alias("area"), F.col("x.iscrowd").alias("iscrowd"))
    x = x.where(F.col("category_id").isNotNull() & F.col("segment_id").isNotNull())
    return x.groupBy("image_id", "segment_id").agg(*[F.max(c).alias(c) for c in ("category_id", "area", "iscrowd")])


def _status(spark: SparkSession, d: str) -> DataFrame:
    sg = cut(segments(spark, d))
    hit, pid = F.col("segment_id") % 11 != 0, F.col("segment_id") + 1
    predicted = sg.where(hit).select("image_id", pid.alias("segment_id"), F.when(F.col("segment_id") % 7 == 0, F.col("category_id") + 1).otherwise(F.col("category_id")).alias("category_id"))
    part = F.expr("(area * (40 + segment_id % 60)) div 100")
    rows = sg.select("image_id", F.col("segment_id").alias("gt"), F.when(hit, pid).otherwise(0).alias("pred"), part.alias("n"))
    rows = rows.unionByName(sg.where(hit).select("image_id", F.col("segment_id").alias("gt"), F.lit(0).alias("pred"), (F.col("area") - part).alias("n")))
    rows = rows.unionByName(sg.where(hit).select("image_id", F.lit(0).alias("gt"), pid.alias("pred"), F.expr("1 + (segment_id % 13) * area div 10").alias("n")))
    return Q.segment_status(cut(Q.overlaps(rows)), sg, predicted)


@query(f"WITH {_SEG} SELECT image_id, category_id, kind, segment_id, round(iou, 6) iou FROM st")
def pq_segments(spark, d):
    return rounded(_status(spark, d), "iou")


@query(f"WITH {_SEG} SELECT category_id, tp, fp, fn, round(pq, 6) pq, round(sq, 6) sq, round(rq, 6) rq FROM (SELECT *, {_PQ} FROM qc)")
def pq_by_category(spark, d):
    return rounded(Q.quality_by_category(_status(spark, d)).drop("precision", "recall"), "pq", "sq", "rq")


@query(f"WITH {_SEG} SELECT image_id, sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn, round(avg(pq), 6) pq, round(avg(sq), 6) sq, round(avg(rq), 6) rq FROM (SELECT *, {_PQ} FROM qm WHERE tp + fp + fn > 0) GROUP BY image_id")
def pq_per_image(spark, d):
    return rounded(Q.quality_by_image(_status(spark, d)), "pq", "sq", "rq")


@query(f"""WITH {_SEG}, r AS (SELECT *, {_PQ} FROM qc JOIN categories ON id = category_id)
    SELECT part, round(avg(pq), 6) pq, round(avg(sq), 6) sq, round(avg(rq), 6) rq, count(*) n FROM (SELECT *, 'all' part FROM r UNION ALL SELECT *, CASE isthing WHEN 1 THEN 'things' ELSE 'stuff' END FROM r) GROUP BY part""")
def pq_report(spark, d):
    out = Q.quality_report(Q.quality_by_category(_status(spark, d)), spark.read.parquet(f"{d}/categories.parquet"))
    return rounded(out.drop("precision", "recall"), "pq", "sq", "rq")


@query(f"WITH {_SEG} SELECT image_id, segment_id, name, segment_id % 256 r, (segment_id // 256) % 256 g, (segment_id // 65536) % 256 b FROM st JOIN categories ON id = category_id WHERE kind = 'fp'")
def false_positive_segments(spark, d):
    return Q.false_positives(_status(spark, d), spark.read.parquet(f"{d}/categories.parquet")).drop("category_id")


_STATUS = "ss AS (SELECT graph_id, node_id, CASE node_id % 4 WHEN 0 THEN 'fp' ELSE 'tp' END status FROM n WHERE node_id % 4 < 3)"


def _node_status(g) -> DataFrame:
    m = F.col("node_id") % 4
    return g.nodes.where(m < 3).select("graph_id", "node_id", F.when(m == 0, "fp").otherwise("tp").alias("status"))


_LINKS = f"""{_STATUS}, lk AS (SELECT t.graph_id, s, r, x.sup, CASE WHEN x.sup IS NULL THEN NULL ELSE coalesce(f.likelihood, 0) END l
    FROM t LEFT JOIN (SELECT DISTINCT subj, ref, sup FROM f) x USING (subj, ref) LEFT JOIN f USING (subj, ref, pos))"""


@query(f"""WITH {BASE}, {_LINKS}, c AS (SELECT l, CASE WHEN a.status = 'fp' AND b.status = 'fp' THEN 'both_fp' WHEN a.status = 'tp' AND b.status = 'tp' THEN 'both_tp'
    WHEN a.status IS NOT NULL AND b.status IS NOT NULL THEN 'tp_fp' WHEN 'fp' IN (coalesce(a.status, ''), coalesce(b.status, '')) THEN 'fp_ignored' ELSE 'ignored' END "class"
    FROM lk LEFT JOIN ss a ON a.graph_id = lk.graph_id AND a.node_id = s LEFT JOIN ss b ON b.graph_id = lk.graph_id AND b.node_id = r)
    SELECT "class", count(*) links, count(*) FILTER (l IS NULL) no_histogram, round(avg(l), 6) avg_likelihood FROM c GROUP BY 1""")
def pair_anomaly(spark, d):
    g = load(spark, d)
    return rounded(A.pair_report(A.pair_anomalies(g, P.filter_prs(P.build(g.triples())), _node_status(g))), "avg_likelihood")


_OBJECTS = f"""{_LINKS}, en AS (SELECT graph_id, s node_id, l FROM lk WHERE l IS NOT NULL UNION ALL SELECT graph_id, r, l FROM lk WHERE l IS NOT NULL),
    ob AS (SELECT ss.graph_id, ss.node_id, status, count(l) n_links, count(l) FILTER (l < 0.1) n_anom, coalesce(100.0::DOUBLE * count(l) FILTER (l < 0.1) / nullif(count(l), 0), 0) anom_pct, coalesce(avg(l), 0) avg_likelihood
        FROM ss LEFT JOIN en USING (graph_id, node_id) GROUP BY ALL)"""


def _objects(spark, d):
    g = load(spark, d)
    return A.object_anomalies(g, P.filter_prs(P.build(g.triples())), _node_status(g), 0.1)


@query(f"WITH {BASE}, {_OBJECTS} SELECT graph_id, node_id, status, n_links, n_anom, round(anom_pct, 6) anom_pct, round(avg_likelihood, 6) avg_likelihood FROM ob")
def object_anomaly(spark, d):
    return rounded(_objects(spark, d), "anom_pct", "avg_likelihood")


@query(f"WITH {BASE}, {_OBJECTS}, th2 AS (SELECT i / 5000.0::DOUBLE t, i FROM range(1000) x(i)) SELECT i::INT k, (count(*) FILTER (round(avg_likelihood, 9) < round(t, 9) AND status = 'fp')) tp, (count(*) FILTER (round(avg_likelihood, 9) < round(t, 9) AND status <> 'fp')) fp FROM th2, ob GROUP BY i")
def anomaly_pr_curve(spark, d):
    scores = _objects(spark, d).select(F.round("avg_likelihood", 9).alias("x"), (F.col("status") == "fp").alias("y"))
    return A.threshold_curve(scores, "x", "y", 0.0, 0.2, 1000).select(F.round(F.col("threshold") * 5000).cast("int").alias("k"), "tp", "fp")


@query(f"WITH {BASE}, {_OBJECTS} SELECT round(count(*) FILTER (anom_pct >= 30 AND status = 'fp') / count(*) FILTER (status = 'fp'), 6) recall, round(count(*) FILTER (anom_pct >= 30 AND status = 'fp') / count(*) FILTER (anom_pct >= 30), 6) AS \"precision\" FROM ob")
def anomaly_at_share(spark, d):
    return rounded(A.at_share(_objects(spark, d), 30), "recall", "precision")


_CONF = f"WITH {_SEG}, cm AS (SELECT category_id % 9 truth, (category_id + CASE WHEN segment_id % 5 = 0 THEN 1 ELSE 0 END) % 9 predicted, count(*) n FROM sg GROUP BY ALL)"


def _confusion(spark, d):
    rows = segments(spark, d).select((F.col("category_id") % 9).alias("t"), ((F.col("category_id") + F.when(F.col("segment_id") % 5 == 0, 1).otherwise(0)) % 9).alias("p"))
    return V.confusion(rows, "t", "p")


@query(f"{_CONF} SELECT * FROM cm")
def confusion_matrix(spark, d):
    return _confusion(spark, d)


@query(f"""{_CONF}, c AS (SELECT truth l, sum(n) tn, sum(n) FILTER (truth = predicted) hit, (SELECT sum(n) FROM cm x WHERE x.predicted = cm.truth) pn FROM cm GROUP BY 1)
    SELECT round(sum(hit) / sum(tn), 6) pixel_acc, round(avg(hit / tn), 6) mean_acc, round(avg(hit / (tn + pn - hit)), 6) mean_iou, round(sum(tn * hit / (tn + pn - hit)) / sum(tn), 6) freq_iou FROM c""")
def confusion_metrics(spark, d):
    return rounded(V.segmentation_scores(_confusion(spark, d)), "pixel_acc", "mean_acc", "mean_iou", "freq_iou")


_BOXES = f"WITH {_SEG}, bx AS (SELECT image_id, segment_id::BIGINT id, segment_id % 200 y1, (segment_id // 200) % 200 x1, segment_id % 200 + 1 + area % 60 y2, (segment_id // 200) % 200 + 1 + (area // 60) % 60 x2, category_id % 5 class_id, (segment_id % 1000) / 1000.0::DOUBLE score FROM sg)"


def boxes(spark, d):
    y1, x1 = F.expr("segment_id % 200"), F.expr("(segment_id div 200) % 200")
    cols = {"y1": y1, "x1": x1, "y2": y1 + 1 + F.col("area") % 60, "x2": x1 + 1 + F.expr("(area div 60) % 60"), "class_id": (F.col("category_id") % 5).cast("int"), "score": (F.col("segment_id") % 1000) / 1000.0}
    return segments(spark, d).select("image_id", F.col("segment_id").cast("bigint").alias("id"), *[c.alias(n) for n, c in cols.items()])


@query(f"""{_BOXES} SELECT image_id, a.id id_a, b.id id_b, round(h * w / (sa + sb - h * w), 6) iou FROM (SELECT a.image_id, a, b, least(a.y2, b.y2) - greatest(a.y1, b.y1) h, least(a.x2, b.x2) - greatest(a.x1, b.x1) w,
    (a.y2 - a.y1) * (a.x2 - a.x1) sa, (b.y2 - b.y1) * (b.x2 - b.x1) sb FROM bx a JOIN bx b ON a.image_id = b.image_id AND a.id % 2 = 0 AND b.id % 2 = 1) WHERE h > 0 AND w > 0""")
def box_iou(spark, d):
    b = boxes(spark, d)
    return rounded(V.box_overlaps(b.where("id % 2 = 0"), b.where("id % 2 = 1"), "image_id"), "iou")


# greedy matching by falling score: the free object of its class that a prediction overlaps most; then the curve's area
@query(f"""{_BOXES}, pr AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) k FROM bx WHERE id % 2 = 0), tr AS (SELECT * FROM bx WHERE id % 2 = 1), tn AS (SELECT image_id, count(*) n FROM tr GROUP BY 1),
    io AS (SELECT image_id, k, gt, h * w / (sa + sb - h * w) iou FROM (SELECT a.image_id, a.k, b.id gt, least(a.y2, b.y2) - greatest(a.y1, b.y1) h, least(a.x2, b.x2) - greatest(a.x1, b.x1) w, (a.y2 - a.y1) * (a.x2 - a.x1) sa, (b.y2 - b.y1) * (b.x2 - b.x1) sb
        FROM pr a JOIN tr b ON a.image_id = b.image_id AND a.class_id = b.class_id) WHERE h > 0 AND w > 0),
    th AS (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE t), ov AS (SELECT t, io.* FROM io JOIN th ON iou >= t), la AS (SELECT t, image_id, max(k) n FROM pr, th GROUP BY ALL),
    s(t, image_id, k, used) AS (SELECT t, image_id, 0::BIGINT, []::BIGINT[] FROM la UNION ALL
        SELECT s.t, s.image_id, s.k + 1, list_append(s.used, (SELECT arg_min(gt, (-iou, gt)) FROM ov WHERE ov.t = s.t AND ov.image_id = s.image_id AND ov.k = s.k + 1 AND NOT coalesce(list_contains(s.used, gt), false))) FROM s JOIN la ON la.t = s.t AND la.image_id = s.image_id AND s.k < la.n),
    hi AS (SELECT t, image_id, unnest(range(1, len(used) + 1)) k, (unnest(used) IS NOT NULL)::INT hit FROM (SELECT s.* FROM s JOIN la ON la.t = s.t AND la.image_id = s.image_id AND s.k = la.n)),
    tq AS (SELECT *, sum(hit) OVER (PARTITION BY t, image_id ORDER BY k) tp FROM hi), pc AS (SELECT *, max(tp / k) OVER (PARTITION BY t, image_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) p FROM tq)
    SELECT t threshold, image_id, round(sum(hit * p) / any_value(n), 6) ap, round(max(tp) / any_value(n), 6) recall FROM pc JOIN tn USING (image_id) GROUP BY t, image_id""".replace("WITH sg", "WITH RECURSIVE sg", 1))
def ap_curve(spark, d):
    b = cut(boxes(spark, d))
    p, t = b.where("id % 2 = 0"), b.where("id % 2 = 1")
    return rounded(V.average_precision_range(p, t, cut(V.box_overlaps(p, t, "image_id")), [0.1, 0.3, 0.5]), "ap", "recall")


@query(f"{_BOXES} SELECT id, image_id, round(y1 / 499.0, 6) y1, round(x1 / 499.0, 6) x1, round((y2 - 1) / 499.0, 6) y2, round((x2 - 1) / 499.0, 6) x2 FROM bx")
def normalised_boxes(spark, d):
    b = boxes(spark, d)
    out = V.norm_box([F.col(c) for c in ("y1", "x1", "y2", "x2")], F.lit(500), F.lit(500))
    return rounded(b.select("id", "image_id", *[c.alias(n) for c, n in zip(out, ("y1", "x1", "y2", "x2"))]), "y1", "x1", "y2", "x2")


@query("""WITH x AS (SELECT l_suppkey, l_quantity t, l_quantity * (1 + l_discount) + l_tax p0 FROM lineitem WHERE l_quantity > 1e-3 AND l_quantity < 80),
    r AS (SELECT l_suppkey, median(t) / median(p0) ratio FROM x GROUP BY 1), y AS (SELECT l_suppkey, t, greatest(1e-3, least(80.0::DOUBLE, p0 * ratio)) p, ratio FROM x JOIN r USING (l_suppkey))
    SELECT l_suppkey, round(max(ratio), 6) ratio, round(avg(abs(t - p) / t), 6) abs_rel, round(avg((t - p) * (t - p) / t), 6) sq_rel, round(sqrt(avg((t - p) * (t - p))), 6) rmse, round(sqrt(avg(pow(ln(t) - ln(p), 2))), 6) rmse_log,
    round(avg((greatest(t / p, p / t) < 1.25)::INT), 6) a1, round(avg((greatest(t / p, p / t) < 1.5625)::INT), 6) a2, round(avg((greatest(t / p, p / t) < 1.953125)::INT), 6) a3 FROM y GROUP BY 1""")
def depth_errors(spark, d):
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", F.col("l_quantity").alias("t"), (F.col("l_quantity") * (1 + F.col("l_discount")) + F.col("l_tax")).alias("p"))
    return rounded(V.depth_errors(x, "l_suppkey", "t", "p"), "ratio", "abs_rel", "sq_rel", "rmse", "rmse_log", "a1", "a2", "a3")


_ITEMS = "im AS (SELECT DISTINCT graph_id, 'n|' || label item FROM n UNION SELECT DISTINCT graph_id, 'e|' || subj || '|' || pos || '|' || \"ref\" FROM t), qs AS (SELECT graph_id q FROM g WHERE graph_id % 50 = 0)"
_RANKED = f"""WITH {BASE}, {_ITEMS}, sh AS (SELECT a.graph_id q, b.graph_id o, count(*) c FROM im a JOIN im b USING (item) WHERE a.graph_id % 50 = 0 AND a.graph_id <> b.graph_id GROUP BY ALL),
    rk AS (SELECT q, g.graph_id o, -coalesce(c, 0) distance, row_number() OVER (PARTITION BY q ORDER BY -coalesce(c, 0), g.graph_id)::INT - 1 place FROM qs JOIN g ON g.graph_id <> q LEFT JOIN sh USING (q, o))"""
_RANKED = _RANKED.replace("LEFT JOIN sh USING (q, o)", "LEFT JOIN sh ON sh.q = qs.q AND sh.o = g.graph_id").replace("SELECT q, g.graph_id o, -coalesce", "SELECT qs.q, g.graph_id o, -coalesce").replace("PARTITION BY q ORDER", "PARTITION BY qs.q ORDER")


def _ranked(spark, d):
    found = cut(R.delivered_features(*delivered(spark, d)))
    graphs, items = found.select("graph_id"), found.select("graph_id", F.explode("items").alias("item"))
    pairs = graphs.select("graph_id", (F.col("graph_id") + 2).alias("b")).where("graph_id % 50 = 0 or b % 50 = 0")
    return graphs.where("graph_id % 50 = 0"), graphs, items, R.symmetric_pairs(pairs, "graph_id", "b", graphs)


@query(f"{_RANKED} SELECT q query_id, o partner_id, distance, place FROM rk WHERE abs(o - q) = 2")
def retrieval_rank(spark, d):
    return R.ranks(*_ranked(spark, d))


@query(f"{_RANKED} SELECT round(avg(place), 6) mean_rank, count(*) n FROM rk WHERE abs(o - q) = 2")
def retrieval_mean_rank(spark, d):
    return rounded(R.mean_rank(retrieval_rank(spark, d)), "mean_rank")


@query(f"{_RANKED} SELECT q query_id, o graph_id, distance FROM rk WHERE place = 0")
def nearest_graph(spark, d):
    queries, graphs, items, _ = _ranked(spark, d)
    return R.nearest(queries, graphs, items)
