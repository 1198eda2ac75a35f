import random

from pyspark.sql import functions as F

from graphweave.model import Graphs
from graphweave.operators import panoptic, scene
from graphweave.plans import pipeline
from graphweave.plans.pipeline import Settings


def collection(spark):
    r = random.Random(1)
    nodes, edges = [], []
    for g in range(40):
        k = r.randint(1, 5)
        nodes += [(g, n, r.choice(["person", "sky", "sea", "kite"])) for n in range(k)]
        edges += [(g, a, r.choice(["on", "below", "below", "side-down"]), b) for a in range(k) for b in range(k) if a < b and r.random() < 0.6]
    return Graphs(spark.range(40).withColumnRenamed("id", "graph_id"), spark.createDataFrame(nodes, "graph_id bigint, node_id int, label string"), spark.createDataFrame(edges, "graph_id bigint, s int, pos string, r int"))


def test_run_is_kept_by_its_parameters(spark, tmp_path):
    g, s = collection(spark), Settings(minsup=0.1, max_edges=2, prs_minsup=1)
    first = pipeline.evaluate_run(g, s, [None, 3], str(tmp_path)).collect()
    again = pipeline.evaluate_run(g, s, [None, 3], str(tmp_path)).collect()
    assert first == again and first[1]["n_graphs"] == 3 and 0 < first[0]["coverage"] <= 1 and first[0]["coverage"] >= first[1]["coverage"]
    assert len(list(tmp_path.iterdir())) == 1
    assert Settings(minsup=0.1).key != Settings(minsup=0.1, coarse=True).key and len({x.key for x in pipeline.GRID}) == 13
    assert Settings(alg="subdue", nsubs=10, node_pruning=False).name == "sgs_eprune_subdue_10"


def test_other_summaries(spark):
    g, s = collection(spark), Settings(minsup=0.2, max_edges=1, prs_minsup=1)
    images = pipeline.image_summary(g, s)
    assert images.graphs.count() > 0 and images.nodes.count() >= 2
    chosen = pipeline.medoid_graphs(g, spark.createDataFrame([(3,), (3,), (5,)], "medoid bigint"))
    p = pipeline.as_patterns(chosen)
    assert p.patterns.count() == 2 and p.nodes.count() == g.nodes.where("graph_id in (3, 5)").count()
    rows = pipeline.grid(g, (s, Settings(alg="subdue", nsubs=2, max_edges=1, prs_minsup=1)))
    assert rows.count() == 2


def test_segment_ids_are_distinct(spark):
    seg = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 2, 8), (1, 3, 7), (2, 0, 8)], "image_id int, ord int, category_id int")
    cat = spark.createDataFrame([(7, [10, 0, 0]), (8, [11, 0, 0])], "id int, color array<int>")
    rows = panoptic.assign_ids(seg, cat).collect()
    assert len({(x["image_id"], x["segment_id"]) for x in rows}) == 5 and {x["segment_id"] for x in rows if x["image_id"] == 2} == {11}
    assert {x["ord"]: x["segment_id"] for x in rows if x["image_id"] == 1} == {0: 10, 1: 11, 3: 12, 2: 13}


def test_depth_runs(spark):
    px = [(1, 0, y, 5 if y < 20 else 7, float(y)) for y in range(30)]
    df = spark.createDataFrame(px, "image_id int, x int, y int, segment_id int, depth double")
    runs = scene.column_runs_depth(df).orderBy("run").collect()
    assert [(x["len"], round(x["depth_first"] * 255, 6), round(x["depth_last"] * 255, 6)) for x in runs] == [(20, 0.5, 18.5), (10, 20.0, 29.0)]
    order = spark.createDataFrame([(1, 5, 1), (1, 7, 2)], "image_id int, segment_id int, rank int")
    x = scene.touch_depth(scene.column_runs_depth(df), order).first()
    assert (x["i"], x["j"], x["touches"]) == (5, 7, 1) and round(x["touch_gap"] * 255, 6) == 1.5


def test_plans_stay_in_the_engine(spark):
    from graphweave.operators import prs, prune

    g = collection(spark)
    p = prs.build(g.triples())
    for df in (p, prs.likelihood(g.triples(), p), prune.edge_pruning(g, p).nodes, prune.node_pruning(g).edges):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
    assert p.where(F.col("likelihood") > 1).count() == 0
    total = p.groupBy("subj", "ref").agg(F.sum("likelihood").alias("s"), F.max("entropy").alias("e"), F.count(F.lit(1)).alias("k"))
    assert total.where((F.abs(F.col("s") - 1) > 1e-9) | (F.col("e") < 0) | (F.col("e") > F.log2(F.col("k").cast("double")) + 1e-9)).count() == 0
