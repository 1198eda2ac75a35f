"""Queries of scene construction, masks, concepts, hierarchies, clustering and sampling with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.functions.terms import term
from graphweave.operators import classifier as ML
from graphweave.operators import cluster as L
from graphweave.operators import concepts as K
from graphweave.operators import scene as S
from graphweave.plans.collection import load
from graphweave.plans.graph_queries import rounded
from graphweave.plans.quality_queries import _SEG, segments
from graphweave.session import checkpoint_dir, cut

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# rasters made up from segments: the segments of an image cover, in order, bands of its columns
_RUNS = f"""WITH {_SEG}, rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY segment_id) k FROM sg),
    ru AS (SELECT image_id, x.x, k, segment_id, len FROM (SELECT *, (area % 3)::INT + 1 len FROM rk), (SELECT unnest(range(4)) x) x WHERE (segment_id + x.x) % 3 <> 0),
    rr AS (SELECT image_id, x, row_number() OVER (PARTITION BY image_id, x ORDER BY k) - 1 run, segment_id, sum(len) OVER (PARTITION BY image_id, x ORDER BY k) - len y0, len FROM ru)"""


def runs(spark, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = segments(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy("segment_id"))).withColumn("len", F.col("area") % 3 + 1)
    s = s.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(3)))).where((F.col("segment_id") + F.col("x")) % 3 != 0)
    w = Window.partitionBy("image_id", "x").orderBy("k")
    return s.select("image_id", "x", (F.row_number().over(w) - 1).alias("run"), "segment_id", (F.sum("len").over(w) - F.col("len")).alias("y0"), "len")


def _order(spark, d):
    return segments(spark, d).select("image_id", "segment_id", F.col("segment_id").alias("rank"))


# each segment has at most one run a column here, so a pair's word is of two symbols
@query(f"""{_RUNS}, p AS (SELECT a.image_id, a.segment_id i, b.segment_id j, b.run - a.run d FROM rr a JOIN rr b ON a.image_id = b.image_id AND a.x = b.x AND a.segment_id < b.segment_id)
    SELECT image_id, i, j, count(*) FILTER (d = 1) i_on_j, count(*) FILTER (d = -1) j_on_i, count(*) FILTER (d > 1) i_above_j, count(*) FILTER (d < -1) j_above_i FROM p GROUP BY ALL""")
def pair_positions(spark, d):
    out = S.pair_positions(cut(runs(spark, d)), _order(spark, d))
    return out.select("image_id", "i", "j", *[F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in S.COUNTERS[:4]])


@query(f"{_RUNS} SELECT image_id, segment_id, min(y0)::BIGINT y1, min(x)::INT x1, max(y0 + len)::BIGINT y2, (max(x) + 1)::INT x2 FROM rr GROUP BY ALL")
def bbox(spark, d):
    return S.boxes(runs(spark, d))


@query(f"{_RUNS} SELECT image_id, segment_id, trunc(sum(len * x) / sum(len))::INT cx, trunc(sum(len * (y0 + (len - 1) / 2)) / sum(len))::INT cy FROM rr GROUP BY ALL")
def barycentres(spark, d):
    return S.barycentre(runs(spark, d))


@query("SELECT l_suppkey, l_partkey, count(*) n, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::BIGINT ones FROM lineitem GROUP BY ALL")
def rle_roundtrip(spark, d):
    """Masks made up of lineitem, encoded and decoded again."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_partkey", F.xxhash64("*").alias("at"), (F.col("l_quantity") > 25).alias("v"))
    px = S.decode_mask(F.col("runs"))
    return S.encode_mask(x, ["l_suppkey", "l_partkey"], "at", "v").select("l_suppkey", "l_partkey", F.size(px).cast("bigint").alias("n"), F.aggregate(px, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("ones"))


@query("SELECT graph_id, node_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY graph_id * 100000000 + node_id) k FROM (SELECT DISTINCT graph_id, node_id, nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), '') label FROM nodes) WHERE label IS NOT NULL) WHERE k <= 5")
def balanced_sample(spark, d):
    n = load(spark, d).nodes.withColumn("at", F.col("graph_id") * 100000000 + F.col("node_id"))
    return ML.balanced_sample(n, "label", "at", 5).drop("at")


@query("SELECT nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), '') label, count(DISTINCT (graph_id, node_id)) n FROM nodes WHERE label IS NOT NULL GROUP BY 1 HAVING nullif(trim(regexp_replace(lower(any_value(label)), '[^a-z0-9]+', ' ', 'g')), '') IS NOT NULL")
def label_counts(spark, d):
    return ML.label_counts(load(spark, d).nodes, "label")


_CLASS = f"WITH {_SEG}, cm AS (SELECT category_id % 9 truth, (category_id + CASE WHEN segment_id % 5 = 0 THEN 1 ELSE 0 END) % 9 predicted, count(*) n FROM sg GROUP BY ALL)"


@query(f"""{_CLASS}, t AS (SELECT truth l, sum(n) t, sum(n) FILTER (truth = predicted) h FROM cm GROUP BY 1), p AS (SELECT predicted l, sum(n) p FROM cm GROUP BY 1)
    SELECT l label, round(h / p, 6) AS "precision", round(h / t, 6) recall, round(2 * (h / p) * (h / t) / (h / p + h / t), 6) f1 FROM t JOIN p USING (l)""")
def class_f1(spark, d):
    rows = segments(spark, d).select((F.col("category_id") % 9).alias("t"), ((F.col("category_id") + F.when(F.col("segment_id") % 5 == 0, 1).otherwise(0)) % 9).alias("p"))
    return rounded(ML.class_scores(ML.confusion_table(rows, "t", "p")), "precision", "recall", "f1")


#: Relations between concepts and places for the sample queries: rel, start, end, weight.
_EDGES = [
    ("AtLocation", "pedestrian", "street", 2.0), ("RelatedTo", "pedestrian", "street", 3.0), ("RelatedTo", "pavement", "street", 1.5), ("HasA", "street", "sign_post", 1.0),
    ("AtLocation", "rowboat", "harbour", 2.5), ("PartOf", "skyline", "city", 1.0), ("LocatedNear", "pedestrian", "city", 0.5), ("Antonym", "foliage", "city", 1.0),
    ("AtLocation", "kettle", "kitchen", 3.0), ("HasA", "kitchen", "table_top", 2.0), ("MadeOf", "kitchen", "wall_panel", 0.5), ("AtLocation", "tram", "city", 2.0), ("RelatedTo", "foliage", "park", 1.0), ("AtLocation", "pedestrian", "park", 1.0),
]
_PLACES = ["street", "harbour", "city", "kitchen", "park", "tram"]
_VALUES = f"""ed AS (SELECT rel, a, b, w::DOUBLE w FROM (VALUES {', '.join(map(str, _EDGES))}) v(rel, a, b, w)), pl AS (SELECT unnest({_PLACES}) place),
    cc AS (SELECT graph_id, replace(label, ' ', '_') concept FROM (SELECT DISTINCT graph_id, nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), '') label FROM nodes) WHERE label IS NOT NULL),
    rp AS (SELECT b place, a concept, rel, w FROM ed WHERE rel IN {K.TO_PLACE + ('Antonym',)} AND b IN (SELECT place FROM pl) UNION ALL SELECT a, b, rel, w FROM ed WHERE rel IN {K.FROM_PLACE + ('Antonym',)} AND a IN (SELECT place FROM pl))"""


def _concepts(spark, d):
    edges = spark.createDataFrame(_EDGES, "rel string, start string, end string, weight double")
    places = spark.createDataFrame([(p,) for p in _PLACES], "place string")
    concepts = load(spark, d).nodes.select("graph_id", K.class_concept(F.col("label"), {}).alias("concept")).distinct()
    return edges, concepts, places


@query(f"WITH {_VALUES} SELECT DISTINCT place, concept, rel, w weight FROM rp WHERE rel <> 'Antonym' AND concept IN (SELECT concept FROM cc)")
def related_places(spark, d):
    edges, concepts, places = _concepts(spark, d)
    return K.related_places(edges, concepts, places)


@query(f"""WITH {_VALUES}, m AS (SELECT graph_id, place, concept, max(w) FILTER (rel <> 'Antonym') w, bool_or(rel = 'Antonym') x FROM rp JOIN cc USING (concept) GROUP BY ALL),
    al AS (SELECT graph_id, place, w, x FROM m UNION ALL SELECT graph_id, concept, 1, false FROM cc WHERE concept IN (SELECT place FROM pl))
    SELECT graph_id, place, round(sum(w), 6) score FROM al GROUP BY ALL HAVING count(w) >= 2 AND NOT bool_or(x)""")
def place_rank(spark, d):
    edges, concepts, places = _concepts(spark, d)
    return rounded(K.rank_places(edges, concepts, places, ["graph_id"]), "score")


@query(f"""WITH {_VALUES}, k AS (SELECT graph_id, place, sum(w) score FROM (SELECT graph_id, place, concept, max(w) w FROM rp JOIN cc USING (concept) WHERE rel <> 'Antonym' GROUP BY ALL) GROUP BY ALL)
    SELECT place, round(sum(score) / (SELECT count(DISTINCT graph_id) FROM nodes), 6) mean_score FROM k GROUP BY place""")
def image_place_profile(spark, d):
    """Places of images from the places of one-label patterns."""
    edges, concepts, places = _concepts(spark, d)
    scores = K.related_places(edges, concepts, places).groupBy("place", "concept").agg(F.max("weight").alias("score"))
    cells = concepts.select("graph_id", F.col("concept").alias("pattern_id"), F.lit(1).alias("cnt"))
    matrix = K.image_places(cells, scores.withColumnRenamed("concept", "pattern_id"))
    return rounded(K.place_profile(matrix, load(spark, d).graphs), "mean_score")


_TEXTS = ["[[A kettle]] is on [[the table top]]", "*Something you find in [[a kitchen]] is [[a kettle]]", "You are likely to find [[a tram]] in [[the city]]", "nothing here"]


_FORMS = [("^\\[\\[(.+?)\\]\\] (?:is|are) (.+?) \\[\\[(.+?)\\]\\]", (1, 2, 3)), ("omething you find (.+?) \\[\\[(.+?)\\]\\] is \\[\\[(.+?)\\]\\]", (3, 1, 2)), ("ou are likely to find \\[\\[(.+?)\\]\\] (.+?) \\[\\[(.+?)\\]\\]", (1, 2, 3))]
_PARTS = [f"coalesce({', '.join(f"nullif(regexp_extract(t, '{x}', {at[k]}), '')" for x, at in _FORMS)}) {n}" for k, n in enumerate(("subj", "pos", "obj"))]


@query(f"SELECT t, {', '.join(_PARTS)} FROM (SELECT unnest({_TEXTS!r}) t)")
def surface_text(spark, d):
    x = spark.createDataFrame([(t,) for t in _TEXTS], "t string")
    return x.select("t", *[c.alias(n) for c, n in zip(K.surface_position(F.col("t")), ("subj", "pos", "obj"))])


_TREE = "tr AS (SELECT 'n' || n_nationkey child, 'r' || n_regionkey parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region)"


@query(f"WITH RECURSIVE {_TREE}, up(node, ancestor, distance) AS (SELECT child, parent, 1 FROM tr UNION ALL SELECT node, parent, distance + 1 FROM up JOIN tr ON child = ancestor) SELECT node, ancestor, distance FROM up")
def hierarchy(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("c"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("p"))
    r = spark.read.parquet(f"{d}/region.parquet").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("c"), F.lit("world").alias("p"))
    return K.ancestors(spark, n.unionByName(r), "c", "p")


def _embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", "label")


@query()
def kmedoids(spark, d):
    return rounded(L.kmedoids(_embeddings(spark, d), "vec_id", "embedding", 5), "distance")


@query()
def kmeans_profile(spark, d):
    return rounded(L.cluster_profile(L.kmeans(_embeddings(spark, d), "embedding", 6)[0], "embedding"), "total")


@query()
def kmeans_sweep(spark, d):
    return rounded(L.kmeans_sweep(_embeddings(spark, d), "embedding", [2, 6]), "cost", "silhouette")


@query()
def bow_hist(spark, d):
    x = _embeddings(spark, d)
    return rounded(L.bag_of_codes(x, "label", "embedding", L.kmeans(x, "embedding", 8)[1]), "share")


@query()
def svd(spark, d):
    return L.truncated_svd(_embeddings(spark, d), "vec_id", "embedding", 3).select("vec_id", *[F.round(F.col("reduced")[i], 6).alias(f"c{i}") for i in range(3)])


@query("""WITH n AS (SELECT DISTINCT graph_id, node_id, nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')), '') label FROM nodes),
    e AS (SELECT DISTINCT graph_id, s, r, nullif(trim(regexp_replace(lower(pos), '[^a-z0-9]+', ' ', 'g')), '') pos FROM edges)
    SELECT a.label subj, b.label ref, replace(pos, ' ', '-') pos, count(*) n FROM e JOIN n a ON a.graph_id = e.graph_id AND a.node_id = s JOIN n b ON b.graph_id = e.graph_id AND b.node_id = r
    WHERE pos IS NOT NULL AND a.label IS NOT NULL AND b.label IS NOT NULL GROUP BY ALL""")
def prs_streamed(spark, d):
    """The bins of the pairwise summary counted over edges read as a stream; each distinct edge counts.

    Deliveries may repeat at any time, so the state holds a hash of every edge; it is kept in RocksDB, which spills."""
    from graphweave.streaming import prs_stream

    nodes = load(spark, d).nodes
    schema = spark.read.parquet(f"{d}/edges.parquet").schema
    edges = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/edges.parquet*")
    edges = edges.select("graph_id", "s", "r", F.replace(term("pos"), F.lit(" "), F.lit("-")).alias("pos")).where(F.col("pos").isNotNull()).dropDuplicates()
    a = nodes.select("graph_id", F.col("node_id").alias("s"), F.col("label").alias("subj"))
    b = nodes.select("graph_id", F.col("node_id").alias("r"), F.col("label").alias("ref"))
    folder, name = f"{checkpoint_dir(spark)}/prs-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        prs_stream.start(edges.join(a, ["graph_id", "s"]).join(b, ["graph_id", "r"]), f"{folder}/table", f"{folder}/checkpoint", once=True).awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return prs_stream.latest(spark, f"{folder}/table").select("subj", "ref", "pos", "n")
