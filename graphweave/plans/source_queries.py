"""Round trips through the sources and sinks, and the operators on scenes, rasters and classifiers that they feed, with their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.terms import term
from graphweave.model import flatten_graphs, nest
from graphweave.operators import classifier as ML
from graphweave.operators import concepts as K
from graphweave.operators import evaluate as E
from graphweave.operators import matching as C
from graphweave.operators import metrics as V
from graphweave.operators import panoptic as Q
from graphweave.operators import prs as P
from graphweave.operators import prune as G
from graphweave.operators import scene as S
from graphweave.plans.collection import load
from graphweave.plans.graph_queries import BASE, rounded
from graphweave.plans.quality_queries import _BOXES, _SEG, boxes, segments
from graphweave.plans.scene_queries import _RUNS, runs
from graphweave.session import checkpoint_dir, cut
from graphweave.sources import graphs as FG
from graphweave.sources import images as FI
from graphweave.sources import relations as FR

QUERIES: dict = {}
ORACLE: dict = {}
#: Elements of a written JSON document that holds a list.
LIST_ROWS = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{checkpoint_dir(spark)}/io-{uuid.uuid4().hex}"


def _documents(rows: DataFrame, item: Column, field: str, key: str, path: str) -> None:
    """JSON documents {field: [items]} of about LIST_ROWS items, a file each."""
    parts = max(1, -(-rows.count() // LIST_ROWS))
    lists = rows.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"), item.alias("x")).groupBy("part").agg(F.collect_list("x").alias(field))
    lists.select("part", F.to_json(F.struct(field)).alias("value")).write.partitionBy("part").text(path)


# graph collections

_GRAPH_ROWS = "SELECT graph_id, 'node' kind, node_id::BIGINT a, NULL::BIGINT b, label FROM n UNION ALL SELECT graph_id, 'edge', s, r, pos FROM e"


def _graph_rows(g) -> DataFrame:
    a, b = F.lit("node").alias("kind"), F.lit(None).cast("bigint").alias("b")
    nodes = g.nodes.select("graph_id", a, F.col("node_id").cast("bigint").alias("a"), b, "label")
    return nodes.unionByName(g.edges.select("graph_id", F.lit("edge").alias("kind"), F.col("s").cast("bigint").alias("a"), F.col("r").cast("bigint").alias("b"), F.col("pos").alias("label")))


@query(f"WITH {BASE} {_GRAPH_ROWS}")
def graphs_round_trip(spark, d):
    path = _folder(spark)
    FG.write_graphs(load(spark, d), path)
    return _graph_rows(FG.read_graphs(spark, path, lines=True))


@query(f"WITH {BASE} SELECT graph_id, (SELECT count(*) FROM n WHERE n.graph_id = g.graph_id) nodes, (SELECT count(*) FROM e WHERE e.graph_id = g.graph_id) links FROM g")
def nested_form(spark, d):
    """The nested form has every graph, those without nodes and links too."""
    return nest(load(spark, d)).select(F.col("graph.name").alias("graph_id"), F.size("nodes").cast("bigint").alias("nodes"), F.size("links").cast("bigint").alias("links"))


@query(f"WITH {BASE} {_GRAPH_ROWS}")
def flat_form(spark, d):
    return _graph_rows(flatten_graphs(nest(load(spark, d))))


_MINER = f"""{BASE}, cd AS (SELECT name, row_number() OVER (ORDER BY name) + 1 code FROM (SELECT label AS name FROM n UNION SELECT pos FROM e)),
    ed AS (SELECT * FROM e WHERE s <> r), v AS (SELECT graph_id, node_id, label, row_number() OVER (PARTITION BY graph_id ORDER BY node_id) - 1 v FROM n WHERE graph_id IN (SELECT graph_id FROM ed))"""


@query(f"""WITH {_MINER}, a AS (SELECT graph_id, string_agg('v ' || v || ' ' || code, chr(10) ORDER BY v) t FROM v JOIN cd ON name = label GROUP BY 1),
    b AS (SELECT ed.graph_id, string_agg('e ' || x.v || ' ' || y.v || ' ' || code, chr(10) ORDER BY 'e ' || x.v || ' ' || y.v || ' ' || code) t FROM ed JOIN v x ON x.graph_id = ed.graph_id AND x.node_id = s JOIN v y ON y.graph_id = ed.graph_id AND y.node_id = r JOIN cd ON name = pos GROUP BY 1)
    SELECT graph_id, md5('t # ' || graph_id || chr(10) || a.t || chr(10) || b.t) digest FROM a JOIN b USING (graph_id)""")
def miner_blocks(spark, d):
    return FG.miner_text(load(spark, d)).select("graph_id", F.md5("block").alias("digest"))


def _parsed(spark, d):
    g = load(spark, d)
    text = FG.miner_text(g).select(F.col("graph_id").cast("string").alias("file"), F.posexplode(F.split("block", "\n")).alias("no", "line"))
    return FG.parse_miner_text(text, FG.label_codes(g))


@query(f"WITH {_MINER} SELECT graph_id, v::INT node, label FROM v")
def miner_nodes(spark, d):
    return _parsed(spark, d)[1].select(F.col("pattern.file").cast("bigint").alias("graph_id"), "node", "label")


@query(f"WITH {_MINER} SELECT ed.graph_id, x.v::INT s, pos, y.v::INT r FROM ed JOIN v x ON x.graph_id = ed.graph_id AND x.node_id = s JOIN v y ON y.graph_id = ed.graph_id AND y.node_id = r")
def miner_edges(spark, d):
    return _parsed(spark, d)[2].select(F.col("pattern.file").cast("bigint").alias("graph_id"), "s", "pos", "r")


@query(f"WITH {BASE} SELECT subj, ref, pos, n, sup, round(likelihood, 6) likelihood, round(entropy, 6) + 0.0 entropy FROM prs")
def prs_round_trip(spark, d):
    path = _folder(spark)
    FG.write_prs(P.build(load(spark, d).triples()), path)
    return rounded(FG.read_prs(spark, path), "likelihood", "entropy")


_NAMES = ("above", "below", "side", "on", "inside")


@query(f"WITH {BASE} SELECT graph_id, pos pattern_id, count(*)::DOUBLE n FROM e WHERE pos IN {_NAMES} GROUP BY ALL")
def matrix_round_trip(spark, d):
    """Counts of positions a graph as a wide table, written, read and made long again."""
    cells = load(spark, d).edges.where(F.col("pos").isin(*_NAMES)).groupBy("graph_id", F.col("pos").alias("pattern_id")).agg(F.count(F.lit(1)).alias("n"))
    path = _folder(spark)
    FG.write_matrix(C.wide(cells, "n", list(_NAMES)), path)
    return C.long(FG.read_matrix(spark, path, list(_NAMES)), "n")


@query(f"WITH {BASE} SELECT label, 2 * count(*) rows FROM n GROUP BY label")
def appended_table(spark, d):
    """A table that two runs added their rows to."""
    path = _folder(spark)
    for _ in range(2):
        FG.append_csv(load(spark, d).nodes, path)
    rows = spark.read.schema("graph_id bigint, node_id int, label string").option("sep", ";").option("header", True).csv(path)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


# annotations, categories, captions, names

_RAW = "(SELECT DISTINCT image_id, x.id segment_id, x.category_id, x.area, x.iscrowd FROM (SELECT image_id, unnest(segments_info) x FROM panoptic))"


def _annotations(spark, d):
    rows = spark.read.parquet(f"{d}/panoptic.parquet").select("image_id", "file_name", "segments_info")
    path = _folder(spark)
    _documents(rows, F.struct("image_id", "file_name", "segments_info"), "annotations", "image_id", path)
    return FI.read_panoptic(spark, f"{path}/*/*.txt", FI.read_category_info(spark, _category_info(spark, d)))


def _category_info(spark, d) -> str:
    path = _folder(spark)
    spark.read.parquet(f"{d}/categories.parquet").write.json(path)
    return path


@query(f"SELECT * FROM {_RAW}")
def panoptic_file(spark, d):
    return _annotations(spark, d)[1].distinct()


@query("SELECT id, name, supercategory, isthing, array_to_string(color, ',') color FROM categories")
def panoptic_categories(spark, d):
    """Annotations without categories of their own take those of the fallback."""
    path = _folder(spark)
    spark.read.parquet(f"{d}/categories.parquet").coalesce(1).select(F.to_json(F.struct("*")).alias("value")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("value")), ","), F.lit("]"))).write.text(path)  # a fixed table
    fallback = FI.read_category_info(spark, path)
    rows = spark.read.parquet(f"{d}/panoptic.parquet").limit(0)
    notes = _folder(spark)
    spark.createDataFrame([('{"annotations": []}',)], "value string").unionByName(rows.select(F.col("file_name").alias("value"))).coalesce(1).write.text(notes)
    found = FI.read_panoptic(spark, notes, fallback)[2]
    return found.select("id", "name", "supercategory", "isthing", F.array_join(F.col("color").cast("array<string>"), ",").alias("color"))


@query("SELECT id, trim(name) AS name FROM categories")
def category_list(spark, d):
    path = _folder(spark)
    spark.read.parquet(f"{d}/categories.parquet").select(F.concat(F.col("id").cast("string"), F.lit(": "), "name").alias("value")).write.text(path)
    return FI.read_category_list(spark, path)


@query("SELECT trim(name) source, unnest([trim(supercategory), 'any']) target FROM categories")
def class_map_file(spark, d):
    path = _folder(spark)
    spark.read.parquet(f"{d}/categories.parquet").select(F.concat("name", F.lit(": "), "supercategory", F.lit(", any")).alias("value")).write.text(path)
    return FI.read_class_map(spark, path)


@query(f"WITH {BASE} SELECT graph_id image_id, label caption FROM n WHERE graph_id IN (SELECT image_id FROM panoptic)")
def captions_file(spark, d):
    """Labels as captions of the images that have an annotation."""
    rows = load(spark, d).nodes.select(F.col("graph_id").alias("image_id"), F.col("label").alias("caption"))
    path = _folder(spark)
    _documents(rows, F.struct("image_id", "caption"), "annotations", "caption", path)
    return FI.read_captions(spark, [f"{path}/*/*.txt"], spark.read.parquet(f"{d}/panoptic.parquet").select("image_id"))


@query("SELECT DISTINCT file_name, try_cast(nullif(regexp_extract(file_name, '([0-9]+)[.][A-Za-z]+$', 1), '') AS BIGINT) id, lpad(image_id::VARCHAR, 12, '0') || '.jpg' photo FROM panoptic WHERE image_id IS NOT NULL")
def file_names(spark, d):
    rows = spark.read.parquet(f"{d}/panoptic.parquet").where(F.col("image_id").isNotNull())
    return rows.select("file_name", FI.image_id(F.col("file_name")).alias("id"), FI.image_name(F.col("image_id")).alias("photo")).distinct()


@query("SELECT DISTINCT regexp_replace(trim(file_name), '[.][A-Za-z]+$', '') AS name FROM panoptic WHERE trim(file_name) <> ''")
def split_file(spark, d):
    path = _folder(spark)
    names = spark.read.parquet(f"{d}/panoptic.parquet").select(F.col("file_name").alias("value")).where(F.col("value").isNotNull()).distinct()
    names.write.text(f"{path}/train.txt")
    return FI.read_split(spark, path, "train")


@query("SELECT DISTINCT graph_id FROM nodes WHERE graph_id NOT IN (SELECT image_id FROM panoptic WHERE image_id IS NOT NULL)")
def unfinished(spark, d):
    """Graphs whose image has no annotation yet."""
    done = spark.read.parquet(f"{d}/panoptic.parquet").select(F.col("image_id").alias("graph_id"))
    return FI.remaining(load(spark, d).graphs, done, "graph_id")


@query("SELECT DISTINCT regexp_replace(trim(name), ' ', '_', 'g') || '.bin' AS name FROM categories")
def listed_files(spark, d):
    """A file a category, listed without being read."""
    path = _folder(spark)
    names = spark.read.parquet(f"{d}/categories.parquet").select(F.translate(F.trim("name"), " ", "_").alias("name")).distinct()
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for r in names.collect():  # a fixed table
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{r['name']}.bin"))
        out.writeByte(1)
        out.close()
    return FI.list_files(spark, path, "*.bin").select(F.url_decode("name").alias("name"))


_CLASSES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


@query(f"WITH {_SEG} SELECT image_id, segment_id, category_id FROM sg WHERE category_id IN {tuple(_CLASSES)}")
def class_annotations(spark, d):
    return FI.annotations_of(segments(spark, d).select("image_id", "segment_id", "category_id"), _CLASSES)


@query(f"WITH {BASE}, c AS (SELECT 'a' source, id, name FROM categories UNION SELECT 'b', n_nationkey, n_name FROM nation) SELECT source, id, name, split_part(name, ',', 1) short, row_number() OVER (ORDER BY source, id)::INT class_id FROM c")
def class_registry(spark, d):
    c = spark.read.parquet(f"{d}/categories.parquet").select(F.lit("a").alias("source"), F.col("id").cast("bigint").alias("id"), "name")
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.lit("b").alias("source"), F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    return FI.class_registry(c.unionByName(n))


@query(f"""WITH {BASE}, x AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY s, r) - 1 k FROM t),
    o AS (SELECT graph_id, s v, 2 * k k, subj label FROM x UNION ALL SELECT graph_id, r, 2 * k + 1, "ref" FROM x), fi AS (SELECT graph_id, v, min(k) k, arg_min(label, k) label FROM o GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY k)::INT - 1 node_id FROM fi)
    SELECT graph_id, node_id::BIGINT a, NULL::BIGINT b, label FROM m UNION ALL SELECT x.graph_id, p.node_id, q.node_id, pos FROM x JOIN m p ON p.graph_id = x.graph_id AND p.v = s JOIN m q ON q.graph_id = x.graph_id AND q.v = r""")
def relationship_graphs(spark, d):
    """Graphs built again from their relations, boxes standing for nodes."""
    box = lambda c: F.array(*[F.col(c).cast("int")] * 4)
    one = F.struct(F.struct(box("s").alias("bbox"), F.col("subj").alias("category")).alias("subject"), F.struct(box("r").alias("bbox"), F.col("ref").alias("category")).alias("object"), F.col("pos").alias("predicate"))
    lists = load(spark, d).triples().groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("s", "r", one.alias("x")))).alias("l"))
    g = FR.relationship_graphs(lists.select("graph_id", F.transform("l", lambda x: x["x"]).alias("relationships")))
    return _graph_rows(g).drop("kind")


@query("""WITH f AS (SELECT DISTINCT file_name a, image_id FROM panoptic WHERE image_id IS NOT NULL)
    SELECT DISTINCT try_cast(nullif(regexp_extract(a, '([0-9]+)[.][A-Za-z]+$', 1), '') AS BIGINT) a, image_id + 1 b FROM f WHERE nullif(regexp_extract(a, '([0-9]+)[.][A-Za-z]+$', 1), '') IS NOT NULL""")
def offered_pairs(spark, d):
    rows = spark.read.parquet(f"{d}/panoptic.parquet").where(F.col("image_id").isNotNull())
    both = F.array(F.struct(F.col("file_name").alias("image_filename")), F.struct(FI.image_name(F.col("image_id") + 1, "png").alias("image_filename")))
    return FR.candidate_pairs(rows.select(both.alias("image_candidates"))).distinct()


# relation triples: what the collection says about its labels, as a file of triples

_FACTS = f"""{BASE}, fa AS (SELECT replace(subj, ' ', '_') a, CASE pos WHEN 'inside' THEN 'AtLocation' WHEN 'on' THEN 'LocatedNear' WHEN 'around' THEN 'IsA' ELSE 'RelatedTo' END rel, replace("ref", ' ', '_') b, count(*)::DOUBLE w FROM t GROUP BY ALL)"""


def _facts(spark, d):
    rel = F.when(F.col("pos") == "inside", "AtLocation").when(F.col("pos") == "on", "LocatedNear").when(F.col("pos") == "around", "IsA").otherwise("RelatedTo")
    name = lambda c: K.class_concept(F.col(c), {})
    rows = load(spark, d).triples().groupBy(name("subj").alias("a"), rel.alias("rel"), name("ref").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    uri = lambda c: F.concat(F.lit("/c/en/"), F.col(c))
    info = F.to_json(F.struct(F.col("w").cast("double").alias("weight"), F.concat(F.lit("[["), "a", F.lit("]] is in [["), "b", F.lit("]]")).alias("surfaceText")))
    written = rows.select(F.concat_ws("/", F.lit("/a"), "rel", "a", "b").alias("uri"), F.concat(F.lit("/r/"), "rel").alias("rel"), uri("a").alias("start"), uri("b").alias("end"), info.alias("info"))
    foreign = written.limit(1).select("uri", "rel", F.lit("/c/fr/chien").alias("start"), "end", "info")
    path = _folder(spark)
    FR.write_triples(written.unionByName(foreign), path)
    return K.named(K.english(FR.read_triples(spark, path)))


@query(f"WITH {_FACTS} SELECT rel, a AS start, b AS \"end\", w weight, '[[' || a || ']] is in [[' || b || ']]' surface FROM fa")
def triples_round_trip(spark, d):
    return _facts(spark, d)


@query(f"WITH {_FACTS} SELECT rel, a AS start, b AS \"end\", w weight FROM fa WHERE rel IN ('AtLocation', 'LocatedNear', 'IsA') AND a IN (SELECT name FROM categories) AND b IN (SELECT name FROM categories)")
def facts_of_classes(spark, d):
    classes = spark.read.parquet(f"{d}/categories.parquet").select(F.col("name").alias("concept"))
    rows = K.both_in(K.meaningful(_facts(spark, d), ("AtLocation", "LocatedNear", "IsA")), classes)
    return rows.select("rel", "start", "end", "weight")


@query(f"WITH {_FACTS} SELECT rel, a AS start, b AS \"end\", w weight FROM fa WHERE (a = 'kettle' OR b = 'kettle') AND rel <> 'Antonym'")
def facts_of_a_concept(spark, d):
    return K.related(_facts(spark, d), "kettle").select("rel", "start", "end", "weight")


@query(f"""WITH {_FACTS}, ok AS (SELECT unnest([a, b]) place, rel, unnest([false, true]) is_end FROM fa),
    c AS (SELECT b place, count(*) n, bool_or(rel = 'IsA') isa FROM fa WHERE contains(b, 'ta') GROUP BY 1)
    SELECT place, n AS links FROM c WHERE (n > 1 OR isa) AND NOT regexp_matches(place, '[0-9''"]')""")
def place_names(spark, d):
    """Names of places by a syllable, as the rule takes those with 'place' in them."""
    return K.place_names(_facts(spark, d), "ta")


# rasters and scenes


@query(f"""{_RUNS}, x AS (SELECT *, sum(CASE WHEN segment_id = lag_id THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, x ORDER BY run) g FROM (SELECT *, lag(segment_id) OVER (PARTITION BY image_id, x ORDER BY run) lag_id FROM rr))
    SELECT image_id, x, g::BIGINT - 1 run, segment_id, min(y0)::BIGINT y0, sum(len)::BIGINT len FROM x GROUP BY image_id, x, g, segment_id""")
def runs_of_pixels(spark, d):
    r = runs(spark, d)
    px = r.select("image_id", "x", "segment_id", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("len") - 1)).alias("y"))
    return S.column_runs(px).select("image_id", "x", F.col("run").cast("bigint").alias("run"), "segment_id", "y0", "len")


@query(f"{_RUNS} SELECT image_id, x, segment_id, y0::BIGINT y0, len::BIGINT len FROM rr")
def png_round_trip(spark, d):
    """Each image's runs drawn into an id map, encoded as PNG and read back."""
    r = runs(spark, d)

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        ids = np.zeros((int((pdf["y0"] + pdf["len"]).max()), 4), np.int64)
        for x, y, n, s in zip(pdf["x"], pdf["y0"], pdf["len"], pdf["segment_id"]):
            ids[int(y) : int(y + n), int(x)] = s
        return pd.DataFrame({"image_id": [key[0]], "content": [FI.encode_png(np.stack([ids & 255, (ids >> 8) & 255, ids >> 16], axis=2))]})

    files = r.select("image_id", "x", "y0", "len", "segment_id").groupBy("image_id").applyInPandas(draw, "image_id bigint, content binary")
    return FI.raster_runs(files).where(F.col("segment_id") != 0).select("image_id", F.col("x").cast("int").alias("x"), F.col("segment_id").cast("int").alias("segment_id"), "y0", "len")


_DEPTH = f"""{_RUNS}, px AS (SELECT image_id, x, segment_id, run, y0 + k y, (segment_id + (y0 + k) * 7) % 256 depth, k, len FROM rr, unnest(range(len)) u(k)),
    dr AS (SELECT image_id, x, run, segment_id, avg(depth) FILTER (k < greatest(1, floor(len * 0.5))) / 255 depth_first, avg(depth) FILTER (k >= len - greatest(1, floor(len * 0.5))) / 255 depth_last FROM px GROUP BY ALL)"""


def _depth_runs(spark, d):
    r = runs(spark, d)
    px = r.select("image_id", "x", "segment_id", F.explode(F.sequence(F.col("y0"), F.col("y0") + F.col("len") - 1)).alias("y"))
    return S.column_runs_depth(px.withColumn("depth", (F.col("segment_id") + F.col("y") * 7) % 256), 0.5)


@query(f"{_DEPTH} SELECT image_id, x, segment_id, round(depth_first, 6) depth_first, round(depth_last, 6) depth_last FROM dr")
def depth_runs(spark, d):
    return rounded(_depth_runs(spark, d).select("image_id", "x", "segment_id", "depth_first", "depth_last"), "depth_first", "depth_last")


@query(f"""{_DEPTH}, p AS (SELECT a.image_id, least(a.segment_id, b.segment_id) i, greatest(a.segment_id, b.segment_id) j, abs(a.depth_last - b.depth_first) g FROM dr a JOIN dr b ON a.image_id = b.image_id AND a.x = b.x AND b.run = a.run + 1)
    SELECT image_id, i, j, count(*) touches, round(avg(g), 6) touch_gap FROM p GROUP BY ALL""")
def touch_depth(spark, d):
    order = segments(spark, d).select("image_id", "segment_id", F.col("segment_id").alias("rank"))
    return rounded(S.touch_depth(cut(_depth_runs(spark, d)), order), "touch_gap")


@query(f"WITH {_SEG} SELECT image_id, segment_id, name AS label, row_number() OVER (PARTITION BY image_id ORDER BY name, segment_id)::INT rank FROM sg JOIN categories ON id = category_id")
def segment_ranks(spark, d):
    return S.segment_order(segments(spark, d), spark.read.parquet(f"{d}/categories.parquet"))


# columns of a pair, its boxes and the features that follow; words are of two symbols as each segment has one run a column at most
_FEATURES = f"""{_RUNS}, bb AS (SELECT image_id, segment_id, min(y0) y1, min(x) x1, max(y0 + len) y2, max(x) + 1 x2 FROM rr GROUP BY ALL),
    rn AS (SELECT image_id, segment_id, name AS label, row_number() OVER (PARTITION BY image_id ORDER BY name, segment_id) k FROM sg JOIN categories ON id = category_id),
    pr AS (SELECT a.image_id, a.segment_id i, b.segment_id j, row_number() OVER (PARTITION BY a.image_id, a.x, a.segment_id ORDER BY b.run) z, b.run > a.run down,
            abs((SELECT count(*) FROM rr c JOIN rn USING (image_id, segment_id) WHERE c.image_id = a.image_id AND c.x = a.x AND c.run > least(a.run, b.run) AND c.run < greatest(a.run, b.run))) between_known, abs(b.run - a.run) apart
        FROM rr a JOIN rr b ON a.image_id = b.image_id AND a.x = b.x JOIN rn p ON p.image_id = a.image_id AND p.segment_id = a.segment_id JOIN rn q ON q.image_id = a.image_id AND q.segment_id = b.segment_id AND p.k < q.k),
    ct AS (SELECT image_id, i, j, count(*) FILTER (down AND apart = 1) a1, count(*) FILTER (NOT down AND apart = 1) a2, count(*) FILTER (down AND apart > 1) a3, count(*) FILTER (NOT down AND apart > 1) a4 FROM pr GROUP BY ALL),
    ft AS (SELECT ct.image_id, i, j, a1 / w a1, a2 / w a2, a3 / w a3, a4 / w a4, coalesce(dy1 / nullif(greatest(abs(dy1), abs(dy2)), 0), 0) dy1, coalesce(dy2 / nullif(greatest(abs(dy1), abs(dy2)), 0), 0) dy2,
            coalesce(dx1 / nullif(greatest(abs(dx1), abs(dx2)), 0), 0) dx1, coalesce(dx2 / nullif(greatest(abs(dx1), abs(dx2)), 0), 0) dx2
        FROM (SELECT ct.*, least(p.x2 - p.x1, q.x2 - q.x1) w, p.y1 - q.y1 dy1, p.y2 - q.y2 dy2, p.x1 - q.x1 dx1, p.x2 - q.x2 dx2 FROM ct JOIN bb p ON p.image_id = ct.image_id AND p.segment_id = i JOIN bb q ON q.image_id = ct.image_id AND q.segment_id = j) ct)"""


def _features(spark, d):
    r = cut(runs(spark, d))
    order = S.segment_order(segments(spark, d), spark.read.parquet(f"{d}/categories.parquet"))
    return r, order, S.pair_features(S.pair_positions(r, order.select("image_id", "segment_id", "rank")), S.boxes(r))


_SHOWN = {"i on j": "a1", "j on i": "a2", "i above j": "a3", "j above i": "a4", "deltaY1": "dy1", "deltaY2": "dy2", "deltaX1": "dx1", "deltaX2": "dx2"}


@query(f"{_FEATURES} SELECT image_id, i, j, {', '.join(f'round({c}, 6) + 0.0 {c}' for c in _SHOWN.values())} FROM ft")
def position_features(spark, d):
    out = _features(spark, d)[2]
    return rounded(out.select("image_id", "i", "j", *[F.col(f"`{c}`").alias(n) for c, n in _SHOWN.items()]), *_SHOWN.values())


def _by_rule(features: DataFrame) -> DataFrame:
    f = lambda c: F.col(f"`{c}`")
    pos = F.when(f("i on j") > 0.5, "on").when(f("i above j") > 0.5, "above").when(f("j above i") > 0.5, "below").when(f("deltaY1") > 0, "side-down").otherwise("side")
    return features.withColumn("pos", pos)


@query(f"{_FEATURES} SELECT image_id graph_id, i s, CASE WHEN a1 > 0.5 THEN 'on' WHEN a3 > 0.5 THEN 'above' WHEN a4 > 0.5 THEN 'below' WHEN dy1 > 0 THEN 'side-down' ELSE 'side' END pos, j r FROM ft")
def scene_graph_edges(spark, d):
    """Scene graphs from rasters, positions by a plain rule in place of a fitted model."""
    return S.scene_graphs(cut(runs(spark, d)), segments(spark, d), spark.read.parquet(f"{d}/categories.parquet"), _by_rule)[1]


@query(f"WITH {_SEG} SELECT image_id graph_id, segment_id node_id, name AS label FROM sg JOIN categories ON id = category_id")
def scene_graph_nodes(spark, d):
    return S.scene_graphs(cut(runs(spark, d)), segments(spark, d), spark.read.parquet(f"{d}/categories.parquet"), _by_rule)[0]


@query(f"{_FEATURES} SELECT image_id, i, j FROM ft WHERE round(a1 + a2 + a3 + a4, 9) <= 0.5")
def side_pairs(spark, d):
    f = _features(spark, d)[2]
    six = [F.round(F.col(f"`{c}`"), 9).alias(c) for c in S.COUNTERS[:6]]
    return ML.side_only(f.select("image_id", "i", "j", *six), list(S.COUNTERS[:6]), 0.5).select("image_id", "i", "j")


@query(f"{_FEATURES} SELECT image_id, i, j, CASE WHEN i % 3 = 0 THEN 'changed' ELSE 'kept' END label FROM ft WHERE i % 5 <> 0")
def relabelled(spark, d):
    """Labels of pairs changed or, where the new label is null, taken out."""
    rows = cut(_features(spark, d)[2].select("image_id", "i", "j", F.lit("kept").alias("label")))
    changes = rows.where("i % 3 = 0 OR i % 5 = 0").select("image_id", "i", "j", F.when(F.col("i") % 5 != 0, "changed").alias("new"))
    return ML.relabel(rows, changes, ["image_id", "i", "j"], "label")


@query(f"{_FEATURES} SELECT image_id, i, j, round(dy1, 6) + 0.0 dy1 FROM ft WHERE (i + j) % 4 = 0")
def features_of_labelled(spark, d):
    """Features worked out again for the labelled pairs alone."""
    r, order, f = _features(spark, d)
    labelled = cut(f.where("(i + j) % 4 = 0").select("image_id", "i", "j"))
    out = S.recomputed_features(r, order, labelled)
    return rounded(out.select("image_id", "i", "j", F.col("deltaY1").alias("dy1")), "dy1")


@query(f"WITH {_SEG}, f AS (SELECT image_id, count(*) n FROM sg WHERE image_id NOT IN (SELECT graph_id FROM nodes WHERE lower(trim(label)) = 'kettle') GROUP BY 1 ORDER BY 1 LIMIT 25) SELECT image_id, 1 AS pairs, true AS own FROM f")
def fresh_images(spark, d):
    """One pair of each of the first 25 images that aren't known: any pair is right, so what is shown is that it is the image's own."""
    s = segments(spark, d)
    pairs = s.select("image_id", F.col("segment_id").alias("i"), (F.col("segment_id") + 1).alias("j"))
    known = spark.read.parquet(f"{d}/nodes.parquet").where(F.lower(F.trim("label")) == "kettle").select(F.col("graph_id").alias("image_id"))
    out = ML.new_images(pairs, known, 25).join(s.select("image_id", F.col("segment_id").alias("i"), F.lit(True).alias("own")), ["image_id", "i"], "left")
    return out.groupBy("image_id").agg(F.count(F.lit(1)).cast("int").alias("pairs"), F.bool_and(F.coalesce("own", F.lit(False))).alias("own"))


_SAMPLE = f"""WITH {_SEG}, fe AS (SELECT image_id * 100000000 + segment_id AS key, (area % 97)::DOUBLE x, (segment_id % 89)::DOUBLE y, category_id % 4 AS label, row_number() OVER (PARTITION BY category_id % 4 ORDER BY image_id * 100000000 + segment_id) k FROM sg),
    sm AS (SELECT * FROM fe WHERE k <= 60)"""


def _labelled(spark, d):
    s = segments(spark, d)
    rows = s.select((F.col("image_id") * 100000000 + F.col("segment_id")).alias("key"), (F.col("area") % 97).cast("double").alias("x"), (F.col("segment_id") % 89).cast("double").alias("y"), (F.col("category_id") % 4).alias("label"))
    return rows, ML.balanced_sample(rows, "label", "key")


@query(f"{_SAMPLE} SELECT key, label FROM sm")
def labelled_sample(spark, d):
    return _labelled(spark, d)[1].select("key", "label")


@query(f"""{_SAMPLE}, nb AS (SELECT a.key, b.label, row_number() OVER (PARTITION BY a.key ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.key) p FROM sm a JOIN sm b ON a.key <> b.key),
    vt AS (SELECT key, label, count(*) n FROM nb WHERE p <= 5 GROUP BY ALL) SELECT key, arg_min(label, (-n, label)) predicted FROM vt GROUP BY key""")
def knn_leave_one_out(spark, d):
    """Predictions of each labelled row from the 5 nearest others."""
    sample = cut(_labelled(spark, d)[1])
    return ML.nearest_neighbours(sample, sample, "key", ["x", "y"], "label", 5)


@query(f"""{_SAMPLE}, nb AS (SELECT a.key, b.label, row_number() OVER (PARTITION BY a.key ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.key) p FROM fe a JOIN sm b ON a.key <> b.key),
    vt AS (SELECT key, label, count(*) n FROM nb WHERE p <= 5 GROUP BY ALL) SELECT key, arg_min(label, (-n, label)) predicted FROM vt GROUP BY key""")
def knn_predictions(spark, d):
    """All rows by the 5 nearest of the labelled sample."""
    rows, sample = _labelled(spark, d)
    return ML.nearest_neighbours(sample, rows, "key", ["x", "y"], "label", 5)


@query("SELECT id, CASE WHEN name IN ('kettle', 'tram') THEN 'first' WHEN supercategory = 'furniture' THEN 'second' ELSE 'other' END AS class FROM categories")
def mapped_classes(spark, d):
    c = spark.read.parquet(f"{d}/categories.parquet")
    both = ML.class_map(F.col("name"), {"kettle": "first", "tram": "first"}, {}, "")
    by_parent = ML.class_map(F.col("supercategory"), {"furniture": "second"}, {}, "other")
    return c.select("id", F.when(both != "", both).otherwise(by_parent).alias("class"))


# measures


@query(f"""{_RUNS}, a AS (SELECT image_id, x, segment_id id, y0 s, y0 + len e FROM rr), b AS (SELECT image_id, x, segment_id + 1 id, y0 + 1 s, y0 + 1 + len e FROM rr),
    p AS (SELECT image_id, a.id id_a, b.id id_b, sum(least(a.e, b.e) - greatest(a.s, b.s)) n FROM a JOIN b USING (image_id, x) WHERE least(a.e, b.e) > greatest(a.s, b.s) GROUP BY ALL),
    z AS (SELECT image_id, segment_id id, sum(len) n FROM rr GROUP BY ALL)
    SELECT image_id, id_a, id_b, round(p.n / (u.n + v.n - p.n), 6) iou FROM p JOIN z u USING (image_id) JOIN z v USING (image_id) WHERE u.id = id_a AND v.id + 1 = id_b""")
def mask_overlaps(spark, d):
    r = runs(spark, d)
    key = F.concat_ws("-", "x").alias("line")
    a = r.select("image_id", key, F.col("segment_id").alias("id"), F.col("y0").alias("start"), "len")
    b = r.select("image_id", key, (F.col("segment_id") + 1).alias("id"), (F.col("y0") + 1).alias("start"), "len")
    return rounded(V.mask_iou(a, b, "image_id"), "iou")


@query(f"{_BOXES} SELECT id, image_id, round(ln(2.0), 6) dh, round(0.5 * (y2 - y1) + 0.0, 6) dy, y1::DOUBLE y1, x1::DOUBLE x1, (y2 + y2 - y1)::DOUBLE y2, x2::DOUBLE x2 FROM bx")
def box_refinement(spark, d):
    """Boxes made twice as high through their deltas; dy in pixels."""
    b = boxes(spark, d)
    box = [F.col(c).cast("double") for c in ("y1", "x1", "y2", "x2")]
    target = [box[0], box[1], box[2] + box[2] - box[0], box[3]]
    delta = V.box_deltas(box, target)
    back = V.apply_deltas(box, delta)
    return rounded(b.select("id", "image_id", delta[2].alias("dh"), (delta[0] * (box[2] - box[0])).alias("dy"), *[c.alias(n) for c, n in zip(back, ("y1", "x1", "y2", "x2"))]), "dh", "dy", "y1", "x1", "y2", "x2")


@query(f"{_BOXES} SELECT id, image_id, y1, x1, y2, x2 FROM bx")
def pixel_boxes(spark, d):
    """Shares of the image back to pixels."""
    b, size = boxes(spark, d), F.lit(500)
    shares = V.norm_box([F.col(c) for c in ("y1", "x1", "y2", "x2")], size, size)
    return b.select("id", "image_id", *[c.cast("bigint").alias(n) for c, n in zip(V.denorm_box(shares, size, size), ("y1", "x1", "y2", "x2"))])


@query("SELECT l_orderkey, l_linenumber, round(0.01 + 9.99 * l_discount, 6) scaled, round(1 / (0.01 + 9.99 * l_discount), 6) depth FROM lineitem")
def disparity_depth(spark, d):
    scaled, depth = V.disparity_to_depth(F.col("l_discount"))
    return rounded(spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", scaled.alias("scaled"), depth.alias("depth")), "scaled", "depth")


@query("""WITH p AS (SELECT l_suppkey, l_orderkey, l_linenumber % 5 AS label, max(l_discount) prob FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY prob DESC, label) k FROM p)
    SELECT l_suppkey, label, round(avg(prob), 6) avg_prob FROM k WHERE k <= 2 GROUP BY ALL HAVING round_even(avg(prob), 3) > 0""")
def probable_labels(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey", "l_orderkey", (F.col("l_linenumber") % 5).alias("label")).agg(F.max("l_discount").alias("prob"))
    return rounded(V.top_labels(rows, ["l_suppkey", "l_orderkey"], ["l_suppkey"], 2), "avg_prob")


@query(f"{_BOXES} SELECT image_id, class_id category_id, score, x1 x, y1 y, x2 - x1 w, y2 - y1 h FROM bx")
def detection_records(spark, d):
    return V.result_records(boxes(spark, d))


@query(f"{_BOXES} SELECT image_id, id FROM bx WHERE y1 <> 0 OR x1 <> 0")
def rows_with_values(spark, d):
    return V.trim_zeros(boxes(spark, d), ["y1", "x1"]).select("image_id", "id")


@query("""SELECT l.i::INT AS level, i * st - 0.5 * sc / sqrt(ra) y1, j * st - 0.5 * sc * sqrt(ra) x1, i * st + 0.5 * sc / sqrt(ra) y2, j * st + 0.5 * sc * sqrt(ra) x2
    FROM (VALUES (0, 32.0::DOUBLE, 8, 16), (1, 64.0::DOUBLE, 4, 32)) l(i, sc, n, st), (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE ra), unnest(range(l.n)) a(i), unnest(range(l.n)) b(j)""".replace("i * st", "a.i * st").replace("j * st", "b.j * st"))
def anchor_grid(spark, d):
    return V.anchors(spark, [32, 64], [0.5, 1, 2], [(8, 8), (4, 4)], [16, 32])


# greedy suppression: in order of score each box is kept unless one kept before overlaps it too much
@query(f"""{_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, id) k FROM bx), m AS (SELECT image_id, max(k) n FROM o GROUP BY 1)
    , w AS (SELECT a.image_id, a.k ka, b.k kb FROM o a JOIN o b ON a.image_id = b.image_id AND a.k < b.k WHERE least(a.y2, b.y2) > greatest(a.y1, b.y1) AND least(a.x2, b.x2) > greatest(a.x1, b.x1)
        AND (least(a.y2, b.y2) - greatest(a.y1, b.y1)) * (least(a.x2, b.x2) - greatest(a.x1, b.x1)) > 0.3 * ((a.y2 - a.y1) * (a.x2 - a.x1) + (b.y2 - b.y1) * (b.x2 - b.x1) - (least(a.y2, b.y2) - greatest(a.y1, b.y1)) * (least(a.x2, b.x2) - greatest(a.x1, b.x1))))
    , s(image_id, k, kept) AS (SELECT image_id, 0::BIGINT, []::BIGINT[] FROM m UNION ALL
        SELECT s.image_id, s.k + 1, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.image_id = s.image_id AND w.kb = s.k + 1 AND list_contains(s.kept, w.ka)) THEN s.kept ELSE list_append(s.kept, s.k + 1) END FROM s JOIN m ON m.image_id = s.image_id AND s.k < m.n)
    SELECT o.image_id, o.id FROM s JOIN m ON m.image_id = s.image_id AND s.k = m.n JOIN o ON o.image_id = s.image_id AND list_contains(s.kept, o.k)""".replace("WITH sg", "WITH RECURSIVE sg", 1))
def nms(spark, d):
    return V.nms(boxes(spark, d), "image_id", 0.3)


@query(f"{_RUNS}, a AS (SELECT DISTINCT image_id, segment_id FROM rr), b AS (SELECT image_id, segment_id FROM sg WHERE category_id % 4 > 0) SELECT image_id, segment_id, 'not in segments' problem FROM a ANTI JOIN b USING (image_id, segment_id) UNION ALL SELECT image_id, segment_id, 'not in raster' FROM b ANTI JOIN a USING (image_id, segment_id)")
def id_problems(spark, d):
    return Q.check_ids(runs(spark, d), segments(spark, d).where("category_id % 4 > 0"))


@query(f"WITH {_SEG} SELECT count(*) segments, count(*) same_first, 0 AS twice FROM sg JOIN categories ON id = category_id")
def coloured_ids(spark, d):
    """Ids given by colour: none twice in an image, none below its category's colour."""
    c = spark.read.parquet(f"{d}/categories.parquet")
    s = segments(spark, d).select("image_id", F.col("segment_id").alias("ord"), "category_id")
    out = Q.assign_ids(s, c).join(c.select(F.col("id").alias("category_id"), "color"), "category_id")
    base = F.col("color")[0].cast("bigint") + F.col("color")[1].cast("bigint") * 256 + F.col("color")[2].cast("bigint") * 65536
    return out.agg(F.count(F.lit(1)).alias("segments"), F.count(F.when(F.col("segment_id") >= base, 1)).alias("same_first"), (F.count(F.lit(1)) - F.countDistinct("image_id", "segment_id")).cast("int").alias("twice"))


# every segment of an image is a detection on its own pixels and a part of the next one's: the first takes all, the next what is left
@query(f"""WITH {_SEG}, k AS (SELECT image_id, segment_id, category_id, row_number() OVER (PARTITION BY image_id ORDER BY segment_id) k FROM sg) SELECT image_id, k::INT segment_id, category_id::INT category_id, CASE WHEN k = 1 THEN 12 ELSE 10 END::BIGINT area FROM k""")
def merged_masks(spark, d):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("image_id").orderBy("segment_id"))
    s = segments(spark, d).withColumn("k", k)
    first = F.col("k") * 10
    masks = s.select("image_id", F.col("k").alias("ord"), "category_id", F.array(F.struct(first.cast("bigint").alias("start"), F.lit(12).cast("bigint").alias("len"))).alias("runs"))
    return Q.merge_masks(masks, masks.limit(0), things=[]).select("image_id", "segment_id", "category_id", "area")


# subsets and summaries


@query("SELECT doc_id FROM documents WHERE contains(text, 'histogram') OR contains(text, 'sensor')")
def subset_by_caption(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return E.subset_by_caption(docs.select("doc_id").distinct(), docs, "doc_id", "text", ["histogram", "sensor"])


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT DISTINCT graph_id FROM nodes) OR vec_id IN (SELECT doc_id FROM documents)")
def features_of_images(spark, d):
    """Rows of a feature matrix for the graphs of a subset."""
    wanted = load(spark, d).graphs.select(F.col("graph_id").alias("vec_id")).unionByName(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("vec_id")))
    return E.select_features(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label"), wanted, "vec_id")


# whole graphs as patterns, isolated nodes and edgeless graphs included: each of 40 small graphs meets the graphs it is in
_SMALL = """sz AS (SELECT graph_id, count(*) k FROM n GROUP BY 1), sm AS (SELECT graph_id pid FROM sz WHERE k = 2 ORDER BY graph_id LIMIT 40),
    pn AS (SELECT pid, min(node_id) u, max(node_id) v, arg_min(label, node_id) a, arg_max(label, node_id) b FROM sm JOIN n ON graph_id = pid GROUP BY 1),
    pe AS (SELECT pid, (s = u) fwd, pos FROM pn JOIN e ON graph_id = pid WHERE s <> r),
    tr AS (SELECT DISTINCT pid, CASE WHEN fwd THEN a ELSE b END x, pos, CASE WHEN fwd THEN b ELSE a END y FROM pe JOIN pn USING (pid)),
    cn AS (SELECT pid, p.graph_id, p.node_id s, q.node_id r FROM pn JOIN n p ON p.label = a JOIN n q ON q.label = b AND q.graph_id = p.graph_id AND q.node_id <> p.node_id),
    fw AS (SELECT pid, list_sort(list(DISTINCT pos) FILTER (fwd)) f, list_sort(list(DISTINCT pos) FILTER (NOT fwd)) w FROM pn LEFT JOIN pe USING (pid) GROUP BY 1),
    ge AS (SELECT pid, cn.graph_id, cn.s, cn.r, list_sort(list(DISTINCT t.pos) FILTER (t.s = cn.s)) f, list_sort(list(DISTINCT t.pos) FILTER (t.s = cn.r)) w
        FROM cn LEFT JOIN (SELECT t.*, tr.pid tp FROM t JOIN tr ON tr.x = t.subj AND tr.pos = t.pos AND tr.y = t."ref") t ON t.tp = cn.pid AND t.graph_id = cn.graph_id AND ((t.s = cn.s AND t.r = cn.r) OR (t.s = cn.r AND t.r = cn.s)) GROUP BY ALL)"""


@query(f"WITH {BASE}, {_SMALL} SELECT DISTINCT pid pattern_id, ge.graph_id FROM ge JOIN fw USING (pid) WHERE coalesce(ge.f, []) = coalesce(fw.f, []) AND coalesce(ge.w, []) = coalesce(fw.w, [])")
def whole_graph_matches(spark, d):
    """The first 40 graphs of two nodes as patterns (with or without edge) against all graphs."""
    from graphweave.model import cut_graphs

    g = cut_graphs(load(spark, d))
    small = g.nodes.groupBy("graph_id").count().where("count = 2").orderBy("graph_id").limit(40).select("graph_id")
    nodes = g.nodes.join(small, "graph_id", "left_semi").select(F.col("graph_id").alias("pattern_id"), F.col("node_id").alias("node"), "label")
    edges = g.edges.where("s <> r").join(small, "graph_id", "left_semi").select(F.col("graph_id").alias("pattern_id"), "s", "pos", "r")
    return C.matches(g, nodes, edges)
