"""Queries p2 (hot keys) and p6 (nested records) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.terms import term
from graphweave.operators.nested import child_tables, flatten, nested_children
from graphweave.operators.salted import salted_aggregate
from graphweave.session import cut

#: Share of the rows from which p2_found names a key.
HOT = 0.05


def _label_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per node and term: deliveries of a node count once."""
    nodes = spark.read.parquet(f"{d}/nodes.parquet").select("graph_id", "node_id", term("label").alias("term"))
    return cut(nodes.where(F.col("term").isNotNull()).dropDuplicates(["graph_id", "node_id", "term"]))


def _segment_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row per segment with a category: deliveries of a segment count once."""
    rows = spark.read.parquet(f"{d}/panoptic.parquet").select("image_id", F.explode("segments_info").alias("x"))
    rows = rows.select("image_id", F.col("x.id").alias("segment_id"), F.col("x.category_id").alias("category_id"), F.col("x.area").alias("area"))
    return cut(rows.where(F.col("category_id").isNotNull()).groupBy("image_id", "segment_id", "category_id").agg(F.max("area").alias("area")))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _label_rows(spark, d)
    return salted_aggregate(rows, ["term"], {"nodes": ("count", None), "graphs": ("count_distinct", "graph_id")})


def p2_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = _segment_rows(spark, d)
    aggs = {"segments": ("count", None), "images": ("count_distinct", "image_id"), "area": ("sum", "area")}
    return salted_aggregate(rows, ["category_id"], aggs)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    def hot(rows: DataFrame, key: str, ids: list[str], field: str) -> DataFrame:
        counts = salted_aggregate(rows, [key], {"n": ("count", None)})
        total = rows.select(*ids).distinct().agg(F.count(F.lit(1)))
        hot = counts.where((F.col("n") > 0) & (F.col("n") * F.lit(100) >= F.lit(round(HOT * 100)) * total.scalar()))
        return hot.select(F.lit(field).alias("field_name"), F.col(key).cast("string").alias("key_value"))

    labels = hot(_label_rows(spark, d), "term", ["graph_id", "node_id"], "label")
    return labels.unionByName(hot(_segment_rows(spark, d), "category_id", ["image_id", "segment_id"], "category_id"))


def p6_children(spark: SparkSession, d: str) -> DataFrame:
    return nested_children(spark.read.parquet(f"{d}/raw_records.parquet"), "record_id", "payload")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = nested_children(spark.read.parquet(f"{d}/raw_records.parquet"), "record_id", "payload", body=False)
    return rows.select("record_id", "ann_no", "kind", "child_no")


def _table(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return child_tables(nested_children(spark.read.parquet(f"{d}/raw_records.parquet"), "record_id", "payload", kinds=(kind,)))[kind]

    return query


def p6_panoptic_segments(spark: SparkSession, d: str) -> DataFrame:
    fields = ["id", "category_id", "area", "iscrowd"]
    return flatten(spark.read.parquet(f"{d}/panoptic.parquet"), {"image_id": "image_id"}, "segments_info", "loaded_at", fields)


def p6_scene_nodes(spark: SparkSession, d: str) -> DataFrame:
    out = flatten(spark.read.parquet(f"{d}/scene_graphs.parquet"), {"graph_id": "graph.name"}, "nodes", "loaded_at", ["id", "label"])
    return out.select("graph_id", "child_no", "id", term("label").alias("term"))


def p6_scene_links(spark: SparkSession, d: str) -> DataFrame:
    return flatten(spark.read.parquet(f"{d}/scene_graphs.parquet"), {"graph_id": "graph.name"}, "links", "loaded_at", ["s", "r", "pos"])


def p6_sgs_nodes(spark: SparkSession, d: str) -> DataFrame:
    return flatten(spark.read.parquet(f"{d}/sgs.parquet"), {"run_name": "run_name", "pattern_id": "g.graph.name"}, "g.nodes", "loaded_at", ["id", "label"])


def p6_sgs_links(spark: SparkSession, d: str) -> DataFrame:
    return flatten(spark.read.parquet(f"{d}/sgs.parquet"), {"run_name": "run_name", "pattern_id": "g.graph.name"}, "g.links", "loaded_at", ["s", "r", "pos"])


QUERIES = {
    "p2_found": p2_found, "p2_labels": p2_labels, "p2_categories": p2_categories,
    "p6_found": p6_found, "p6_children": p6_children, "p6_segments": _table("segments_info"), "p6_nodes": _table("nodes"), "p6_links": _table("links"),
    "p6_panoptic_segments": p6_panoptic_segments, "p6_scene_nodes": p6_scene_nodes, "p6_scene_links": p6_scene_links,
    "p6_sgs_nodes": p6_sgs_nodes, "p6_sgs_links": p6_sgs_links,
}

TERM = "nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), '')"
_LABELS = f"(SELECT DISTINCT graph_id, node_id, {TERM.format('label')} term FROM nodes WHERE {TERM.format('label')} IS NOT NULL)"
_SEGMENTS = """(SELECT image_id, x.id segment_id, x.category_id category_id, max(x.area) area
    FROM (SELECT image_id, unnest(segments_info) x FROM panoptic) WHERE x.category_id IS NOT NULL GROUP BY ALL)"""


def _last(keys: str, array: str, fields: str, table: str) -> str:
    """SQL of flatten over rows whose deliveries have equal arrays or different times."""
    return f"""SELECT * EXCLUDE (x), {fields} FROM (
        SELECT * EXCLUDE (items), unnest(range(len(items)))::INT child_no, unnest(items) x
        FROM (SELECT {keys}, arg_max({array}, loaded_at) items FROM {table} GROUP BY ALL)) WHERE x IS NOT NULL"""

_KINDS = "('segments_info', 'nodes', 'links')"
# objects by the paths of a JSON tree; a text that holds JSON starts a tree of its own
_CHILDREN = f"""WITH RECURSIVE p AS (SELECT DISTINCT record_id, payload::JSON j FROM raw_records WHERE json_valid(payload)),
    a0 AS (SELECT record_id, CASE WHEN json_type(j, '$.annotations') = 'VARCHAR' AND json_valid(j ->> '$.annotations') THEN (j ->> '$.annotations')::JSON ELSE json_extract(j, '$.annotations') END a FROM p),
    a1 AS (SELECT record_id, json_type(a) = 'ARRAY' listed, CASE json_type(a) WHEN 'ARRAY' THEN json_extract(a, '$[*]') WHEN 'OBJECT' THEN [a] ELSE [] END l FROM a0),
    w AS (SELECT record_id, (k - 1)::INT ann_no, l[k] doc, NULL::VARCHAR kind, NULL::INT child, '$.annotations' || CASE WHEN listed THEN '[' || (k - 1) || ']' ELSE '' END base FROM a1, unnest(range(1, len(l) + 1)) u(k)
        UNION ALL SELECT record_id, ann_no, (value ->> '$')::JSON, CASE WHEN fullkey NOT LIKE '%]' THEN CASE WHEN key IN {_KINDS} THEN key END WHEN path = '$' THEN CASE WHEN child IS NULL THEN kind END ELSE nullif(regexp_extract(path, '[.](segments_info|nodes|links)$', 1), '') END,
            CASE WHEN fullkey LIKE '%]' THEN key::INT END, base || substr(fullkey, 2)
        FROM (SELECT w.*, x.key, x.value, x.fullkey, x.path FROM w, json_tree(w.doc) x WHERE x.type = 'VARCHAR' AND left(ltrim(x.value ->> '$'), 1) IN ('{{', '[') AND json_valid(x.value ->> '$'))),
    c AS (SELECT record_id, ann_no, CASE WHEN fullkey = '$' THEN kind WHEN fullkey NOT LIKE '%]' THEN CASE WHEN key IN {_KINDS} THEN key END WHEN path = '$' THEN CASE WHEN child IS NULL THEN kind END ELSE nullif(regexp_extract(path, '[.](segments_info|nodes|links)$', 1), '') END kind,
            CASE WHEN fullkey = '$' THEN coalesce(child, 0) WHEN fullkey LIKE '%]' THEN key::INT ELSE 0 END child_no, base || substr(fullkey, 2) AS path, value::VARCHAR body
        FROM (SELECT w.*, x.key, x.value, x.fullkey, x.path FROM w, json_tree(w.doc) x WHERE x.type = 'OBJECT'))"""


def _fields(kind: str, numbers: list[tuple[str, str]], texts: list[str]) -> str:
    columns = [f"TRY_CAST(json_extract_string(body, '$.{n}') AS {t}) {n}" for n, t in numbers] + [f"json_extract_string(body, '$.{n}') {n}" for n in texts]
    return f"{_CHILDREN} SELECT DISTINCT record_id, ann_no, child_no, path, {', '.join(columns)} FROM c WHERE kind = '{kind}'"

ORACLE = {
    "p6_found": f"{_CHILDREN} SELECT DISTINCT record_id, ann_no, kind, child_no FROM c WHERE kind IS NOT NULL",
    "p6_children": f"{_CHILDREN} SELECT DISTINCT * FROM c WHERE kind IS NOT NULL",
    "p6_segments": _fields("segments_info", [("id", "BIGINT"), ("category_id", "INT"), ("area", "BIGINT"), ("iscrowd", "INT")], []),
    "p6_nodes": _fields("nodes", [("id", "BIGINT")], ["label"]),
    "p6_links": _fields("links", [("s", "BIGINT"), ("r", "BIGINT")], ["pos"]),
    "p2_labels": f"SELECT term, count(*) nodes, count(DISTINCT graph_id) graphs FROM {_LABELS} GROUP BY term",
    "p2_categories": f"SELECT category_id, count(*) segments, count(DISTINCT image_id) images, sum(area)::BIGINT area FROM {_SEGMENTS} GROUP BY 1",
    "p2_found": f"""SELECT 'label' field_name, term key_value FROM {_LABELS} GROUP BY term
        HAVING count(*) * 100 >= 5 * (SELECT count(*) FROM (SELECT DISTINCT graph_id, node_id FROM {_LABELS}))
        UNION ALL SELECT 'category_id', category_id::VARCHAR FROM {_SEGMENTS} GROUP BY category_id
        HAVING count(*) * 100 >= 5 * (SELECT count(*) FROM (SELECT DISTINCT image_id, segment_id FROM {_SEGMENTS}))""",
    "p6_panoptic_segments": _last("image_id", "segments_info", "x.id, x.category_id, x.area, x.iscrowd", "panoptic"),
    "p6_scene_links": _last("graph.name AS graph_id", "links", "x.s, x.r, x.pos", "scene_graphs"),
    "p6_sgs_nodes": _last("run_name, g.graph.name AS pattern_id", "g.nodes", "x.id, x.label", "sgs"),
    "p6_sgs_links": _last("run_name, g.graph.name AS pattern_id", "g.links", "x.s, x.r, x.pos", "sgs"),
}
ORACLE["p6_scene_nodes"] = f"SELECT graph_id, child_no, id, {TERM.format('label')} term FROM ({_last('graph.name AS graph_id', 'nodes', 'x.id, x.label', 'scene_graphs')})"
