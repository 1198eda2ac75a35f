"""Queries of this folder's operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions.terms import term
from graphweave.llm.cooccur import cooccurrences
from graphweave.llm.mixing import mix
from graphweave.llm.packing import Limits, pack, pack_report
from graphweave.llm.setjoin import record_pairs, similar_records
from graphweave.llm.spans import SharedSpans
from graphweave.llm.subset import choose_varied
from graphweave.llm.termfreq import mark_terms, record_term_frequencies, unite_deliveries
from graphweave.llm.tokens import token_sizes
from graphweave.session import cut

#: p1_found: least graphs with both items, and least lift.
MIN_TOGETHER, MIN_LIFT = 5, 3
#: p3_found: least label terms of a graph, least similarity.
MIN_TERMS, SIMILARITY = 6, 0.6
#: p4_found: most records of a rare term, least share of a common one.
RARE, COMMON = 2, 0.2
#: p7_limits: documents and attention cost a container may hold, binding on these texts.
LIMITS = Limits(docs_per_token=1 / 256, attention=0.5)
#: p9_found: least characters of a span.
SPAN = 250


def _items(spark: SparkSession, d: str) -> DataFrame:
    nodes = spark.read.parquet(f"{d}/nodes.parquet").select("graph_id", term("label").alias("item"))
    return nodes.unionByName(spark.read.parquet(f"{d}/edges.parquet").select("graph_id", term("pos").alias("item")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrences(_items(spark, d), "graph_id", "item", min_count=MIN_TOGETHER, min_lift=MIN_LIFT).select("item_a", "item_b")


def p1_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    out = cooccurrences(_items(spark, d), "graph_id", "item")
    return out.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("odds_ratio", 6).alias("odds_ratio"))


def _graph_terms(spark: SparkSession, d: str) -> DataFrame:
    graphs = spark.read.parquet(f"{d}/scene_graphs.parquet").select(F.col("graph.name").alias("graph_id"), F.explode("nodes.label").alias("label"))
    return graphs.select("graph_id", term("label").alias("term"))


def _similar(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return similar_records(_graph_terms(spark, d), "graph_id", "term", SIMILARITY, min_size=MIN_TERMS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return record_pairs(*_similar(spark, d)).select(F.col("record_a").alias("graph_a"), F.col("record_b").alias("graph_b"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d)[0].select(F.col("record").alias("graph_id"), "class_id", "links")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d)[1]


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    """(field, record, terms), a row per delivery."""
    graphs = spark.read.parquet(f"{d}/scene_graphs.parquet").select(F.lit("label").alias("field"), F.col("graph.name").alias("record"), F.transform("nodes.label", lambda x: term(x)).alias("terms"))
    sups = spark.read.parquet(f"{d}/sgs.parquet").select(F.lit("sup").alias("field"), F.col("g.graph.name").alias("record"), F.array(F.col("sup").cast("string")).alias("terms"))
    return graphs.unionByName(sups)


def p4_frequencies(spark: SparkSession, d: str) -> DataFrame:
    rows, totals = unite_deliveries(_deliveries(spark, d), "field", "record", "terms")
    return mark_terms(record_term_frequencies(rows), totals, rare=RARE, common=COMMON).select(F.col("field").alias("field_name"), "term", "occurrences", "records", "mark")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_frequencies(spark, d).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/sgs.parquet").select("run_name", F.col("g.graph.name").alias("pattern_id"), F.col("g.nodes.label").alias("labels"))
    terms = F.array_sort(F.array_distinct(F.array_compact(F.transform("labels", lambda x: term(x)))))
    return rows.select("run_name", "pattern_id", F.transform(terms, lambda x: F.xxhash64(x)).alias("members"))


def p5_subset(spark: SparkSession, d: str) -> DataFrame:
    return choose_varied(_patterns(spark, d), spark.read.parquet(f"{d}/subset_jobs.parquet"), record="pattern_id", group="run_name", members="members").withColumnRenamed("record", "pattern_id")


def p5_check(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, chosen, foreign, twice) of each job: patterns chosen, those of another run or unknown, those chosen twice."""
    jobs = spark.read.parquet(f"{d}/subset_jobs.parquet")
    picks = p5_subset(spark, d).select("job_id", F.col("run_name").alias("run"), "pattern_id")
    known = _patterns(spark, d).select(F.col("run_name").alias("r"), F.col("pattern_id").alias("p")).distinct()
    rows = picks.join(known, F.col("run").eqNullSafe(F.col("r")) & F.col("pattern_id").eqNullSafe(F.col("p")), "left")
    rows = rows.join(F.broadcast(jobs.select("job_id", F.col("run_name").alias("wanted"), F.lit(True).alias("named"))), "job_id", "left")
    wrong = F.col("named").isNull() | F.col("r").isNull() & F.col("p").isNull() & (F.col("run").isNotNull() | F.col("pattern_id").isNotNull()) | F.col("wanted").isNotNull() & ~F.col("wanted").eqNullSafe(F.col("run"))
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("chosen"), F.count(F.when(wrong, 1)).alias("foreign"), (F.count(F.lit(1)) - F.count_distinct(F.struct("run", "pattern_id"))).alias("twice"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")
    return token_sizes(docs, "text", ["doc_id", "source"])


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(_sizes(spark, d), spark.read.parquet(f"{d}/pack_jobs.parquet"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    jobs = spark.read.parquet(f"{d}/pack_jobs.parquet")
    return pack_report(pack(_sizes(spark, d), jobs), jobs)


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    jobs = spark.read.parquet(f"{d}/pack_jobs.parquet")
    return pack_report(pack(_sizes(spark, d), jobs, limits=LIMITS), jobs, LIMITS)


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """(job_id, documents, wrongly_cut, over) of packing under LIMITS: documents placed, those cut although they fit, containers above a limit."""
    jobs = spark.read.parquet(f"{d}/pack_jobs.parquet")
    packed = cut(pack(_sizes(spark, d), jobs, limits=LIMITS))
    capacity = jobs.select("job_id", F.col("capacity_tokens").alias("capacity"))
    docs = packed.groupBy("job_id", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    docs = docs.join(F.broadcast(capacity), "job_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity"))), 1)).alias("wrongly_cut"))
    return docs.join(pack_report(packed, jobs, LIMITS).select("job_id", "over"), "job_id")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), spark.read.parquet(f"{d}/mix_targets.parquet"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mix(_sizes(spark, d), spark.read.parquet(f"{d}/mix_targets.parquet"))[1]


def p8_check(spark: SparkSession, d: str) -> DataFrame:
    """(mix_id, source, target_share, foreign, above_cap, twice) of each mix and source: drawn documents of another source, drawn more often than the cap, or in two rows."""
    targets = spark.read.parquet(f"{d}/mix_targets.parquet").where(F.col("source").isNotNull())
    drawn, report = mix(_sizes(spark, d), targets)
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("source").alias("own"))
    caps = targets.groupBy("mix_id", "source").agg(F.max("max_repeats").alias("cap"))
    rows = drawn.join(docs, "doc_id").join(F.broadcast(caps), ["mix_id", "source"])
    counts = rows.groupBy("mix_id", "source").agg(
        F.count(F.when(~F.col("own").eqNullSafe(F.col("source")), 1)).alias("foreign"), F.count(F.when(F.col("copies") > F.col("cap"), 1)).alias("above_cap"),
        (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("twice"),
    )
    out = report.select("mix_id", "source", "target_share").join(counts, ["mix_id", "source"], "left")
    return out.select("mix_id", "source", F.round("target_share", 9).alias("target_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("foreign", "above_cap", "twice")])


def _shared(spark: SparkSession, d: str) -> SharedSpans:
    return SharedSpans(spark.read.parquet(f"{d}/documents.parquet"), min_len=SPAN)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).pairs()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).shares().withColumnRenamed("doc", "doc_id")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).passages()


QUERIES = {
    "p1_found": p1_found, "p1_cooccurrence": p1_cooccurrence,
    "p3_found": p3_found, "p3_members": p3_members, "p3_links": p3_links,
    "p4_found": p4_found, "p4_frequencies": p4_frequencies,
    "p5_subset": p5_subset, "p5_check": p5_check,
    "p7_pack": p7_pack, "p7_report": p7_report, "p7_limits": p7_limits, "p7_check": p7_check, "p8_mix": p8_mix, "p8_report": p8_report, "p8_check": p8_check,
    "p9_found": p9_found, "p9_shares": p9_shares, "p9_passages": p9_passages,
}

_TERM = "nullif(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), '')"
_PAIRS = f"""items AS (SELECT graph_id, {_TERM.format('label')} item FROM nodes UNION SELECT graph_id, {_TERM.format('pos')} FROM edges),
    i AS (SELECT * FROM items WHERE item IS NOT NULL AND graph_id IS NOT NULL),
    n AS (SELECT item, count(*) n FROM i GROUP BY item), whole AS (SELECT count(DISTINCT graph_id) total FROM i),
    p AS (SELECT a.item item_a, b.item item_b, count(*) n_ab FROM i a JOIN i b ON a.graph_id = b.graph_id AND a.item < b.item GROUP BY ALL),
    q AS (SELECT item_a, item_b, x.n n_a, y.n n_b, n_ab, total FROM p JOIN n x ON item_a = x.item JOIN n y ON item_b = y.item, whole)"""
_LABEL_TERMS = f"""(SELECT DISTINCT graph_id, {_TERM.format('label')} term FROM (SELECT graph.name graph_id, unnest(nodes).label AS label FROM scene_graphs) WHERE {_TERM.format('label')} IS NOT NULL)"""

ORACLE = {
    "p1_found": f"WITH {_PAIRS} SELECT item_a, item_b FROM q WHERE n_ab >= {MIN_TOGETHER} AND n_ab * total >= {MIN_LIFT} * n_a * n_b",
    "p1_cooccurrence": f"""WITH {_PAIRS} SELECT item_a, item_b, n_a, n_b, n_ab, round(n_ab * total / (n_a * n_b), 6) lift,
        round((n_ab + 0.5::DOUBLE) * (total - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 6) odds_ratio FROM q""",
    "p3_found": f"""WITH t AS (SELECT * FROM {_LABEL_TERMS} WHERE graph_id IS NOT NULL), n AS (SELECT graph_id, count(*) n FROM t GROUP BY 1 HAVING count(*) >= {MIN_TERMS}),
        p AS (SELECT a.graph_id graph_a, b.graph_id graph_b, count(*) c FROM t a JOIN t b ON a.term = b.term AND a.graph_id < b.graph_id GROUP BY ALL)
        SELECT graph_a, graph_b FROM p JOIN n x ON graph_a = x.graph_id JOIN n y ON graph_b = y.graph_id WHERE c * 10 >= 6 * (x.n + y.n - c)""",
    "p4_frequencies": f"""WITH l AS (SELECT graph.name record, list_sort(list_transform(nodes, lambda x: {_TERM.format('x.label')})) terms FROM scene_graphs),
        o AS (SELECT 'label' field_name, record, term, max(n) n FROM (SELECT record, terms, term, count(*) n FROM (SELECT record, terms, unnest(terms) term FROM (SELECT DISTINCT * FROM l)) WHERE term IS NOT NULL GROUP BY ALL) GROUP BY ALL
            UNION ALL SELECT DISTINCT 'sup', g.graph.name, sup::VARCHAR, 1 FROM sgs WHERE sup IS NOT NULL),
        w AS (SELECT 'label' field_name, count(*) total FROM (SELECT DISTINCT graph.name FROM scene_graphs) UNION ALL SELECT 'sup', count(*) FROM (SELECT DISTINCT g.graph.name FROM sgs))
        SELECT field_name, term, sum(n)::BIGINT occurrences, count(*) records, CASE WHEN count(*) <= {RARE} THEN 'rare' WHEN count(*) * 5 >= any_value(total) THEN 'common' END mark
        FROM o JOIN w USING (field_name) GROUP BY field_name, term""",
}
_CLASSES = f"""t AS (SELECT graph_id, list(term ORDER BY term) terms FROM {_LABEL_TERMS} WHERE graph_id IS NOT NULL GROUP BY 1 HAVING count(*) >= {MIN_TERMS}),
    m AS (SELECT graph_id, terms, min(graph_id) OVER (PARTITION BY terms) class_id FROM t),
    c AS (SELECT class_id, unnest(terms) term, len(terms) n FROM m WHERE graph_id = class_id),
    p AS (SELECT a.class_id class_a, b.class_id class_b, a.n n, b.n k, count(*) c FROM c a JOIN c b ON a.term = b.term AND a.class_id < b.class_id GROUP BY ALL),
    l AS (SELECT class_a, class_b, c / (n + k - c) AS similarity FROM p WHERE c * 10 >= 6 * (n + k - c))"""
ORACLE["p3_links"] = f"WITH {_CLASSES} SELECT * FROM l"
ORACLE["p3_members"] = f"""WITH {_CLASSES}, d AS (SELECT x, count(*) k FROM (SELECT class_a x FROM l UNION ALL SELECT class_b FROM l) GROUP BY 1)
    SELECT graph_id, class_id, coalesce(k, 0) links FROM m LEFT JOIN d ON x = class_id"""
#: every window of SPAN characters of every text, by hash
ORACLE["p9_found"] = f"""WITH s AS (SELECT DISTINCT doc_id, hash(substring(text, i, {SPAN})) h FROM documents, unnest(range(1, length(text) - {SPAN} + 2)) u(i) WHERE length(text) >= {SPAN}),
    k AS (SELECT s.* FROM s JOIN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) USING (h))
    SELECT DISTINCT a.doc_id doc_a, b.doc_id doc_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id"""
# what any right answer must have: sizes and no faults
ORACLE["p5_check"] = """WITH k AS (SELECT DISTINCT run_name, g.graph.name p FROM sgs), j AS (SELECT DISTINCT job_id, run_name, subset_size FROM subset_jobs WHERE subset_size > 0)
    SELECT job_id, least(any_value(subset_size), count(*)) chosen, 0 AS foreign, 0 twice FROM j JOIN k ON j.run_name IS NULL OR j.run_name = k.run_name GROUP BY job_id"""
ORACLE["p7_check"] = """SELECT job_id, count(DISTINCT doc_id) documents, 0 wrongly_cut, 0 AS over FROM pack_jobs j JOIN documents d ON j.source IS NULL OR j.source = d.source WHERE capacity_tokens > 0 GROUP BY job_id"""
ORACLE["p8_check"] = """SELECT mix_id, source, round(sum(coalesce(weight, 0)) / sum(sum(coalesce(weight, 0))) OVER (PARTITION BY mix_id), 9) target_share, 0 AS foreign, 0 above_cap, 0 twice
    FROM mix_targets WHERE source IS NOT NULL GROUP BY mix_id, source"""
ORACLE["p9_shares"] = f"""WITH s AS (SELECT doc_id, i, hash(substring(text, i, {SPAN})) h FROM documents, unnest(range(1, length(text) - {SPAN} + 2)) u(i) WHERE length(text) >= {SPAN}),
    k AS (SELECT h FROM s GROUP BY h HAVING min(doc_id) < max(doc_id)),
    f AS (SELECT doc_id, least({SPAN}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {SPAN})) n FROM s JOIN k USING (h)),
    c AS (SELECT doc_id, sum(n)::BIGINT n FROM f GROUP BY 1)
    SELECT doc_id, length(text)::BIGINT chars, coalesce(n, 0) shared_chars, coalesce(n, 0) / length(text) AS share FROM documents LEFT JOIN c USING (doc_id) WHERE length(text) >= {SPAN}"""
ORACLE["p4_found"] = f"SELECT field_name, term, mark FROM ({ORACLE['p4_frequencies']}) WHERE mark IS NOT NULL"
