"""Ranking graphs by what they share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.operators.salted import heavy_keys
from graphweave.session import BROADCAST_ROWS, cut, lookup, parallelism

#: Share of the rows from which an item counts as hot, and the parts it is spread over.
HOT_SHARE, SALTS = 0.002, 32
#: Graphs (or queries) that meet in one group and their items, about; graphs below which a chunk isn't split for more tasks.
GROUP, GROUP_ITEMS, LEAST_CHUNK = 1 << 16, 1 << 22, 1 << 11
#: Rows of nodes and edges whose items one group finds, about, and the partitions a group of any kind gets, so that few groups share one.
ROWS, SPREAD = 1 << 19, 4
#: Items of a chunk that are kept as a row of zeros and ones at most, and the share of its graphs from which one is.
DENSE, DENSE_SHARE = 1024, 1 / 64


def features(triples: DataFrame, nodes: DataFrame, relations: bool = True) -> DataFrame:
    """(graph_id, item): the distinct labels of each graph and, with relations, its triples."""
    labels = nodes.select("graph_id", "label").distinct().select("graph_id", F.concat(F.lit("n|"), "label").alias("item"))
    if not relations:
        return labels
    links = triples.select("graph_id", F.concat_ws("|", F.lit("e"), "subj", "pos", "ref").alias("item")).distinct()
    return labels.unionByName(links)


def _found(schema: pa.Schema):
    """The items of a group of whole graphs from their rows as delivered: (graph_id, items)."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return schema.empty_table()
        graphs, g = np.unique(nodes.column("graph_id").to_numpy(), return_inverse=True)
        label, labels = _codes(nodes.column("label"))
        n_labels = len(labels) + 1
        named = label >= 0
        # an item's number: its place among the labels, or after these among the triples; a graph's items by graph and number
        held = np.unique(g[named] * n_labels + label[named])
        of, item = held // n_labels, held % n_labels
        names = pc.binary_join_element_wise(pa.scalar("n"), labels, "|")
        named &= nodes.column("node_id").is_valid().to_numpy()
        ids, at = np.unique(nodes.column("node_id").filter(pa.array(named)).to_numpy(), return_inverse=True)
        keys, k = np.unique(g[named] * len(ids) + at, return_inverse=True)
        kept = np.unique(k * n_labels + label[named])  # a node's labels, one after the other
        first, label = np.searchsorted(kept, np.arange(len(keys) + 1) * n_labels), kept % n_labels
        edges = edges.filter(pc.and_(edges.column("s").is_valid(), pc.and_(edges.column("r").is_valid(), edges.column("pos").is_valid())))
        if edges.num_rows and len(keys):
            eg, there = _find(graphs, edges.column("graph_id").to_numpy())
            ends = []
            for c in ("s", "r"):
                x, some = _find(ids, edges.column(c).to_numpy())
                x, is_node = _find(keys, eg * len(ids) + x)
                there &= some & is_node
                ends.append(x)
            pos, positions = _codes(edges.column("pos"))
            rank = np.empty(len(positions), np.int64)
            rank[np.argsort(np.array(positions.to_pylist(), object))] = np.arange(len(positions))
            loaded = edges.column("loaded_at").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()
            eg, s, r, pos, loaded = (x[there] for x in (eg, *ends, pos, loaded))
            order = np.lexsort((rank[pos], loaded, r, s))
            eg, s, r, pos = (x[order] for x in (eg, s, r, pos))
            last = np.append((s[1:] != s[:-1]) | (r[1:] != r[:-1]), np.ones(min(1, len(s)), bool))
            eg, s, r, pos = (x[last] for x in (eg, s, r, pos))
            many = first[r + 1] - first[r]
            n = (first[s + 1] - first[s]) * many  # each label of one end with each of the other
            edge = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
            subj, ref = label[first[s[edge]] + nth // many[edge]], label[first[r[edge]] + nth % many[edge]]
            triples, triple = np.unique((subj * len(positions) + pos[edge]) * n_labels + ref, return_inverse=True)
            linked = np.unique(eg[edge] * max(1, len(triples)) + triple)
            of, item = np.append(of, linked // max(1, len(triples))), np.append(item, len(labels) + linked % max(1, len(triples)))
            pair, ref = triples // n_labels, triples % n_labels
            words = [labels.take(pa.array(pair // len(positions))), positions.take(pa.array(pair % len(positions))), labels.take(pa.array(ref))]
            names = pa.concat_arrays([names, pc.binary_join_element_wise(pa.scalar("e"), *words, "|")])
        order = np.argsort(of, kind="stable")
        offsets = np.searchsorted(of[order], np.arange(len(graphs) + 1)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(item[order])))
        return pa.Table.from_arrays([pa.array(graphs, schema.field(0).type), found.cast(schema.field(1).type)], schema=schema)

    return run


def _codes(words: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(number of each row's word, -1 for none; the words)."""
    d = words.combine_chunks().dictionary_encode()
    return d.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _find(ordered: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of x in ordered, which isn't empty; whether it is there)."""
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return at, ordered[at] == x


def delivered_features(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, items): the set of items that features has of each graph, from rows as delivered: one row for each graph, also without items.

    nodes(graph_id, node_id, label) and edges(graph_id, s, r, pos, loaded_at) hold whole numbers as ids and normal forms, null
    where there is none. As in a collection, deliveries count once, of several positions between two nodes the last stays, ties
    to the greatest name, and edges without an end are left out. Rows are shuffled once, to groups of whole graphs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = dict(nodes.dtypes)["graph_id"]
    ddl = f"graph_id {kind}, items array<string>"
    groups = max(1, -(-(nodes.count() + edges.count()) // ROWS))
    group = F.pmod(F.xxhash64(F.col("graph_id").cast(kind)), F.lit(groups)).cast("int").alias("group")
    # a number of partitions is given, as AQE would unite the groups by their bytes
    sides = [x.where(F.col("graph_id").isNotNull()).select(group, *c).repartition(SPREAD * groups, "group").groupBy("group") for x, c in ((nodes, ("graph_id", "node_id", "label")), (edges, ("graph_id", "s", "r", "pos", "loaded_at")))]
    return sides[0].cogroup(sides[1]).applyInArrow(_found(to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def shared(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, graph_id, shared): number of items that a query shares with other graphs, where above 0; through an inverted index."""
    q = queries.select(F.col("graph_id").alias("query_id")).distinct()
    own = cut(items.join(q.withColumnRenamed("query_id", "graph_id"), "graph_id", "left_semi").select(F.col("graph_id").alias("query_id"), "item"))
    if own.count() <= BROADCAST_ROWS:  # each graph's items in one partition, so that the counts need no further shuffle
        met = items.repartition("graph_id").join(F.broadcast(own), "item")
    else:  # items that many graphs hold are spread over SALTS parts, each of which meets all queries with the item
        hot = F.broadcast(cut(heavy_keys(items, ["item"], HOT_SHARE).withColumn("hot", F.lit(True))))  # at most 1 / HOT_SHARE rows
        part = F.when(F.col("hot"), F.pmod(F.xxhash64("graph_id"), F.lit(SALTS))).otherwise(0)
        spread = items.join(hot, "item", "left").select("graph_id", "item", part.alias("part"))
        every = F.explode(F.sequence(F.lit(0), F.when(F.col("hot"), SALTS - 1).otherwise(0)))
        met = own.join(hot, "item", "left").select("query_id", "item", every.cast("bigint").alias("part")).join(spread, ["item", "part"])
    return met.where(F.col("query_id") != F.col("graph_id")).groupBy("query_id", "graph_id").agg(F.count(F.lit(1)).alias("shared"))


def _counts(graphs: pa.Table, queries: pa.Table):
    """(graph ids of the chunk in order, iterator of (query's row, its own place among them or their number, the items it shares with each of them)); the query itself shares 0."""
    order, at = np.unique(graphs.column("graph_id").to_numpy(), return_inverse=True)
    n = len(order)
    held = graphs.column("item").to_numpy()
    items, nth = np.unique(held[held >= 0], return_inverse=True)
    codes = np.unique(nth * n + at[held >= 0])  # an item of a graph counts once
    places = codes % n
    ends = np.searchsorted(codes, np.arange(len(items) + 1) * n)
    first, ends = ends[:-1], ends[1:]
    dense = np.argsort(first - ends, kind="stable")[:DENSE]
    dense = dense[(ends - first)[dense] >= n * DENSE_SHARE]
    asked = queries.column("items").combine_chunks()
    offsets, wanted = asked.offsets.to_numpy(), asked.values.to_numpy()
    most = int(np.diff(offsets).max(initial=0))
    width = np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32
    rows, row_of = np.zeros((len(dense), n), width), np.full(len(items) + 1, -1)
    for r, k in enumerate(dense):
        rows[r, places[first[k] : ends[k]]] = 1
    row_of[dense] = np.arange(len(dense))
    nth = np.searchsorted(items, wanted)
    known = np.append(items, -1)[nth] == wanted
    ids = queries.column("query_id").to_numpy()
    own = np.searchsorted(order, ids)
    own[order[np.minimum(own, n - 1)] != ids] = n

    def each():
        total = np.empty(n + 1, width)
        for q in range(len(ids)):
            part = slice(offsets[q], offsets[q + 1])
            met = nth[part][known[part]]
            total[:] = 0
            for k in met.tolist():
                if row_of[k] >= 0:
                    np.add(total[:n], rows[row_of[k]], out=total[:n])
                else:
                    total[places[first[k] : ends[k]]] += 1
            total[own[q]] = 0
            yield q, own[q], total[:n]

    return order, each()


def _places(schema: pa.Schema):
    """For each query and partner the graphs of a chunk that come before it: those that share more, or as much with a lower id."""

    def run(graphs: pa.Table, queries: pa.Table) -> pa.Table:
        if not graphs.num_rows or not queries.num_rows:
            return schema.empty_table()
        order, counts = _counts(graphs, queries)
        partners = queries.column("partners").combine_chunks()
        offsets, (partner, own) = partners.offsets.to_numpy(), (partners.values.field(x) for x in (0, 1))
        below, own = np.searchsorted(order, partner.to_numpy(zero_copy_only=False)), own.to_numpy().tolist()
        ahead = np.zeros(len(below), np.int64)
        for q, itself, total in counts:
            for i in range(offsets[q], offsets[q + 1]):
                ahead[i] = np.count_nonzero(total > own[i]) + np.count_nonzero(total[: below[i]] == own[i]) - (own[i] == 0 and itself < below[i])
        listed = slice(offsets[0], offsets[-1])
        ids = np.repeat(queries.column("query_id").to_numpy(), np.diff(offsets))
        return pa.Table.from_arrays([pa.array(ids, schema.field(0).type), partner[listed], pa.array(ahead[listed])], schema=schema)

    return run


def _best(schema: pa.Schema):
    """For each query the graph of a chunk that shares most with it, ties to the lower id; none where none shares."""

    def run(graphs: pa.Table, queries: pa.Table) -> pa.Table:
        if not graphs.num_rows or not queries.num_rows:
            return schema.empty_table()
        order, counts = _counts(graphs, queries)
        best, most = np.zeros(queries.num_rows, np.int64), np.zeros(queries.num_rows, np.int64)
        for q, _, total in counts:
            best[q] = total.argmax()
            most[q] = total[best[q]]
        some = most > 0
        ids = queries.column("query_id").to_numpy()[some]
        return pa.Table.from_arrays([pa.array(ids, schema.field(0).type), pa.array(order[best[some]], schema.field(1).type), pa.array(most[some])], schema=schema)

    return run


def _sets(items: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """(graph_id, items): the items of the graphs in ids, as a set; none for a graph without items."""
    own = lookup(items.where(F.col("item").isNotNull()), ids, ["graph_id"], n_ids, "left_semi")
    return cut(own.groupBy("graph_id").agg(F.collect_set("item").alias("items")))


def _meet(queries: DataFrame, sets: DataFrame, graphs: DataFrame, items: DataFrame, run: Callable, ddl: str) -> DataFrame:
    """run over each chunk of graphs with each block of queries: (graph_id, item), item -1 for the graph itself, and (query_id, items, other columns of queries); sets are _sets of the queries.

    Only counts of a query and a chunk leave a group, never a row for each graph that a query meets."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    queries = cut(queries.join(sets.withColumnRenamed("graph_id", "query_id"), "query_id", "left"))
    own = queries.select("query_id", F.explode("items").alias("item"))
    known = cut(own.select("item").distinct().withColumn("n", F.monotonically_increasing_id()))
    n_known = known.count()
    n_queries, n_own = (x or 0 for x in queries.agg(F.count(F.lit(1)), F.sum(F.size("items"))).first())
    n_graphs, n_items = graphs.count(), items.count()
    chunks = max(1, -(-n_graphs // GROUP), -(-n_items // GROUP_ITEMS), min(parallelism(items.sparkSession), n_graphs // LEAST_CHUNK))
    blocks = max(1, -(-n_queries // GROUP), -(-n_own // GROUP_ITEMS))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    numbers = lookup(own, known, ["item"], n_known).groupBy("query_id").agg(F.collect_list("n").alias("items"))
    asked = queries.drop("items").join(numbers, "query_id", "left").withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).select("*", every(chunks, "chunk"))
    held = lookup(items, known, ["item"], n_known).select("graph_id", F.col("n").alias("item")).unionByName(graphs.select("graph_id", F.lit(-1).cast("bigint").alias("item")))
    held = held.where(F.col("graph_id").isNotNull()).withColumn("chunk", F.pmod(F.xxhash64("graph_id"), F.lit(chunks)).cast("int")).select("*", every(blocks, "block"))
    # a number of partitions is given, as the groups are few rows with much to do
    sides = [x.repartition(SPREAD * chunks * blocks, "chunk", "block").groupBy("chunk", "block") for x in (held, asked)]
    return sides[0].cogroup(sides[1]).applyInArrow(run(to_arrow_schema(StructType.fromDDL(ddl))), ddl)


def ranks(queries: DataFrame, graphs: DataFrame, items: DataFrame, partners: DataFrame) -> DataFrame:
    """(query_id, partner_id, distance, place): 0-based place of each partner in the query's ranking of all other graphs.

    The distance is minus the number of shared items; ties rank by graph_id. Queries meet the other graphs in chunks, of
    which only counts come out. graphs and items are read several times: where they are dear to compute, give them cut."""
    graphs = graphs.select("graph_id").distinct()
    want = partners.select("query_id", "partner_id").distinct().where(F.col("query_id") != F.col("partner_id")).join(queries.select(F.col("graph_id").alias("query_id")), "query_id", "left_semi")
    for c in ("query_id", "partner_id"):
        want = want.join(graphs.withColumnRenamed("graph_id", c), c, "left_semi")
    want = cut(want)
    sets = _sets(items, want.select(F.explode(F.array("query_id", "partner_id")).alias("graph_id")).distinct(), 2 * want.count())
    mine, theirs = (sets.select(F.col("graph_id").alias(c), F.col("items").alias(name)) for c, name in (("query_id", "mine"), ("partner_id", "theirs")))
    own = F.when(F.col("mine").isNotNull() & F.col("theirs").isNotNull(), F.size(F.array_intersect("mine", "theirs"))).otherwise(0).cast("bigint")
    want = want.join(mine, "query_id", "left").join(theirs, "partner_id", "left").select("query_id", "partner_id", own.alias("own"))
    asked = want.groupBy("query_id").agg(F.collect_list(F.struct("partner_id", "own")).alias("partners"))
    types = dict(want.dtypes)
    counts = _meet(asked, sets, graphs, items, _places, f"query_id {types['query_id']}, partner_id {types['partner_id']}, ahead bigint")
    counts = counts.groupBy("query_id", "partner_id").agg(F.sum("ahead").cast("int").alias("place"))
    return want.join(counts, ["query_id", "partner_id"]).select("query_id", "partner_id", (-F.col("own")).alias("distance"), "place")


def mean_rank(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.avg("place").alias("mean_rank"), F.count(F.lit(1)).alias("n"))


def nearest(queries: DataFrame, graphs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, graph_id, distance): the other graph that shares most with each query, ties to the lower id; the first other graph if none shares."""
    ids, types = queries.select(F.col("graph_id").alias("query_id")).distinct(), dict(items.dtypes)
    best = _meet(ids, _sets(items, ids.withColumnRenamed("query_id", "graph_id"), ids.count()), graphs.select("graph_id").distinct(), items, _best, f"query_id {dict(ids.dtypes)['query_id']}, graph_id {types['graph_id']}, shared bigint")
    best = best.groupBy("query_id").agg(F.min_by(F.struct("graph_id", "shared"), F.struct(-F.col("shared"), F.col("graph_id"))).alias("b"))
    lowest = graphs.select("graph_id").distinct().orderBy("graph_id").limit(2).agg(F.array_sort(F.collect_list("graph_id")).alias("x"))
    out = ids.join(best, "query_id", "left").withColumn("x", lowest.scalar())
    other = F.when(F.col("x")[0] != F.col("query_id"), F.col("x")[0]).otherwise(F.get("x", F.lit(1)))
    return out.select("query_id", F.coalesce("b.graph_id", other).alias("graph_id"), F.coalesce(-F.col("b.shared"), F.lit(0).cast("bigint")).alias("distance")).where(F.col("graph_id").isNotNull())


def symmetric_pairs(pairs: DataFrame, a: str, b: str, known: DataFrame | None = None) -> DataFrame:
    """(query_id, partner_id): both directions of each pair once; with known, both ends must be among its graph_ids."""
    p = pairs.select(F.col(a).alias("query_id"), F.col(b).alias("partner_id"))
    p = p.unionByName(p.select(F.col("partner_id").alias("query_id"), F.col("query_id").alias("partner_id"))).where(F.col("query_id") != F.col("partner_id")).distinct()
    if known is not None:
        p = p.join(known.select(F.col("graph_id").alias("query_id")), "query_id", "left_semi").join(known.select(F.col("graph_id").alias("partner_id")), "partner_id", "left_semi")
    return p.select("query_id", "partner_id")
