import pytest
from pyspark.sql import functions as F

from graphweave.model import Graphs
from graphweave.operators import concepts, evaluate, matching, prs, prune
from graphweave.operators.keys import dense_ids
from graphweave.sources import graphs, images, relations


def small(spark):
    return Graphs(
        spark.createDataFrame([(1,), (2,)], "graph_id bigint"), spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b,c")], "graph_id bigint, node_id int, label string"),
        spark.createDataFrame([(1, 1, "on", 2), (2, 1, "by", 2), (2, 2, "by", 2)], "graph_id bigint, s int, pos string, r int"),
    )


def test_summary_round_trip(spark, tmp_path):
    p = prs.build(small(spark).triples())
    graphs.write_prs(p, str(tmp_path / "p"))
    key = ["subj", "ref", "pos", "n", "sup", "likelihood", "entropy"]
    assert sorted(map(tuple, graphs.read_prs(spark, str(tmp_path / "p")).select(key).collect())) == sorted(map(tuple, p.select(key).collect()))


def test_matrix_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0, 1.0), (1, 2, 0.5), (2, 0, 0.25)], "graph_id bigint, pattern_id bigint, v double")
    wide = matching.wide(cells, "v", [0, 1, 2])
    graphs.write_matrix(wide, str(tmp_path / "m"))
    back = graphs.read_matrix(spark, str(tmp_path / "m"), ["0", "1", "2"])
    assert sorted((x["graph_id"], int(x["pattern_id"]), x["v"]) for x in matching.long(back, "v").collect()) == [(1, 0, 1.0), (1, 2, 0.5), (2, 0, 0.25)]


def test_appended_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x;y")], "i int, t string")
    graphs.append_csv(df, str(tmp_path / "t"))
    graphs.append_csv(df, str(tmp_path / "t"))
    assert spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "t")).count() == 2


def test_patterns_file(spark, tmp_path):
    g = '{"directed": true, "multigraph": false, "graph": {"name": %d}, "nodes": [%s], "links": []}'
    (tmp_path / "s.json").write_text('[{"g": %s, "sup": 3}, {"g": %s, "sup": 9}]' % (g % (0, '{"id": 0, "label": "a"}'), g % (1, '{"id": 0, "label": "a"}, {"id": 1, "label": "b"}')))
    assert [x["sup"] for x in graphs.read_patterns(spark, str(tmp_path / "s.json")).collect()] == [9]


def test_subdue_text(spark):
    blocks = {x["graph_id"]: x["block"] for x in graphs.miner_text(small(spark), subdue=True).collect()}
    assert blocks[1].startswith("XP\nv 1 ") and blocks[2].count("\nu ") == 2
    assert graphs.miner_text(small(spark)).where("graph_id = 2").first()["block"].count("\ne ") == 1  # no self loops


def test_triples(spark, tmp_path):
    rows = [("/a", "/r/AtLocation", "/c/en/dog", "/c/en/park", '{"weight": 2.5, "surfaceText": "[[a dog]] is in [[a park]]"}'), ("/b", "/r/IsA", "/c/fr/chien", "/c/en/dog", "broken"), ("/c", "/r/IsA", "/c/en/dog/n", "/c/en/pet", "{}")]
    df = spark.createDataFrame(rows, "uri string, rel string, start string, end string, info string")
    relations.write_triples(df, str(tmp_path / "t"))
    en = concepts.named(concepts.english(relations.read_triples(spark, str(tmp_path / "t"))))
    got = sorted(map(tuple, en.select("rel", "start", "end", "weight").collect()), key=str)
    assert got == sorted([("AtLocation", "dog", "park", 2.5), ("IsA", "n", "pet", None)], key=str)
    assert [x["s"] for x in en.where("weight > 0").select(concepts.surface_position(F.col("surface"))[0].alias("s")).collect()] == ["a dog"]
    assert concepts.both_in(en, spark.createDataFrame([("dog",), ("park",)], "concept string")).count() == 1
    assert concepts.both_in(en, spark.createDataFrame([("pet",)], "concept string"), either=True).count() == 1
    assert concepts.related(en, "dog").count() == 1


def test_lists_maps_and_registry(spark, tmp_path):
    (tmp_path / "m.csv").write_text("3:sky, cloud\n4:sea\n")
    assert sorted(map(tuple, images.read_class_map(spark, str(tmp_path / "m.csv")).collect())) == [("3", "cloud"), ("3", "sky"), ("4", "sea")]
    (tmp_path / "train.txt").write_text("b.jpg\n\na\n")
    assert [x["name"] for x in images.read_split(spark, str(tmp_path), "train").collect()] == ["a", "b"]
    left = images.remaining(spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a",)], "name string"))
    assert [x["name"] for x in left.collect()] == ["b"]
    reg = images.class_registry(spark.createDataFrame([("coco", 9, "cup, mug"), ("coco", 2, "dog")], "source string, id int, name string"))
    assert sorted((x["class_id"], x["short"]) for x in reg.collect()) == [(1, "dog"), (2, "cup")]
    ann = spark.createDataFrame([(1, 5), (1, 6), (2, 6)], "image_id int, category_id int")
    assert images.annotations_of(ann, [5]).count() == 1
    assert images.list_files(spark, str(tmp_path), "*.txt").count() == 1


def test_captions(spark, tmp_path):
    for n, k in ((1, 10), (2, 20)):
        (tmp_path / f"c{n}.json").write_text('{"annotations": [{"image_id": %d, "caption": "a man skiing"}, {"image_id": %d, "caption": "a car driving and skiing"}]}' % (n, k))
    rows = images.read_captions(spark, [str(tmp_path / "c1.json"), str(tmp_path / "c2.json")], spark.createDataFrame([(1,), (10,), (20,)], "image_id bigint"))
    found = evaluate.caption_search(rows, "image_id", "caption", ["skiing", "driving"])
    assert sorted((x["image_id"], x["term"]) for x in found.collect()) == [(1, "skiing"), (10, "driving"), (10, "skiing"), (20, "driving"), (20, "skiing")]


def test_pairs_of_candidates(spark):
    df = spark.createDataFrame([([("img_000000000012.jpg",), ("img_000000000007.jpg",)],), ([("x.jpg",), ("2.jpg",)],)], "image_candidates array<struct<image_filename:string>>")
    assert [tuple(x) for x in relations.candidate_pairs(df).collect()] == [(12, 7)]


def test_small_graph_helpers(spark):
    g = small(spark)
    assert sorted(x["graph_id"] for x in prune.label_subset(g, ["a", "b"]).graphs.collect()) == [1]
    names = spark.createDataFrame([("wall-other-merged",), ("sky-merged",), ("dog",)], "n string").select(prune.clean_class(F.col("n")).alias("n"))
    assert [x["n"] for x in names.collect()] == ["wall", "sky", "dog"]
    even = prune.evenly_spaced(spark.range(1000), "id", 10).orderBy("id").collect()
    assert len(even) == 10 and (even[0]["id"], even[-1]["id"]) == (0, 999)
    assert prune.evenly_spaced(spark.range(5), "id", 10).count() == 5


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_dense_ids(spark, n):
    rows = dense_ids(spark.range(n).selectExpr("id * 7 % 5003 AS k"), [F.asc("k")], "i").orderBy("k").collect()
    assert [x["i"] for x in rows] == list(range(n))


def test_checkpoints_go_when_unused(spark):
    import gc
    import time
    from pathlib import Path

    from graphweave.session import checkpoint_dir, cut

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    kept = cut(spark.range(50).selectExpr("id * 2 AS x"))
    before = {p.name for p in folder.iterdir()}
    dropped = cut(spark.range(60))
    new = {p.name for p in folder.iterdir()} - before
    assert len(new) == 1
    del dropped
    for _ in range(40):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
        if not new & {p.name for p in folder.iterdir()}:
            break
    assert not new & {p.name for p in folder.iterdir()} and kept.agg({"x": "sum"}).first()[0] == 2450
