"""The classifier of relative positions: data sets, model selection, measures, the final model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweave.session import cut

#: Rows of a labelled sample at most, where each task gets all of it.
SAMPLE_ROWS = 10_000


def confusion_table(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n)."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(table: DataFrame) -> DataFrame:
    """(label, precision, recall, f1) of each class in truth or predictions; 0 where undefined."""
    t = table.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    p = table.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("p"))
    zero = F.lit(0.0)
    out = t.join(p, "label", "full").na.fill(0, ["t", "p", "hit"])
    out = out.withColumns({"precision": F.coalesce(F.try_divide(F.col("hit"), F.col("p")), zero), "recall": F.coalesce(F.try_divide(F.col("hit"), F.col("t")), zero)})
    return out.select("label", "precision", "recall", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero).alias("f1"))


def macro_f1(table: DataFrame) -> float:
    return float(class_scores(table).agg(F.avg("f1")).first()[0] or 0.0)


class MacroF1(Evaluator):
    """Unweighted mean of the classes' F1."""

    def __init__(self, label: str = "__y", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return macro_f1(confusion_table(dataset, self.label, self.prediction))

    def isLargerBetter(self) -> bool:
        return True


def balanced_sample(df: DataFrame, label: str, order: str, n: int = 60, seed: int = 1) -> DataFrame:
    """The first n rows by order of each label, in a seeded random order."""
    top = df.withColumn("__k", F.row_number().over(Window.partitionBy(label).orderBy(order))).where(F.col("__k") <= n).drop("__k")
    return top.orderBy(F.xxhash64(order, F.lit(seed)), order)


def side_only(df: DataFrame, counters: list[str], most: float = 0.1) -> DataFrame:
    """Pairs that hardly share columns: the sum of their counters is at most 0.1."""
    total = F.lit(0.0)
    for c in counters:
        total = total + F.col(f"`{c}`")
    return df.where(total <= most)


def new_images(candidates: DataFrame, known: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """One random pair (seeded) of each of n images that aren't known, by image_id."""
    fresh = candidates.join(known.select("image_id").distinct(), "image_id", "left_anti")
    draw = F.struct(F.xxhash64("image_id", "i", "j", F.lit(seed)), F.col("i"), F.col("j"))
    one = fresh.groupBy("image_id").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "image_id"]), draw).alias("x"))
    return one.orderBy("image_id").limit(n).select("image_id", "x.*")


def relabel(df: DataFrame, changes: DataFrame, keys: list[str], label: str) -> DataFrame:
    """df with labels replaced by changes (keys, new); a null new label discards the row."""
    c = changes.select(*keys, F.col("new").alias("__new"), F.lit(True).alias("__hit"))
    out = df.join(c, keys, "left").where(F.col("__hit").isNull() | F.col("__new").isNotNull())
    return out.withColumn(label, F.coalesce("__new", label)).drop("__new", "__hit").select(df.columns)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _prepare(features: list[str], label: str) -> list:
    return [VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="keep"), StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc")]


def select_model(
    df: DataFrame, features: list[str], label: str, folds: int = 10, seed: int = 1, depths: tuple[int, ...] = (5, 10, 15, 20, 25, 30), trees: tuple[int, ...] = (10, 15, 20, 25, 30, 35, 40, 45, 50),
    neighbours: tuple[int, ...] = (5, 10, 15), key: str | None = None,
) -> DataFrame:
    """(model, params, macro_f1) by cross-validation: nearest neighbours (with a key column), decision trees, random forests, and linear SVMs one
    against the rest in place of kernel SVMs. Trees reach the engine's greatest depth, 30."""
    prep = Pipeline(stages=_prepare(features, label)).fit(df)
    data = cut(prep.transform(df).select("__x", "__y"))
    dt, rf = DecisionTreeClassifier(featuresCol="__x", labelCol="__y", seed=seed), RandomForestClassifier(featuresCol="__x", labelCol="__y", seed=seed)
    svc = OneVsRest(classifier=LinearSVC(featuresCol="__x", labelCol="__y", maxIter=20), featuresCol="__x", labelCol="__y")
    grids = {
        "tree": (dt, ParamGridBuilder().addGrid(dt.maxDepth, list(depths)).build()),
        "forest": (rf, ParamGridBuilder().addGrid(rf.maxDepth, list(depths)).addGrid(rf.numTrees, list(trees)).build()),
        "svm": (svc, ParamGridBuilder().build()),
    }
    rows = []
    if key is not None:
        fold = cut(df.select(key, label, *features).withColumn("__fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds))))
        for k in neighbours:
            parts = [nearest_neighbours(fold.where(F.col("__fold") != i), fold.where(F.col("__fold") == i), key, features, label, k) for i in range(folds)]
            scores = [macro_f1(confusion_table(fold.join(p, key), label, "predicted")) for p in parts]
            rows.append(("knn", f"k={k}", float(np.mean(scores))))
    for name, (model, grid) in grids.items():
        cv = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=MacroF1(), numFolds=folds, seed=seed, parallelism=2).fit(data)
        for params, score in zip(grid, cv.avgMetrics):
            rows.append((name, ", ".join(f"{p.name}={v}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name)), float(score)))
    return df.sparkSession.createDataFrame(rows, "model string, params string, macro_f1 double")


def nearest_neighbours(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str, k: int) -> DataFrame:
    """(key, predicted): majority of the k nearest rows of a labelled sample of at most SAMPLE_ROWS, itself left out; ties of distance to the
    lower key, of votes to the lower label.

    With test = train this is the leave-one-out prediction. The sample goes to each task as a matrix; no join."""
    rows = train.select(key, label, *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]).orderBy(key).limit(SAMPLE_ROWS + 1).toPandas()
    if len(rows) > SAMPLE_ROWS:
        raise ValueError(f"a labelled sample of at most {SAMPLE_ROWS} rows")
    names = np.array(sorted(rows[label].dropna().unique()))
    shared = train.sparkSession.sparkContext.broadcast((rows[key].to_numpy(), rows[[f"f{i}" for i in range(len(features))]].to_numpy(float), np.searchsorted(names, rows[label].to_numpy()) if len(rows) else np.zeros(0, int), names))
    kinds = {f.name: f.dataType.simpleString() for f in (test.schema[key], train.schema[label])}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, points, codes, classes = shared.value
        for pdf in frames:
            own, x = pdf[key].to_numpy(), pdf.drop(columns=[key]).to_numpy(float)
            picked = np.full(len(own), -1)
            for at in range(0, len(own), 512):
                d = ((x[at : at + 512, None] - points[None]) ** 2).sum(axis=2)
                d[own[at : at + 512, None] == keys[None]] = np.inf
                near = np.argsort(d, axis=1, kind="stable")[:, :k]  # the sample is in order of its keys
                votes = np.zeros((len(near), len(classes)), int)
                np.add.at(votes, (np.arange(len(near))[:, None], codes[near]), np.isfinite(np.take_along_axis(d, near, axis=1)))
                picked[at : at + 512] = np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), -1) if len(classes) else -1
            ok = picked >= 0
            if ok.any():
                yield pd.DataFrame({key: own[ok], "predicted": classes[picked[ok]]})

    rows = test.select(key, *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    return rows.mapInPandas(run, f"`{key}` {kinds[key]}, predicted {kinds[label]}")


def leave_one_out(df: DataFrame, key: str, features: list[str], label: str, model: str, params: dict[str, int], seed: int = 1) -> DataFrame:
    """(key, predicted): each row of a labelled sample predicted by the model fitted to all others; a fit a row, so meant for samples.

    model is knn (k), tree (maxDepth), forest (maxDepth, numTrees) or svm."""
    if model == "knn":
        return nearest_neighbours(df, df, key, features, label, params["k"])
    data = cut(df.select(key, label, *features))
    keys = [r[0] for r in data.select(key).distinct().orderBy(key).limit(SAMPLE_ROWS + 1).collect()]
    if len(keys) > SAMPLE_ROWS:
        raise ValueError(f"a labelled sample of at most {SAMPLE_ROWS} rows")
    out = None
    for k in keys:
        rest, one = data.where(F.col(key) != F.lit(k)), data.where(F.col(key) == F.lit(k))
        stages = _prepare(features, label)
        indexer = stages[1].fit(rest)
        fitted = Pipeline(stages=[stages[0], indexer, _model(model, params, seed)]).fit(rest)
        # a label that only this row has can't be predicted
        got = fitted.transform(one.withColumn(label, F.lit(indexer.labels[0]).cast(df.schema[label].dataType)))
        names = F.array(*[F.lit(x) for x in indexer.labels])
        got = got.select(key, F.element_at(names, F.col("prediction").cast("int") + 1).cast(df.schema[label].dataType).alias("predicted"))
        out = got if out is None else out.unionByName(got)
    return out


def _model(name: str, params: dict, seed: int):
    common = {"featuresCol": "__x", "labelCol": "__y"}
    if name == "tree":
        return DecisionTreeClassifier(seed=seed, **common, **params)
    if name == "forest":
        return RandomForestClassifier(seed=seed, **common, **params)
    if name == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=20, **common), **common)
    raise ValueError(f"unknown model {name}")


def final_model(df: DataFrame, features: list[str], label: str, depth: int = 10, trees: int = 35, seed: int = 1) -> PipelineModel:
    """Random forest over the features; transform adds predicted_label."""
    stages = _prepare(features, label)
    indexer = stages[1].fit(df)
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", maxDepth=depth, numTrees=trees, seed=seed)
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=indexer.labels)
    return Pipeline(stages=[stages[0], indexer, forest, back]).fit(df)


def class_map(source: Column, first: dict, second: dict, other: str = "other") -> Column:
    """Class by the first mapping that has it, then the second, then the rest class."""
    at = lambda m: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), source) if m else F.lit(None)
    return F.coalesce(at(first), at(second), F.lit(other))
