"""Preparing, splitting, training, selecting, scoring and explaining models, and their registry tables."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml import classification as MC, evaluation as ME, feature as MF, regression as MR
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from millrace.operators.condensed import Condensed, variants
from millrace.plans.joins import one_row
from millrace.plans.ranks import in_value_order, order_stats
from millrace.plans.runs import in_order, numbered
from millrace.plans.spread import dealt
from millrace.plans.topn import at_most, first_per_key
from millrace.session import cut

ROWS_PER_PIECE = 1 << 20  # that one task sorts
AT_ONCE = 8  # columns; each adds the model's steps to one plan


def preprocess(numeric: Sequence[str], categorical: Sequence[str] = (), output: str = "features") -> list:
    """Pipeline stages: median and mode imputing, one-hot with unknowns kept apart, scaling without centring."""
    stages: list = []
    parts = []
    if numeric:
        filled = [f"{c}__filled" for c in numeric]
        stages += [
            MF.Imputer(strategy="median", inputCols=list(numeric), outputCols=filled),
            MF.VectorAssembler(inputCols=filled, outputCol="_numeric", handleInvalid="keep"),
            MF.StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=False, withStd=True),
        ]
        parts.append("_scaled")
    if categorical:
        codes, flags = [f"{c}__code" for c in categorical], [f"{c}__flag" for c in categorical]
        stages += [
            MF.StringIndexer(inputCols=list(categorical), outputCols=codes, handleInvalid="keep", stringOrderType="frequencyDesc"),
            MF.OneHotEncoder(inputCols=codes, outputCols=flags, handleInvalid="keep", dropLast=False),
        ]
        parts += flags
    return [*stages, MF.VectorAssembler(inputCols=parts, outputCol=output)]


def fill_modes(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Nulls of text columns replaced by the most frequent value (the smaller one on ties)."""
    for c in categorical:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        mode = counts.agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias("m")).scalar()
        df = df.withColumn(c, F.coalesce(c, mode))
    return df


def stratified_split(df: DataFrame, key: str, label: str | None = None, share: float = 0.2) -> DataFrame:
    """Adds ``is_test``: the first ``floor(n * share)`` rows per class in the order of a hash of the key.

    The cut-off hash of each class is an exact order statistic, so no class is sorted in one task. The
    key must be unique.
    """
    hashed = df.withColumn("_h", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("bigint"))
    keys = [label] if label else []
    cut = order_stats(hashed, "_h", {"cut": lambda n: F.floor(n * F.lit(share))}, keys)
    if not label:
        return hashed.withColumn("is_test", F.coalesce(F.col("_h") <= one_row(cut)["cut"], F.lit(False))).drop("_h")
    from millrace.plans.joins import salted_join

    tagged = salted_join(hashed, cut.select(label, "cut"), [label], ["_h"], "left")
    return tagged.withColumn("is_test", F.coalesce(F.col("_h") <= F.col("cut"), F.lit(False))).drop("_h", "cut")


@dataclass(frozen=True)
class Candidate:
    name: str
    estimator: object
    grid: Mapping[str, Sequence] | None = None


def candidates(problem: str, features: str = "features", label: str = "label", seed: int = 42) -> list[Candidate]:
    """The model families that Spark trains on a cluster, with small grids."""
    common = {"featuresCol": features, "labelCol": label}
    if problem == "regression":
        return [
            Candidate("ridge", MR.LinearRegression(elasticNetParam=0.0, maxIter=50, **common), {"regParam": [0.1, 1.0]}),
            Candidate("lasso", MR.LinearRegression(elasticNetParam=1.0, maxIter=50, **common), {"regParam": [0.01, 0.1]}),
            Candidate("elasticnet", MR.LinearRegression(elasticNetParam=0.5, maxIter=50, **common), {"regParam": [0.01, 0.1]}),
            Candidate("decision_tree", MR.DecisionTreeRegressor(seed=seed, **common), {"maxDepth": [4, 8]}),
            Candidate("random_forest", MR.RandomForestRegressor(seed=seed, numTrees=20, **common), {"maxDepth": [4, 8]}),
            Candidate("gbt", MR.GBTRegressor(seed=seed, maxIter=10, **common), {"maxDepth": [3, 5]}),
        ]
    return [
        Candidate("logistic_regression", MC.LogisticRegression(maxIter=50, **common), {"regParam": [0.0, 0.1]}),
        Candidate("decision_tree", MC.DecisionTreeClassifier(seed=seed, **common), {"maxDepth": [4, 8]}),
        Candidate("random_forest", MC.RandomForestClassifier(seed=seed, numTrees=20, **common), {"maxDepth": [4, 8]}),
        Candidate("gbt", MC.GBTClassifier(seed=seed, maxIter=10, **common), {"maxDepth": [3, 5]}),
        Candidate("linear_svc", MC.LinearSVC(maxIter=20, **common), {"regParam": [0.0, 0.1]}),
    ]


def network(layers: Sequence[int], features: str = "features", label: str = "label", seed: int = 42, iterations: int = 30) -> MC.MultilayerPerceptronClassifier:
    """Dense classifier; ``layers`` runs from the number of inputs to the number of classes."""
    return MC.MultilayerPerceptronClassifier(layers=list(layers), featuresCol=features, labelCol=label, seed=seed, maxIter=iterations)


def evaluator(problem: str, label: str = "label") -> ME.Evaluator:
    if problem == "regression":
        return ME.RegressionEvaluator(labelCol=label, metricName="rmse")
    return ME.MulticlassClassificationEvaluator(labelCol=label, metricName="f1")


def select_model(train: DataFrame, test: DataFrame, stages: Sequence, pool: Sequence[Candidate], problem: str, label: str = "label",
                 folds: int = 5, use_grid: bool = True, parallelism: int = 4) -> tuple[DataFrame, PipelineModel, str]:
    """Cross-validates every candidate, scores it on the test rows, and keeps the best by test score.

    Both sides are dealt out over all cores and written once to the shared folder, preprocessing is fitted once. Regressions whose
    fit depends on the rows only through moments or cells are fitted and validated on those; for the others the
    prepared rows, of which only the columns that a candidate names, are cached for the folds. A candidate that fails is skipped. Returns the leaderboard, the fitted
    pipeline and the winner's name.
    """
    train, test = cut(dealt(train), "train"), cut(dealt(test), "test")
    judge = evaluator(problem, label)
    prepared = Pipeline(stages=list(stages)).fit(train)
    named = {c.estimator.getOrDefault(p) for c in pool for p in c.estimator.params if p.name.endswith("Col") and c.estimator.isDefined(p)} | {label}
    ready_train, ready_test = (df.select(*[c for c in df.columns if c in named]) for df in (prepared.transform(train), prepared.transform(test)))
    condensed = Condensed(ready_train, pool[0].estimator.getFeaturesCol(), label, folds) if problem == "regression" and pool else None
    ready_train, ready_test, board, best = ready_train.cache(), ready_test.cache(), [], None  # the first is filled by fits on rows only
    try:
        for c in pool:
            grid = ParamGridBuilder()
            for name, values in (c.grid or {}).items() if use_grid else ():
                grid = grid.addGrid(c.estimator.getParam(name), list(values))
            try:
                each = variants(c.estimator, grid.build())
                if condensed and condensed.fits(each):
                    model, metrics = condensed.cross_validate(each, judge, parallelism)
                else:
                    cv = CrossValidator(estimator=c.estimator, estimatorParamMaps=grid.build(), evaluator=judge, numFolds=folds, parallelism=parallelism, seed=42)
                    fitted = cv.fit(ready_train)
                    model, metrics = fitted.bestModel, fitted.avgMetrics
                score = judge.evaluate(model.transform(ready_test))
            except Exception as failure:  # noqa: BLE001 - any failing candidate is reported and skipped
                board.append((c.name, None, None, str(failure).splitlines()[0][:200]))
                continue
            pick = (max if judge.isLargerBetter() else min)(metrics)
            board.append((c.name, float(score), float(pick), None))
            better = best is None or (score > best[1] if judge.isLargerBetter() else score < best[1])
            if better:
                best = (c.name, score, model)
    finally:
        ready_train.unpersist()
        ready_test.unpersist()
        if condensed:
            condensed.close()
    if best is None:
        raise RuntimeError(f"every candidate failed: {board}")
    frame = train.sparkSession.createDataFrame(board, "model string, score double, cv_score double, error string")
    return frame, PipelineModel(stages=[*prepared.stages, best[2]]), best[0]


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: rmse, mae, r2."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    mean = df.agg(F.avg(y).alias("m")).scalar()
    total = F.sum((y - F.col("_mean")) * (y - F.col("_mean")))
    sums = df.withColumn("_mean", mean).agg(F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.sum((y - p) * (y - p)).alias("res"), total.alias("tot"))
    return sums.select(F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide("res", "tot")).alias("r2"))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and F1 weighted by class size, from the confusion counts."""
    cells = df.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).cast("bigint").alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("hit")),
    )
    per = cells.select(F.explode(sides).alias("e")).select("e.*").groupBy("c").agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    f1 = 2.0 * F.col("hit") / (F.col("actual") + F.col("guessed"))
    return per.agg((F.sum("hit") / F.sum("actual")).alias("accuracy"), (F.sum(f1 * F.col("actual")) / F.sum("actual")).alias("f1"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: area under the ROC curve of a 0/1 label, ties counted half.

    Scores are counted per distinct value, and the running count of negatives goes over ranges of them.
    """
    counts = df.groupBy(F.col(score).alias("_v")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = in_value_order(counts, {"below": F.col("neg")})
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    return ranked.agg((wins / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def one_vs_rest_auc(df: DataFrame, label: str, scores: Mapping[str, str]) -> DataFrame:
    """Mean AUC over classes; ``scores`` maps a class to its score column."""
    parts = [roc_auc(df.select((F.col(label).cast("string") == c).cast("int").alias("y"), F.col(s).alias("s")), "y", "s") for c, s in scores.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).agg(F.avg("auc").alias("auc"))


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """Slot names of an assembled vector, from the column's metadata."""
    attrs = df.schema[column].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name for _, name in slots]


def feature_importance(model: Model, names: Sequence[str], spark) -> DataFrame:
    """Rows (feature, importance), tree importances or mean absolute coefficients, largest first."""
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficientMatrix"):
        matrix = model.coefficientMatrix.toArray()
        weights = abs(matrix).mean(axis=0).tolist()
    else:
        weights = abs(model.coefficients.toArray()).tolist()
    rows = list(zip(names, (float(w) for w in weights)))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def redealt(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Adds, for each column, ``_new_<column>``: its values in hash order of the key, paired with the rows in key order.

    Both orders are numbered once, whatever the number of columns. The numbers meet in pieces of a bounded number of rows.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_PIECE))
    placed = in_order(df, key, F.floor(F.col(key) / 100_000), parts, "_at")
    values = df.select(F.xxhash64(F.col(key)).alias("_h"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    mixed_up = in_order(values, "_h", F.shiftright("_h", 50), parts, "_at").drop("_h")
    return placed.repartition(parts, "_at").join(mixed_up.repartition(parts, "_at"), "_at").drop("_at")


def permutation_importance(df: DataFrame, model: PipelineModel, columns: Sequence[str], problem: str, key: str, label: str = "label") -> DataFrame:
    """Loss of score when a column's values are dealt out anew: rows (feature, importance).

    Values are re-dealt by pairing rows in key order with values in hash order. One pass over the pairs predicts for up to ``AT_ONCE``
    columns; only the predictions are written, for the evaluator.
    """
    judge = evaluator(problem, label)
    base = judge.evaluate(model.transform(df))
    rows = []
    for some in (columns[i:i + AT_ONCE] for i in range(0, len(columns), AT_ONCE)):
        pairs = redealt(df, some, key).withColumns({f"_old_{c}": F.col(c) for c in some})
        for c in some:
            mixed = pairs.withColumns({x: F.col(f"_new_{x}" if x == c else f"_old_{x}") for x in some})
            pairs = model.transform(mixed).select(*pairs.columns, F.col("prediction").alias(f"_told_{c}"))
        told = cut(pairs.select(label, *[f"_told_{c}" for c in some]), "predictions")
        for c in some:
            score = judge.evaluate(told, {judge.predictionCol: f"_told_{c}"})
            rows.append((c, float(base - score if judge.isLargerBetter() else score - base)))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def explain_linear(df: DataFrame, coefficients: Mapping[str, float], key: str, limit: int | None = None) -> DataFrame:
    """Exact contributions of a linear model, coefficient * (value - mean): rows (key, feature, contribution)."""
    means = one_row(df.agg(*[F.avg(c).alias(c) for c in coefficients]))
    shown = df if limit is None else df.orderBy(key).limit(limit)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), (F.lit(float(w)) * (F.col(c) - means[c])).alias("contribution")) for c, w in coefficients.items()])
    return shown.select(key, F.explode(parts).alias("e")).select(key, "e.*")


def missing_features(df: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def predict(model: PipelineModel, df: DataFrame, needed: Sequence[str], labels: Sequence[str] | None = None, probabilities: bool = False) -> DataFrame:
    """Scores a table; checks the features first, decodes labels, optionally adds class probabilities."""
    gone = missing_features(df, needed)
    if gone:
        raise ValueError(f"missing features: {', '.join(gone)}")
    out = model.transform(df)
    keep = [*df.columns, "prediction"]
    if labels:
        out = out.withColumn("predicted_label", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1))
        keep.append("predicted_label")
    if probabilities and "probability" in out.columns:
        from pyspark.ml.functions import vector_to_array

        out = out.withColumn("probabilities", vector_to_array("probability"))
        keep.append("probabilities")
    return out.select(*keep)


def register_versions(models: DataFrame, name: str = "model_name", created: str = "created_at", tie: str = "model_id") -> DataFrame:
    """Adds ``version`` per model name in order of creation."""
    return numbered(models, [name], [created, tie], F.date_trunc("month", created), "version")


def promote(registry: DataFrame, changes: DataFrame, name: str = "model_name") -> DataFrame:
    """Applies promotions (name, version, stage, at): every version has the stage of its newest promotion, or is archived
    if another version was promoted to that stage later."""
    newest = first_per_key(changes, [name, "version"], ["at"], latest=True).select(name, "version", F.col("stage").alias("_asked"))
    holder = first_per_key(changes, [name, "stage"], ["at", "version"], latest=True)
    holder = holder.select(name, F.col("version").alias("_holder"), F.col("stage").alias("_asked"))
    staged = registry.join(newest, [name, "version"], "left").join(holder, [name, "_asked"], "left")
    stage = F.when(F.col("_asked").isNull(), "none").when(F.col("_holder") == F.col("version"), F.col("_asked")).otherwise("archived")
    return staged.select(*[c for c in registry.columns if c != "stage"], stage.alias("stage"))


def resolve_stage(registry: DataFrame, stage: str, name: str = "model_name") -> DataFrame:
    return first_per_key(registry.where(F.col("stage") == stage), [name], ["version"], latest=True)


def fold_runs(events: DataFrame, run: str = "run_id", at: str = "at") -> DataFrame:
    """Run events (run, at, kind, key, value) folded to the latest value per kind and key."""
    return first_per_key(events, [run, "kind", "key"], [at], latest=True)


def run_list(folded: DataFrame, run: str = "run_id", at: str = "at", limit: int | None = None) -> DataFrame:
    """One row per run, newest first: maps of metrics, params and tags; keys are few per run."""
    def held(kind: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "value"))))
        return F.map_from_entries(pairs)

    out = folded.groupBy(run).agg(*[held(k).alias(k + "s") for k in ("metric", "param", "tag")], F.max(at).alias(at))
    return at_most(out.orderBy(F.desc(at), run), limit)


def model_list(meta: DataFrame, registry: DataFrame, tag: str | None = None, problem: str | None = None, page: int = 1, per_page: int = 20) -> DataFrame:
    """Model cards: registry values fill what the metadata lacks; filtered by tag and problem, newest first."""
    from millrace.operators.joins import enriched
    from millrace.operators.scopes import sorted_page

    out = enriched(meta, registry, ["model_id"], [c for c in registry.columns if c != "model_id"])
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if problem is not None:
        out = out.where(F.col("problem") == problem)
    return sorted_page(out, ["-created_at", "model_id"], page, per_page)
