"""Training and scoring: linear models and forests of MLlib, forests of ``bagged``, boosted trees of ``boost``.

Preprocessing is fitted on training rows and kept as pipeline stages (SQL
expressions plus a vector assembler), so it is saved with the model and stays
in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casesignal.bounds import few_values
from casesignal.operators import evaluate, labels, prep, trees
from casesignal.plans import bagged, boost
from casesignal.session import stored

FEATURES = "features"
WEIGHT = "__weight"
#: A category of more values is one sparse vector, not a column for each value.
WIDE = 1_000


@dataclass(frozen=True)
class FeatureSet:
    """Chosen columns: numbers, categories, and an optional bits column."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    bits: str | None = None
    nbits: int = 1024


def choose_features(
    df: DataFrame, exclude: Sequence[str], candidates: Sequence[str] | None = None
) -> FeatureSet:
    """By column type, or those of a candidate list that exist.

    All-null numbers and one-valued categories are left out.
    """
    numeric, categorical = prep.numeric_columns(df, exclude), prep.text_columns(df, exclude)
    if candidates is not None:
        numeric = [c for c in candidates if c in numeric]
        categorical = [c for c in candidates if c in categorical]
    return FeatureSet(*(tuple(c) for c in prep.usable_features(df, numeric, categorical)))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class Preparation:
    """Fitted preprocessing: pipeline stages and the names of the features."""

    stages: list
    names: list[str] = field(default_factory=list)
    # Most values of an indexed category, unseen ones included.
    categories: int = 0

    def pipeline(self) -> PipelineModel:
        return PipelineModel(self.stages)


def fit_preparation(
    train: DataFrame,
    features: FeatureSet,
    fill: str = "median",
    scaling: str | None = None,
    encode: str = "onehot",
    exact: bool = True,
) -> Preparation:
    """Fit imputation, scaling and encoding on the training rows.

    ``fill``: median or zero. ``scaling``: None, 'std' (divide only) or
    'standard' (centre and divide), on imputed values. ``encode``: 'onehot'
    columns, or 'index' for trees that split on category subsets. One-hot
    categories of more than ``WIDE`` values become sparse vectors; their values
    are part of the model, like the coefficient that each of them gets. Unseen
    values are all zero.
    """
    numeric, categorical = list(features.numeric), list(features.categorical)
    filled = (
        prep.as_dict(prep.medians(train, numeric, exact)) if fill == "median" and numeric else {}
    )
    fills = {c: float(filled.get(c) or 0.0) for c in numeric}
    imputed = prep.impute(
        train.select(*[F.col(c).cast("double").alias(c) for c in numeric]), fills
    )
    stats = prep.scale_stats(imputed, numeric) if scaling and numeric else {}

    exprs, names = [], []
    for i, c in enumerate(numeric):
        value = f"coalesce(cast({_quoted(c)} as double), {fills[c]!r}D)"
        if scaling:
            mean, std = stats[c]
            shift = f" - ({mean!r}D)" if scaling == "standard" else ""
            value = f"({value}{shift}) / {std!r}D"
        exprs.append(f"{value} AS __n{i}")
        names.append(c)
    inputs = [f"__n{i}" for i in range(len(numeric))]

    modes = prep.as_dict(prep.most_frequent(train, categorical)) if categorical else {}
    indexers, sparse = [], []
    for i, c in enumerate(categorical):
        value = f"coalesce({_quoted(c)}, {_text(modes[c])})"
        if encode == "index":
            exprs.append(f"{value} AS __t{i}")
            indexer = StringIndexer(inputCol=f"__t{i}", outputCol=f"__c{i}", handleInvalid="keep")
            seen = train.select(F.coalesce(c, F.lit(modes[c])).alias(f"__t{i}"))
            indexers.append(indexer.fit(seen))
            inputs.append(f"__c{i}")
            names.append(c)
        else:
            few = few_values(train, c, WIDE)
            if few is None:
                exprs.append(f"{value} AS __t{i}")
                seen = train.select(F.coalesce(c, F.lit(modes[c])).alias(f"__t{i}"))
                found = StringIndexer(inputCol=f"__t{i}", outputCol=f"__c{i}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(seen)
                # The last index is that of unseen values, and is dropped.
                sparse += [found, OneHotEncoder(inputCol=f"__c{i}", outputCol=f"__v{i}").fit(found.transform(seen.limit(1)))]
                inputs.append(f"__v{i}")
                few = found.labels
            else:
                inputs += [f"__o{i}_{j}" for j in range(len(few))]
                exprs += [f"cast({value} = {_text(v)} as double) AS __o{i}_{j}" for j, v in enumerate(few)]
            names += [f"{c}_{v}" for v in few]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"), *indexers, *sparse]
    if features.bits:
        as_text = f"transform({_quoted(features.bits)}, b -> cast(b as string)) AS __bit_text"
        stages.append(SQLTransformer(statement=f"SELECT *, {as_text} FROM __THIS__"))
        stages.append(prep.bits_vector(features.nbits, "__bit_text", "__bits"))
        inputs.append("__bits")
        names += [f"FP{i}" for i in range(features.nbits)]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return Preparation(stages, names, max([0, *(len(i.labels) + 1 for i in indexers)]))


def prepared(df: DataFrame, preparation: Preparation, keep: Sequence[str]) -> DataFrame:
    """Kept columns and the feature vector."""
    return preparation.pipeline().transform(df).select(*keep, FEATURES)


# Estimators. Defaults are the published settings of each model.


def logistic(c: float = 1.0, max_iter: int = 2000) -> LogisticRegression:
    """L2 logistic regression with penalty 1/C.

    MLlib averages the loss over the weights while the penalty 1/C goes with
    their sum: ``fit`` divides the penalty by the weights of its rows.
    """
    return LogisticRegression(
        featuresCol=FEATURES, weightCol=WEIGHT, maxIter=max_iter,
        regParam=1.0 / c, elasticNetParam=0.0, standardization=False,
    )


def forest(trees: int = 400, min_leaf: int = 2, depth: int = 30, seed: int = 42, max_bins: int = 64) -> RandomForestClassifier:
    return RandomForestClassifier(
        featuresCol=FEATURES, weightCol=WEIGHT, numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, featureSubsetStrategy="sqrt", seed=seed, maxBins=max_bins,
    )


def weighted(df: DataFrame, y: str, scheme: str) -> DataFrame:
    """Row weights: balanced classes, neg/pos on positives, or none."""
    if scheme == "balanced":
        return prep.with_class_weight(df, y, WEIGHT)
    if scheme == "positive":
        weight = prep.positive_weight(df, y).first()[0]
        return df.withColumn(WEIGHT, F.when(F.col(y) == 1, F.lit(float(weight or 1.0))).otherwise(1.0))
    return df.withColumn(WEIGHT, F.lit(1.0))


def fit(estimator: Estimator, train: DataFrame, y: str, scheme: str = "balanced", categories: int = 0):
    """Fit on rows that carry the feature vector and a 0/1 label.

    ``categories``: most values of a category; trees get as many bins.
    """
    rows = weighted(train, y, scheme)
    more = {estimator.labelCol: y}
    if isinstance(estimator, LogisticRegression):
        total = rows.agg(F.sum(WEIGHT)).first()[0]
        more[estimator.regParam] = estimator.getRegParam() / max(float(total or 0), 1.0)
    elif categories > estimator.getMaxBins():
        more[estimator.maxBins] = categories
    return estimator.copy(more).fit(rows)


def scores(model, df: DataFrame, keep: Sequence[str], out: str = "score") -> DataFrame:
    """Probability of class 1 next to the kept columns."""
    return model.transform(df).select(
        *keep, vector_to_array("probability").getItem(1).alias(out)
    )


def rescaled_scores(df: DataFrame, raw: str, out: str = "score") -> DataFrame:
    """Raw scores onto [0, 1] by their range, for models without probability."""
    span = df.agg(F.struct(F.min(raw).alias("low"), F.max(raw).alias("high")).alias("s")).scalar()
    low, high = span["low"], span["high"]
    return df.withColumn(out, (F.col(raw) - low) / (high - low + F.lit(1e-9)))


def coefficients(model, names: Sequence[str]) -> list[tuple[str, float]]:
    pairs = zip(names, (float(v) for v in model.coefficients))
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def importances(model, names: Sequence[str]) -> list[tuple[str, float]]:
    pairs = zip(names, (float(v) for v in model.featureImportances.toArray()))
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def importance_table(spark, pairs: Sequence[tuple[str, float]], value: str = "importance", top: int | None = None) -> DataFrame:
    return spark.createDataFrame(list(pairs)[:top], f"feature string, {value} double")


def fit_and_score(
    train: DataFrame,
    test: DataFrame,
    id_col: str,
    y: str,
    features: FeatureSet,
    estimator: Estimator,
    scheme: str = "balanced",
    **preparation,
) -> tuple[PipelineModel, DataFrame, Preparation]:
    """Preparation fitted on train, model, and scored test rows (id, y, score)."""
    done = fit_preparation(train, features, **preparation)
    model = fit(estimator, prepared(train, done, [id_col, y]), y, scheme, done.categories)
    scored = scores(model, prepared(test, done, [id_col, y]), [id_col, y])
    return PipelineModel([*done.stages, model]), scored, done


def grow_and_score(
    train: DataFrame,
    test: DataFrame,
    id_col: str,
    y: str,
    features: FeatureSet,
    estimator: RandomForestClassifier,
    fill: str = "median",
    max_bins: int = 255,
) -> tuple[bagged.Forests, DataFrame, list[str]]:
    """As ``fit_and_score`` for a forest, grown by ``bagged``: forest, scored test rows, names.

    The estimator gives trees, depth, least rows of a leaf and seed. A category
    is one column, whose splits ask for one value; a value not learned from
    equals none. Classes are balanced within each bag. Scaling changes no split.
    """
    numeric, categorical = list(features.numeric), list(features.categorical)
    fills = prep.as_dict(prep.medians(train, numeric)) if fill == "median" and numeric else {}
    fills |= prep.as_dict(prep.most_frequent(train, categorical)) if categorical else {}
    columns = [c for c in (*numeric, *categorical, features.bits) if c]
    both = train.select(id_col, y, *columns, F.lit(1).alias("__learn")).unionByName(test.select(id_col, y, *columns, F.lit(0).alias("__learn")))
    binning, table = bagged.encode_rows(
        both, [id_col, y, "__learn"], numeric, features.bits, features.nbits, "__learn = 1", max_bins, categorical, fills
    )
    settings = bagged.Settings(
        trees=estimator.getNumTrees(), least=estimator.getMinInstancesPerNode(), depth=estimator.getMaxDepth(), seed=estimator.getSeed()
    )
    model = bagged.fit_rows(table.where("__learn = 1"), binning, id_col, [y], settings)
    scored = model.score_once(table.where("__learn = 0"), [id_col, y])
    return model, scored.select(id_col, y, F.col("scores")[0].alias("score")), [name for name, _ in model.importances()]


@dataclass(frozen=True)
class CrossValidation:
    """Out-of-fold scores, fold metrics, mean importances."""

    predictions: DataFrame
    metrics: DataFrame
    importances: DataFrame


def cross_validate(
    df: DataFrame,
    id_col: str,
    y: str,
    fold: str,
    folds: int,
    features: FeatureSet,
    estimator: Estimator,
    scheme: str = "positive",
    **preparation,
) -> CrossValidation:
    """Fit on all folds but one, score that one; everything is fitted per fold.

    ``predictions`` also has ``pred`` by the F1-optimal threshold of each fold.
    """
    base = stored(df, "rows")
    scored, gains = [], []
    for k in range(folds):
        train, held = base.where(F.col(fold) != k), base.where(F.col(fold) == k)
        done = fit_preparation(train, features, **preparation)
        model = fit(estimator, prepared(train, done, [y]), y, scheme, done.categories)
        scored.append(scores(model, prepared(held, done, [id_col, y, fold]), [id_col, y, fold]))
        gains += importances(model, done.names)
    out = stored(reduce(DataFrame.unionByName, scored), "oof")
    predictions, metrics = _by_fold(out, y, fold)
    table = df.sparkSession.createDataFrame(gains, "feature string, importance double")
    mean = table.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return CrossValidation(predictions, metrics, mean)


def _by_fold(out: DataFrame, y: str, fold: str) -> tuple[DataFrame, DataFrame]:
    """Predictions by the F1-optimal threshold of each fold, and fold metrics."""
    best = evaluate.best_threshold(out, y, "score", [fold])
    return evaluate.apply_threshold(out, "score", best, [fold]), evaluate.fold_metrics(out, y, "score", fold)


@dataclass(frozen=True)
class BoostedFolds(CrossValidation):
    """``nodes``: every tree of every fold's model, as ``trees.node_table`` gives them."""

    nodes: DataFrame


def cross_validate_boosted(
    df: DataFrame,
    id_col: str,
    y: str,
    fold: str,
    folds: int,
    features: FeatureSet,
    settings: boost.Settings | None = None,
    max_bins: int = 255,
) -> BoostedFolds:
    """Boosted trees on all folds but one, every fold's model in the same jobs.

    The published settings are the defaults. Positives weigh neg / pos of the
    rows learned from; missing values stand at the median or the commonest
    category of those rows, to the bin. Cuts between numbers are shared. The
    importance of a feature is the mean gain of its splits, averaged over folds.
    """
    settings = settings or boost.Settings()
    fitted, table = boost.fit_table(
        df, id_col, [y], features.numeric, features.categorical, settings, fold=fold, folds=folds, max_bins=max_bins
    )
    out = stored(fitted.score_once(table, [id_col, y, fold], fold), "oof")
    spark = df.sparkSession
    nodes = stored(fitted.nodes(spark), "nodes")
    names = [*features.numeric, *[f"{c}_{v}" for c, own in zip(fitted.binning.categorical, fitted.binning.values, strict=True) for v in own]]
    listed = spark.createDataFrame([(n,) for n in names], "feature string")
    predictions, metrics = _by_fold(out, y, fold)
    return BoostedFolds(predictions, metrics, trees.mean_gains(nodes, listed, folds), nodes)


def oof_summary(cv: CrossValidation, y: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Areas, confusion counts and report over all out-of-fold rows."""
    cells = evaluate.confusion(cv.predictions, y, "pred")
    return (
        evaluate.auc_and_ap(cv.predictions, y, "score"),
        cells,
        evaluate.classification_report(cells),
    )


@dataclass(frozen=True)
class TunedModel:
    model: PipelineModel | bagged.Forests
    threshold: float
    predictions: DataFrame
    names: list[str]


def tune_and_refit(
    df: DataFrame,
    id_col: str,
    y: str,
    part: str,
    features: FeatureSet,
    estimator: Estimator,
    scheme: str = "balanced",
    low: float = 0.3,
    high: float = 0.99,
    grown: bool = False,
    **preparation,
) -> TunedModel:
    """Threshold from the validation rows, refit on train and validation,
    predictions of the test rows. ``part`` is train, val or test.

    ``grown``: a forest by ``grow_and_score``, which balances classes itself."""
    base = stored(df, "rows")
    run = partial(grow_and_score, **preparation) if grown else partial(fit_and_score, scheme=scheme, **preparation)
    inner, val, test = (base.where(F.col(part) == p) for p in ("train", "val", "test"))
    _, val_scores, _ = run(inner, val, id_col, y, features, estimator)
    chosen = evaluate.stepped_threshold(val_scores, y, "score", low=low, high=high).first()
    threshold = float(chosen["threshold"]) if chosen else 0.5
    model, scored, done = run(base.where(F.col(part) != "test"), test, id_col, y, features, estimator)
    predictions = evaluate.apply_threshold(scored, "score", threshold)
    return TunedModel(model, threshold, predictions, done if grown else done.names)


@dataclass(frozen=True)
class LabelModels:
    """Per-label thresholds, long predictions of the test rows, the models."""

    thresholds: DataFrame
    predictions: DataFrame
    models: Mapping[str, object]
    preparation: Preparation


def train_per_label(
    df: DataFrame,
    pairs: DataFrame,
    id_col: str,
    label: str,
    names: Sequence[str],
    part: str,
    features: FeatureSet,
    estimator: Estimator,
    scheme: str = "balanced",
    tuning: str = "grid",
    refit: bool = False,
    **preparation,
) -> LabelModels:
    """One binary model per label over shared features.

    The vectors are assembled once and stored with one 0/1 column per
    label. ``tuning``: 'grid' or 'stepped' thresholds on the validation rows.
    With ``refit`` the test rows are scored by models refitted on train and
    validation.
    """
    columns = [f"__y{i}" for i in range(len(names))]
    ys = labels.label_matrix(pairs, id_col, label, names, columns)
    done = fit_preparation(df.where(F.col(part) != "test"), features, **preparation)
    vectors = prepared(df.join(ys, id_col), done, [id_col, part, *columns])
    base = stored(vectors, "vectors")
    inner = base.where(F.col(part) == "train")
    models, val, test = {}, [], []
    for name, column in zip(names, columns):
        model = fit(estimator, inner, column, scheme, done.categories)
        val.append(_label_scores(model, base.where(F.col(part) == "val"), id_col, name, column))
        if refit:
            model = fit(estimator, base.where(F.col(part) != "test"), column, scheme, done.categories)
        test.append(_label_scores(model, base.where(F.col(part) == "test"), id_col, name, column))
        models[name] = model
    tuned: Callable = {"grid": evaluate.grid_threshold, "stepped": evaluate.stepped_threshold}[tuning]
    tuned_on = reduce(DataFrame.unionByName, val)
    thresholds = stored(
        tuned(tuned_on, "y", "score", ["label"]).select("label", "threshold"), "thresholds"
    )
    scored = stored(reduce(DataFrame.unionByName, test), "scored")
    predictions = evaluate.apply_threshold(scored, "score", thresholds, ["label"])
    return LabelModels(thresholds, predictions, models, done)


def forest_per_label(
    df: DataFrame,
    pairs: DataFrame,
    id_col: str,
    label: str,
    names: Sequence[str],
    part: str,
    features: FeatureSet,
    settings: bagged.Settings | None = None,
    max_bins: int = 255,
) -> tuple[DataFrame, DataFrame]:
    """One forest for each label, all labels in the same jobs: (thresholds, predictions).

    Numbers, a missing one as 0, and the bits column; no categories. Classes
    are balanced within each bag. Thresholds one step below the best on the
    'val' rows, from forests of the 'train' rows; predictions of the 'test'
    rows by forests of both. Defaults are the published size.
    """
    settings = settings or bagged.Settings()
    columns = [f"__y{i}" for i in range(len(names))]
    ys = labels.label_matrix(pairs, id_col, label, names, columns)
    learn = f"{_quoted(part)} <> 'test'"
    binning, table = bagged.encode_rows(df.join(ys, id_col), [id_col, part, *columns], features.numeric, features.bits, features.nbits, learn, max_bins)
    each = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("label"), F.array(*columns).alias("y"), F.col("scores").alias("score")))

    def scored(rows: DataFrame, to: str) -> DataFrame:
        out = bagged.scored_by_rows(rows, table.where(F.col(part) == to), [id_col, *columns], binning, id_col, columns, settings)
        return stored(out.select(id_col, each.alias("e")).select(id_col, "e.*"), "scored")

    val = scored(table.where(F.col(part) == "train"), "val")
    thresholds = stored(evaluate.stepped_threshold(val, "y", "score", ["label"]).select("label", "threshold"), "thresholds")
    return thresholds, evaluate.apply_threshold(scored(table.where(learn), "test"), "score", thresholds, ["label"])


@dataclass(frozen=True)
class BoostedLabels:
    """Per-label thresholds, long predictions of the test rows, the trees of all labels.

    Model i of ``nodes`` is the i-th of ``names``.
    """

    thresholds: DataFrame
    predictions: DataFrame
    nodes: DataFrame
    names: tuple[str, ...]


def boosted_per_label(
    df: DataFrame,
    pairs: DataFrame,
    id_col: str,
    label: str,
    names: Sequence[str],
    part: str,
    features: FeatureSet,
    settings: boost.Settings | None = None,
    max_bins: int = 255,
) -> BoostedLabels:
    """One boosted model for each label, all labels in the same jobs.

    Learned from the rows whose ``part`` is 'train'; thresholds by grid on the
    'val' rows, predictions of the 'test' rows. Defaults are the published
    rounds and rate; depth five gives 32 leaves a tree.
    """
    settings = settings or boost.Settings(rounds=1200, depth=5, rate=0.05)
    columns = [f"__y{i}" for i in range(len(names))]
    ys = labels.label_matrix(pairs, id_col, label, names, columns)
    fitted, table = boost.fit_table(
        df.join(ys, id_col), id_col, columns, features.numeric, features.categorical, settings,
        keep=[part], learn=f"{_quoted(part)} = 'train'", max_bins=max_bins,
    )
    scored = fitted.score_once(table.where(F.col(part).isin("val", "test")), [id_col, part, *columns])
    each = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("label"), F.array(*columns).alias("y"), F.col("scores").alias("score")))
    scored = stored(scored.select(id_col, part, each.alias("e")).select(id_col, part, "e.*"), "scored")
    tuned = evaluate.grid_threshold(scored.where(F.col(part) == "val"), "y", "score", ["label"])
    thresholds = stored(tuned.select("label", "threshold"), "thresholds")
    test = scored.where(F.col(part) == "test").drop(part)
    predictions = evaluate.apply_threshold(test, "score", thresholds, ["label"])
    return BoostedLabels(thresholds, predictions, fitted.nodes(df.sparkSession), tuple(names))


def _label_scores(model, df: DataFrame, id_col: str, name: str, column: str) -> DataFrame:
    return scores(model, df, [id_col, F.lit(name).alias("label"), F.col(column).alias("y")])


def save(model: LabelModels, path: str) -> None:
    """Preparation and one model per label under numbered folders."""
    model.preparation.pipeline().write().overwrite().save(f"{path}/preparation")
    for i, fitted in enumerate(model.models.values()):
        fitted.write().overwrite().save(f"{path}/label_{i:03d}")

