"""Model-backed operators on Spark ML: out-of-fold scores, uplift learners, importance, learning curves."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import wide
from plumbline.functions.primitives import discard, global_rank, md5_number, spread, written

from .comparison import bootstrap_ci
from .ranking import auc
from .splits import kfold

SEED = 7


def _stages(features: Sequence[str], model, scale: bool = False) -> Pipeline:
    assemble = VectorAssembler(inputCols=list(features), outputCol="__raw", handleInvalid="keep")
    if not scale:
        return Pipeline(stages=[assemble, model.setFeaturesCol("__raw")])
    return Pipeline(stages=[assemble, StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True), model.setFeaturesCol("__scaled")])


def gbt_classifier(label: str, depth: int = 3, trees: int = 10) -> GBTClassifier:
    model = GBTClassifier(labelCol=label, maxDepth=depth, maxIter=trees, seed=SEED, predictionCol="__pred")
    return model.setProbabilityCol("__prob").setRawPredictionCol("__rawp")


def gbt_regressor(label: str, depth: int = 3, trees: int = 10) -> GBTRegressor:
    return GBTRegressor(labelCol=label, maxDepth=depth, maxIter=trees, seed=SEED, predictionCol="__pred")


def logistic(label: str) -> LogisticRegression:
    return LogisticRegression(labelCol=label, maxIter=30, regParam=0.01, predictionCol="__pred", probabilityCol="__prob", rawPredictionCol="__rawp")


def filled(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """keep and features, nulls by the median of all rows; what df is made of is read once, into a stored table of these columns."""
    rows = written(df.select(*dict.fromkeys([*keep, *features])), "filled")
    middle = wide.quantiles(rows, features, (0.5,))
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(middle[c][0] if middle[c] else 0.0)) for c in features})


def scored(model: PipelineModel, df: DataFrame, score: Column, name: str) -> DataFrame:
    """df with one column of a model's output: scorings follow each other in one pass, rows are not joined, repeated keys stay."""
    return model.transform(df).select(*df.columns, score.alias(name))


def positive() -> Column:
    return vector_to_array("__prob")[1]


def oof_score(df: DataFrame, features: Sequence[str], label: str, key: str, make, k: int = 5, scale: bool = False) -> DataFrame:
    """key, score: rows of split train by the models of the other folds, the rest by a model of all training rows; null without both classes."""
    rows = written(kfold(filled(df, features, [key, "split", label]), k, key, SEED), "oof")
    train = rows.filter("split = 'train'")
    if train.select(F.count_distinct(label)).first()[0] < 2:
        return rows.select(key, F.lit(None).cast("double").alias("score"))
    parts = [(train.filter(F.col("fold") != f), train.filter(F.col("fold") == f)) for f in range(k)] + [(train, rows.filter("split <> 'train'"))]
    scored = [_stages(features, make(label), scale).fit(a).transform(b).select(key, positive().alias("score")) for a, b in parts]
    out = scored[0]
    for s in scored[1:]:
        out = out.unionByName(s)
    return out


def lr_oof_score(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5) -> DataFrame:
    return oof_score(df, features, label, key, logistic, k, scale=True)


def gbdt_oof_score(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5) -> DataFrame:
    return oof_score(df, features, label, key, gbt_classifier, k)


def pca_features(df: DataFrame, vector: str, key: str, k: int = 8, fit_on: Column | None = None) -> DataFrame:
    """key, pca_0.. of centred vectors, fitted on the rows of fit_on."""
    rows = df.select("*", array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    train = rows if fit_on is None else rows.filter(fit_on)
    scaler = StandardScaler(inputCol="__v", outputCol="__c", withMean=True, withStd=False)
    model = Pipeline(stages=[scaler, PCA(k=k, inputCol="__c", outputCol="__p")]).fit(train)
    out = model.transform(rows).select(key, vector_to_array("__p").alias("p"))
    return out.select(key, *[F.col("p")[i].alias(f"pca_{i}") for i in range(k)])


def cluster_features(df: DataFrame, vector: str, key: str, k: int = 12, fit_on: Column | None = None) -> DataFrame:
    """key, cluster (nearest centre by squared distance), distance."""
    rows = df.select("*", array_to_vector(F.col(vector).cast("array<double>")).alias("__v"))
    centres = KMeans(k=k, seed=SEED, featuresCol="__v", maxIter=10).fit(rows if fit_on is None else rows.filter(fit_on)).clusterCenters()
    table = F.array(*[F.struct(F.lit(i).alias("cluster"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for i, c in enumerate(centres)])  # k centres
    v = F.col(vector).cast("array<double>")
    far = F.transform(table, lambda s: F.struct(F.aggregate(F.zip_with(v, s["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x).alias("d"), s["cluster"].alias("cluster")))
    return df.select(key, F.array_min(far).alias("m")).select(key, "m.cluster", F.sqrt("m.d").alias("distance"))


def treatment_predictability(df: DataFrame, covariates: Sequence[str], arm: str, key: str, holdout: float = 0.3, least: int = 30) -> DataFrame:
    """One row: rows by arm, AUC of a model of the arm on a hashed holdout, level (0.6, 0.7, 0.8), importances by falling gain; none under least rows an arm."""
    rows = filled(df, covariates, [key, arm]).withColumn("held", md5_number(SEED, key) % 1000 < holdout * 1000)
    n = rows.agg(F.count_if(F.col(arm) == 1).alias("treated"), F.count_if(F.col(arm) == 0).alias("control"))
    enough = min(n.first()) >= least
    scored, gains = rows.limit(0).select(arm, F.lit(0.0).alias("s")), []
    if enough:
        model = _stages(covariates, gbt_classifier(arm)).fit(rows.filter("NOT held"))
        scored = model.transform(rows.filter("held")).select(F.col(arm), positive().alias("s"))
        gains = sorted(zip(model.stages[-1].featureImportances.toArray().tolist(), covariates, strict=True), key=lambda x: (-x[0], x[1]))
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(g).alias("gain")) for g, c in gains]).cast("array<struct<feature:string,gain:double>>")
    out = n.crossJoin(auc(scored, arm, "s")).withColumn("importances", listed)  # one row each
    return out.withColumn("level", F.when(F.col("auc") >= 0.8, "severe").when(F.col("auc") >= 0.7, "high").when(F.col("auc") >= 0.6, "warning").when(F.col("auc").isNotNull(), "ok"))


def s_learner(df: DataFrame, features: Sequence[str], arm: str, outcome: str, key: str, binary: bool = True) -> DataFrame:
    """key, p1, p0, uplift: one model of training rows with the arm as a feature, applied with each arm."""
    rows = filled(df, features, [key, "split", arm, outcome])
    model = _stages([*features, arm], gbt_classifier(outcome) if binary else gbt_regressor(outcome)).fit(rows.filter("split = 'train'"))
    score, out = positive() if binary else F.col("__pred"), rows
    for v in (1, 0):
        out = scored(model, out.withColumn(arm, F.lit(v)), score, f"p{v}")
    return out.select(key, "p1", "p0", (F.col("p1") - F.col("p0")).alias("uplift"))


def t_learner(df: DataFrame, features: Sequence[str], arm: str, outcome: str, key: str, binary: bool = True) -> DataFrame:
    """key, p1, p0, uplift: a model for each arm of the training rows."""
    rows = filled(df, features, [key, "split", arm, outcome])
    make, score = (gbt_classifier, positive()) if binary else (gbt_regressor, F.col("__pred"))
    out = rows
    for v in (1, 0):
        fitted = _stages(features, make(outcome)).fit(rows.filter((F.col("split") == "train") & (F.col(arm) == v)))
        out = scored(fitted, out, score, f"p{v}")
    return out.select(key, "p1", "p0", (F.col("p1") - F.col("p0")).alias("uplift"))


def importance_table(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """feature, gain, share, rank (ties share the lowest) of a boosted model."""
    model: PipelineModel = _stages(features, gbt_classifier(label)).fit(filled(df, features, [label]))
    gains = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    table = df.sparkSession.createDataFrame(list(zip(features, gains, strict=True)), "feature string, gain double")
    all_ = Window.partitionBy()  # a row for each feature
    return table.withColumn("share", F.col("gain") / F.nullif(F.sum("gain").over(all_), F.lit(0.0))).withColumn("rank", F.rank().over(Window.orderBy(F.desc("gain"))).cast("long"))


def sample_noise_check(full: DataFrame, keys: DataFrame, key: str, label: str, score: str, smallest: float, n_boot: int = 2000) -> DataFrame:
    """One row: the AUC's standard error on all rows and on those with keys, their ratio to twice the smallest effect, usable."""
    chosen = keys.select(key).distinct().withColumn("__chosen", F.lit(True))
    rows = written(full.select(key, label, score).join(chosen, key, "left"), "noise")
    a = bootstrap_ci(rows, label, score, key, n_boot).select(F.col("se").alias("se_full"))
    b = bootstrap_ci(rows.filter("__chosen"), label, score, key, n_boot).select(F.col("se").alias("se_sample"))
    return a.crossJoin(b).withColumn("ratio", F.col("se_sample") / (2 * smallest)).withColumn("usable", F.col("ratio") <= 1)  # one row each


#: Rows that a cell has on average, and projections at most.
CELL_ROWS, MOST_DIMS = 20, 24


def local_ambiguity(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """One row: dims, cells, within, total, ambiguity (within-cell over total variance) over hashed projections cut in three bins each.

    There are as many projections as give cells of about CELL_ROWS rows, 2 at
    least, so the resolution grows with the rows.
    """
    rows = filled(df.filter(F.col(y).isNotNull()), features, [y])
    dims = max(2, min(MOST_DIMS, round(math.log(max(4, rows.count() // CELL_ROWS), 3))))
    moments = rows.agg(*[F.struct(F.avg(c), spread(F.stddev_pop, c)).alias(c) for c in features]).first()
    weight = lambda c, d: (int(hashlib.md5(f"{SEED}|{d}|{c}".encode()).hexdigest()[:8], 16) / 2**31) - 1
    for d in range(dims):
        rows = rows.withColumn(f"__p{d}", sum((F.lit(weight(c, d)) * (F.col(c) - moments[c][0]) / (moments[c][1] or 1.0) for c in features), F.lit(0.0)))
    edges = wide.edges_of(wide.quantiles(rows, [f"__p{d}" for d in range(dims)], (0, 1 / 3, 2 / 3, 1)))
    bins = [sum(((F.col(f"__p{d}") > x).cast("long") for x in wide.inner(edges[f"__p{d}"])), F.lit(0).cast("long")) for d in range(dims)]
    cell = sum((b * 3**d for d, b in enumerate(bins)), F.lit(0).cast("long"))  # at most 3 ** MOST_DIMS
    cells = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.var_pop(y).alias("v"))
    total = rows.agg(spread(F.var_pop, y).alias("total"))
    out = cells.agg(F.lit(dims).alias("dims"), F.count("*").alias("cells"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within")).crossJoin(total)  # one row each
    return out.withColumn("ambiguity", F.col("within") / F.nullif("total", F.lit(0.0)))


def _fitted(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    return _stages(features, gbt_classifier(label)).fit(train)


def _aucs(models: Sequence[PipelineModel], test: DataFrame, label: str, by: Sequence[str] = ()) -> dict[tuple, float | None]:
    """AUC of each model on test by its number and the groups by, which are few: the rows are read once and scored by all."""
    out = test.select(*by, label, *[c for c in test.columns if c not in (*by, label)])
    for k, m in enumerate(models):
        out = scored(m, out, positive(), f"__s{k}")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(f"__s{k}").alias("s")) for k in range(len(models))])).alias("_")
    found = auc(out.select(*by, label, each).select(*by, label, "_.*"), label, "s", [*by, "model"])
    return {(r["model"], *(r[c] for c in by)): r["auc"] for r in found.collect()}  # a row for each model and group


def sample_size_curve(df: DataFrame, features: Sequence[str], label: str, key: str, fractions: Sequence[float] = (0.125, 0.25, 0.5, 1.0), seeds: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """fraction, seed, rows, auc on split test of models of hashed shares of the training rows."""
    rows = filled(df, features, [key, "split", label])
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    points = [(f, s) for f in fractions for s in (seeds if f < 1 else seeds[:1])]
    within = [md5_number(s, key) < int(f * 2**32) for f, s in points]
    sizes = train.agg(*[F.count_if(w) for w in within]).first()
    found = _aucs([_fitted(train.filter(w), features, label) for w in within], test, label)
    return df.sparkSession.createDataFrame([(f, s, n, found.get((k,))) for k, ((f, s), n) in enumerate(zip(points, sizes, strict=True))], "fraction double, seed int, rows long, auc double")


def last_step(curve: DataFrame) -> DataFrame:
    """One row of a sample_size_curve: gain of the last step, its error over seeds (root of 2 / seeds times the larger spread), whether its 95 % interval covers zero, steep.

    With one seed there is no error, and the interval covers zero. steep: the
    gain is beyond its interval and over a tenth of the whole rise.
    """
    points = sorted((r.fraction, r.n, r.auc, r.sd) for r in curve.groupBy("fraction").agg(F.count("auc").alias("n"), F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("sd")).collect() if r.auc is not None)  # a row for each fraction
    if len(points) < 2:
        return curve.sparkSession.createDataFrame([], "gain double, se double, covers_zero boolean, steep boolean")
    (_, n, before, spread), (_, _, after, last) = points[-2], points[-1]
    gain, rise = after - before, after - points[0][2]
    se = math.sqrt(2 / n) * max(spread, last, 1e-12) if n > 1 else None
    covers = se is None or abs(gain) <= 1.96 * se
    return curve.sparkSession.createDataFrame([(gain, se, covers, rise > 0 and gain > 0.1 * rise and not covers)], "gain double, se double, covers_zero boolean, steep boolean")


def feature_count_curve(df: DataFrame, ranked_features: Sequence[str], label: str, key: str, steps: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """n_features, auc on split test, gain over the step before."""
    rows = filled(df, ranked_features, [key, "split", label])
    train, test, out, before = rows.filter("split = 'train'"), rows.filter("split = 'test'"), [], None
    sizes = sorted({max(1, round(s * len(ranked_features))) for s in steps})
    found = _aucs([_fitted(train, list(ranked_features[:n]), label) for n in sizes], test, label)
    for k, n in enumerate(sizes):
        a = found.get((k,))
        out.append((n, a, None if before is None or a is None else a - before))
        before = a
    return df.sparkSession.createDataFrame(out, "n_features int, auc double, gain double")


def families(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns by what is before their first underscore; those without one are the family base."""
    out: dict[str, list[str]] = {}
    for c in columns:
        out.setdefault(c.partition("_")[0] if "_" in c else "base", []).append(c)
    return out


def permuted(rank: np.ndarray, n: int, seed: np.ndarray) -> np.ndarray:
    """Where ranks below n go under a permutation of 0 .. n - 1 that the seed sets: a Feistel network, walked on until it comes below n."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), rank.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        left, right, s = out[todo] >> np.uint64(half), out[todo] & mask, seed[todo].astype(np.uint64)
        for k in range(4):
            mixed = (right + s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[todo] = left << np.uint64(half) | right
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def group_permutation_importance(df: DataFrame, features: Sequence[str], label: str, key: str, repeats: int = 2) -> DataFrame:
    """family, columns, base_auc, drop: mean loss of test AUC when a family's columns are dealt anew together.

    Test rows are ranked once. In each family and repeat a row's donor is the row
    whose rank a permutation gives, computed without a sort; all of them, and
    the base, are scored in one pass and measured by one grouped AUC. Donors
    are a row for each test row, however small their compressed file is, so
    they are never broadcast.
    """
    rows = filled(df, features, [key, "split", label])
    model = _stages(features, gbt_classifier(label)).fit(rows.filter("split = 'train'"))
    test = written(global_rank(rows.filter("split = 'test'"), [key]), "test")
    n, groups = test.count(), families(features)

    @F.pandas_udf("long")
    def donor_of(rank: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series(permuted(rank.to_numpy(), n, seed.to_numpy()))

    rounds = F.array(F.struct(F.lit(-1).alias("family"), F.lit(0).alias("seed")), *[F.struct(F.lit(f).alias("family"), F.lit(f * repeats + r + 1).alias("seed")) for f in range(len(groups)) for r in range(repeats)])
    each = test.withColumn("__r", F.explode(rounds)).select("*", "__r.*").drop("__r")
    each = each.withColumn("donor", F.when(F.col("family") >= 0, donor_of("rank", "seed")).otherwise(F.col("rank")))
    given = test.select(F.col("rank").alias("donor"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(features)])
    number = {c: k for k, columns in enumerate(groups.values()) for c in columns}
    dealt = each.join(given.hint("merge"), "donor").select("family", "seed", label, *[F.when(F.col("family") == number[c], F.col(f"__{k}")).otherwise(F.col(c)).alias(c) for k, c in enumerate(features)])
    scored = model.transform(dealt).select("family", "seed", label, positive().alias("s"))
    found = auc(scored, label, "s", ["family", "seed"]).collect()  # a row for each family and repeat
    base = next((r.auc for r in found if r.family == -1), None)
    out = []
    for k, (name, columns) in enumerate(groups.items()):
        drops = [base - r.auc for r in found if r.family == k]
        out.append((name, ",".join(columns), base, sum(drops) / len(drops) if drops else None))
    discard(test)
    return df.sparkSession.createDataFrame(out, "family string, columns string, base_auc double, drop double")


def incremental_gain(df: DataFrame, base: Sequence[str], feature: str, label: str, key: str, seeds: Sequence[int] = (1, 2, 3), share: float = 0.8) -> DataFrame:
    """split (test, oot), gain (mean over seeds of the AUC with the feature less without), lower (mean less one standard error)."""
    rows = filled(df, [*base, feature], [key, "split", label])
    fitted = []  # with and without the feature, for each seed; each judges both splits
    for s in seeds:
        train = rows.filter((F.col("split") == "train") & (md5_number(s, key) < int(share * 2**32)))
        fitted += [_fitted(train, columns, label) for columns in ([*base, feature], list(base))]
    found = _aucs(fitted, rows.filter("split IN ('test', 'oot')"), label, ["split"])
    gain = lambda k, split: found[2 * k, split] - found[2 * k + 1, split]
    out = [(split, s, gain(k, split)) for k, s in enumerate(seeds) for split in ("test", "oot")]
    table = df.sparkSession.createDataFrame(out, "split string, seed int, gain double")
    return table.groupBy("split").agg(F.avg("gain").alias("gain"), (F.avg("gain") - F.stddev_samp("gain") / F.sqrt(F.count("*"))).alias("lower"))


def fusion_gain(df: DataFrame, base: Sequence[str], accepted: Sequence[str], label: str, key: str, least: float = 0.0) -> DataFrame:
    """One row: base_auc and fused_auc on split oot of models with the base alone and with all accepted features, gain, passed."""
    rows = filled(df, [*base, *accepted], [key, "split", label])
    train, oot = rows.filter("split = 'train'"), rows.filter("split = 'oot'")
    found = _aucs([_fitted(train, columns, label) for columns in (list(base), [*base, *accepted])], oot, label)
    one, two = found.get((0,)), found.get((1,))
    gain = None if one is None or two is None else two - one
    return df.sparkSession.createDataFrame([(one, two, gain, gain is not None and gain >= least)], "base_auc double, fused_auc double, gain double, passed boolean")


def hurdle_regression(df: DataFrame, features: Sequence[str], y: str, key: str, threshold: float = 0.0) -> DataFrame:
    """key, p (chance of y over the threshold), m (mean above it, at least 0), prediction p times m."""
    rows = filled(df, features, [key, "split", y]).withColumn("__over", (F.col(y) > threshold).cast("int"))
    train = rows.filter("split = 'train'")
    out = scored(_stages(features, gbt_classifier("__over")).fit(train), rows, positive(), "p")
    out = scored(_stages(features, gbt_regressor(y)).fit(train.filter("__over = 1")), out, F.greatest("__pred", F.lit(0.0)), "m")
    return out.select(key, "p", "m", (F.col("p") * F.col("m")).alias("prediction"))
