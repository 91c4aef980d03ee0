"""Models: boosted trees, logistic baseline, search, scoring, drivers, calibration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.operators.evaluation import auc
from leadloom.operators.windows import score_percentile, top_drivers


def weighted(df: DataFrame, y: str, counts: tuple[int, int] | None = None) -> DataFrame:
    """Rows of class 1 weigh negatives / positives; ``counts`` are positives and rows, if known."""
    if counts is None:
        n = df.agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n")).first()
        counts = n["pos"] or 0, n["n"]
    up = (counts[1] - counts[0]) / counts[0] if counts[0] else 1.0
    return df.withColumn("_weight", F.when(F.col(y) == 1, F.lit(float(up))).otherwise(F.lit(1.0)))


def _vector(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")


def train(df: DataFrame, features: Sequence[str], y: str, *, validation: DataFrame | None = None, seed: int = 7, counts: tuple[int, int] | None = None, **params) -> Model:
    """Gradient-boosted trees with class weights; early stopping watches validation rows only."""
    rows = weighted(df, y, counts).withColumn("_valid", F.lit(False))
    settings = {"maxIter": 20, "maxDepth": 3, "seed": seed} | params
    if validation is not None:
        rows = rows.unionByName(validation.withColumns({"_weight": F.lit(1.0), "_valid": F.lit(True)}))
        settings["validationIndicatorCol"] = "_valid"
    trees = GBTClassifier(featuresCol="_features", labelCol=y, weightCol="_weight", **settings)
    return Pipeline(stages=[_vector(features), trees]).fit(rows)


def train_lr(df: DataFrame, features: Sequence[str], y: str) -> Model:
    """A balanced logistic regression on standardised features; missing values take the mean."""
    filled = [f"_{f}" for f in features]
    fill = Imputer(inputCols=list(features), outputCols=filled, strategy="mean")
    scale = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True)
    lr = LogisticRegression(featuresCol="_scaled", labelCol=y, weightCol="_weight", regParam=0.01)
    return Pipeline(stages=[fill, _vector(filled), scale, lr]).fit(weighted(df, y))


def score(model: Model, df: DataFrame, features: Sequence[str], out: str = "model_score") -> DataFrame:
    scored = model.transform(df).withColumn(out, F.round(vector_to_array("probability")[1], 6))
    return scored.select(*df.columns, out)


#: Fits that run beside one another, and folds that a search takes.
PARALLEL, MOST_FOLDS = 4, 100


def _placed(df: DataFrame, key: str, seed: int) -> DataFrame:
    """A number from 0 to 1 by a hash of the key: rows below a share are a sample, and each
    sample lies in the larger ones."""
    return df.withColumn("_share", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30)))


def tune(df: DataFrame, features: Sequence[str], y: str, fold: str, grid: Sequence[Mapping[str, int]], *, key: str | None = None, shares: Sequence[float] = (1.0,), seed: int = 7) -> DataFrame:
    """Mean AUC of each setting over the folds, by successive halving.

    Each of the ``shares`` is a round on a nested sample by ``key``; the better half of the
    settings goes on to the next, the last round has all rows if its share is 1. A setting's
    result is that of its last round. The fits of a round run beside one another, and the rows
    of the classes are counted once a round for all folds.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().limit(MOST_FOLDS + 1).collect())
    if len(folds) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    rows = _placed(df, key, seed) if key else df
    alive, results = list(range(len(grid))), {}
    for k, share in enumerate(shares):
        part = rows.where(F.col("_share") < share).drop("_share") if key and share < 1 else rows.drop("_share")
        counted = {r[fold]: (r.pos or 0, r.n) for r in part.groupBy(fold).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n")).collect()}

        def fit(job: tuple[int, object], part: DataFrame = part, counted: Mapping = counted) -> float | None:
            setting, held = job
            counts = tuple(sum(c[j] for f, c in counted.items() if f != held) for j in (0, 1))
            model = train(part.where(F.col(fold) != held), features, y, counts=counts, **grid[setting])
            return auc(score(model, part.where(F.col(fold) == held), features), y, "model_score").first()["auc_roc"]

        jobs = [(i, f) for i in alive for f in folds]
        with ThreadPoolExecutor(PARALLEL) as pool:
            found = dict(zip(jobs, pool.map(fit, jobs), strict=True))
        for i in alive:
            kept = [found[i, f] for f in folds if found[i, f] is not None]
            results[i] = (share, float(sum(kept) / len(kept)) if kept else None)
        if k + 1 < len(shares):
            alive = sorted(alive, key=lambda i: (results[i][1] is None, -(results[i][1] or 0), i))[: max(1, -(-len(alive) // 2))]
    table = [(i, str(dict(p)), results[i][1], float(results[i][0])) for i, p in enumerate(grid)]
    return df.sparkSession.createDataFrame(table, "setting int, params string, mean_auc double, share double")


def learning_curve(df: DataFrame, validation: DataFrame, features: Sequence[str], y: str, key: str, shares: Sequence[float], *, seed: int = 7, **params) -> DataFrame:
    """Rows and AUC, on the rows themselves and on the validation rows, of fits on nested samples."""
    rows = _placed(df, key, seed)

    def fit(share: float) -> tuple:
        part = rows.where(F.col("_share") < share).drop("_share") if share < 1 else rows.drop("_share")
        model = train(part, features, y, seed=seed, **params)
        own, other = (auc(score(model, x, features), y, "model_score").first() for x in (part, validation))
        return float(share), own["n"], own["auc_roc"], other["auc_roc"]

    with ThreadPoolExecutor(PARALLEL) as pool:
        table = list(pool.map(fit, shares))
    return df.sparkSession.createDataFrame(table, "share double, n long, train_auc double, validation_auc double")


def score_batch(model: Model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scores, percentiles and the flags of the lowest and highest fifth."""
    ranked = score_percentile(score(model, df, features), "model_score")
    return ranked.select("*", (F.col("percentile") <= 20).cast("int").alias("is_bottom"), (F.col("percentile") >= 80).cast("int").alias("is_top"))


def drivers(df: DataFrame, importance: Mapping[str, float], k: int = 3) -> DataFrame:
    """Contributions z-score x importance, and the k largest of each row."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in importance], *[F.stddev_samp(c).alias(f"s_{c}") for c in importance])
    joined = df.crossJoin(F.broadcast(stats.limit(1)))
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0)) * w for c, w in importance.items()}
    rows = joined.select(*[c for c in df.columns if c not in importance], *[e.alias(c) for c, e in z.items()])
    return top_drivers(rows, list(importance), k)


def calibrate(df: DataFrame, s: str = "score", y: str = "target") -> DataFrame:
    """Isotonic and Platt calibration, better Brier score first. Isotonic fits on the means by score bin."""
    rows = df.select(F.col(s).alias("s"), F.col(y).cast("double").alias("y"))
    bins = rows.groupBy(F.floor(F.col("s") * 1000).alias("b")).agg(F.avg("s").alias("s"), F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
    iso = IsotonicRegression(featuresCol="s", labelCol="y", weightCol="w").fit(bins)
    platt = Pipeline(stages=[VectorAssembler(inputCols=["s"], outputCol="_f"), LogisticRegression(featuresCol="_f", labelCol="y")]).fit(rows)
    brier = lambda p: F.round(F.avg((F.col(p) - F.col("y")) ** 2), 6)
    a = iso.transform(rows).agg(brier("prediction").alias("brier")).select(F.lit("isotonic").alias("method"), "brier")
    b = platt.transform(rows).withColumn("p", vector_to_array("probability")[1]).agg(brier("p").alias("brier")).select(F.lit("platt").alias("method"), "brier")
    return a.unionByName(b).orderBy("brier", "method")


def lookup(df: DataFrame, s: str, y: str, bins: int = 100) -> DataFrame:
    """The observed rate of each score bin."""
    bin_ = F.least(F.floor(F.col(s) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_.alias("bin")).agg(F.avg(y).alias("calibrated"), F.count(F.lit(1)).alias("n"))


def apply_lookup(df: DataFrame, table: DataFrame, s: str, bins: int = 100) -> DataFrame:
    bin_ = F.least(F.floor(F.col(s) * bins), F.lit(bins - 1)).cast("int")
    return df.withColumn("bin", bin_).join(table.select("bin", "calibrated"), "bin")
