"""Classifier two-sample tests with pyspark.ml: folds, pooled AUC, importances, PCA and permutation tests."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusverk.operators import forest
from korpusverk.operators.sampling import folds
from korpusverk.operators.skew import hash62, prefix_rank
from korpusverk.operators.stats import auc, hanley_mcneil
from korpusverk.plans.runtime import cut

#: Folds that are fitted at the same time.
PARALLEL = 5


def two_samples(pairs: DataFrame, key: str, human: str, llm: str) -> DataFrame:
    """(key, label, value): the human side as 0 stacked over the machine side as 1."""
    side = F.array(F.struct(F.lit(0).alias("label"), F.col(human).alias("value")), F.struct(F.lit(1).alias("label"), F.col(llm).alias("value")))
    return pairs.select(key, F.explode(side).alias("s")).select(key, "s.label", "s.value")


def assemble(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """features from numeric columns: columns without any number are dropped, then rows with a missing one."""
    held = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    used = [c for c in columns if held[c]]
    return VectorAssembler(inputCols=used, outputCol="features", handleInvalid="skip").transform(df)


def from_arrays(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def balanced(df: DataFrame) -> DataFrame:
    """Adds weight n / (2 n_class)."""
    n = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    weight = F.lit(1.0)
    for k, v in n.items():
        weight = F.when(F.col("label") == k, total / (2.0 * v)).otherwise(weight)
    return df.withColumn("weight", weight)


def estimator(model: str, n_train: int, trees: int = 400):
    if model == "lr":
        return LogisticRegression(regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-4, featuresCol="features", labelCol="label", weightCol="weight")
    if model == "rf":
        return RandomForestClassifier(numTrees=trees, seed=0, featuresCol="features", labelCol="label", weightCol="weight")
    return GBTClassifier(maxDepth=3, maxIter=100, stepSize=0.1, seed=0, featuresCol="features", labelCol="label", weightCol="weight")


def scaled(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = StandardScaler(inputCol="features", outputCol="_z", withMean=True, withStd=True).fit(train)
    return tuple(m.transform(d).drop("features").withColumnRenamed("_z", "features") for d in (train, test))


def cross_validate(df: DataFrame, key: str, model: str = "lr", k: int = 5, seed: int = 0, grouped: bool = False, scale: bool = False, trees: int = 400) -> DataFrame:
    """Scores of every row from the model that has not seen its fold: (key, label, fold, score, predicted). With grouped, rows of a key share a fold."""
    smallest = df.groupBy("label").count().agg(F.min("count")).first()[0] or 0
    k = max(2, min(k, smallest))
    data = cut(balanced(folds(df.withColumn("_key", F.col(key)), k, seed, "_key", None if grouped else "label")))
    if model == "rf":
        return forest.scores(data, key, k, trees, seed)
    n = data.count()

    def one(f: int) -> DataFrame:
        train, test = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        if scale:
            train, test = scaled(train, test)
        fitted = estimator(model, int(n * (k - 1) / k), trees).fit(train)
        return cut(fitted.transform(test).select(key, "label", "fold", vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("predicted")))

    with ThreadPool(min(k, PARALLEL)) as pool:  # the folds' jobs share the cluster
        parts = pool.map(inheritable_thread_target(df.sparkSession)(one), range(k))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cv_metrics(scores: DataFrame) -> DataFrame:
    """Mean and deviation (population) over folds of AUC, accuracy and F1, with the Hanley-McNeil interval of the mean AUC."""
    tp, fp, fn = (F.count_if((F.col("label") == a) & (F.col("predicted") == b)) for a, b in ((1, 1), (0, 1), (1, 0)))
    by = scores.groupBy("fold").agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("acc"), F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"))
    j = by.join(auc(scores, ["fold"], "score", "label"), "fold")
    m = j.agg(F.avg("auc").alias("roc_auc"), F.stddev_pop("auc").alias("roc_auc_sd"), F.avg("acc").alias("accuracy"), F.avg("f1").alias("f1"), F.sum("positives").alias("n_positive"), F.sum("negatives").alias("n_negative"))
    low, high = hanley_mcneil(F.col("roc_auc"), F.col("n_positive").cast("double"), F.col("n_negative").cast("double"))
    return m.withColumn("ci95_lo", low).withColumn("ci95_hi", high)


def permutation_test(scores: DataFrame, key: str, permutations: int = 200, seed: int = 0) -> DataFrame:
    """Observed AUC, mean AUC and p = (C + 1) / (N + 1) with labels shuffled over the held-out scores; a bounded number of permutations, in one job.

    Each permutation deals the labels anew by a hash, with the observed class sizes.
    """
    ones = scores.filter("label = 1").count()
    ids = F.explode(F.sequence(F.lit(1), F.lit(permutations)))
    many = scores.select(key, "label", "score", ids.alias("perm"))
    order = hash62(F.lit(seed), "perm", F.col(key), "label")
    dealt = prefix_rank(many, ["perm"], order, key).withColumn("label", (F.col("_before") < ones).cast("int"))
    null = auc(dealt, ["perm"], "score", "label")
    seen = auc(scores.withColumn("_g", F.lit(1)), ["_g"], "score", "label").select(F.col("auc").alias("observed"))
    j = null.join(F.broadcast(seen))
    return j.groupBy("observed").agg(F.avg("auc").alias("null_mean_auc"), ((F.count_if(F.col("auc") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("n_permutations"))


def importance(df: DataFrame, columns: Sequence[str], model: str = "lr", trees: int = 400) -> DataFrame:
    """Signed coefficients or impurity importances of a fit on all rows, largest first."""
    data = cut(balanced(assemble(df, columns)))
    data, _ = scaled(data, data.limit(0))
    fitted = estimator(model, data.count(), trees).fit(data)
    values = (fitted.coefficients if model == "lr" else fitted.featureImportances).toArray().tolist()
    some = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    held = [c for c in columns if some[c]]
    return df.sparkSession.createDataFrame(list(zip(held, values)), "feature string, weight double").orderBy(F.abs("weight").desc(), "feature")


def pca2(df: DataFrame, key: str, column: str) -> DataFrame:
    """Two principal components of centred vectors, with the share of variance of each; the sign is arbitrary."""
    data = from_arrays(df, column)
    mean = data.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray().tolist()
    centred = data.withColumn("features", array_to_vector(F.zip_with(vector_to_array("features"), F.array(*map(F.lit, mean)), lambda a, b: a - b)))
    m = PCA(k=2, inputCol="features", outputCol="p").fit(centred)
    share = m.explainedVariance.toArray().tolist()
    return m.transform(centred).select(key, vector_to_array("p")[0].alias("pc1"), vector_to_array("p")[1].alias("pc2"), F.lit(share[0]).alias("share1"), F.lit(share[1]).alias("share2"))


def topics(df: DataFrame, key: str, column: str, k: int = 8, seed: int = 0) -> DataFrame:
    """A topic number per vector by k-means; a stand-in for density-based topics, not the same partition."""
    from pyspark.ml.clustering import KMeans

    data = from_arrays(df, column)
    return KMeans(k=k, seed=seed).fit(data).transform(data).select(key, F.col("prediction").alias("topic"))


def matched(df: DataFrame, keys: DataFrame, on: Sequence[str], least: int = 20) -> DataFrame:
    """Rows of the documents that keys holds; nothing if fewer than least remain."""
    kept = df.join(keys.select(*on).distinct(), list(on), "left_semi")
    return kept if kept.limit(least).count() >= least else kept.limit(0)


