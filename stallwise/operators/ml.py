"""Model pipelines: imputed numbers, text features, categories, and a registry of classifiers that Spark ML has."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, Imputer, NGram, Normalizer, OneHotEncoder, PCA, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN
from ..sources.scratch import Scratch
from .splits import folds

#: Seeds, sizes and vocabularies of the registry. Fixed values.
SEED, TERMS, TREES, FOREST = 42, 500, 120, 240
#: Texts of a task where terms are counted, in the mean.
TOGETHER = 4_000

CLASSIFIERS = {
    "logistic": lambda: LogisticRegression(maxIter=100, regParam=0.01),
    "sgd": lambda: LogisticRegression(maxIter=50, regParam=1e-4),
    "svm": lambda: LinearSVC(maxIter=50, regParam=0.01),
    "tree": lambda: DecisionTreeClassifier(maxDepth=5, seed=SEED),
    "forest": lambda: RandomForestClassifier(numTrees=FOREST, maxDepth=8, seed=SEED),
    "extra_trees": lambda: RandomForestClassifier(numTrees=TREES, maxDepth=10, featureSubsetStrategy="sqrt", subsamplingRate=1.0, seed=SEED),
    "hist_gb": lambda: GBTClassifier(maxIter=30, maxDepth=4, stepSize=0.1, seed=SEED),
    "xgboost": lambda: GBTClassifier(maxIter=40, maxDepth=5, stepSize=0.08, subsamplingRate=0.9, seed=SEED),
    "naive_bayes": lambda: NaiveBayes(),
    "lightgbm": lambda: GBTClassifier(maxIter=60, maxDepth=5, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.8", seed=SEED),
    "catboost": lambda: GBTClassifier(maxIter=50, maxDepth=6, stepSize=0.06, seed=SEED),
    "extra_trees_tuned": lambda: RandomForestClassifier(numTrees=FOREST, maxDepth=14, minInstancesPerNode=3, featureSubsetStrategy="sqrt", subsamplingRate=1.0, seed=SEED),
    "hist_gb_tuned": lambda: GBTClassifier(maxIter=80, maxDepth=4, stepSize=0.05, minInstancesPerNode=20, validationTol=0.005, validationIndicatorCol="__held", seed=SEED),
}
#: Models that learn with class weights, and those without texts. Fixed values.
WEIGHTED = ("logistic", "sgd", "svm", "tree", "forest", "extra_trees", "extra_trees_tuned", "hist_gb_tuned", "catboost")
WITHOUT_TEXT = ("extra_trees", "extra_trees_tuned", "hist_gb", "hist_gb_tuned", "catboost")
STACKED = ("forest", "xgboost", "lightgbm")
#: Settings of the full preparation, over those of the plain one. Fixed values.
FULL = {"terms": 400, "min_df": 3, "accents": True, "min_frequency": 5}


def preparation(numbers: list[str], texts: list[str] = (), categories: list[str] = (), scale: bool = True, terms: int = TERMS, min_df: int = 2, components: int = 0, accents: bool = False, min_frequency: int = 1, counted: dict[str, list[int]] | None = None) -> list:
    """Stages from columns to ``features``: medians for missing numbers, one- and two-word TF-IDF for each text, one-hot categories; components > 0 reduces the texts by PCA.

    accents: strip them first. Categories of fewer than min_frequency rows have no column, and are all zeros, as new ones are.
    counted: for each text the places of its terms in the vectors of its column __all, where the terms are counted already.
    """
    stages, parts = [], []
    if numbers:
        filled = [f"{c}__filled" for c in numbers]
        stages += [Imputer(strategy="median", inputCols=numbers, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__numbers", handleInvalid="keep")]
        stages += [StandardScaler(withMean=False, inputCol="__numbers", outputCol="__scaled")] if scale else []
        parts.append("__scaled" if scale else "__numbers")
    for c in texts:
        if counted:
            stages.append(VectorSlicer(inputCol=f"{c}__all", outputCol=f"{c}__counts", indices=counted[c]))
        else:
            stages += [*_terms(c, accents), CountVectorizer(inputCol=f"{c}__terms", outputCol=f"{c}__counts", vocabSize=terms, minDF=min_df)]
        stages.append(IDF(inputCol=f"{c}__counts", outputCol=f"{c}__tfidf"))
        if components:
            stages.append(PCA(k=components, inputCol=f"{c}__tfidf", outputCol=f"{c}__pca"))
        parts.append(f"{c}__pca" if components else f"{c}__tfidf")
    if categories and min_frequency > 1:
        for c in categories:
            stages += [SQLTransformer(statement=f"select *, array_compact(array(cast(`{c}` as string))) as `{c}__one` from __THIS__"), CountVectorizer(inputCol=f"{c}__one", outputCol=f"{c}__hot", minDF=float(min_frequency), binary=True)]
        parts += [f"{c}__hot" for c in categories]
    elif categories:
        index, hot = [f"{c}__index" for c in categories], [f"{c}__hot" for c in categories]
        stages += [StringIndexer(inputCols=list(categories), outputCols=index, handleInvalid="keep"), OneHotEncoder(inputCols=index, outputCols=hot)]
        parts += hot
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def _terms(c: str, accents: bool) -> list:
    """Stages from a text to its one- and two-word terms."""
    return [
        SQLTransformer(statement=f"select *, {_folded(c) if accents else f"lower(coalesce(`{c}`, ''))"} as `{c}__low` from __THIS__"),
        RegexTokenizer(inputCol=f"{c}__low", outputCol=f"{c}__one", pattern=r"[^a-z0-9]+", minTokenLength=2),
        NGram(n=2, inputCol=f"{c}__one", outputCol=f"{c}__two"),
        SQLTransformer(statement=f"select *, concat(`{c}__one`, `{c}__two`) as `{c}__terms` from __THIS__"),
    ]


def _folded(c: str) -> str:
    """SQL of a column in lower case without accents."""
    return f"translate(lower(coalesce(`{c}`, '')), '{ACCENTED}', '{PLAIN}')"


def pipeline(name: str, label: str, weight: str | None = None, **columns) -> Pipeline:
    """The model's stages; weight: a column of row weights, e.g. balanced_weights, for the models that take class weights."""
    if name in WITHOUT_TEXT:
        columns["texts"] = ()
    learner = CLASSIFIERS[name]().setLabelCol(label).setFeaturesCol("features")
    held = []
    if learner.hasParam("validationIndicatorCol") and learner.isDefined("validationIndicatorCol"):  # a tenth of the rows, by a hash of their numbers, tells when to stop
        held = [SQLTransformer(statement=f"select *, pmod(xxhash64({', '.join(f'`{c}`' for c in columns['numbers'])}), 10) = 0 as `__held` from __THIS__")]
    return Pipeline(stages=[*held, *preparation(**columns), learner.setWeightCol(weight) if weight and name in WEIGHTED else learner])


def stacked_scores(train: DataFrame, df: DataFrame, label: str, key: str, base: tuple[str, ...] = STACKED, name: str = "score", **columns) -> DataFrame:
    """df with the score of a logistic regression over the base models' scores.

    The stacker learns from scores that each half of train gets from models of the other half (by a hash of the key), so none has seen its label.
    """
    half = lambda k: train.filter(F.pmod(F.xxhash64(key), F.lit(2)) == k)

    def scored(fit_on: DataFrame, rows: DataFrame) -> DataFrame:
        for b in base:
            rows = with_scores(pipeline(b, label, **columns).fit(fit_on), rows, f"__{b}")
        return rows

    meta = stacker(scored(half(0), half(1)).unionByName(scored(half(1), half(0))), [f"__{b}" for b in base], label)
    return with_scores(meta, scored(train, df), name).drop(*[f"__{b}" for b in base])


def student(train: DataFrame, df: DataFrame, teacher: str, cutoff: float | None = None, name: str = "score", **columns) -> DataFrame:
    """df with the score of a student of the teacher's scores: a linear regression held to 0 and 1, or with a cutoff a classifier of who passes it.

    Rows of train without a teacher's score are left out.
    """
    known = train.filter(F.col(teacher).isNotNull() & ~F.isnan(teacher))
    if cutoff is not None:
        known = balanced_weights(known.withColumn("__passes", (F.col(teacher) >= cutoff).cast("double")), "__passes", "__w")
        return with_scores(pipeline("logistic", "__passes", "__w", **columns).fit(known), df, name)
    model = Pipeline(stages=[*preparation(**columns), LinearRegression(labelCol=teacher, featuresCol="features", predictionCol="__p", regParam=0.01)]).fit(known)
    return model.transform(df).select(*df.columns, F.least(F.greatest("__p", F.lit(0.0)), F.lit(1.0)).alias(name))


def text_vectors(df: DataFrame, text: str, name: str = "vector", terms: int = 1 << 14, min_df: int = 2):
    """(df with the text's unit TF-IDF vector over one- and two-word terms that min_df rows have, the fitted stages)."""
    model = Pipeline(stages=[*preparation([], [text], terms=terms, min_df=min_df)[:-1], Normalizer(p=2.0, inputCol=f"{text}__tfidf", outputCol=name)]).fit(df)
    return model.transform(df).select(*df.columns, name), model


def save(model, path: str) -> None:
    """Spark's own writer: the stages and their data as files under path."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights that give both classes the same total; two counts, joined by broadcast."""
    n = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(F.col(label).cast("double")).alias("__p"))
    w = F.when(F.col(label) == 1, F.try_divide(F.col("__n"), 2 * F.col("__p"))).otherwise(F.try_divide(F.col("__n"), 2 * (F.col("__n") - F.col("__p"))))
    return df.join(F.broadcast(n), F.lit(True)).withColumn(name, w).drop("__n", "__p")


def with_scores(model, df: DataFrame, name: str = "score") -> DataFrame:
    """df with the model's probability of label 1; of a margin model, the logistic function of its margin (calibrated_svm calibrates it)."""
    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)
    return out.withColumn(name, 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))).select(*df.columns, name)


def platt(df: DataFrame, margin: str, label: str, steps: int = 50) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(a * margin + b)), the likeliest for labels smoothed as (n1 + 1) / (n1 + 2) and 1 / (n0 + 2), by Newton steps of one aggregation each."""
    rows = df.select(F.col(margin).cast("double").alias("m"), (F.col(label) == 1).alias("y")).filter("m is not null and y is not null and not isnan(m)")
    n, n1 = rows.agg(F.count(F.lit(1)), F.count_if("y")).first()
    high, low = (n1 + 1) / (n1 + 2), 1 / (n - n1 + 2)
    t, m = F.when(F.col("y"), high).otherwise(low), F.col("m")
    a, b = 0.0, float(np.log((n - n1 + 1) / (n1 + 1)))

    def cost(a: float, b: float, more: tuple = ()):
        z = a * m + b
        loss = t * z + F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        return rows.agg(F.sum(loss), *more).first()

    for _ in range(steps if n else 0):
        p = 1 / (1 + F.exp(a * m + b))
        d, w = t - p, p * (1 - p)
        now, ga, gb, haa, hab, hbb = cost(a, b, (F.sum(m * d), F.sum(d), F.sum(m * m * w), F.sum(m * w), F.sum(w)))
        if max(abs(ga), abs(gb)) < 1e-9 * max(n, 1):
            break
        step, scale = np.linalg.solve(np.array([[haa + 1e-12, hab], [hab, hbb + 1e-12]]), np.array([ga, gb])), 1.0
        while scale > 1e-10 and cost(a - scale * step[0], b - scale * step[1])[0] > now + 1e-12 * abs(now):
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
    return float(a), float(b)


def margins(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).select(*df.columns, vector_to_array("rawPrediction")[1].alias(name))


def vocabularies(dealt: DataFrame, terms: str, fold: str, cv: int, size: int, min_df: float, scratch: Scratch) -> list[list[str]]:
    """For each fold the vocabulary that a CountVectorizer finds in the others: the most frequent terms of those that min_df rows have, ties in the terms' order. One pass over the texts."""
    least = [min_df] * cv if min_df >= 1 else [min_df * dealt.filter(F.col(fold) != k).count() for k in range(cv)]
    both = F.array(F.col(terms), F.array_distinct(terms))  # a term counts as often as it stands, and once a row
    each = dealt.select(fold, F.posexplode(both).alias("__once", "__terms")).select(fold, "__once", F.explode("__terms").alias("__term"))
    n = lambda once, k: F.count_if((F.col("__once") == once) & (F.col(fold) != k))
    counts = each.groupBy("__term").agg(*[n(once, k).alias(f"__{name}{k}") for once, name in enumerate(("n", "rows")) for k in range(cv)])
    often = [F.col(f"__rows{k}") >= least[k] for k in range(cv)]
    counts = scratch.write(counts.filter(sum((F.when(x, 1).otherwise(0) for x in often), F.lit(0)) > 0))
    return [[r[0] for r in counts.filter(often[k]).orderBy(F.desc(f"__n{k}"), "__term").limit(size).select("__term").collect()] for k in range(cv)]


def calibrated_svm(train: DataFrame, df: DataFrame, label: str, key: str, cv: int = 3, name: str = "score", weight: str | None = None, **columns) -> DataFrame:
    """df with a linear SVM's calibrated probability: each of cv models learns from the other folds (dealt round by class), is calibrated on margins of the fold that it hasn't seen, and the probabilities are averaged.

    Terms are counted over the texts once for all folds; then each text becomes one vector of the counts of all models' terms, of which a model takes its own.
    """
    scratch, texts, accents = Scratch(df.sparkSession, "svm"), columns.get("texts", ()), columns.get("accents", False)
    needed = dict.fromkeys([key, label, *([weight] if weight else []), *columns["numbers"], *texts, *columns.get("categories", ())])
    dealt, found, places, out = folds(train.select(*needed), label, key, cv, "__fold"), [], [{} for _ in range(cv)], df.columns
    dealt = scratch.write(dealt.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(train.count() / TOGETHER))) if texts else dealt)
    split = Pipeline(stages=[s for c in texts for s in _terms(c, accents)]).fit(dealt)
    for c in texts:
        found_terms = vocabularies(split.transform(dealt), f"{c}__terms", "__fold", cv, columns.get("terms", TERMS), columns.get("min_df", 2), scratch)
        every = sorted({t for v in found_terms for t in v})
        at = {t: i for i, t in enumerate(every)}
        for k in range(cv):
            places[k][c] = [at[t] for t in found_terms[k]]
        split.stages.append(CountVectorizerModel.from_vocabulary(every, inputCol=f"{c}__terms", outputCol=f"{c}__all"))
    if texts:
        count = lambda rows: split.transform(rows).select(*rows.columns, *[f"{c}__all" for c in texts])
        dealt, df = scratch.write(count(dealt).drop(*texts)), count(df)
    for k in range(cv):
        model = pipeline("svm", label, weight, **columns, counted=places[k]).fit(dealt.filter(F.col("__fold") != k))
        a, b = platt(scratch.write(margins(model, dealt.filter(F.col("__fold") == k), "__m").select("__m", label)), "__m", label)
        df = margins(model, df, f"__m{k}")
        found.append(1 / (1 + F.exp(a * F.col(f"__m{k}") + b)))
    scratch.close()
    return df.withColumn(name, sum(found[1:], found[0]) / cv).select(*out, name)


def svd_vectors(df: DataFrame, text: str, k: int = 50, name: str = "svd", terms: int = TERMS, min_df: int = 2, accents: bool = False, **_) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(df with the text's TF-IDF vector in the first k right singular directions, the directions as columns, the singular values): a truncated SVD of the sparse rows, not centred.

    Spark finds the singular vectors from products of the distributed rows with vectors; what comes to the driver is terms by k.
    """
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    model = Pipeline(stages=preparation([], [text], terms=terms, min_df=min_df, accents=accents)[:-1]).fit(df)
    rows = Scratch(df.sparkSession, "svd").write(model.transform(df).select(*df.columns, F.col(f"{text}__tfidf").alias("__x")))  # read once for each product
    size = len(model.stages[-2].vocabulary)
    found = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select("__x"), "__x")).computeSVD(min(k, size), False)
    v, s = found.V.toArray(), found.s.toArray()

    @F.pandas_udf("array<double>")
    def projected(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(x.to_numpy()) @ v) if len(x) else [], dtype=object)

    return rows.withColumn(name, projected(vector_to_array("__x"))).drop("__x"), v, s


def stacker(wide: DataFrame, scores: list[str], label: str):
    """A logistic regression over the scores of other models."""
    return Pipeline(stages=[*preparation(scores), LogisticRegression(labelCol=label)]).fit(wide)


def wald(df: DataFrame, numbers: list[str], label: str) -> DataFrame:
    """feature, coefficient, error, z, p and the 95 % interval of a binomial regression."""
    from pyspark.ml.regression import GeneralizedLinearRegression

    rows = VectorAssembler(inputCols=numbers, outputCol="features", handleInvalid="skip").transform(df)
    model = GeneralizedLinearRegression(family="binomial", link="logit", labelCol=label).fit(rows)
    s = model.summary
    names, values = [*numbers, "intercept"], [*model.coefficients.toArray().tolist(), model.intercept]
    found = list(zip(names, values, s.coefficientStandardErrors, s.tValues, s.pValues, strict=True))
    out = df.sparkSession.createDataFrame([tuple([n, *map(float, x)]) for n, *x in found], "feature string, coefficient double, error double, z double, p double")
    return out.withColumn("low", F.col("coefficient") - 1.96 * F.col("error")).withColumn("high", F.col("coefficient") + 1.96 * F.col("error"))


def centroid_scores(train: DataFrame, df: DataFrame, numbers: list[str], label: str, name: str = "score") -> DataFrame:
    """df with the share of its distance to the centroid of label 0 in both distances; the centroids are one broadcast row."""
    means = train.agg(*[F.avg(F.when(F.col(label) == k, F.col(c))).alias(f"__{c}{k}") for c in numbers for k in (0, 1)])
    far = lambda k: F.sqrt(sum((F.pow(F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"__{c}{k}"), 2) for c in numbers), F.lit(0.0)))
    return df.join(F.broadcast(means), F.lit(True)).withColumn(name, F.coalesce(F.try_divide(far(0), far(0) + far(1)), F.lit(0.5))).select(*df.columns, name)
