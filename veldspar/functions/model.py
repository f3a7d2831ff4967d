"""A trained intent classifier on word n-grams, and request texts from templates to train it on."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, IndexToString, NGram, Normalizer, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGETS = ["body_type", "fuel_type", "transmission", "use_case"]

# Request templates and what fills them.
TEMPLATES = ["{use} {body} under {price} lakh", "{gear} {fuel} {body}", "i want a {body} for {use} use", "{fuel} car with {gear} gearbox", "best {use} car under {price} lakh", "{body} that runs on {fuel}, {gear}", "show me {gear} cars for {use}", "{price} lakh {fuel} {body} for {use}"]
VALUES = {"use": ["family", "city", "highway", "budget", "premium"], "body": ["suv", "sedan", "hatchback", "mpv"], "fuel": ["petrol", "diesel", "cng", "electric"], "gear": ["manual", "automatic"], "price": ["8", "12", "20"]}
_LABEL = {"body_type": "body", "fuel_type": "fuel", "transmission": "gear", "use_case": "use"}


# The features that a generated text may ask for.
FEATURES = ["sunroof", "airbags", "abs", "cruise_control", "android_auto", "apple_carplay"]


def one_hot(feature: Column, names: list[str] = FEATURES) -> Column:
    """A flag for each feature, true for the one that a text was generated with; all false without one."""
    return F.struct(*(F.coalesce(feature == n, F.lit(False)).alias(n) for n in names))


def generated(spark: SparkSession, rows: int = 400, seed: int = 42) -> DataFrame:
    """(query, labels, split): distinct texts of all templates and values, in a hashed order; what a
    text does not say is ``unknown``, and a fifth is for tests."""
    out = None
    for template in TEMPLATES:
        held = spark.range(1).select(F.lit(template).alias("query"))
        for name, values in VALUES.items():
            if f"{{{name}}}" in template:
                held = held.select("*", F.explode(F.array(*map(F.lit, values))).alias(name)).withColumn("query", F.replace("query", F.lit(f"{{{name}}}"), F.col(name)))
            else:
                held = held.withColumn(name, F.lit("unknown"))
        held = held.select("query", *(F.col(v).alias(k) for k, v in _LABEL.items()))
        out = held if out is None else out.union(held)
    out = out.dropDuplicates(["query"]).withColumn("__h", F.xxhash64("query", F.lit(seed))).orderBy("__h").limit(rows)
    return out.withColumn("split", F.when(F.pmod("__h", F.lit(5)) == 0, "test").otherwise("train")).drop("__h")


def trained(labelled: DataFrame, target: str, text: str = "query") -> PipelineModel:
    """Term weights of words and word pairs, and a logistic regression with balanced classes."""
    per = labelled.groupBy(target).agg(F.count("*").alias("__n"))
    whole = per.agg(F.sum("__n").alias("__all"), F.count("*").alias("__k"))
    rows = labelled.join(F.broadcast(per), target).crossJoin(whole).withColumn("__w", F.col("__all") / (F.col("__k") * F.col("__n")))  # one row
    stages = [
        StringIndexer(inputCol=target, outputCol="__y", handleInvalid="keep"),
        RegexTokenizer(inputCol=text, outputCol="__1", pattern=r"\w\w+", gaps=False),
        NGram(n=2, inputCol="__1", outputCol="__2"),
        *(CountVectorizer(inputCol=f"__{i}", outputCol=f"__c{i}", minDF=1) for i in (1, 2)),
        VectorAssembler(inputCols=["__c1", "__c2"], outputCol="__c"),
        IDF(inputCol="__c", outputCol="__t"),
        Normalizer(inputCol="__t", outputCol="__f"),
        LogisticRegression(featuresCol="__f", labelCol="__y", weightCol="__w", maxIter=100, regParam=0.001, predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r"),
    ]
    return Pipeline(stages=stages).fit(rows)


def predicted(model: PipelineModel, requests: DataFrame, name: str) -> DataFrame:
    """``requests`` with the model's label in column ``name``."""
    back = IndexToString(inputCol="__p", outputCol=name, labels=model.stages[0].labels)
    steps = PipelineModel([s for s in model.stages[1:]] + [back])
    return steps.transform(requests).select(*requests.columns, name)


def trained_all(labelled: DataFrame, targets: list[str] = TARGETS, text: str = "query") -> dict[str, PipelineModel]:
    """A model for each target; texts are cut, counted and weighed once for all of them.

    The labelled texts are a bounded sample (of :func:`generated`, say), kept in one partition
    while they are fitted.
    """
    shaping = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__1", pattern=r"\w\w+", gaps=False),
        NGram(n=2, inputCol="__1", outputCol="__2"),
        *(CountVectorizer(inputCol=f"__{i}", outputCol=f"__c{i}", minDF=1) for i in (1, 2)),
        VectorAssembler(inputCols=["__c1", "__c2"], outputCol="__c"),
        IDF(inputCol="__c", outputCol="__t"),
        Normalizer(inputCol="__t", outputCol="__f"),
    ]).fit(labelled)
    counts = {t: {r[0]: r[1] for r in labelled.groupBy(t).agg(F.count("*")).collect()} for t in targets}  # a row for each label
    rows = shaping.transform(labelled).select("__f", *targets).coalesce(1).persist()
    models = {}
    for t in targets:
        n = sum(counts[t].values())
        weights = F.create_map(*(F.lit(x) for label, c in counts[t].items() for x in (label, n / (len(counts[t]) * c))))
        index = StringIndexer(inputCol=t, outputCol="__y", handleInvalid="keep").fit(rows)
        fit = LogisticRegression(featuresCol="__f", labelCol="__y", weightCol="__w", maxIter=100, regParam=0.001, predictionCol="__p", probabilityCol="__q", rawPredictionCol="__r")
        models[t] = PipelineModel([index, *shaping.stages, fit.fit(index.transform(rows).withColumn("__w", weights[F.col(t)]))])
    rows.unpersist()
    return models


def predicted_all(models: dict[str, PipelineModel], requests: DataFrame, prefix: str = "guess_") -> DataFrame:
    """``requests`` with each target's label in ``<prefix><target>``; the models share their texts' weights."""
    first = next(iter(models.values()))
    rows, names = PipelineModel(first.stages[1:-1]).transform(requests).select(*requests.columns, "__f"), list(requests.columns)
    for target, model in models.items():
        back = IndexToString(inputCol="__p", outputCol=f"{prefix}{target}", labels=model.stages[0].labels)
        names.append(f"{prefix}{target}")
        rows = PipelineModel([model.stages[-1], back]).transform(rows).select(*names, "__f")
    return rows.drop("__f")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
