"""Training and scoring on Spark ML, gates, selection and corpus building."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import (
    IDF, PCA, CountVectorizerModel, PCAModel, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fields import truthy
from ..runtime import cut_lineage, global_row_number

PASS_THRESHOLD = 0.95
# Reconstruction-error limit of the unfitted anomaly test, and the
# margin added to the worst normal row of the fitted one.
FIXED_ANOMALY_LIMIT, ANOMALY_MARGIN = 0.1, 0.001
VOCABULARY = 10_000
MIN_TEXT = 10
# Marks around one chat turn.
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>\n"
PORT_FEATURES = ("f_port", "f_service", "f_product", "f_open", "f_version")


def train_binary(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    hidden: Sequence[int] | None = (32, 16),
    seed: int = 7,
    max_iter: int = 60,
) -> PipelineModel:
    """Standardise, then a perceptron (or logistic regression when ``hidden`` is None)."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]
    common = {
        "featuresCol": "features", "labelCol": label, "probabilityCol": "p_vector",
        "rawPredictionCol": "p_raw", "predictionCol": "p_class",
    }
    if hidden is None:
        stages.append(LogisticRegression(maxIter=max_iter, **common))
    else:
        layers = [len(features), *hidden, 2]
        stages.append(
            MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=max_iter, **common)
        )
    return Pipeline(stages=stages).fit(df)


def with_probability(df: DataFrame, model: Transformer, name: str = "p") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(name, vector_to_array("p_vector")[1]).select(*df.columns, name)


def text_label_index(df: DataFrame, label: str, order: str) -> DataFrame:
    """(label, label_index) numbered by first appearance."""
    firsts = df.groupBy(label).agg(F.min(order).alias("first_seen"))
    numbered = global_row_number(firsts, ["first_seen"], "label_index", 0).select(
        label, F.col("label_index").cast("double").alias("label_index")
    )
    # Written out like the codes below: texts are not dealt by their few labels.
    return cut_lineage(numbered, "labels")


def train_text_classifier(
    df: DataFrame, title: str, content: str, label: str, order: str, max_iter: int = 30, vocabulary: int = VOCABULARY
) -> tuple[PipelineModel, DataFrame]:
    """TF-IDF over title and content, at least ten characters; (model, label table).

    ``vocabulary`` is the number of commonest terms that are features; rarer ones are not used.
    Texts are cut into words once and counted once, both written; every pass of the fits reads the counts.
    """
    text = F.trim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    rows = df.withColumn("text", text).filter((F.length("text") >= MIN_TEXT) & truthy(label))
    labels = text_label_index(rows, label, order)
    cut = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="words", outputCol="kept"),
    ]
    words = cut_lineage(PipelineModel(cut).transform(rows.join(labels, label)).select("kept", "label_index"), "words")
    counted = words.select(F.explode("kept").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    commonest = counted.orderBy(F.col("n").desc(), "w").limit(vocabulary)  # of equally common terms the first in order
    counter = CountVectorizerModel.from_vocabulary([r["w"] for r in commonest.collect()], inputCol="kept", outputCol="tf")
    counts = cut_lineage(counter.transform(words).select("tf", "label_index"), "counts")
    fitted = Pipeline(stages=[
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_index", maxIter=max_iter),
    ]).fit(counts)
    return PipelineModel([*cut, counter, *fitted.stages]), labels


def dense_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """(value, code from 0 in value order, n codes): an encoder free of row order."""
    values = df.select(F.col(column)).distinct()
    coded = global_row_number(values, [F.col(column).asc_nulls_first()], name, 0)
    n = coded.agg(F.count("*")).scalar()
    # Written out, so that joins see how small it is: few values of a large table would be few keys to sort by.
    return cut_lineage(coded.withColumn(f"n_{name}", n), "codes")


def port_features(df: DataFrame) -> DataFrame:
    """Five numbers per port row: port, service code, product code, open, version length."""
    services = dense_codes(df.select(F.coalesce("service", F.lit("unknown")).alias("service")), "service", "svc")
    products = dense_codes(df.select(F.coalesce("product", F.lit("unknown")).alias("product")), "product", "prd")
    base = df.withColumn("__s", F.coalesce("service", F.lit("unknown"))).withColumn(
        "__p", F.coalesce("product", F.lit("unknown"))
    )
    services = services.withColumnRenamed("service", "__s")
    products = products.withColumnRenamed("product", "__p")
    out = base.join(services, "__s").join(products, "__p")
    return out.select(
        *df.columns,
        (F.col("port") / F.lit(65535.0)).alias("f_port"),
        (F.col("svc") / F.greatest(F.lit(1), F.col("n_svc"))).alias("f_service"),
        (F.col("prd") / F.greatest(F.lit(1), F.col("n_prd"))).alias("f_product"),
        F.when(F.col("state") == "open", 1.0).otherwise(0.0).alias("f_open"),
        (F.length(F.coalesce("version", F.lit(""))) / F.lit(100.0)).alias("f_version"),
    )


def train_risk(
    df: DataFrame, label: str = "risk_score", features: Sequence[str] = PORT_FEATURES, linear: bool = False
) -> PipelineModel:
    """Regression of risk on standardised port features."""
    regressor = (
        LinearRegression(featuresCol="features", labelCol=label)
        if linear
        else GBTRegressor(featuresCol="features", labelCol=label, maxIter=10, seed=7)
    )
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        regressor,
    ]
    return Pipeline(stages=stages).fit(df)


def score_risk(df: DataFrame, model: Transformer, name: str = "predicted_risk") -> DataFrame:
    """Predictions clipped to [0, 1]."""
    out = model.transform(df)
    clipped = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn(name, clipped).select(*df.columns, name)


@dataclass(frozen=True)
class AnomalyModel:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    threshold: float


def _standardised(model: AnomalyModel) -> Column:
    return F.array(
        *[
            (F.col(f).cast("double") - F.lit(m)) / F.lit(s)
            for f, m, s in zip(model.features, model.mean, model.std, strict=True)
        ]
    )


def anomaly_error(model: AnomalyModel) -> Column:
    """Mean squared distance between a row and its projection on the components."""
    x = F.col("__x")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    back = [F.lit(0.0)] * len(model.features)
    for comp in model.components:
        weight = dot(x, F.array(*[F.lit(c) for c in comp]))
        back = [b + weight * F.lit(c) for b, c in zip(back, comp, strict=True)]
    gaps = [(x[i] - b) * (x[i] - b) for i, b in enumerate(back)]
    total = F.lit(0.0)
    for g in gaps:
        total = total + g
    return total / F.lit(float(len(model.features)))


def fit_anomaly(
    normal: DataFrame,
    features: Sequence[str] = PORT_FEATURES,
    k: int = 2,
    threshold: float | None = None,
) -> AnomalyModel:
    """Principal components of normal rows; limit fixed, or the worst normal plus a margin."""
    names = tuple(features)
    stats = normal.agg(
        *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in names],
        *[F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in names],
    ).first()
    mean = tuple(float(stats[f"m_{f}"]) for f in names)
    std = tuple(float(stats[f"s_{f}"]) or 1.0 for f in names)
    shell = AnomalyModel(names, mean, std, (), 0.0)
    vectors = normal.select(array_to_vector(_standardised(shell)).alias("x"))
    pca: PCAModel = PCA(k=k, inputCol="x", outputCol="y").fit(vectors)
    comps = tuple(tuple(float(v) for v in col) for col in pca.pc.toArray().T)
    model = AnomalyModel(names, mean, std, comps, threshold or 0.0)
    if threshold is not None:
        return model
    worst = anomaly_score(normal, model).agg(F.max("anomaly_error")).first()[0]
    return AnomalyModel(names, mean, std, comps, float(worst) + ANOMALY_MARGIN)


def anomaly_score(df: DataFrame, model: AnomalyModel) -> DataFrame:
    """Adds ``anomaly_error`` and ``is_outlier``; native expressions only."""
    out = df.withColumn("__x", _standardised(model)).withColumn("anomaly_error", anomaly_error(model))
    return out.withColumn("is_outlier", F.col("anomaly_error") > model.threshold).drop("__x")


def detection_rate(scored: DataFrame, known: str) -> DataFrame:
    """Share of known anomalies that were flagged."""
    return scored.filter(F.col(known)).agg(
        F.count("*").alias("n"),
        F.avg(F.col("is_outlier").cast("double")).alias("detection_rate"),
    )


def score_and_gate(df: DataFrame, p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Verdict and confidence from a probability."""
    yes = F.col(p) >= threshold
    return df.withColumns(
        {
            "verdict": F.when(yes, "accepted").otherwise("rejected"),
            "confidence": F.when(yes, F.col(p)).otherwise(1 - F.col(p)),
        }
    )


def humility_gate(df: DataFrame, tau: float, p: str = "p") -> DataFrame:
    """Act only when sure enough; the rest goes to review with its entropy."""
    x = F.col(p)
    term = lambda v: F.when(v > 0, -v * F.log2(v)).otherwise(0.0)
    gate = F.when(x >= tau, "act").when(x <= 1 - tau, "refuse").otherwise("review")
    return df.withColumn("gate", gate).withColumn("entropy", term(x) + term(1 - x))


def review_sample(df: DataFrame, n: int, tie: str) -> DataFrame:
    """The ``n`` least certain rows to review."""
    return df.filter("gate = 'review'").orderBy(F.col("entropy").desc(), tie).limit(n)


def best_of_n(
    df: DataFrame,
    prompt: str,
    score: str,
    variation: str = "variation",
    response: str = "response",
    threshold: float = PASS_THRESHOLD,
) -> DataFrame:
    """Best response per prompt (first wins a tie), kept when good enough.

    A mergeable aggregate picks it, so a prompt with very many variants is
    reduced before the shuffle.
    """
    order = F.struct(F.col(score), -F.col(variation))
    rest = [c for c in df.columns if c != prompt]
    best = (
        df.filter(truthy(response))
        .groupBy(prompt)
        .agg(F.max_by(F.struct(*rest), order).alias("b"))
    )
    return best.select(prompt, "b.*").filter(F.col(score) >= threshold)


def template_grid(templates: DataFrame, n: int, seed: int | None = None, key: str = "template_id") -> DataFrame:
    """Every template with variants 0..n-1; with a seed, in a repeatable shuffled order."""
    out = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if seed is None:
        return out
    return out.withColumn("shuffle_key", F.xxhash64(F.col(key), F.col("variant"), F.lit(seed))).orderBy(
        "shuffle_key", key, "variant"
    )


def chat_corpus(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One training text per conversation.

    Turns are joined in runs of a thousand first, so that a very long
    conversation is assembled from few pieces.
    """
    line = F.concat(F.lit(TURN_OPEN), F.col(role), F.lit("\n"), F.col(text), F.lit(TURN_CLOSE))
    run = F.floor(F.col(turn) / 1000)
    pieces = df.groupBy(conv, run.alias("run")).agg(
        F.array_sort(F.collect_list(F.struct(turn, line.alias("line")))).alias("x"),
        F.count("*").alias("n"),
    ).select(conv, "run", "n", F.array_join(F.transform("x", lambda s: s["line"]), "").alias("piece"))
    whole = F.array_sort(F.collect_list(F.struct("run", "piece")))
    return pieces.groupBy(conv).agg(
        F.array_join(F.transform(whole, lambda s: s["piece"]), "").alias("text"),
        F.sum("n").alias("n_turns"),
    )


def hash_split(df: DataFrame, key: str, validation_pct: int = 10) -> DataFrame:
    """Stable train / validation tag from the key."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn(
        "split", F.when(F.pmod(digest, F.lit(100)) < validation_pct, "validation").otherwise("train")
    )

