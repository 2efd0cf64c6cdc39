"""Training, scoring, gates, selection, corpus and encryption queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as m
from ..operators import rollup, security
from ..operators import vectors as v
from .base import query
from .risks import ports
from .vectors import N_FEATURES, dictionary, topk

VARIANTS_SQL = """v AS (SELECT conv_id AS prompt, turn AS variation, CASE WHEN turn % 7 = 5 THEN '' ELSE text END AS response,
 round(least(length(text), 2000) / 2000.0::DOUBLE, 1) AS score FROM conversations WHERE role = 'assistant')"""


def variants(t):
    text = F.when(F.col("turn") % 7 == 5, "").otherwise(F.col("text"))
    return t.conversations.filter("role = 'assistant'").select(
        F.col("conv_id").alias("prompt"), F.col("turn").alias("variation"), text.alias("response"),
        F.round(F.least(F.length("text"), F.lit(2000)) / F.lit(2000.0), 1).alias("score"),
    )


@query(
    "best_of_n",
    f"""WITH {VARIANTS_SQL} SELECT * FROM (SELECT prompt, variation, md5(response) AS response, score FROM v WHERE response <> ''
 QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY score DESC, variation) = 1) WHERE score >= 0.3""",
)
def best_of_n(t):
    out = m.best_of_n(variants(t), "prompt", "score", threshold=0.3)
    return out.withColumn("response", F.md5("response"))


@query(
    "chat_corpus",
    """WITH c AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text, count(*) AS n_turns FROM conversations GROUP BY 1)
SELECT conv_id, md5(text) AS text_md5, n_turns, CASE WHEN ('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 10 THEN 'validation' ELSE 'train' END AS split FROM c""",
)
def chat_corpus(t):
    out = m.hash_split(m.chat_corpus(t.conversations), "conv_id")
    return out.select("conv_id", F.md5("text").alias("text_md5"), "n_turns", "split")


@query(
    "template_grid",
    "SELECT item_id, i AS variant FROM benchmark, range(25) r(i)",
)
def template_grid(t):
    out = m.template_grid(t.benchmark.select("item_id"), 25, seed=3, key="item_id")
    return out.select("item_id", F.col("variant").cast("bigint").alias("variant"))


@query(
    "prompt_grid",
    "SELECT conv_id, i AS variant, 'context ' || conv_id || ' prompt ' || i AS prompt FROM (SELECT DISTINCT conv_id FROM conversations), range(5) r(i)",
)
def prompt_grid(t):
    out = m.template_grid(t.conversations.select("conv_id").distinct(), 5)
    text = F.format_string("context %d prompt %d", F.col("conv_id"), F.col("variant"))
    return out.select("conv_id", F.col("variant").cast("bigint").alias("variant"), text.alias("prompt"))


@query(
    "humility_gate",
    """WITH p AS (SELECT event_id, least(value, 100.0) / 100.0 AS p FROM events)
SELECT event_id, CASE WHEN p >= 0.7 THEN 'act' WHEN p <= 1 - 0.7::DOUBLE THEN 'refuse' ELSE 'review' END AS gate,
 round(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN 1 - p > 0 THEN -(1 - p) * log2(1 - p) ELSE 0 END, 6) AS entropy FROM p""",
)
def humility_gate(t):
    p = t.events.select("event_id", (F.least("value", F.lit(100.0)) / 100.0).alias("p"))
    return m.humility_gate(p, 0.7).select("event_id", "gate", F.round("entropy", 6).alias("entropy"))


@query(
    "score_and_gate_rows",
    """WITH p AS (SELECT event_id, least(value, 100.0) / 100.0 AS p FROM events)
SELECT event_id, CASE WHEN p >= 0.5 THEN 'accepted' ELSE 'rejected' END AS verdict, round(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 8) AS confidence FROM p""",
)
def score_and_gate_rows(t):
    p = t.events.select("event_id", (F.least("value", F.lit(100.0)) / 100.0).alias("p"))
    return m.score_and_gate(p).select("event_id", "verdict", F.round("confidence", 8).alias("confidence"))


@query(
    "review_sample",
    """WITH p AS (SELECT event_id, least(value, 100.0) / 100.0 AS p FROM events)
SELECT event_id, 'review' AS gate FROM p WHERE p < 0.7 AND p > 1 - 0.7::DOUBLE ORDER BY abs(p - 0.5), event_id LIMIT 100""",
)
def review_sample(t):
    p = t.events.select("event_id", (F.least("value", F.lit(100.0)) / 100.0).alias("p"))
    return m.review_sample(m.humility_gate(p, 0.7), 100, "event_id").select("event_id", "gate")


@query("binary_classifier")
def binary_classifier(t):
    """Vectors to eight sums to a perceptron's verdict, counted against the label."""
    sums = v.gestalt(topk(t), N_FEATURES)
    data = sums.join(t.embeddings.select("vec_id", (F.col("label") < 5).cast("double").alias("truth")), "vec_id")
    model = m.train_binary(data, v.PILLARS, "truth", max_iter=20)
    return rollup.confusion(m.with_probability(data, model), "p", "truth")


@query("verdict_flow")
def verdict_flow(t):
    from ..plans.flows import vector_verdicts

    sums = v.gestalt(topk(t), N_FEATURES)
    data = sums.join(t.embeddings.select("vec_id", (F.col("label") < 5).cast("double").alias("truth")), "vec_id")
    model = m.train_binary(data, v.PILLARS, "truth", hidden=None, max_iter=20)
    scored, _ = vector_verdicts(t.embeddings, dictionary(t), N_FEATURES, model, 16)
    return scored.select("vec_id", "verdict", F.round("confidence", 6).alias("confidence"))


@query("text_classifier")
def text_classifier(t):
    docs = t.documents
    model, labels = m.train_text_classifier(docs, "source", "text", "lang", "doc_id", max_iter=5)
    text = F.concat_ws(" ", "source", "text")
    scored = model.transform(docs.withColumn("text", text))
    names = labels.select(F.col("lang").alias("predicted"), F.col("label_index").alias("prediction"))
    return scored.join(names, "prediction").groupBy("lang", "predicted").agg(F.count("*").alias("n"))


@query("risk_regressor")
def risk_regressor(t):
    data = m.port_features(ports(t))
    model = m.train_risk(data, linear=True)
    return m.score_risk(data, model).agg(
        F.count("*").alias("n"), F.min("predicted_risk").alias("lowest"), F.max("predicted_risk").alias("highest")
    )


@query("anomaly_scores")
def anomaly_scores(t):
    data = m.port_features(ports(t))
    model = m.fit_anomaly(data.filter("not is_anomaly"))
    scored = m.anomaly_score(data, model)
    return scored.groupBy("is_anomaly").agg(
        F.count("*").alias("n"), F.count_if("is_outlier").alias("outliers"), F.max("anomaly_error").alias("worst")
    )


@query("detection_rate")
def detection_rate(t):
    data = m.port_features(ports(t))
    model = m.fit_anomaly(data.filter("not is_anomaly"), threshold=m.FIXED_ANOMALY_LIMIT)
    return m.detection_rate(m.anomaly_score(data, model), "is_anomaly")


@query(
    "encryption_round_trip",
    "SELECT doc_id, TRUE AS same_text, TRUE AS same_list, TRUE AS hidden, '[Decryption Error]' AS with_wrong_key FROM documents",
)
def encryption_round_trip(t):
    # Throw-away keys made from the session's own id; real ones come from the caller.
    import hashlib

    app = t.spark.sparkContext.applicationId.encode()
    key, other = hashlib.sha256(app).digest(), hashlib.sha256(app + b"x").digest()
    df = t.documents.select("doc_id", "text", F.array("lang", "source").alias("list"))
    locked = security.encrypt_columns(df, ["text", "list"], key).select(
        "doc_id", F.col("text").alias("secret"), F.col("text"), F.col("list"), F.col("text").alias("wrong")
    )
    opened = security.decrypt_columns(security.decrypt_columns(locked, ["text", "list"], key), ["wrong"], other)
    plain = df.select("doc_id", F.col("text").alias("t0"), F.col("list").alias("l0"))
    return opened.join(plain, "doc_id").select(
        "doc_id", (F.col("text") == F.col("t0")).alias("same_text"), (F.col("list") == F.col("l0")).alias("same_list"),
        (F.col("secret") != F.col("t0")).alias("hidden"), F.col("wrong").alias("with_wrong_key"),
    )


@query(
    "read_settings",
    "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name AS value FROM nation",
)
def read_settings(t):
    import hashlib

    key = hashlib.sha256(t.spark.sparkContext.applicationId.encode()).digest()
    flag = F.col("n_nationkey") % 2 == 0
    plain = t.nation.select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"), flag.alias("encrypted"))
    locked = security.encrypt_columns(plain, ["value"], key).withColumnRenamed("value", "locked")
    value = F.when(F.col("encrypted"), F.col("locked")).otherwise(F.col("value"))
    mixed = plain.join(locked.drop("encrypted"), "key").select("key", value.alias("value"), "encrypted")
    return security.read_settings(mixed, key)
