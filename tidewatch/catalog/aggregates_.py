"""D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.catalog.joins_ import V_GAPS, V_LATEST, latest
from tidewatch.catalog.registry import V_COMMENT, V_SCORED, V_SNAP, Tables, query, rounded, within_rank
from tidewatch.catalog.shaping_ import STRIP
from tidewatch.functions.numeric import scaled
from tidewatch.operators import aggregates, alerts, metrics, sketches
from tidewatch.operators.quantiles import bounds, exact_quantiles
from tidewatch.operators.ranking import top
from tidewatch.plans import virality
from tidewatch.plans.cleaning import comment_texts

# Labels and probabilities, both kept for every document.
JUDGED = "viral_label AS y, viral_probability AS p"

CONFUSION = """confusion AS (
  SELECT count(*) FILTER (WHERE viral_label <> 1 AND viral_probability < 0.5E0) AS tn,
    count(*) FILTER (WHERE viral_label <> 1 AND viral_probability >= 0.5E0) AS fp,
    count(*) FILTER (WHERE viral_label = 1 AND viral_probability < 0.5E0) AS fn,
    count(*) FILTER (WHERE viral_label = 1 AND viral_probability >= 0.5E0) AS tp
  FROM v_scored)"""

CLASSIFICATION = """classification AS (
  SELECT (tp + tn) / (tp + tn + fp + fn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision",
    coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score,
    coalesce((tp * tn - fp * fn) / nullif(sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc
  FROM confusion)"""

PROBABILISTIC = """probabilistic AS (
  SELECT avg((viral_label - p) * (viral_label - p)) AS brier_score,
    avg(-(viral_label * ln(s) + (1 - viral_label) * ln(1 - s))) AS log_loss,
    sqrt(avg((viral_label - p) * (viral_label - p))) AS rmse, avg(abs(viral_label - p)) AS mae,
    avg(CASE WHEN viral_label = 1 THEN abs(viral_label - p) END) * 100 AS mape_viral,
    count(*) AS test_samples, count(*) FILTER (WHERE viral_label = 1) AS viral_in_test
  FROM (SELECT viral_label, viral_probability AS p,
          least(greatest(viral_probability, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS s FROM v_scored))"""

ROC = """per_score AS (
  SELECT viral_probability AS score, count(*) FILTER (WHERE viral_label = 1) AS pos,
    count(*) FILTER (WHERE viral_label <> 1) AS neg FROM v_scored GROUP BY 1),
ranked AS (SELECT *, sum(neg) OVER (ORDER BY score) - neg AS below FROM per_score),
roc AS (SELECT sum(pos * (below + neg / 2.0E0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS roc_auc FROM ranked)"""


@query("d1_group_size", "SELECT narrative_cluster_id, count(*) AS cluster_volume FROM v_scored GROUP BY 1", V_SCORED)
def d1(t: Tables):
    return aggregates.group_sizes(t.scored(), "narrative_cluster_id")


@query("d2_group_count_mean", """
    SELECT cluster_topic_name, count(video_id) AS n, round(avg(viral_probability), 6) AS mean FROM v_scored GROUP BY 1""", V_SCORED)
def d2(t: Tables):
    return rounded(aggregates.count_and_mean(t.scored(), "cluster_topic_name", "video_id", "viral_probability"))


@query("d3_value_counts", """
    SELECT CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END AS label, count(*) AS n
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1 HAVING label IS NOT NULL""")
def d3(t: Tables):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left").selectExpr(
        "CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END AS verdict"
    )
    return aggregates.value_counts(rows, "verdict")


@query("d4_global_mean", """
    SELECT round(avg(viral_probability), 3) AS viral, round(avg(toxicity_score), 3) AS toxicity FROM v_scored""", V_SCORED)
def d4(t: Tables):
    means = t.scored().agg(F.avg("viral_probability").alias("viral"), F.avg("toxicity_score").alias("toxicity"))
    return rounded(means, 3)


@query("d5_conditional_counts", """
    SELECT count(*) AS n, count(*) FILTER (WHERE emerging_narrative = 'emerging') AS emerging,
      count(*) FILTER (WHERE viral_probability >= 0.7E0) AS high, count(*) FILTER (WHERE pharma_risk_label = 'high_risk') AS risky
    FROM v_scored""", V_SCORED)
def d5(t: Tables):
    return t.scored().agg(
        F.count("*").alias("n"), F.count_if(F.col("emerging_narrative") == "emerging").alias("emerging"),
        F.count_if(F.col("viral_probability") >= 0.7).alias("high"),
        F.count_if(F.col("pharma_risk_label") == "high_risk").alias("risky"),
    )


@query("d6_exact_quantile", """
    SELECT round(quantile_cont(trend_score, 0.90), 6) AS trend_q90, round(quantile_cont(narrative_trend_score, 0.95), 6) AS narrative_q95,
      round(quantile_cont(growth_acceleration, 0.95), 6) AS acceleration_q95 FROM v_scored""", V_SCORED)
def d6(t: Tables):
    found = exact_quantiles(t.scored(), {
        "trend_q90": (F.col("trend_score"), 0.90), "narrative_q95": (F.col("narrative_trend_score"), 0.95),
        "acceleration_q95": (F.col("growth_acceleration"), 0.95),
    })
    return rounded(t.spark.range(1).select(*[F.lit(v).alias(n) for n, v in found.items()]))


@query("d19_joint_quantiles", """
    SELECT name, n, round(q05, 6) AS q05, round(median, 6) AS median, round(q99, 6) AS q99 FROM (
      SELECT 'l_quantity' AS name, count(l_quantity) AS n, quantile_cont(l_quantity, 0.05) AS q05, quantile_cont(l_quantity, 0.5) AS median,
        quantile_cont(l_quantity, 0.99) AS q99 FROM lineitem
      UNION ALL SELECT 'l_extendedprice', count(l_extendedprice), quantile_cont(l_extendedprice, 0.05),
        quantile_cont(l_extendedprice, 0.5), quantile_cont(l_extendedprice, 0.99) FROM lineitem
      UNION ALL SELECT 'l_discount', count(l_discount), quantile_cont(l_discount, 0.05),
        quantile_cont(l_discount, 0.5), quantile_cont(l_discount, 0.99) FROM lineitem
      UNION ALL SELECT 'l_tax', count(l_tax), quantile_cont(l_tax, 0.05), quantile_cont(l_tax, 0.5), quantile_cont(l_tax, 0.99) FROM lineitem)""")
def d19_joint(t: Tables):
    """Twelve quantiles of four columns, narrowed together in the same passes down to a thousand rows each."""
    shares = {"q05": 0.05, "median": 0.5, "q99": 0.99}
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    found = exact_quantiles(t.lineitem, {f"{c}_{n}": (F.col(c), q) for c in names for n, q in shares.items()}, small=1000)
    counts = t.lineitem.agg(*[F.count(c).alias(c) for c in names])
    return rounded(counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).alias("n"), *[F.lit(found[f"{c}_{n}"]).cast("double").alias(n) for n in shares]) for c in names
    ]))))


@query("d6_quantile_sketch", """
    SELECT 'viral_probability' AS score, count(viral_probability) AS n, true AS within FROM v_scored
    UNION ALL SELECT 'trend_score', count(trend_score), true FROM v_scored""", V_SCORED)
def d6_sketch(t: Tables):
    """Two columns' 0.9 quantiles from one pass, held to their exact ranks."""
    rows, q, names = t.scored(), 0.9, ("viral_probability", "trend_score")
    found = sketches.approx_quantiles(rows, {c: (F.col(c), q) for c in names})
    ranks = rows.agg(*[x for c in names for x in (
        F.count(c).alias(f"n_{c}"), F.count_if(F.col(c) < found[c]).alias(f"under_{c}"), F.count_if(F.col(c) <= found[c]).alias(f"upto_{c}"))])
    return ranks.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("score"), F.col(f"n_{c}").alias("n"), within_rank(f"under_{c}", f"upto_{c}", f"n_{c}", q).alias("within")) for c in names
    ])))


@query("d7_min_max_normalise", """
    SELECT video_id, round((trend_score - lo) / (hi - lo), 6) AS trend01, 0E0 AS constant01
    FROM v_scored, (SELECT min(trend_score) AS lo, max(trend_score) AS hi FROM v_scored)""", V_SCORED)
def d7(t: Tables):
    rows = t.scored().withColumn("same", F.lit(3.0))
    limits = bounds(rows, {"trend_score": F.col("trend_score"), "same": F.col("same")})
    return rounded(rows.select(
        "video_id", scaled(F.col("trend_score"), *limits["trend_score"]).alias("trend01"),
        scaled(F.col("same"), *limits["same"]).alias("constant01"),
    ))


@query("d8_ordered_text_concat", f"""
    SELECT video_id, string_agg({STRIP.format('text')}, chr(10) || chr(10) ORDER BY comment_id) AS comments_text
    FROM v_comment WHERE {STRIP.format('text')} <> '' GROUP BY video_id""", V_COMMENT)
def d8(t: Tables):
    return comment_texts(t.comment())


@query("d9_comment_summary", """
    SELECT video_id, count(*) AS comments_count_fetched,
      CAST(sum(CASE WHEN like_count > 3 THEN like_count ELSE 0 END) AS BIGINT) AS top_comment_like_total
    FROM v_comment GROUP BY video_id""", V_COMMENT)
def d9(t: Tables):
    return aggregates.comment_summary(t.comment().withColumn("like_count", F.expr("CASE WHEN like_count > 3 THEN like_count END")))


@query("d10_distinct_count", "SELECT count(DISTINCT user_id) AS videos FROM events")
def d10(t: Tables):
    return t.events.agg(F.count_distinct("user_id").alias("videos"))


@query("d10_distinct_sketch", "SELECT count(DISTINCT user_id) AS videos, true AS within FROM events")
def d10_sketch(t: Tables):
    """The exact count, and whether the union of one sketch per day comes close to it."""
    daily = sketches.distinct_sketches(t.events.withColumn("day", F.to_date("ts")), "user_id", ["day"])
    close = F.abs(F.col("estimate") - F.col("videos")) <= F.lit(sketches.DISTINCT_ERROR) * F.col("videos")
    guess = sketches.distinct_estimate(daily, out="estimate").first()[0]
    return d10(t).withColumn("estimate", F.lit(guess)).select("videos", close.alias("within"))


@query("d11_group_mode", """
    SELECT narrative_cluster_id, topic_keywords FROM (
      SELECT narrative_cluster_id, topic_keywords, count(*) AS n FROM v_scored GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY narrative_cluster_id ORDER BY n DESC, topic_keywords) = 1""", V_SCORED)
def d11(t: Tables):
    return aggregates.group_mode(t.scored(), "narrative_cluster_id", "topic_keywords")


@query("d12_last_non_null", "SELECT * FROM v_latest", V_SNAP, V_GAPS, V_LATEST)
def d12(t: Tables):
    return latest(t)


@query("d13_histogram", """
    SELECT CAST(least(floor(viral_probability * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM v_scored GROUP BY 1""", V_SCORED)
def d13(t: Tables):
    return aggregates.histogram(t.scored(), "viral_probability")


@query("d14_confusion_matrix", "SELECT * FROM confusion", V_SCORED, CONFUSION)
def d14(t: Tables):
    return metrics.confusion(t.scored(), "viral_label", "viral_probability")


@query("d15_classification_metrics", """
    SELECT round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall,
      round(f1_score, 6) AS f1_score, round(mcc, 6) AS mcc FROM classification""", V_SCORED, CONFUSION, CLASSIFICATION)
def d15(t: Tables):
    return rounded(metrics.classification(metrics.confusion(t.scored(), "viral_label", "viral_probability")))


@query("d16_probability_metrics", """
    SELECT round(brier_score, 6) AS brier_score, round(log_loss, 6) AS log_loss, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
      round(mape_viral, 6) AS mape_viral, test_samples, viral_in_test FROM probabilistic""", V_SCORED, PROBABILISTIC)
def d16(t: Tables):
    return rounded(metrics.probabilistic(t.scored(), "viral_label", "viral_probability"))


@query("d17_roc_auc", "SELECT round(roc_auc, 6) AS roc_auc FROM roc", V_SCORED, ROC)
def d17(t: Tables):
    return rounded(metrics.roc_auc(t.scored(), "viral_label", "viral_probability"))


@query("d18_class_report", """
    SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM (
      SELECT * FROM per_class
      UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM per_class
      UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per_class)""", V_SCORED, CONFUSION, """per_class AS (
      SELECT 'viral' AS class, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score, tp + fn AS support FROM confusion
      UNION ALL SELECT 'non-viral', coalesce(tn / nullif(tn + fn, 0), 0), coalesce(tn / nullif(tn + fp, 0), 0),
        coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0), tn + fp FROM confusion)""")
def d18(t: Tables):
    return rounded(metrics.class_report(t.scored(), "viral_label", "viral_probability"))


@query("d19_imputation_values", """
    SELECT 'trend_score' AS feature, CAST(round(quantile_cont(trend_score, 0.5), 6) AS VARCHAR) AS value FROM v_scored
    UNION ALL SELECT 'narrative_trend_score', CAST(round(quantile_cont(narrative_trend_score, 0.5), 6) AS VARCHAR) FROM v_scored
    UNION ALL SELECT 'sentiment_label', (SELECT sentiment_label FROM v_scored GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    UNION ALL SELECT 'pharma_risk_label', (SELECT pharma_risk_label FROM v_scored GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""", V_SCORED)
def d19(t: Tables):
    features = virality.Features(("trend_score", "narrative_trend_score"), ("sentiment_label", "pharma_risk_label"))
    values = virality.impute_values(t.scored(), features)
    rows = [(k, str(round(v, 6)) if isinstance(v, float) else v) for k, v in values.items()]
    return t.spark.createDataFrame(rows, "feature string, value string")


@query("d20_metrics_row", """
    SELECT round(accuracy, 4) AS accuracy, round(roc_auc, 4) AS roc_auc, round("precision", 4) AS "precision", round(recall, 4) AS recall,
      round(f1_score, 4) AS f1_score, round(mcc, 4) AS mcc, round(brier_score, 4) AS brier_score, round(log_loss, 4) AS log_loss,
      round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(mape_viral, 2) AS mape_viral, test_samples, viral_in_test
    FROM classification, roc, probabilistic""", V_SCORED, CONFUSION, CLASSIFICATION, PROBABILISTIC, ROC)
def d20(t: Tables):
    return metrics.metrics_row(t.scored(), "viral_label", "viral_probability")


@query("d21_alert_summary", """
    SELECT 'total' AS section, 'all' AS label, count(*) AS n FROM fired
    UNION ALL SELECT 'type', alert_type, count(*) FROM fired GROUP BY 2
    UNION ALL SELECT 'priority', CASE alert_type WHEN 'pharma_risk' THEN 'critical' ELSE 'high' END, count(*) FROM fired GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'topic', topic_keywords, count(*) AS n FROM fired GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""",
       V_SCORED, """fired AS (
      SELECT 'viral_emerging' AS alert_type, topic_keywords FROM v_scored WHERE viral_probability >= 0.80E0
      UNION ALL SELECT 'toxicity_spike', topic_keywords FROM v_scored WHERE toxicity_score >= 0.75E0
      UNION ALL SELECT 'pharma_risk', topic_keywords FROM v_scored WHERE pharma_risk_score >= 1)""")
def d21(t: Tables):
    return alerts.summary(alerts.fan_out(alerts.prepare(t.scored()), alerts.Thresholds()))
