"""Queries of score evaluation, uplift and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.primitives import spread
from plumbline.operators import comparison, evaluation, ranking, resampling, uplift

from .analysis import auc_sql, signed_sql
from .registry import query
from .views import LONG, NUMERIC, SAMPLE, long_sample, sample

S, L = f"WITH {SAMPLE}", f"WITH {LONG}"
AUC = f"g AS (SELECT score AS s, sum(label) AS p, sum(1 - label) AS n FROM sample GROUP BY 1)"
LOSS = "-CASE WHEN label = 1 THEN ln(least(greatest({s}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)) ELSE ln(1 - least(greatest({s}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)) END"
DOWN = "row_number() OVER (ORDER BY score DESC, id) - 1 AS i, count(*) OVER () AS n"
UP = "row_number() OVER (ORDER BY score, id) - 1 AS i, count(*) OVER () AS n"
CUM = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("j1_auc", f"{S}, {AUC}, w AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS b FROM g) SELECT sum(p * (b + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM w", "auc")
def _(spark, d):
    return ranking.auc(sample(spark, d), "label", "score")


@query("j2_ks", f"{S}, {AUC}, w AS (SELECT sum(p) OVER (ORDER BY s) AS cp, sum(n) OVER (ORDER BY s) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM g) SELECT max(abs(cp / tp - cn / tn)) AS ks FROM w", "ks")
def _(spark, d):
    return ranking.ks(sample(spark, d), "label", "score")


@query("j3_pr_auc", f"{S}, {AUC}, w AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM g) SELECT sum(p * cp / (cp + cn)) / sum(p) AS pr_auc FROM w", "pr_auc")
def _(spark, d):
    return ranking.pr_auc(sample(spark, d), "label", "score")


@query("j4_logloss_gini", f"{S}, {AUC}, w AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS b FROM g) SELECT (SELECT avg({LOSS.format(s='score')}) FROM sample) AS logloss, 2 * sum(p * (b + n / 2.0)) / (sum(p) * sum(n)) - 1 AS gini FROM w", "logloss gini")
def _(spark, d):
    return evaluation.logloss_gini(sample(spark, d), "label", "score")


@query("j5_threshold_metrics", f"""{S}, c AS (SELECT count(*) FILTER (label = 1 AND score >= 0.5) AS tp, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 0 AND score < 0.5) AS tn FROM sample)
    SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""", "accuracy precision recall f1")
def _(spark, d):
    return evaluation.threshold_metrics(sample(spark, d), "label", "score")


@query("j6_decile_table", f"""{S}, r AS (SELECT score, label, outcome, 10 - greatest(CAST(ceil(i * 10 / greatest(n - 1, 1)) AS BIGINT) - 1, 0) AS decile FROM (SELECT *, {DOWN} FROM sample)),
    e AS (SELECT decile, count(*) AS "rows", min(score) AS min_score, max(score) AS max_score, sum(label) AS positives, avg(label) AS rate, avg(outcome) AS avg_outcome FROM r GROUP BY 1),
    f AS (SELECT *, rate / (sum(positives) OVER () / sum("rows") OVER ()) AS lift, positives / sum(positives) OVER () AS recall FROM e) SELECT *, sum(recall) OVER (ORDER BY decile DESC {CUM}) AS cum_recall FROM f""", "min_score max_score rate avg_outcome lift recall cum_recall", "positives")
def _(spark, d):
    return evaluation.decile_table(sample(spark, d), "score", "label", "id", business=["outcome"])


@query("j7_score_bucket", f"{S} SELECT id, label, score, CAST(floor(i * 10 / n) AS BIGINT) + 1 AS bucket FROM (SELECT *, {DOWN} FROM sample)", "score", "label")
def _(spark, d):
    return evaluation.score_bucket(sample(spark, d).select("id", "label", "score"), "score", "id")


SEGMENTS = "seg AS (SELECT label, score, score_old, unnest(['all', 'c_mktsegment=' || c_mktsegment, 'split=' || split]) AS segment FROM sample)"
_SEG = f"""{SEGMENTS}, g AS (SELECT segment, score AS s, sum(label) AS p, sum(1 - label) AS n FROM seg GROUP BY 1, 2),
    w AS (SELECT *, sum(n) OVER o AS cn, sum(p) OVER o AS cp, sum(p) OVER t AS tp, sum(n) OVER t AS tn FROM g WINDOW o AS (PARTITION BY segment ORDER BY s), t AS (PARTITION BY segment)),
    m AS (SELECT segment, sum(p + n) AS "rows", sum(p) / sum(p + n) AS rate, sum(p * (cn - n / 2.0)) / (max(tp) * max(tn)) AS auc, max(abs(cp / tp - cn / tn)) AS ks FROM w GROUP BY 1),
    metrics AS (SELECT segment, "rows", rate, CASE WHEN "rows" >= 10 THEN auc END AS auc, CASE WHEN "rows" > 50 THEN ks END AS ks FROM m)"""


@query("j8_segment_metrics", f"{S}, {_SEG} SELECT * FROM metrics", "rate auc ks", "rows")
def _(spark, d):
    return evaluation.segment_metrics(sample(spark, d), "label", "score", ["c_mktsegment", "split"])


@query("j9_slice_masks", f"""{S}, q AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(c_acctbal, [0, 0.25, 0.5, 0.75, 1]), lambda x: round(x, 9)))) AS e FROM sample),
    x AS (SELECT unnest(['c_acctbal=q' || CAST(len(list_filter(list_slice(e, 2, len(e) - 1), lambda v: v < c_acctbal)) + 1 AS VARCHAR), 'c_mktsegment=' || c_mktsegment, 'o_orderpriority=' || o_orderpriority]) AS slice, label FROM sample, q)
    SELECT slice, count(*) AS n, avg(label) AS rate FROM x GROUP BY 1 HAVING count(*) >= 50""", "rate")
def _(spark, d):
    rows = evaluation.slice_masks(sample(spark, d), ["c_acctbal"], ["c_mktsegment", "o_orderpriority"])
    return rows.groupBy("slice").agg(F.count("*").alias("n"), F.avg("label").alias("rate"))


@query("j10_top_lift", f"""{S}, r AS (SELECT label, i < greatest(1, round_even(n * 5 / 100, 0)) AS top FROM (SELECT label, {DOWN} FROM sample)) SELECT count(*) FILTER (top) AS "rows", avg(label) FILTER (top) / avg(label) AS lift FROM r""", "lift")
def _(spark, d):
    return evaluation.top_lift(sample(spark, d), "label", "score", "id", 5)


RANKBINS = f"rb AS (SELECT *, CAST(floor(i * 10 / n) AS BIGINT) AS bin FROM (SELECT *, {UP} FROM sample))"


@query("j11_segment_ranking", f"""{S}, {RANKBINS}, b AS (SELECT bin, avg(label) AS m, count(*) AS c FROM rb GROUP BY 1), x AS (SELECT *, CAST(m >= lag(m) OVER (ORDER BY bin) AS INT) AS up, rank() OVER (ORDER BY m) AS r, sum(m * c) OVER () / sum(c) OVER () AS a FROM b)
    SELECT count(*) AS bins, avg(up) AS monotonicity, abs(corr(bin, r)) AS spearman, arg_max(m / a, bin) AS top_lift, avg(up) >= 0.8 AND corr(bin, r) > 0 AS passed FROM x""", "monotonicity spearman top_lift")
def _(spark, d):
    return evaluation.segment_ranking(sample(spark, d), "score", "label", "id")


@query("j12_classification_segments", f"""{S}, {RANKBINS}, e AS (SELECT bin, count(*) AS r, sum(label) AS p FROM rb GROUP BY 1), c AS (SELECT *, sum(r) OVER w AS cr, sum(p) OVER w AS cp, sum(r) OVER () AS tr, sum(p) OVER () AS tp FROM e WINDOW w AS (ORDER BY bin DESC {CUM}))
    SELECT bin, r AS "rows", r / tr AS share, p AS positives, p / r AS rate, p / r / (tp / tr) AS lift, cp / cr AS cum_rate, cp / cr / (tp / tr) AS cum_lift, cp / tp AS cum_recall, abs(cp / tp - (cr - cp) / (tr - tp)) AS ks FROM c""", "share rate lift cum_rate cum_lift cum_recall ks", "positives")
def _(spark, d):
    return evaluation.classification_segments(sample(spark, d), "label", "score", "id")


@query("j13_merge_evaluations", f"""{S}, {_SEG} SELECT 'splits' AS part, sum("rows") AS "rows", sum(auc * "rows") / sum("rows") AS auc, sum(ks * "rows") / sum("rows") AS ks FROM metrics WHERE starts_with(segment, 'split=')""", "auc ks", "rows")
def _(spark, d):
    made = evaluation.segment_metrics(sample(spark, d), "label", "score", ["c_mktsegment", "split"]).filter(F.col("segment").startswith("split="))
    return evaluation.merge_evaluations(made.withColumn("part", F.lit("splits")), ["auc", "ks"], ["part"])


@query("j14_compare_models", f"""{S}, long AS (SELECT split AS segment, label, 'new' AS model, score AS v FROM sample UNION ALL SELECT split, label, 'old', score_old FROM sample), g AS (SELECT segment, model, v, sum(label) AS p, sum(1 - label) AS n FROM long GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER o AS cn, sum(p) OVER o AS cp, sum(p) OVER t AS tp, sum(n) OVER t AS tn FROM g WINDOW o AS (PARTITION BY segment, model ORDER BY v), t AS (PARTITION BY segment, model)),
    m AS (SELECT segment, model, sum(p * (cn - n / 2.0)) / (max(tp) * max(tn)) AS auc, max(abs(cp / tp - cn / tn)) AS ks FROM w GROUP BY 1, 2)
    SELECT segment, max(auc) FILTER (model = 'new') AS new_auc, max(ks) FILTER (model = 'new') AS new_ks, max(auc) FILTER (model = 'old') AS old_auc, max(ks) FILTER (model = 'old') AS old_ks FROM m GROUP BY 1""", "new_auc new_ks old_auc old_ks")
def _(spark, d):
    pairs = F.array(F.struct(F.lit("new").alias("model"), F.col("score").alias("v")), F.struct(F.lit("old").alias("model"), F.col("score_old").alias("v")))
    rows = sample(spark, d).select(F.col("split").alias("segment"), "label", F.explode(pairs).alias("x")).select("segment", "label", "x.*")
    keys = ["segment", "model"]
    evals = ranking.auc(rows, "label", "v", keys).join(ranking.ks(rows, "label", "v", keys), keys)
    return evaluation.compare_models(evals, ["new", "old"])


CUTS = "(" + " + ".join(f"CAST(i >= floor(n * {j} / 10) AS BIGINT)" for j in range(1, 10)) + ")"


@query("j15_error_bins", f"""{S}, r AS (SELECT label, score, {LOSS.format(s='score')} AS loss, {CUTS} AS bin FROM (SELECT *, {DOWN} FROM sample)), e AS (SELECT bin, count(*) AS r, avg(score) AS mean_score, avg(label) AS rate, sum(loss) AS l FROM r GROUP BY 1)
    SELECT bin, r AS "rows", mean_score, rate, l / sum(l) OVER () AS loss_share, l / sum(l) OVER () / (r / sum(r) OVER ()) AS loss_over_share, mean_score - rate AS bias FROM e""", "mean_score rate loss_share loss_over_share bias")
def _(spark, d):
    return evaluation.error_bins(sample(spark, d), "label", "score", "id")


@query("j16_high_loss_profile", f"""{S}, r AS (SELECT *, row_number() OVER (ORDER BY {LOSS.format(s='score')} DESC, id) - 1 AS i, count(*) OVER () AS n FROM sample), h AS (SELECT *, i < greatest(30, floor(n * 0.05)) AS high FROM r),
    m AS (SELECT high, unnest([{', '.join(f"'{f}'" for f in NUMERIC)}]) AS feature, unnest([{', '.join(f'CAST({f} AS DOUBLE)' for f in NUMERIC)}]) AS value FROM h),
    e AS (SELECT feature, avg(value) FILTER (high) AS mean_high, avg(value) FILTER (NOT high) AS mean_rest, stddev_samp(value) FILTER (NOT high) AS sd FROM m GROUP BY 1)
    SELECT feature, mean_high, mean_rest, (mean_high - mean_rest) / sd AS z FROM e WHERE sd > 1e-12 AND abs((mean_high - mean_rest) / sd) > 0.02""", "mean_high mean_rest z")
def _(spark, d):
    return evaluation.high_loss_profile(sample(spark, d), "label", "score", "id", NUMERIC, z_min=0.02)


@query("j17_delta_by_bin", f"""{S}, r AS (SELECT *, {CUTS} AS bin FROM (SELECT *, {DOWN} FROM sample)) SELECT bin, count(*) AS "rows", avg({LOSS.format(s='score_old')} - ({LOSS.format(s='score')})) AS saved FROM r GROUP BY 1""", "saved")
def _(spark, d):
    return evaluation.delta_by_bin(sample(spark, d), "label", "score", "score_old", "id")


PRED = "pr AS (SELECT *, outcome * 0.5::DOUBLE + score * 150000 AS p, outcome * 0.6::DOUBLE + score_old * 100000 AS p2 FROM sample)"


def predicted(spark, d):
    return sample(spark, d).withColumn("p", F.col("outcome") * 0.5 + F.col("score") * 150000).withColumn("p2", F.col("outcome") * 0.6 + F.col("score_old") * 100000)


@query("k1_regression_metrics", f"{S}, {PRED} SELECT sqrt(avg((p - outcome) * (p - outcome))) AS rmse, avg(abs(p - outcome)) AS mae, avg(CASE WHEN outcome <> 0 THEN abs((p - outcome) / outcome) END) AS mape, 1 - avg((p - outcome) * (p - outcome)) / var_pop(outcome) AS r2 FROM pr", "rmse mae mape r2")
def _(spark, d):
    return evaluation.regression_metrics(predicted(spark, d), "outcome", "p")


@query("k2_regression_segments", f"""{S}, {PRED}, b AS (SELECT *, CAST(floor(i * 10 / n) AS BIGINT) AS bin FROM (SELECT *, row_number() OVER (ORDER BY p, id) - 1 AS i, count(*) OVER () AS n FROM pr)),
    e AS (SELECT bin, count(*) AS "rows", avg(p) AS mean_pred, avg(outcome) AS mean_actual, avg(p - outcome) AS bias, avg(abs(p - outcome)) AS mae, sqrt(avg((p - outcome) * (p - outcome))) AS rmse, quantile_cont(outcome, 0.5) AS median, min(p) AS min_pred, max(p) AS max_pred, sum(outcome) AS total FROM b GROUP BY 1),
    s AS (SELECT *, total / sum(total) OVER () AS share FROM e) SELECT *, sum(share) OVER (ORDER BY bin DESC {CUM}) AS cum_share FROM s""", "mean_pred mean_actual bias mae rmse median min_pred max_pred total share cum_share")
def _(spark, d):
    return evaluation.regression_segments(predicted(spark, d), "outcome", "p", "id")


@query("k3_level_stats", f"""{S}, {PRED}, m AS (SELECT count(*) AS n, avg(p) / avg(outcome) AS r, avg(outcome) AS y FROM pr), s AS (SELECT stddev_samp(p - r * outcome) / (sqrt(max(n)) * abs(max(y))) AS se FROM pr, m)
    SELECT n AS "rows", r AS ratio, se, abs(r - 1) > greatest(0.1, 2 * se) AS warning FROM m, s""", "ratio se")
def _(spark, d):
    return evaluation.level_stats(predicted(spark, d), "outcome", "p")


@query("k4_level_by_period", f"""{S}, {PRED}, x AS (SELECT *, year(dt) AS year FROM pr), m AS (SELECT year, count(*) AS n, avg(p) / avg(outcome) AS r, avg(outcome) AS y FROM x GROUP BY 1 HAVING count(*) >= 50),
    s AS (SELECT year, stddev_samp(p - r * outcome) / (sqrt(max(n)) * abs(max(y))) AS se FROM x JOIN m USING (year) GROUP BY 1) SELECT year, n AS "rows", r AS ratio, se, abs(r - 1) > greatest(0.1, 2 * se) AS warning FROM m JOIN s USING (year)""", "ratio se", "year")
def _(spark, d):
    return evaluation.level_stats(predicted(spark, d).withColumn("year", F.year("dt")), "outcome", "p", ["year"], 50)


@query("k5_metric_divergence", f"""{S}, {PRED}, x AS (SELECT (p - outcome) * (p - outcome) - (p2 - outcome) * (p2 - outcome) AS sq, abs(p - outcome) - abs(p2 - outcome) AS ab FROM pr),
    o AS (SELECT avg(sq) AS d_squared, stddev_samp(sq) / sqrt(count(*)) AS se_squared, avg(ab) AS d_absolute, stddev_samp(ab) / sqrt(count(*)) AS se_absolute FROM x)
    SELECT d_squared / 1e6 AS d_squared, se_squared / 1e6 AS se_squared, d_absolute, se_absolute, abs(d_squared) > 2 * se_squared AND abs(d_absolute) > 2 * se_absolute AND sign(d_squared) <> sign(d_absolute) AS diverged FROM o""", "d_squared se_squared d_absolute se_absolute")
def _(spark, d):
    out = evaluation.metric_divergence(predicted(spark, d), "outcome", "p", "p2")
    return out.withColumn("d_squared", F.col("d_squared") / 1e6).withColumn("se_squared", F.col("se_squared") / 1e6)


ARMS = "count(*) FILTER (arm = 1) AS treated, count(*) FILTER (arm = 0) AS control, avg(outcome) FILTER (arm = 1) AS treated_mean, avg(outcome) FILTER (arm = 0) AS control_mean"
GAIN = "treated_mean - control_mean AS uplift, (treated_mean - control_mean) / nullif(abs(control_mean), 0) AS relative"
SUPPORT = "CASE WHEN treated = 0 OR control = 0 THEN 'missing_arm' WHEN treated < 30 OR control < 30 THEN 'low' ELSE 'ok' END AS support"
BY_CATE = "row_number() OVER (ORDER BY cate DESC, id) - 1 AS i, count(*) OVER () AS n"
U = "treated_mean control_mean uplift relative"


@query("l1_arm_support", f"{S}, e AS (SELECT split, {ARMS} FROM sample GROUP BY 1) SELECT *, {GAIN}, treated = 0 OR control = 0 AS blocked FROM e", U)
def _(spark, d):
    return uplift.arm_support(sample(spark, d), "arm", "outcome")


SMD = f"""num AS (SELECT split, feature AS variable, CAST(NULL AS VARCHAR) AS level, avg(value) FILTER (arm = 1) AS m1, avg(value) FILTER (arm = 0) AS m0, var_pop(value) FILTER (arm = 1) AS v1, var_pop(value) FILTER (arm = 0) AS v0 FROM long GROUP BY 1, 2),
    lv AS (SELECT split, 'c_mktsegment' AS variable, c_mktsegment AS level, count(*) FILTER (arm = 1) AS c1, count(*) FILTER (arm = 0) AS c0 FROM sample GROUP BY 1, 3), sz AS (SELECT split, count(*) FILTER (arm = 1) AS n1, count(*) FILTER (arm = 0) AS n0 FROM sample GROUP BY 1),
    rt AS (SELECT split, variable, level, c1 / n1 AS m1, c0 / n0 AS m0 FROM lv JOIN sz USING (split)),
    bt AS (SELECT * FROM num UNION ALL SELECT *, m1 * (1 - m1), m0 * (1 - m0) FROM rt), sm AS (SELECT split, variable, level, abs(m1 - m0) / sqrt(nullif((v1 + v0) / 2, 0)) AS smd FROM bt),
    smd AS (SELECT *, CASE WHEN smd >= 0.2 THEN 'severe' WHEN smd >= 0.1 THEN 'warning' WHEN smd IS NOT NULL THEN 'ok' END AS status FROM sm)"""


@query("l2_smd_table", f"{L}, {SMD} SELECT * FROM smd", "smd")
def _(spark, d):
    return uplift.smd_table(sample(spark, d), NUMERIC, ["c_mktsegment"], "arm")


@query("l4_homogeneity", f"""{L}, {SMD}, o AS (SELECT split, max(smd) AS worst, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'severe') AS severes, max(smd) FILTER (variable = 'c_acctbal') AS k FROM smd GROUP BY 1)
    SELECT split, worst, warnings, severes, CASE WHEN coalesce(k, 0) >= 0.5 OR severes >= 5 THEN 'critical' WHEN severes > 0 THEN 'severe' WHEN warnings > 0 THEN 'warning' ELSE 'ok' END AS risk FROM o""", "worst")
def _(spark, d):
    return uplift.homogeneity(uplift.smd_table(sample(spark, d), NUMERIC, ["c_mktsegment"], "arm"), ["c_acctbal"])


@query("l5_uplift_bivariate", f"{L}, {signed_sql('true')}, e AS (SELECT feature, bin, {ARMS} FROM sb GROUP BY 1, 2) SELECT *, {GAIN}, {SUPPORT} FROM e", U)
def _(spark, d):
    return uplift.uplift_bivariate(long_sample(spark, d, ("id", "arm", "outcome")), "arm", "outcome")


@query("l6_uplift_bins", f"{S}, r AS (SELECT arm, outcome, CAST(floor(i * 10 / n) AS BIGINT) + 1 AS bin FROM (SELECT *, {BY_CATE} FROM sample)), e AS (SELECT bin, {ARMS} FROM r GROUP BY 1) SELECT *, {GAIN}, {SUPPORT} FROM e", U)
def _(spark, d):
    return uplift.uplift_bins(sample(spark, d), "cate", "arm", "outcome", "id")


CURVE = f"""cs AS (SELECT id, row_number() OVER w AS k, sum(CASE WHEN arm = 1 THEN label ELSE 0 END) OVER w AS yt, sum(CASE WHEN arm = 0 THEN label ELSE 0 END) OVER w AS yc, sum(arm) OVER w AS nt, sum(1 - arm) OVER w AS nc FROM sample WINDOW w AS (ORDER BY cate DESC, id {CUM})),
    curve AS (SELECT id, k, nt, nc, yt - coalesce(yc * nt / nullif(nc, 0), 0) AS gain FROM cs)"""


@query("l7_uplift_curve", f"{S}, {CURVE} SELECT * FROM curve", "gain", "nt nc")
def _(spark, d):
    return uplift.uplift_curve(sample(spark, d), "cate", "arm", "label", "id")


@query("l7_auuc_qini", f"{S}, {CURVE}, t AS (SELECT count(*) AS n, sum(gain) AS s, arg_max(gain, k) AS g FROM curve) SELECT (s - g / 2) / n AS auuc, (s - g / 2) / n - g / 2 AS qini FROM t", "auuc qini")
def _(spark, d):
    return uplift.uplift_areas(sample(spark, d), "cate", "arm", "label", "id")


@query("l8_auuc_report", f"""{S}, g AS (SELECT cate AS s, sum(label) FILTER (arm = 1) AS yt, sum(label) FILTER (arm = 0) AS yc, count(*) FILTER (arm = 1) AS nt, count(*) FILTER (arm = 0) AS nc FROM sample GROUP BY 1),
    c AS (SELECT sum(yt) OVER w AS yt, sum(yc) OVER w AS yc, sum(nt) OVER w AS nt, sum(nc) OVER w AS nc, s, nt + nc AS step FROM g WINDOW w AS (ORDER BY s DESC {CUM})),
    h AS (SELECT s, step, nt + nc AS n, (coalesce(coalesce(yt, 0) / nullif(nt, 0), 0) - coalesce(coalesce(yc, 0) / nullif(nc, 0), 0)) * (nt + nc) AS gain FROM c), l AS (SELECT *, coalesce(lag(gain) OVER (ORDER BY s DESC), 0) AS before FROM h),
    t AS (SELECT sum((gain + before) / 2 * step) AS area, max(n) AS n, arg_max(gain, n) AS last, max(abs(gain)) AS peak FROM l) SELECT area - last * n / 2 AS raw, (area - last * n / 2) / peak AS adjusted FROM t""", "raw adjusted")
def _(spark, d):
    return uplift.auuc_report(sample(spark, d), "cate", "arm", "label")


def raw_area(g: str) -> str:
    return f"""SELECT sum((gain + before) / 2 * step) - arg_max(gain, n) * max(n) / 2 FROM (SELECT *, coalesce(lag(gain) OVER (ORDER BY s DESC), 0) AS before FROM
        (SELECT s, step, nt + nc AS n, (coalesce(yt / nullif(nt, 0), 0) - coalesce(yc / nullif(nc, 0), 0)) * (nt + nc) AS gain FROM
        (SELECT s, nt + nc AS step, sum(yt) OVER w AS yt, sum(yc) OVER w AS yc, sum(nt) OVER w AS nt, sum(nc) OVER w AS nc FROM {g} WINDOW w AS (ORDER BY s DESC {CUM}))))"""


@query("l8_normalized_auuc", f"""{S}, two AS (SELECT *, CASE WHEN count(*) FILTER (label = 1 AND arm = 0) OVER () > count(*) FILTER (label = 0 AND arm = 1) OVER () THEN label ELSE arm END AS extra FROM sample),
    g AS (SELECT cate AS s, sum(label * arm) AS yt, sum(label * (1 - arm)) AS yc, sum(arm) AS nt, sum(1 - arm) AS nc FROM sample GROUP BY 1), p AS (SELECT 2 * CAST(label = arm AS INT) + extra AS s, sum(label * arm) AS yt, sum(label * (1 - arm)) AS yc, sum(arm) AS nt, sum(1 - arm) AS nc FROM two GROUP BY 1),
    areas AS (SELECT ({raw_area('g')}) AS raw, ({raw_area('p')}) AS perfect) SELECT raw, perfect, raw / perfect AS normalized FROM areas""", "raw perfect normalized")
def _(spark, d):
    return uplift.normalized_auuc(sample(spark, d), "cate", "arm", "label")


@query("l9_uplift_segments", f"""{S}, b AS (SELECT *, CAST(floor(i * 10 / n) AS BIGINT) AS bin FROM (SELECT *, row_number() OVER (ORDER BY cate, id) - 1 AS i, count(*) OVER () AS n FROM sample)),
    e AS (SELECT bin, {ARMS}, avg(cate) AS predicted, sum(outcome) FILTER (arm = 1) AS yt, sum(outcome) FILTER (arm = 0) AS yc FROM b GROUP BY 1)
    SELECT bin, treated, control, treated_mean, control_mean, predicted, treated_mean - control_mean AS uplift, sum(yt) OVER w / sum(treated) OVER w - sum(yc) OVER w / sum(control) OVER w AS cum_uplift, (treated_mean - control_mean) * treated AS increment FROM e WINDOW w AS (ORDER BY bin DESC {CUM})""", "treated_mean control_mean predicted uplift cum_uplift increment")
def _(spark, d):
    return uplift.uplift_segments(sample(spark, d), "cate", "arm", "outcome", "id")


@query("l10_uplift_calibration", f"""{S}, r AS (SELECT *, {CUTS} AS bin FROM (SELECT *, {BY_CATE} FROM sample)), e AS (SELECT bin, {ARMS.replace('outcome', 'label')}, count(*) AS "rows", avg(cate) AS predicted FROM r GROUP BY 1)
    SELECT bin, "rows", predicted, treated_mean - control_mean AS actual, predicted - (treated_mean - control_mean) AS deviation FROM e WHERE "rows" >= 30 AND treated >= 10 AND control >= 10""", "predicted actual deviation")
def _(spark, d):
    return uplift.uplift_calibration(sample(spark, d), "cate", "arm", "label", "id")


@query("l13_overall_uplift", f"{S}, e AS (SELECT {ARMS} FROM sample) SELECT *, {GAIN} FROM e", U)
def _(spark, d):
    return uplift.overall_uplift(sample(spark, d), "arm", "outcome")


@query("l14_rank_candidates", f"""{S}, c AS (SELECT split AS model, CAST(split = 'test' AS INT) AS tuned, CASE split WHEN 'oot' THEN 0 WHEN 'test' THEN 1 ELSE 2 END AS position, 'all' AS population, 'rate' AS metric, round(avg(label), 1) AS value FROM sample GROUP BY 1)
    SELECT *, true AS comparable, row_number() OVER (ORDER BY value DESC, tuned, position) AS rank FROM c""", "value", "tuned position")
def _(spark, d):
    position = F.when(F.col("split") == "oot", 0).when(F.col("split") == "test", 1).otherwise(2)
    evals = sample(spark, d).groupBy(F.col("split").alias("model"), (F.col("split") == "test").cast("int").alias("tuned"), position.alias("position")).agg(F.lit("all").alias("population"), F.lit("rate").alias("metric"), F.round(F.avg("label"), 1).alias("value"))
    return uplift.rank_candidates(evals)


@query("l15_thin_curve", f"{S}, {CURVE}, n AS (SELECT max(k) AS n FROM curve) SELECT id, k, nt, nc, gain FROM curve, n WHERE n <= 900 OR k - 1 = floor(round((k - 1) * 899 / (n - 1)) * (n - 1) / 899)", "gain", "nt nc")
def _(spark, d):
    return uplift.thin_curve(uplift.uplift_curve(sample(spark, d), "cate", "arm", "label", "id"), "k")


#: A quarter of the operator's default: the SQL side has a row for each order and replicate.
REPLICATES = 500
_P = comparison.PRIME
BOOT = f"""x1 AS (SELECT label, score, score_old, cate, rep, (id % {_P} * 69621 + rep * 16807 + 7 * 48271 + 1) % {_P} AS x FROM sample, (SELECT unnest(range(0, {REPLICATES})) AS rep)),
    x2 AS (SELECT * REPLACE ((x * x + x * 40692 + 12345) % {_P} AS x) FROM x1),
    x3 AS (SELECT * REPLACE ((x * x + x * 48271 + rep * 7919 + 7) % {_P} AS x) FROM x2),
    b AS (SELECT *, """ + " + ".join(f"CAST(x >= {int(p * _P)} AS BIGINT)" for p in comparison.POISSON) + " AS w FROM x3)"


def boot_auc(score: str, extra: str = "") -> str:
    by = f"rep{extra}"
    return f"""SELECT {by}, sum(p * (cn + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY s) - n AS cn FROM (SELECT {by}, {score} AS s, sum(label * w) AS p, sum((1 - label) * w) AS n FROM b WHERE w > 0 GROUP BY ALL)) GROUP BY {by}"""


@query("m1_bootstrap_ci", f"{S}, {BOOT}, a AS ({boot_auc('score')}) SELECT count(*) AS replicates, avg(auc) AS mean, stddev_samp(auc) AS se, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM a", "mean se low high")
def _(spark, d):
    return comparison.bootstrap_ci(sample(spark, d), "label", "score", "id", REPLICATES)


@query("m2_paired_bootstrap", f"""{S}, {BOOT}, a AS ({boot_auc('score')}), o AS ({boot_auc('score_old')}), x AS (SELECT a.auc - o.auc AS d FROM a JOIN o USING (rep))
    SELECT count(*) AS replicates, avg(d) AS mean, stddev_samp(d) AS se, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, avg(CAST(d > 0 AS INT)) AS share_positive, avg(d) / stddev_samp(d) AS z FROM x""", "mean se low high share_positive z")
def _(spark, d):
    return comparison.paired_bootstrap(sample(spark, d), "label", "score", "score_old", "id", REPLICATES)


#: Replicates of the other metrics.
FEW = 100
FEWER = BOOT.replace(f"range(0, {REPLICATES})", f"range(0, {FEW})")


def boot_steps(score: str) -> str:
    """Of each replicate and score: its weighted labels, and those of it and all higher ones."""
    return f"""SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER o AS tp, sum(n) OVER o AS tn FROM (SELECT rep, {score} AS s, sum(label * w) AS p, sum((1 - label) * w) AS n FROM b GROUP BY ALL)
        WINDOW w AS (PARTITION BY rep ORDER BY s DESC), o AS (PARTITION BY rep)"""


KS_OF = "SELECT rep, max(abs(cp / tp - cn / tn)) AS v FROM ({}) GROUP BY 1"
PR_OF = "SELECT rep, sum(CASE WHEN cp + cn > 0 THEN p * cp / (cp + cn) ELSE 0 END) / max(tp) AS v FROM ({}) GROUP BY 1"
INTERVAL = "SELECT count(v) AS replicates, avg(v) AS mean, stddev_samp(v) AS se, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM a"


@query("m1_bootstrap_ks", f"{S}, {FEWER}, a AS ({KS_OF.format(boot_steps('score'))}) {INTERVAL}", "mean se low high")
def _(spark, d):
    return resampling.metric_interval(sample(spark, d), "ks", "label", "score", "id", FEW)


@query("m1_bootstrap_pr_auc", f"{S}, {FEWER}, a AS ({PR_OF.format(boot_steps('score'))}) {INTERVAL}", "mean se low high")
def _(spark, d):
    return resampling.metric_interval(sample(spark, d), "pr_auc", "label", "score", "id", FEW)


@query("m1_bootstrap_logloss", f"{S}, {FEWER}, a AS (SELECT rep, sum(w * -ln(CASE WHEN label = 1 THEN q ELSE 1 - q END)) / sum(w) AS v FROM (SELECT *, least(greatest(score, 1e-15), 1 - 1e-15) AS q FROM b) GROUP BY 1) {INTERVAL}", "mean se low high")
def _(spark, d):
    return resampling.metric_interval(sample(spark, d), "logloss", "label", "score", "id", FEW)


@query("m1_bootstrap_rmse", f"{S}, {FEWER}, a AS (SELECT rep, sqrt(sum(w * (score_old - score) * (score_old - score)) / sum(w)) AS v FROM b GROUP BY 1) {INTERVAL}", "mean se low high")
def _(spark, d):
    return resampling.metric_interval(sample(spark, d), "rmse", "score", "score_old", "id", FEW)


@query("m1_bootstrap_uplift", f"""{S}, {FEWER.replace("SELECT label, score", "SELECT id, arm, label, score")}, r AS (SELECT rep, w, sum(w * arm * label) OVER o AS yt, sum(w * (1 - arm) * label) OVER o AS yc, sum(w * arm) OVER o AS nt, sum(w * (1 - arm)) OVER o AS nc, row_number() OVER o AS k FROM b WINDOW o AS (PARTITION BY rep ORDER BY cate DESC, id ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT *, yt - CASE WHEN nc > 0 THEN yc * nt / nc ELSE 0 END AS g FROM r), h AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY rep ORDER BY k), 0) AS f FROM g),
    a AS (SELECT rep, sum(w * (g + f) / 2) / sum(w) AS auuc, sum(w * (g + f) / 2) / sum(w) - arg_max(g, k) / 2 AS qini FROM h GROUP BY 1)
    SELECT metric, avg(v) AS mean, stddev_samp(v) AS se, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM (SELECT 'auuc' AS metric, auuc AS v FROM a UNION ALL SELECT 'qini', qini FROM a) GROUP BY 1""", "mean se low high")
def _(spark, d):
    each = resampling.bootstrap_uplift(sample(spark, d), "cate", "arm", "label", "id", FEW)
    parts = [comparison.interval(each, m).select(F.lit(m).alias("metric"), "mean", "se", "low", "high") for m in ("auuc", "qini")]
    return parts[0].unionByName(parts[1])


@query("m2_paired_bootstrap_ks", f"""{S}, {FEWER}, a0 AS ({KS_OF.format(boot_steps('score'))}), o0 AS ({KS_OF.format(boot_steps('score_old'))}), x AS (SELECT a0.v - o0.v AS d FROM a0 JOIN o0 USING (rep))
    SELECT count(*) AS replicates, avg(d) AS mean, stddev_samp(d) AS se, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, avg(CAST(d > 0 AS INT)) AS share_positive, avg(d) / stddev_samp(d) AS z FROM x""", "mean se low high share_positive z")
def _(spark, d):
    return resampling.metric_change(sample(spark, d), "ks", "label", "score", "score_old", "id", FEW)


@query("m3_weighted_auc", f"{S}, g AS (SELECT score AS s, sum(label * n_lines) AS p, sum((1 - label) * n_lines) AS n FROM sample GROUP BY 1), w AS (SELECT *, sum(coalesce(n, 0)) OVER (ORDER BY s) - coalesce(n, 0) AS b FROM g) SELECT sum(p * (b + n / 2.0)) / (sum(p) * sum(n)) AS auc FROM w", "auc")
def _(spark, d):
    return comparison.weighted_auc(sample(spark, d).withColumn("n_lines", F.coalesce("n_lines", F.lit(0))), "label", "score", "n_lines")


@query("m4_benjamini_hochberg", f"""{S}, p AS (SELECT o_custkey, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE avg(score) * avg(score) * avg(score) END AS p FROM sample GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST) AS r, count(p) OVER () AS k FROM p), c AS (SELECT *, max(CASE WHEN p <= r * 0.1::DOUBLE / k THEN p END) OVER () AS cut FROM r)
    SELECT o_custkey, p, coalesce(p <= cut, false) AS passed FROM c""", "p")
def _(spark, d):
    m = F.avg("score")
    tests = sample(spark, d).groupBy("o_custkey").agg((m * m * m).alias("p")).withColumn("p", F.when(F.col("o_custkey") % 11 != 0, F.col("p")))
    return comparison.benjamini_hochberg(tests, "p")


@query("m5_noise_gate", f"""{S}, e AS (SELECT o_custkey, avg(score - score_old) AS d, stddev_samp(score - score_old) / sqrt(count(*)) AS se FROM sample GROUP BY 1), g AS (SELECT *, d AS gain, d / nullif(se, 0) AS z FROM e)
    SELECT o_custkey, d, se, gain, CASE WHEN z >= 1 AND gain >= 0.05 THEN 'better' WHEN z >= 0.5 THEN 'likely_better' WHEN z <= -1 THEN 'worse' WHEN z <= -0.5 THEN 'likely_worse' ELSE 'noise' END AS verdict FROM g""", "d se gain")
def _(spark, d):
    gap = F.col("score") - F.col("score_old")
    rows = sample(spark, d).groupBy("o_custkey").agg(F.avg(gap).alias("d"), (spread(F.stddev_samp, gap) / F.sqrt(F.count("*"))).alias("se"))
    return comparison.noise_gate(rows, "d", "se", smallest=0.05)


@query("m7_aligned_leaderboard", f"""{S}, {BOOT}, l AS (SELECT label, unnest(['score', 'score_old', 'cate']) AS participant, unnest([score, score_old, cate]) AS v FROM sample), a AS ({auc_sql('l', 'participant', 'v')}),
    bl AS (SELECT rep, label, w, unnest(['score', 'score_old', 'cate']) AS participant, unnest([score, score_old, cate]) AS v FROM b), e AS ({boot_auc('v', ', participant').replace('FROM b ', 'FROM bl ')}),
    dl AS (SELECT participant, avg(auc - base) AS delta, quantile_cont(auc - base, 0.025) AS low, quantile_cont(auc - base, 0.975) AS high FROM e JOIN (SELECT rep, auc AS base FROM e WHERE participant = 'score_old') USING (rep) GROUP BY 1)
    SELECT participant, a AS auc, rank() OVER (ORDER BY a DESC) AS rank, delta, low, high, CASE WHEN participant = 'score_old' THEN 'reference' WHEN low > 0 THEN 'better' WHEN high < 0 THEN 'worse' ELSE 'tie' END AS verdict FROM a JOIN dl USING (participant)""", "auc delta low high")
def _(spark, d):
    return comparison.aligned_leaderboard(sample(spark, d), "label", ["score", "score_old", "cate"], "id", "score_old", REPLICATES)


@query("m13_slice_gate", f"""{S}, {SEGMENTS}, a AS ({auc_sql('seg', 'segment', 'score')}), o AS ({auc_sql('seg', 'segment', 'score_old')}), n AS (SELECT segment, count(*) AS "rows" FROM seg GROUP BY 1 HAVING count(*) >= 50), x AS (SELECT segment, "rows", a.a AS new_auc, o.a AS old_auc, a.a - o.a AS delta FROM n JOIN a USING (segment) JOIN o USING (segment))
    SELECT *, delta = min(delta) OVER () AS worst FROM x""", "new_auc old_auc delta")
def _(spark, d):
    return comparison.slice_gate(sample(spark, d), "label", "score", "score_old", ["c_mktsegment", "split"])


ZS = " ".join(f"WHEN {k} THEN {comparison.NormalDist().inv_cdf(1 - 0.05 / k)!r}::DOUBLE" for k in range(1, 21))


@query("m13_slice_and_period_gate", f"""{S}, {BOOT}, a0 AS ({boot_auc('score')}), o0 AS ({boot_auc('score_old')}), e AS (SELECT stddev_samp(a0.auc - o0.auc) AS se FROM a0 JOIN o0 USING (rep)),
    seg AS (SELECT 'slice' AS kind, label, score, score_old, unnest(['c_mktsegment=' || c_mktsegment, 'o_orderpriority=' || o_orderpriority]) AS segment FROM sample UNION ALL SELECT 'period', label, score, score_old, 'split=' || split FROM sample),
    a AS ({auc_sql('seg', 'kind, segment', 'score')}), o AS ({auc_sql('seg', 'kind, segment', 'score_old')}), n AS (SELECT kind, segment, count(*) AS "rows" FROM seg WHERE segment IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 50),
    x AS (SELECT kind, segment, "rows", a.a AS new_auc, o.a AS old_auc, a.a - o.a AS delta FROM n JOIN a USING (kind, segment) JOIN o USING (kind, segment) WHERE a.a - o.a IS NOT NULL),
    y AS (SELECT x.*, se, CASE kind WHEN 'period' THEN 2 ELSE CASE count(*) OVER (PARTITION BY kind) {ZS} END END * se AS reach, min(delta) OVER (PARTITION BY kind) AS low FROM x, e)
    SELECT * EXCLUDE (low), delta = low AS worst, CASE kind WHEN 'period' THEN low >= -reach ELSE low > -reach END AS passed FROM y""", "new_auc old_auc delta se reach")
def _(spark, d):
    return comparison.slice_and_period_gate(sample(spark, d), "label", "score", "score_old", ["c_mktsegment", "o_orderpriority"], "split", "id", n_boot=REPLICATES)


@query("m14_lift_capture", f"{S}, e AS (SELECT c_mktsegment, avg(score_old) AS b, avg(score) AS a, max(score) AS r FROM sample GROUP BY 1) SELECT c_mktsegment, CASE WHEN r - b > 0 THEN (a - b) / (r - b) END AS captured FROM e", "captured")
def _(spark, d):
    rows = sample(spark, d).groupBy("c_mktsegment").agg(F.avg("score_old").alias("b"), F.avg("score").alias("a"), F.max("score").alias("r"))
    return rows.select("c_mktsegment", comparison.lift_capture(F.col("b"), F.col("a"), F.col("r")).alias("captured"))
