"""Queries of profiles, binning, drift and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.primitives import melt
from plumbline.operators import binning, drift, profile, rank_matrix, screening

from .registry import query
from .views import CATEGORICAL, CATS, LONG, NUMERIC, SAMPLE, TOKENS, long_sample, over_columns, over_sample, read, sample, tokens

S, L, C = f"WITH {SAMPLE}", f"WITH {LONG}", f"WITH {CATS}"
Q10 = "[0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]"


def edges_sql(source: str, by: str = "feature", where: str = "true") -> str:
    return f"SELECT {by}, list_sort(list_distinct(list_transform(quantile_cont(value, {Q10}), lambda x: round(x, 9)))) AS edges FROM {source} WHERE value IS NOT NULL AND {where} GROUP BY {by}"


def bin_sql(closed: str = "right") -> str:
    sign = "<" if closed == "right" else "<="
    return f"CASE WHEN value IS NULL THEN -1 ELSE coalesce(len(list_filter(list_slice(edges, 2, greatest(len(edges) - 1, 1)), lambda e: e {sign} value)), 0) END"


def cat_sample(spark, d):
    return melt(sample(spark, d), CATEGORICAL, ("id", "label", "arm", "split", "dt"), text=True)


IV = f"""edges AS ({edges_sql('long')}), cells AS (SELECT feature, {bin_sql()} AS bin, label FROM long JOIN edges USING (feature)),
    counts AS (SELECT feature, bin, sum(label) AS pos, sum(1 - label) AS neg FROM cells GROUP BY 1, 2),
    shares AS (SELECT *, (pos + 0.5) / (sum(pos) OVER w + CAST(0.5 AS DOUBLE)) AS p, (neg + 0.5) / (sum(neg) OVER w + CAST(0.5 AS DOUBLE)) AS n FROM counts WINDOW w AS (PARTITION BY feature)),
    woe AS (SELECT feature, bin, pos, neg, ln(p / n) AS woe, (p - n) * ln(p / n) AS iv_part FROM shares)"""
IV_TABLE = """ivs AS (SELECT feature, sum(iv_part) AS iv FROM woe GROUP BY 1), by_woe AS (SELECT feature, round(woe, 9) AS s, sum(pos) AS pos, sum(neg) AS neg FROM woe GROUP BY 1, 2),
    below AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY s) - neg AS b FROM by_woe), aucs AS (SELECT feature, sum(pos * (b + neg / 2.0)) / (sum(pos) * sum(neg)) AS a FROM below GROUP BY 1),
    iv_table AS (SELECT feature, iv, greatest(a, 1 - a) AS auc FROM ivs JOIN aucs USING (feature))"""


@query("d1_basic_stats", f"""{L}, st AS (SELECT feature, count(value) AS n, 1 - count(value) / count(*) AS missing_rate, count(DISTINCT value) AS "distinct", avg(value) AS mean, CASE WHEN count(value) = 1 THEN 0 ELSE stddev_samp(value) END AS std,
        min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, max(value) AS max FROM long GROUP BY 1)
    SELECT feature, CASE feature WHEN 'n_lines' THEN 'bigint' ELSE 'double' END AS dtype, * EXCLUDE (feature) FROM st
    UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment), 1 - count(c_mktsegment) / count(*), count(DISTINCT c_mktsegment), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM sample
    UNION ALL SELECT 'gone', 'MISSING_COL', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL""", "missing_rate mean std min q25 median q75 max")
def _(spark, d):
    return over_sample(spark, d, lambda rows: profile.basic_stats(rows, [*NUMERIC, "c_mktsegment", "gone"]))


@query("d2_feature_quality", f"""{L}, b AS (SELECT feature, count(*) AS r, count(value) AS n, count(DISTINCT value) AS d, quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.99) AS q9 FROM long GROUP BY 1),
    t AS (SELECT feature, max(c) AS top FROM (SELECT feature, value, count(*) AS c FROM long WHERE value IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    o AS (SELECT feature, count(*) FILTER (value < q1 - 3 * (q9 - q1) OR value > q9 + 3 * (q9 - q1)) AS o FROM long JOIN b USING (feature) GROUP BY 1)
    SELECT feature, n / r AS coverage, d / n AS distinct_ratio, o / n AS outlier_share, d <= 1 AS is_constant, top / n AS top_share, d / n > 0.95 AND d > 100 AS high_cardinality FROM b JOIN t USING (feature) JOIN o USING (feature)""", "coverage distinct_ratio outlier_share top_share")
def _(spark, d):
    return over_sample(spark, d, lambda rows: profile.feature_quality(rows, NUMERIC))


QUALITY = """vc AS (SELECT split, feature, value, count(*) AS c FROM long GROUP BY 1, 2, 3),
    qs AS (SELECT split, feature, sum(c) AS r, coalesce(sum(c) FILTER (value IS NULL), 0) AS missing, count(value) AS d, max(c) FILTER (value IS NOT NULL) AS top FROM vc GROUP BY 1, 2),
    qr AS (SELECT split, feature, missing, missing / r AS missing_rate, d AS "distinct", top / nullif(r - missing, 0) AS mode_ratio FROM qs),
    quality AS (SELECT *, CASE WHEN missing_rate > 0.8 OR "distinct" <= 1 OR mode_ratio >= 0.99 THEN 'severe' WHEN missing_rate > 0.5 OR mode_ratio >= 0.95 THEN 'warning' ELSE 'ok' END AS severity FROM qr)"""


@query("d3_basic_quality_by_split", f"{L}, {QUALITY} SELECT * FROM quality", "missing_rate mode_ratio", "missing")
def _(spark, d):
    return profile.quality_by_split(long_sample(spark, d))


@query("d4_identifier_like", f"""{S}, t AS (SELECT unnest(['id', 'pday', 'c_mktsegment', 'o_custkey']) AS feature, unnest([CAST(id AS VARCHAR), pday, c_mktsegment, CAST(o_custkey AS VARCHAR)]) AS value FROM sample),
    l AS (SELECT feature, max(c) / sum(c) AS one_length FROM (SELECT feature, length(value) AS l, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1),
    u AS (SELECT feature, count(DISTINCT value) / count(*) AS unique_ratio, avg(CAST(regexp_full_match(value, '[A-Za-z0-9_-]{{6,}}') AS INT)) AS token_share FROM t GROUP BY 1)
    SELECT feature, unique_ratio, one_length, token_share, feature = 'id' AS named, unique_ratio > 0.95 AND (feature = 'id' OR one_length >= 0.8 OR token_share >= 0.9) AS identifier FROM l JOIN u USING (feature)""", "unique_ratio one_length token_share")
def _(spark, d):
    return profile.identifier_like(sample(spark, d), ["id", "pday", "c_mktsegment", "o_custkey", "c_acctbal"])


@query("d5_text_shape", f"""WITH {TOKENS}, s AS (SELECT stddev_samp(length(seq)) / avg(length(seq)) AS length_cv, avg(length(seq) - length(replace(seq, ',', ''))) AS delimiters FROM tokens),
    w AS (SELECT count(DISTINCT t) AS vocabulary, count(*) / count(DISTINCT t) AS reuse FROM (SELECT unnest(string_split(seq, ',')) AS t FROM tokens))
    SELECT *, length_cv > 0.25 OR reuse > 50 OR delimiters > 0.5 AS composite FROM s, w""", "length_cv delimiters reuse")
def _(spark, d):
    return profile.text_shape(tokens(spark, d), "seq")


@query("d6_sample_distribution", f"""{S} SELECT strftime(dt, '%Y-%m') AS month, count(*) AS "rows", avg(label) AS rate, count(DISTINCT o_custkey) AS entities, avg(arm) AS treated_rate, avg(label) FILTER (arm = 1) AS treated_response,
    avg(label) FILTER (arm = 0) AS control_response, 1 - count(DISTINCT o_custkey) / count(*) AS duplicate_rate, avg(label) FILTER (arm = 1) - avg(label) FILTER (arm = 0) AS ate FROM sample GROUP BY 1""", "rate treated_rate treated_response control_response duplicate_rate ate")
def _(spark, d):
    return profile.sample_distribution(sample(spark, d), "dt", "label", "o_custkey", "arm")


@query("d7_sample_overview", f"""{S}, k AS (SELECT o_custkey, dt, count(*) AS c FROM sample GROUP BY 1, 2)
    SELECT count(*) AS "rows", sum(label) AS positives, sum(1 - label) AS negatives, CAST(min(dt) AS VARCHAR) AS first_day, CAST(max(dt) AS VARCHAR) AS last_day, 0 AS null_labels, count(DISTINCT o_custkey) AS ids, (SELECT sum(c - 1) FROM k) AS repeated,
           sum(1 - label) / sum(label) AS ratio FROM sample""", "ratio", "positives negatives null_labels repeated")
def _(spark, d):
    return profile.sample_overview(sample(spark, d), "o_custkey", "dt", "label")


@query("d8_label_stability", f"""{S}, e AS (SELECT strftime(dt, '%Y-%m') AS period, avg(label) AS r, count(*) AS n, sum(label) AS p FROM sample GROUP BY 1),
    o AS (SELECT count(*) AS periods, (max(r) - min(r)) * 100 AS range_points, stddev_pop(r) * 100 AS std_points, sum(n) AS n, sum(p) AS p FROM e)
    SELECT periods, range_points, std_points, n AS "rows", p AS positives, CASE WHEN std_points < 1 THEN 'stable' WHEN std_points < 3 THEN 'slight' ELSE 'marked' END AS verdict,
           CASE WHEN n >= 10000 AND p >= 500 THEN 'sufficient' WHEN n >= 1000 AND p >= 50 THEN 'limited' ELSE 'insufficient' END AS sufficiency FROM o""", "range_points std_points", 'rows positives')
def _(spark, d):
    return profile.label_stability(sample(spark, d), "dt", "label")


@query("d9_entity_overlap", f"""{S}, e AS (SELECT o_custkey, bool_or(split = 'train') AS a, bool_or(split = 'test') AS b, bool_or(split = 'oot') AS c FROM sample GROUP BY 1),
    u AS (SELECT 'train' AS "left", 'test' AS "right", count(*) FILTER (a AND b) AS x, count(*) FILTER (a OR b) AS y FROM e UNION ALL SELECT 'train', 'oot', count(*) FILTER (a AND c), count(*) FILTER (a OR c) FROM e UNION ALL SELECT 'test', 'oot', count(*) FILTER (b AND c), count(*) FILTER (b OR c) FROM e)
    SELECT "left", "right", x AS "both", y AS either, x / y AS jaccard FROM u""", "jaccard")
def _(spark, d):
    return profile.entity_overlap(sample(spark, d), "o_custkey")


@query("d10_compression_audit", f"""{S}, e AS (SELECT o_custkey, count(*) AS n, (CAST(count(DISTINCT c_acctbal) <= 1 AS INT) + CAST(count(DISTINCT n_lines) <= 1 AS INT) + CAST(count(DISTINCT o_orderpriority) <= 1 AS INT)) / 3 AS s FROM sample GROUP BY 1),
    o AS (SELECT avg(n) AS rows_per_entity, avg(s) FILTER (n > 1) AS unchanged_share FROM e) SELECT *, rows_per_entity > 1.3 AS many_periods, unchanged_share > 0.7 AS compressible FROM o""", "rows_per_entity unchanged_share")
def _(spark, d):
    return profile.compression_audit(sample(spark, d), "o_custkey", ["c_acctbal", "n_lines", "o_orderpriority"])


@query("d14_score_histogram", f"{S}, h AS (SELECT least(CAST(floor(score * 10) AS BIGINT), 9) AS bin, count(*) AS n FROM sample GROUP BY 1) SELECT bin, n, n / sum(n) OVER () AS share FROM h", "share")
def _(spark, d):
    return profile.score_histogram(sample(spark, d), "score")


PSI = f"""pe AS ({edges_sql('long', where="split = 'train'")}), pc AS (SELECT feature, split, CAST({bin_sql()} AS VARCHAR) AS bin FROM long JOIN pe USING (feature) WHERE split IN ('train', 'oot') AND len(edges) > 2),
    pf AS (SELECT l.feature, l.split, coalesce(CAST(l.value AS VARCHAR), 'null') AS v FROM long l JOIN pe USING (feature) WHERE l.split IN ('train', 'oot') AND len(edges) <= 2),
    pg AS (SELECT *, CASE WHEN (feature, v) IN (SELECT (feature, v) FROM pf WHERE split = 'train') THEN v ELSE 'OTHER' END AS bin FROM pf),
    pb AS (SELECT feature, bin, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'oot') AS b FROM (SELECT feature, split, bin FROM pc UNION ALL SELECT feature, split, bin FROM pg) GROUP BY 1, 2),
    ps AS (SELECT feature, CASE WHEN a = 0 THEN 1e-6 ELSE a / sum(a) OVER w END AS p, CASE WHEN b = 0 THEN 1e-6 ELSE b / sum(b) OVER w END AS q FROM pb WINDOW w AS (PARTITION BY feature)),
    psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM ps GROUP BY 1)"""


@query("d13_profile_rules", f"""{L}, {PSI}, m AS (SELECT feature FROM long GROUP BY 1 HAVING 1 - count(value) / count(*) > 0.5), n AS (SELECT count(*) AS n, avg(label) AS rate FROM sample)
    SELECT 'small_sample' AS rule, 'rows' AS subject FROM n WHERE n < 20000 UNION ALL SELECT 'imbalance', 'label' FROM n WHERE least(rate, 1 - rate) < 0.05 UNION ALL SELECT 'missing', feature FROM m UNION ALL SELECT 'strong_drift', feature FROM psi WHERE psi > 0.25""")
def _(spark, d):
    def make(rows):
        top = rows.agg(F.count("*"), F.avg("label")).first()
        return profile.profile_rules(profile.basic_stats(rows, NUMERIC), drift.psi_numeric(rows, NUMERIC), top[0], top[1])

    return over_sample(spark, d, make)


@query("d15_quality_summary", f"""{L}, {QUALITY}, {PSI}
    SELECT kind, band, count(*) AS n FROM (SELECT 'severity' AS kind, severity AS band FROM quality UNION ALL SELECT 'missing', CASE WHEN missing_rate <= 0.5 THEN 'low' WHEN missing_rate <= 0.8 THEN 'high' ELSE 'severe' END FROM quality
    UNION ALL SELECT 'psi', CASE WHEN psi <= 0.1 THEN 'stable' WHEN psi <= 0.25 THEN 'moderate' ELSE 'strong' END FROM psi) GROUP BY 1, 2""")
def _(spark, d):
    return over_sample(spark, d, lambda rows: profile.quality_summary(profile.quality_by_split(melt(rows, NUMERIC, ["split"])), drift.psi_numeric(rows, NUMERIC)))


@query("e1_equal_freq_edges", f"{L}, edges AS ({edges_sql('long')}) SELECT feature, len(edges) AS n_edges, list_sum(edges) AS total FROM edges", "total")
def _(spark, d):
    made = over_sample(spark, d, lambda rows: binning.edge_table(spark, binning.equal_freq_edges(rows, NUMERIC)))
    return made.select("feature", F.size("edges").alias("n_edges"), F.aggregate("edges", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("e2_woe_table", f"{L}, {IV} SELECT * FROM woe", "woe iv_part", "bin pos neg")
def _(spark, d):
    return over_sample(spark, d, lambda rows: binning.woe_table(rows, NUMERIC))


@query("e2_iv_table", f"{L}, {IV}, {IV_TABLE} SELECT * FROM iv_table", "iv auc")
def _(spark, d):
    return over_sample(spark, d, lambda rows: binning.iv_table(rows, NUMERIC))


MIXED = f"""e AS ({edges_sql('long')}), bins AS (SELECT feature, CASE WHEN value IS NULL THEN '__nan__' ELSE CAST({bin_sql()} AS VARCHAR) END AS bin, label, arm FROM long JOIN e USING (feature)
        UNION ALL SELECT 'c_mktsegment', c_mktsegment, label, arm FROM sample UNION ALL SELECT 'o_orderpriority', o_orderpriority, label, arm FROM sample)"""


def mixed_iv(source: str, by: str) -> str:
    return f"""SELECT {by}, sum((p - n) * ln(p / n)) AS iv FROM (SELECT {by}, (pos + 0.5) / CAST(sum(pos) OVER w AS DOUBLE) AS p, (neg + 0.5) / CAST(sum(neg) OVER w AS DOUBLE) AS n
        FROM (SELECT {by}, bin, sum(label) AS pos, sum(1 - label) AS neg FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY {by})) GROUP BY {by}"""


@query("e3_iv_woe_mixed", f"{L}, {MIXED} {mixed_iv('bins', 'feature')}", "iv")
def _(spark, d):
    return binning.iv_woe_mixed(binning.mixed_bins(long_sample(spark, d), cat_sample(spark, d)))


@query("e4_uplift_iv", f"""{L}, {MIXED}, sided AS (SELECT feature, bin, label, 'all' AS side FROM bins UNION ALL SELECT feature, bin, label, CASE WHEN arm = 1 THEN 'treated' ELSE 'control' END FROM bins), i AS ({mixed_iv('sided', 'side, feature')})
    SELECT feature, max(iv) FILTER (side = 'all') AS iv_all, max(iv) FILTER (side = 'treated') AS iv_treated, max(iv) FILTER (side = 'control') AS iv_control, abs(max(iv) FILTER (side = 'treated') - max(iv) FILTER (side = 'control')) AS gap FROM i GROUP BY 1""", "iv_all iv_treated iv_control gap")
def _(spark, d):
    return binning.uplift_iv(binning.mixed_bins(long_sample(spark, d), cat_sample(spark, d)))


def rank_sql(by: str, value: str) -> str:
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0)"


@query("e5_target_spearman", f"{L}, r AS (SELECT feature, {rank_sql('feature', 'value')} AS x, {rank_sql('feature', 'outcome')} AS y FROM long WHERE value IS NOT NULL), c AS (SELECT feature, count(*) AS n, abs(corr(x, y)) AS r FROM r GROUP BY 1) SELECT feature, n, CASE WHEN n >= 10 AND NOT isnan(r) THEN r END AS spearman FROM c", "spearman")
def _(spark, d):
    return over_columns(spark, d, ["outcome"], lambda rows: rank_matrix.target_spearman(rows, NUMERIC, "outcome"))


def auc_sql(source: str, by: str, score: str, label: str = "label") -> str:
    return f"""SELECT {by}, sum(p * (b + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS a, count(*) AS levels FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY s) - n AS b FROM
        (SELECT {by}, {score} AS s, sum({label}) AS p, sum(1 - {label}) AS n FROM {source} WHERE {score} IS NOT NULL GROUP BY ALL)) GROUP BY {by}"""


@query("e6_univariate_auc", f"{L}, a AS ({auc_sql('long', 'feature', 'value')}) SELECT feature, CASE WHEN levels > 1 THEN greatest(a, 1 - a) END AS auc FROM a", "auc")
def _(spark, d):
    return binning.univariate_auc(long_sample(spark, d))


@query("e7_woe_encode", f"{L}, {IV} SELECT feature, count(*) AS n, avg(w.woe) AS mean_woe, max(w.woe) AS most FROM (SELECT feature, {bin_sql()} AS bin FROM long JOIN edges USING (feature)) JOIN woe w USING (feature, bin) GROUP BY 1", "mean_woe most")
def _(spark, d):
    def make(rows):
        edges = binning.equal_freq_edges(rows, NUMERIC)
        made = binning.woe_encode(melt(rows, NUMERIC), binning.edge_table(spark, edges), binning.woe_table(rows, NUMERIC, edges=edges))
        return made.groupBy("feature").agg(F.count("*").alias("n"), F.avg("woe").alias("mean_woe"), F.max("woe").alias("most"))

    return over_sample(spark, d, make)


#: Every way to join the ten quantile bins of a column into at most four whose event rates rise, or fall, with 5 % of the rows each.
MONOTONE = f"""me AS ({edges_sql('long')}), mc AS (SELECT feature, {bin_sql()} AS bin, sum(label) AS pos, sum(1 - label) AS neg FROM long JOIN me USING (feature) WHERE value IS NOT NULL GROUP BY 1, 2),
    mb AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY bin) AS k FROM mc), mt AS (SELECT feature, max(k) AS m, sum(pos) AS tp, sum(neg) AS tn FROM mb GROUP BY 1),
    sg AS (SELECT a.feature, a.k AS i, b.k AS j, tp, tn, m, (SELECT sum(pos) FROM mb c WHERE c.feature = a.feature AND c.k BETWEEN a.k AND b.k) AS p, (SELECT sum(neg) FROM mb c WHERE c.feature = a.feature AND c.k BETWEEN a.k AND b.k) AS n FROM mb a JOIN mb b ON a.feature = b.feature AND a.k <= b.k JOIN mt ON mt.feature = a.feature),
    iv AS (SELECT feature, i, j, m, p / (p + n) AS rate, ((p + CAST(0.5 AS DOUBLE)) / (tp + CAST(0.5 AS DOUBLE)) - (n + CAST(0.5 AS DOUBLE)) / (tn + CAST(0.5 AS DOUBLE))) * ln((p + CAST(0.5 AS DOUBLE)) / (tp + CAST(0.5 AS DOUBLE)) / ((n + CAST(0.5 AS DOUBLE)) / (tn + CAST(0.5 AS DOUBLE)))) AS v FROM sg WHERE p + n >= (tp + tn) * CAST(0.05 AS DOUBLE)),
    way AS (SELECT feature, j, rate, v AS total, 1 AS bins, d FROM iv, (SELECT unnest([1, -1]) AS d) WHERE i = 1
        UNION ALL SELECT w.feature, s.j, s.rate, w.total + s.v, w.bins + 1, w.d FROM way w JOIN iv s ON s.feature = w.feature AND s.i = w.j + 1 AND w.d * (s.rate - w.rate) > 0 WHERE w.bins < 4)"""


@query("e7_monotone_bins", f"WITH RECURSIVE {LONG}, {MONOTONE} SELECT way.feature, max(total) AS iv FROM way JOIN mt ON mt.feature = way.feature AND way.j = mt.m GROUP BY 1", "iv")
def _(spark, d):
    def make(rows):
        edges = binning.monotone_edges(rows, NUMERIC, most=4, n_prebins=10)
        counts = binning.label_counts(rows, [f for f in NUMERIC if edges[f]], edges)
        return binning.woe_of(counts.filter("bin >= 0"), 0.5).groupBy("feature").agg(F.coalesce(F.sum("iv_part"), F.lit(0.0)).alias("iv"))

    return over_sample(spark, d, make)


REPORT = f"""{IV}, {IV_TABLE}, {PSI}, st AS (SELECT feature, 1 - count(value) / count(*) AS missing_rate FROM long GROUP BY 1)
    SELECT feature, iv, auc, psi, missing_rate, CASE WHEN iv >= 0.5 THEN 'suspicious' WHEN iv >= 0.3 THEN 'strong' WHEN iv >= 0.1 THEN 'medium' WHEN iv >= 0.02 THEN 'weak' WHEN iv IS NOT NULL THEN 'none' END AS iv_level,
           CASE WHEN psi >= 0.25 THEN 'high' WHEN psi >= 0.1 THEN 'moderate' WHEN psi >= 0.02 THEN 'low' WHEN psi IS NOT NULL THEN 'none' END AS psi_level, coalesce(psi < 0.1, false) AS stable FROM st FULL JOIN iv_table USING (feature) FULL JOIN psi USING (feature)"""


@query("e8_quality_report", f"{L}, {REPORT}", "iv auc psi missing_rate")
def _(spark, d):
    return over_sample(spark, d, lambda rows: drift.feature_report(rows, NUMERIC))


@query("f1_psi_numeric", f"{L}, {PSI} SELECT * FROM psi", "psi")
def _(spark, d):
    return over_sample(spark, d, lambda rows: drift.psi_numeric(rows, NUMERIC))


@query("f2_psi_categorical", f"""{C}, b AS (SELECT feature, value, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'oot') AS b FROM cats WHERE split IN ('train', 'oot') GROUP BY 1, 2),
    s AS (SELECT feature, CASE WHEN a = 0 THEN 1e-6 ELSE a / sum(a) OVER w END AS p, CASE WHEN b = 0 THEN 1e-6 ELSE b / sum(b) OVER w END AS q FROM b WINDOW w AS (PARTITION BY feature)) SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM s GROUP BY 1""", "psi")
def _(spark, d):
    return drift.psi_categorical(cat_sample(spark, d))


@query("f3_drift_profile", f"""{L}, p AS (SELECT split AS period, feature, value FROM long UNION ALL SELECT CAST(year(dt) AS VARCHAR), feature, value FROM long),
    big AS (SELECT DISTINCT period FROM (SELECT period, feature FROM p GROUP BY 1, 2 HAVING count(*) >= 100)),
    pairs AS (SELECT * FROM (VALUES ('split', 'train', 'test'), ('split', 'train', 'oot'), ('first', '1995', '1996'), ('first', '1995', '1999'), ('adjacent', '1998', '1999'), ('adjacent', '2000', '2001')) AS t(kind, base, current) WHERE base IN (FROM big) AND current IN (FROM big)),
    e AS ({edges_sql('p', 'period, feature')}),
    r AS (SELECT kind, base, current, p.feature, {bin_sql('left')} AS bin, 'a' AS side FROM pairs JOIN p ON p.period = base JOIN e ON e.period = base AND e.feature = p.feature
          UNION ALL SELECT kind, base, current, p.feature, {bin_sql('left')}, 'b' FROM pairs JOIN p ON p.period = current JOIN e ON e.period = base AND e.feature = p.feature),
    c AS (SELECT kind, base, current, feature, bin, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM r GROUP BY 1, 2, 3, 4, 5),
    v AS (SELECT *, sum(CASE WHEN bin >= 0 THEN a ELSE 0 END) OVER w AS va, sum(CASE WHEN bin >= 0 THEN b ELSE 0 END) OVER w AS vb, sum(a) OVER w AS ta, sum(b) OVER w AS tb FROM c WINDOW w AS (PARTITION BY kind, base, current, feature)),
    s AS (SELECT kind, base, current, feature, va, vb, CASE WHEN bin >= 0 THEN a / va ELSE a / ta END + CAST(1e-6 AS DOUBLE) AS p, CASE WHEN bin >= 0 THEN b / vb ELSE b / tb END + CAST(1e-6 AS DOUBLE) AS q FROM v)
    SELECT kind, base, current, feature, sum(CASE WHEN va >= 10 AND vb >= 10 THEN (q - p) * ln(q / p) END) AS psi FROM s GROUP BY 1, 2, 3, 4""", "psi")
def _(spark, d):
    long = long_sample(spark, d)
    both = long.select(F.explode(F.array(F.col("split"), F.year("dt").cast("string"))).alias("period"), "feature", "value")
    pairs = [("split", "train", "test"), ("split", "train", "oot"), ("first", "1995", "1996"), ("first", "1995", "1999"), ("adjacent", "1998", "1999"), ("adjacent", "2000", "2001")]
    return drift.drift_profile(both, spark.createDataFrame(pairs, "kind string, base string, current string"))


def signed_sql(fit: str, keep: str = "split") -> str:
    return f"""se AS ({edges_sql('long', where=f"{fit} AND value > 0")}), sb AS (SELECT {keep}, arm, outcome, label, feature, CASE WHEN value IS NULL THEN 'Missing' WHEN value < 0 THEN 'Negative' WHEN value = 0 THEN 'Zero' ELSE 'Positive_Q' || CAST({bin_sql()} + 1 AS VARCHAR) END AS bin FROM long LEFT JOIN se USING (feature))"""


@query("f4_psi_signed", f"""{L}, {signed_sql("split = 'train'")}, b AS (SELECT feature, bin, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'oot') AS b FROM sb WHERE split IN ('train', 'oot') GROUP BY 1, 2),
    s AS (SELECT feature, a / sum(a) OVER w + 1e-6 AS p, b / sum(b) OVER w + 1e-6 AS q FROM b WINDOW w AS (PARTITION BY feature)), o AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM s GROUP BY 1)
    SELECT feature, psi, CASE WHEN psi > 0.25 THEN 'severe' WHEN psi > 0.1 THEN 'warning' ELSE 'ok' END AS level FROM o""", "psi")
def _(spark, d):
    return over_sample(spark, d, lambda rows: drift.psi_signed(rows, NUMERIC))


@query("f4_psi_signed_categorical", f"""{C}, b AS (SELECT feature, value, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'oot') AS b FROM cats WHERE split IN ('train', 'oot') GROUP BY 1, 2),
    s AS (SELECT feature, a / sum(a) OVER w + 1e-6 AS p, b / sum(b) OVER w + 1e-6 AS q FROM b WINDOW w AS (PARTITION BY feature)) SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM s GROUP BY 1""", "psi")
def _(spark, d):
    return drift.psi_signed_categorical(cat_sample(spark, d))


@query("f5_monthly_psi", f"""{L}, {signed_sql("strftime(dt, '%Y-%m') = '1995-01'", "strftime(dt, '%Y-%m') AS month")},
    c AS (SELECT feature, month, bin, count(*) AS c FROM sb GROUP BY 1, 2, 3), k AS (SELECT DISTINCT feature, bin FROM c), m AS (SELECT DISTINCT month FROM c WHERE month > '1995-01'),
    g AS (SELECT k.feature, m.month, k.bin, coalesce(x.c, 0) AS a, coalesce(y.c, 0) AS b FROM k CROSS JOIN m LEFT JOIN c x ON x.feature = k.feature AND x.bin = k.bin AND x.month = '1995-01' LEFT JOIN c y ON y.feature = k.feature AND y.bin = k.bin AND y.month = m.month),
    s AS (SELECT feature, month, a / sum(a) OVER w + 1e-6 AS p, b / sum(b) OVER w + 1e-6 AS q FROM g WHERE a > 0 OR b > 0 WINDOW w AS (PARTITION BY feature, month)) SELECT feature, month, sum((q - p) * ln(q / p)) AS psi FROM s GROUP BY 1, 2""", "psi")
def _(spark, d):
    return drift.monthly_psi(long_sample(spark, d).withColumn("month", F.date_format("dt", "yyyy-MM")), "month")


@query("f6_score_psi", f"""{S}, long AS (SELECT 'score' AS feature, score AS value, split FROM sample WHERE split IN ('train', 'oot')), e AS ({edges_sql('long', where="split = 'train'")}),
    b AS (SELECT {bin_sql('left')} AS bin, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'oot') AS b FROM long JOIN e USING (feature) GROUP BY 1),
    s AS (SELECT greatest(a / sum(a) OVER (), 1e-12) AS p, greatest(b / sum(b) OVER (), 1e-12) AS q FROM b) SELECT sum((q - p) * ln(q / p)) AS psi FROM s""", "psi")
def _(spark, d):
    return drift.score_psi(sample(spark, d), "score")


@query("f7_token_drift", f"""WITH {TOKENS}, x AS (SELECT DISTINCT user_id, day, unnest(string_split(seq, ',')) AS token FROM tokens), n AS (SELECT day, count(*) AS n FROM tokens GROUP BY 1),
    base AS (SELECT token, count(*) / (SELECT count(*) FROM tokens WHERE day < '2024-01-11') AS base_coverage FROM x WHERE day < '2024-01-11' GROUP BY 1), c AS (SELECT day, token, count(*) AS c FROM x GROUP BY 1, 2),
    g AS (SELECT n.day AS period, base.token, coalesce(c.c, 0) / n.n AS coverage, base_coverage FROM n CROSS JOIN base LEFT JOIN c ON c.day = n.day AND c.token = base.token),
    r AS (SELECT *, coverage / base_coverage AS ratio, max(coverage) OVER (PARTITION BY token ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g)
    SELECT period, token, coverage, base_coverage, ratio, base_coverage >= 0.05 AND ratio < 0.1 AND coalesce(seen, 0) > 0 AS collapsed FROM r""", "coverage base_coverage ratio")
def _(spark, d):
    return drift.token_drift(tokens(spark, d), "seq", "day", F.col("day") < "2024-01-11")


@query("f7_token_divergence", f"""WITH {TOKENS}, x AS (SELECT day, unnest(string_split(seq, ',')) AS token FROM tokens), r AS (SELECT day, avg(len(string_split(seq, ','))) AS tokens_per_row FROM tokens GROUP BY 1),
    base AS (SELECT token, count(*) / sum(count(*)) OVER () AS p FROM x WHERE day < '2024-01-11' GROUP BY 1), c AS (SELECT day, token, count(*) / sum(count(*)) OVER (PARTITION BY day) AS q FROM x GROUP BY 1, 2),
    g AS (SELECT k.day, k.token, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM (SELECT day, token FROM r CROSS JOIN (SELECT token FROM base UNION SELECT token FROM c)) k LEFT JOIN base USING (token) LEFT JOIN c ON c.day = k.day AND c.token = k.token)
    SELECT day AS period, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END) AS jsd, sum(CASE WHEN p = 0 THEN q ELSE 0 END) AS new_share,
           sum(CASE WHEN q = 0 THEN p ELSE 0 END) AS vanished_share, max(tokens_per_row) AS tokens_per_row FROM g JOIN r USING (day) GROUP BY 1""", "jsd new_share vanished_share tokens_per_row")
def _(spark, d):
    return drift.token_divergence(tokens(spark, d), "seq", "day", F.col("day") < "2024-01-11")


@query("f8_ks_scan", f"""{L}, c AS (SELECT feature, value, count(*) FILTER (score >= 0.5 AND label = 0) AS a, count(*) FILTER (NOT (score >= 0.5 AND label = 0)) AS b FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT feature, sum(a) OVER o AS ca, sum(b) OVER o AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM c WINDOW o AS (PARTITION BY feature ORDER BY value), p AS (PARTITION BY feature))
    SELECT feature, max(abs(ca / nullif(na, 0) - cb / nullif(nb, 0))) AS ks, max(na) AS n_a, max(nb) AS n_b FROM w GROUP BY 1""", "ks", "n_a n_b")
def _(spark, d):
    return drift.ks_scan(long_sample(spark, d, ("id", "label", "score")), (F.col("score") >= 0.5) & (F.col("label") == 0))


STATS = """st AS (SELECT feature, count(value) AS n, count(DISTINCT value) AS d, coalesce(stddev_samp(value), 0) AS std, 1 - count(value) / count(*) AS missing_rate FROM long GROUP BY 1)"""


@query("g1_boundary_filter", f"""{L}, {IV}, {IV_TABLE}, {STATS}, r AS (SELECT feature, array_to_string(list_filter([CASE WHEN n > 0 AND (d <= 1 OR std = 0) THEN 'constant' END, CASE WHEN iv > 1 THEN 'leak' END, CASE WHEN d / (SELECT count(*) FROM sample) > 0.9 THEN 'id_like' END, CASE WHEN n = 0 THEN 'all_missing' END], lambda x: x IS NOT NULL), ',') AS reasons FROM st JOIN iv_table USING (feature))
    SELECT feature, reasons, reasons = '' AS kept FROM r""")
def _(spark, d):
    return over_sample(spark, d, lambda rows: screening.boundary_filter(profile.basic_stats(rows, NUMERIC), binning.iv_table(rows, NUMERIC), rows.count()))


@query("g2_selection_rules", f"""{L}, {IV}, {IV_TABLE}, {PSI}, {STATS}, r AS (SELECT feature, array_to_string(list_filter([CASE WHEN psi > 0.1 THEN 'high_psi' END, CASE WHEN iv IS NULL OR iv < 0.02 THEN 'low_iv' END, CASE WHEN missing_rate > 0.95 THEN 'high_missing' END], lambda x: x IS NOT NULL), ',') AS reasons FROM st JOIN iv_table USING (feature) JOIN psi USING (feature))
    SELECT feature, reasons, reasons = '' AS kept FROM r""")
def _(spark, d):
    return over_sample(spark, d, lambda rows: screening.selection_rules(profile.basic_stats(rows, NUMERIC), binning.iv_table(rows, NUMERIC), drift.psi_numeric(rows, NUMERIC)))


@query("g3_recommend_features", f"""{L}, {QUALITY}, {signed_sql("split = 'train'")}, b AS (SELECT feature, bin, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'oot') AS b FROM sb WHERE split IN ('train', 'oot') GROUP BY 1, 2),
    s AS (SELECT feature, a / sum(a) OVER w + 1e-6 AS p, b / sum(b) OVER w + 1e-6 AS q FROM b WINDOW w AS (PARTITION BY feature)), o AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM s GROUP BY 1),
    f AS (SELECT feature, severity AS level, 'quality' AS source FROM quality WHERE split = 'train' UNION ALL SELECT feature, CASE WHEN psi > 0.25 THEN 'severe' WHEN psi > 0.1 THEN 'warning' ELSE 'ok' END, 'psi' FROM o)
    SELECT feature, count(*) FILTER (level = 'severe') = 0 AS keep, coalesce(string_agg(source || '_severe', ',' ORDER BY source) FILTER (level = 'severe'), '') AS reasons, count(*) FILTER (level = 'warning') AS warnings FROM f GROUP BY 1""")
def _(spark, d):
    return over_sample(spark, d, lambda rows: screening.recommend_features(profile.quality_by_split(melt(rows, NUMERIC, ["split"])), drift.psi_signed(rows, NUMERIC)))


@query("g4_gate_signal", f"""{L}, a AS ({auc_sql('long', 'feature', 'value')}), {PSI}, {STATS} SELECT feature, CASE WHEN levels > 1 THEN greatest(a, 1 - a) END AS auc, 1 - missing_rate AS coverage, psi,
    coalesce(CASE WHEN levels > 1 THEN greatest(a, 1 - a) END >= 0.5 AND 1 - missing_rate >= 0.3 AND psi <= 0.3 AND d > 1, false) AS passed FROM st JOIN a USING (feature) JOIN psi USING (feature)""", "auc coverage psi")
def _(spark, d):
    return over_sample(spark, d, lambda rows: screening.gate_signal(binning.univariate_auc(melt(rows, NUMERIC, ["label"])), profile.basic_stats(rows, NUMERIC), drift.psi_numeric(rows, NUMERIC)))


_WIDE = "wide AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in ("a", "b", "c", "e")) + " FROM (SELECT coalesce(c_acctbal, 0) AS a, coalesce(n_lines, 0) AS b, coalesce(sum_qty, 0) AS c, coalesce(avg_disc, 0) AS e FROM sample))"
REDUNDANT = f"""{_WIDE}, cp AS (SELECT unnest(['n_lines', 'n_lines', 'avg_disc', 'avg_disc']) AS feature, unnest(['c_acctbal', 'sum_qty', 'c_acctbal', 'sum_qty']) AS nearest, unnest([abs(corr(b, a)), abs(corr(b, c)), abs(corr(e, a)), abs(corr(e, c))]) AS corr FROM wide),
    redundant AS (SELECT feature, arg_max(nearest, corr) AS nearest, max(corr) AS corr, max(corr) > 0.9 AS redundant FROM cp GROUP BY 1)"""


@query("g5_redundancy", f"{S}, {REDUNDANT} SELECT * FROM redundant", "corr")
def _(spark, d):
    return over_sample(spark, d, lambda rows: screening.redundancy(rows, ["n_lines", "avg_disc"], ["c_acctbal", "sum_qty"]))


@query("g6_roi_probe", f"{L}, {REDUNDANT}, a AS ({auc_sql('long', 'feature', 'value')}) SELECT feature, corr, greatest(a, 1 - a) AS auc, CASE WHEN redundant THEN 'black' WHEN corr < 0.5 AND greatest(a, 1 - a) > 0.5 THEN 'white' ELSE 'grey' END AS list FROM redundant JOIN a USING (feature)", "corr auc")
def _(spark, d):
    return over_sample(spark, d, lambda rows: screening.roi_probe(screening.redundancy(rows, ["n_lines", "avg_disc"], ["c_acctbal", "sum_qty"]), binning.univariate_auc(melt(rows, NUMERIC, ["label"]))))


@query("g7_cross_validate_features", "SELECT event_type AS feature, event_type IN ('click', 'view') AS present FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, d):
    names = read(spark, d, "events").select(F.col("event_type").alias("feature")).distinct()
    return screening.cross_validate_features(names, names.filter(F.col("feature").isin("click", "view")))
