"""Queries of feature construction and text features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import features, text

from .analysis import auc_sql
from .registry import query
from .views import LONG, NUMERIC, SAMPLE, TOKENS, long_sample, read, sample, tokens

S, L = f"WITH {SAMPLE}", f"WITH {LONG}"
EV = "ev AS (SELECT event_id, user_id, ts, event_type, value FROM events)"


def events(spark, d):
    return read(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")


@query("h1_impute_median", f"{S}, m AS (SELECT quantile_cont(n_lines, 0.5) AS a, quantile_cont(sparse_f, 0.5) AS b, avg(CAST(n_lines IS NULL AS INT)) AS ra, avg(CAST(sparse_f IS NULL AS INT)) AS rb FROM sample WHERE split = 'train') SELECT id, coalesce(n_lines, a) AS n_lines, coalesce(sparse_f, b) AS sparse_f FROM sample, m", "n_lines sparse_f")
def _(spark, d):
    rows = sample(spark, d)
    return features.impute_median(rows.filter("split = 'train'"), rows, ["n_lines", "sparse_f"]).select("id", "n_lines", "sparse_f")


@query("h2_encode_features", f"""{S} SELECT id, coalesce(n_lines, (SELECT quantile_cont(n_lines, 0.5) FROM sample WHERE split = 'train')) AS n_lines, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS "c_mktsegment__BUILDING", CAST(c_mktsegment IS NULL AS BIGINT) AS "c_mktsegment__MISSING",
    CAST(c_mktsegment NOT IN (SELECT DISTINCT c_mktsegment FROM sample WHERE split = 'train') AS BIGINT) AS "c_mktsegment__OTHER" FROM sample""", "n_lines")
def _(spark, d):
    rows = sample(spark, d)
    return features.encode_features(rows.filter("split = 'train'"), rows, ["n_lines"], ["c_mktsegment"]).select("id", "n_lines", "c_mktsegment__BUILDING", "c_mktsegment__MISSING", "c_mktsegment__OTHER")


@query("h3_recency_view", f"{S}, l AS (SELECT split, max(dt) AS last FROM sample GROUP BY 1) SELECT id, c_acctbal * exp(-ln(2) * datediff('day', dt, last) / 90) AS c_acctbal_rec FROM sample JOIN l USING (split)", "c_acctbal_rec")
def _(spark, d):
    return features.recency_view(sample(spark, d), "dt", ["c_acctbal"], 90.0, ["label", "id", "arm"]).select("id", "c_acctbal_rec")


@query("h4_active_view", f"{S} SELECT id, c_acctbal * CAST(coalesce(n_lines, 0) > 0 AS INT) AS c_acctbal_active, CAST(coalesce(n_lines, 0) > 0 AS BIGINT) AS is_active FROM sample", "c_acctbal_active")
def _(spark, d):
    return features.active_view(sample(spark, d), ["c_acctbal"], "n_lines").select("id", "c_acctbal_active", "is_active")


_W = "w AS (SELECT o_custkey, count(*) FILTER (o_orderdate >= '2001-07-01') AS n_1m, count(*) FILTER (o_orderdate >= '2001-05-01') AS n_3m, count(*) FILTER (o_orderdate >= '2000-08-01') AS n_12m FROM orders GROUP BY 1)"


@query("h5_window_ratio_view", f"WITH {_W} SELECT *, coalesce(n_1m / nullif(n_3m, 0), 0) AS n_1m_over_3m, coalesce(n_1m / nullif(n_12m, 0), 0) AS n_1m_over_12m, coalesce(n_3m / nullif(n_12m, 0), 0) AS n_3m_over_12m FROM w", "n_1m_over_3m n_1m_over_12m n_3m_over_12m")
def _(spark, d):
    c = lambda day, name: F.count_if(F.col("o_orderdate") >= day).alias(name)
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(c("2001-07-01", "n_1m"), c("2001-05-01", "n_3m"), c("2000-08-01", "n_12m"))
    return features.window_ratio_view(rows)


@query("h6_apply_view", f"{S} SELECT id, outcome, outcome / 2 AS half FROM sample", "outcome half")
def _(spark, d):
    return features.apply_view(sample(spark, d).select("id", "outcome"), lambda df: df.withColumn("half", F.col("outcome") / 2), "id")


@query("h7_feature_block", f"{S} SELECT id, CAST(CAST(outcome / 1000 AS FLOAT) AS DOUBLE) AS thousands, CAST(CAST(floor(outcome) % 10 AS FLOAT) AS DOUBLE) AS last_digit FROM sample", "thousands last_digit")
def _(spark, d):
    block = lambda x: pd.DataFrame({"thousands": x["outcome"] / 1000, "last_digit": x["outcome"] // 1 % 10})
    return features.feature_block(sample(spark, d), block, "id", ["outcome"], ["thousands", "last_digit"])


@query("h8_candidate_transform", f"{S} SELECT id, CAST(CAST(floor(outcome / 1000) AS FLOAT) AS DOUBLE) AS candidate FROM sample", "candidate")
def _(spark, d):
    return features.candidate_transform(sample(spark, d), lambda x: x["outcome"] // 1000, "id", ["outcome"])


@query("h9_attach_features", "SELECT o_orderkey, o_custkey, c_acctbal FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_acctbal FROM customer WHERE c_acctbal > 0) USING (o_custkey)", "c_acctbal")
def _(spark, d):
    side = read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return features.attach_features(read(spark, d, "orders").select("o_orderkey", "o_custkey"), side, ["o_custkey"])


@query("h10_history_to_sequence", "SELECT o_custkey, count(*) AS n, string_agg(o_orderstatus || '|' || o_orderpriority, ';' ORDER BY o_orderdate, o_orderkey) AS seq FROM orders GROUP BY 1")
def _(spark, d):
    return features.history_to_sequence(read(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query("h11_window_counts", "WITH e AS (SELECT user_id, datediff('day', CAST(ts AS DATE), DATE '2024-02-01') AS ago FROM events), c AS (SELECT user_id, count(*) FILTER (ago <= 7) AS n_7, count(*) FILTER (ago <= 14) AS n_14, count(*) FILTER (ago <= 30) AS n_30 FROM e WHERE ago > 0 GROUP BY 1) SELECT *, n_7 / nullif(n_14, 0) AS r_7_14, n_14 / nullif(n_30, 0) AS r_14_30 FROM c", "r_7_14 r_14_30")
def _(spark, d):
    return features.window_counts(events(spark, d), "user_id", "ts", "2024-02-01", [7, 14, 30])


@query("h12_frequency_encode", f"{S} SELECT id, coalesce(n, 0) AS o_custkey_freq FROM sample LEFT JOIN (SELECT o_custkey, count(*) AS n FROM sample WHERE split = 'train' GROUP BY 1) USING (o_custkey)")
def _(spark, d):
    rows = sample(spark, d)
    return features.frequency_encode(rows.filter("split = 'train'"), rows, "o_custkey").select("id", "o_custkey_freq")


@query("h12_target_encode_oof", f"""{S}, f AS (SELECT id, c_mktsegment, label, ('0x' || substr(md5('7|' || CAST(id AS VARCHAR)), 1, 8))::BIGINT % 5 AS fold FROM sample), c AS (SELECT c_mktsegment, fold, count(*) AS n, sum(label) AS s FROM f GROUP BY 1, 2), p AS (SELECT avg(label) AS prior FROM f),
    t AS (SELECT c_mktsegment, fold, (sum(s) OVER w - s + 20 * prior) / (sum(n) OVER w - n + 20) AS te FROM c, p WINDOW w AS (PARTITION BY c_mktsegment)) SELECT id, te AS c_mktsegment_te FROM f JOIN t USING (c_mktsegment, fold)""", "c_mktsegment_te")
def _(spark, d):
    return features.target_encode_oof(sample(spark, d), "c_mktsegment", "label", "id").select("id", "c_mktsegment_te")


@query("h12_missing_pattern", f"{S} SELECT id, CAST(n_lines IS NULL AS BIGINT) + CAST(sparse_f IS NULL AS BIGINT) AS n_null, CAST(CAST(n_lines IS NULL AS INT) AS VARCHAR) || CAST(CAST(sparse_f IS NULL AS INT) AS VARCHAR) AS null_pattern FROM sample")
def _(spark, d):
    return features.missing_pattern(sample(spark, d), ["n_lines", "sparse_f"]).select("id", "n_null", "null_pattern")


@query("h13_prepare_benchmark_sample", "SELECT o_orderkey AS order_key, ln(1 + o_totalprice) AS label, CAST(o_orderdate AS DATE) AS dt, CAST(o_orderstatus = 'F' AS BIGINT) AS done FROM orders", "label")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("order key"), F.col("o_totalprice").alias("total $"), F.col("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").alias("done"))
    return features.prepare_benchmark_sample(rows, "total $", log_target=True, date="day").select("order_key", "label", "dt", "done")


@query("h14_compound_math", f"""{S}, z AS (SELECT id, signed AS x, signed / 2000 AS z FROM sample) SELECT id, ln(1 + abs(x)) AS signed_log1p, sqrt(abs(x)) AS signed_sqrt, cbrt(x) AS signed_cbrt, tanh(z) AS signed_tanh, sin(z) AS signed_sin, x * x / 1000 AS signed_square,
    exp(-abs(z)) AS signed_decay, exp(-z * z) AS signed_kernel, least(greatest(z, -1), 1) AS signed_ramp FROM z""", "signed_log1p signed_sqrt signed_cbrt signed_tanh signed_sin signed_square signed_decay signed_kernel signed_ramp")
def _(spark, d):
    rows = features.compound_math(sample(spark, d).select("id", "signed"), "signed", 0.0, 2000.0)
    return rows.withColumn("signed_square", F.col("signed_square") / 1000).drop("signed", "signed_fraction")


@query("h14_erf")
def _(spark, d):
    return sample(spark, d).select("id", features.erf_column(F.col("cate") * 2).alias("erf"))


@query("h15_interactions", f"{S}, p AS (SELECT *, avg_rank / n AS percent_rank FROM (SELECT id, c_acctbal AS a, outcome AS b, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS avg_rank, count(*) OVER () AS n FROM sample)) SELECT id, a - b AS difference, a + 0.5 * b AS weighted_sum, a / (b + 1e-6) AS ratio, a / nullif(a + b + 1e-6, 0) AS share, percent_rank FROM p", "difference weighted_sum ratio share percent_rank")
def _(spark, d):
    rows = features.interactions(sample(spark, d).select("id", "c_acctbal", "outcome"), "c_acctbal", "outcome")
    return features.percent_rank_feature(rows, "c_acctbal").select("id", "difference", "weighted_sum", "ratio", "share", "percent_rank")


@query("h16_text_stats", r"""WITH t AS (SELECT page_id, coalesce(url, '') AS u FROM pages) SELECT page_id, length(u) AS url_length, len(regexp_extract_all(u, '[^ \t-\r]+')) AS url_words, coalesce(length(regexp_replace(u, '[ \t-\r]+', '', 'g')) / nullif(len(regexp_extract_all(u, '[^ \t-\r]+')), 0), 0) AS url_mean_word,
    len(regexp_extract_all(u, '[.,;:!?]')) AS url_punctuation, len(regexp_extract_all(u, '[0-9]')) AS url_digits, len(regexp_extract_all(lower(u), 'example')) AS url_kw_example FROM t""", "url_mean_word")
def _(spark, d):
    return text.text_stats(read(spark, d, "pages").select("page_id", "url"), "url", ["example"]).drop("url")


@query("h17_category_codes", "SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) / count(*) OVER () AS c_mktsegment_share, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_code FROM customer", "c_mktsegment_share")
def _(spark, d):
    return features.category_codes(read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("h18_recency_decay", """WITH e AS (SELECT user_id, value, datediff('day', CAST(ts AS DATE), DATE '2024-02-01') AS ago FROM events) SELECT user_id, sum(exp(-ln(2) * ago / 7)) AS decayed_count, sum(exp(-ln(2) * ago / 7) * value) AS decayed_sum,
    list_sort(list(ago))[1] AS days_since_1, list_sort(list(ago))[2] AS days_since_2, list_sort(list(ago))[3] AS days_since_3 FROM e WHERE ago > 0 GROUP BY 1""", "decayed_count decayed_sum")
def _(spark, d):
    return features.recency_decay(events(spark, d), "user_id", "ts", "value", "2024-02-01", 7.0)


@query("h19_period_buckets", """SELECT user_id, count(*) FILTER (w = '2024-01-08') AS "2024-01-08_n", round(sum(value) FILTER (w = '2024-01-08'), 6) AS "2024-01-08_sum", count(*) FILTER (w = '2024-01-15') AS "2024-01-15_n", round(sum(value) FILTER (w = '2024-01-15'), 6) AS "2024-01-15_sum"
    FROM (SELECT user_id, value, strftime(date_trunc('week', ts), '%Y-%m-%d') AS w FROM events) WHERE w IN ('2024-01-08', '2024-01-15') GROUP BY 1""")
def _(spark, d):
    made = features.period_buckets(events(spark, d), "user_id", "ts", "value", "week", ["2024-01-08", "2024-01-15"])
    return made.withColumns({c: F.coalesce(c, F.lit(0)) for c in made.columns if c.endswith("_n")})


_DAYS = "epoch_us(date_trunc('second', ts)) / 86400e6"


@query("h20_event_aggregates", f"""WITH {EV}, a AS (SELECT user_id, count(*) AS n, sum(value) AS total, avg(value) AS mean, min(value) AS least, max(value) AS most, var_samp(value) AS variance, covar_pop(value, {_DAYS}) / CASE WHEN var_pop({_DAYS}) > 1e-9 THEN var_pop({_DAYS}) END AS slope,
    min(ts) FILTER (event_type = 'view') AS s0, min(ts) FILTER (event_type = 'click') AS s1 FROM ev GROUP BY 1) SELECT * EXCLUDE (s0, s1), (CAST(s0 IS NOT NULL AS INT) + CAST(coalesce(s0 IS NOT NULL AND s1 >= s0, false) AS INT)) / 2 AS funnel FROM a""", "total mean least most variance slope funnel")
def _(spark, d):
    return features.event_aggregates(events(spark, d), "user_id", "ts", "value", "event_type", ["view", "click"])


@query("h21_sequence_structure", f"""WITH {EV}, l AS (SELECT user_id, event_type, lag(event_type) OVER w AS b, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT user_id, event_type, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM ev GROUP BY 1, 2), e AS (SELECT user_id, -sum(p * log2(p)) AS entropy FROM k GROUP BY 1),
    a AS (SELECT user_id, count(*) AS n, count(DISTINCT b || '>' || event_type) AS bigrams, count(*) FILTER (b = event_type) AS repeats, quantile_cont(gap, 0.5) / 1e6 AS median_gap FROM l GROUP BY 1) SELECT * FROM a JOIN e USING (user_id)""", "median_gap entropy")
def _(spark, d):
    return features.sequence_structure(events(spark, d), "user_id", "ts", "event_id", "event_type")


@query("h22_group_statistics", f"{S}, g AS (SELECT c_mktsegment, avg(outcome) AS m, stddev_pop(outcome) AS s FROM sample GROUP BY 1) SELECT id, m AS outcome_group_mean, s AS outcome_group_std, outcome - m AS outcome_vs_group, outcome / m AS outcome_over_group FROM sample JOIN g USING (c_mktsegment)", "outcome_group_mean outcome_group_std outcome_vs_group outcome_over_group")
def _(spark, d):
    return features.group_statistics(sample(spark, d), ["c_mktsegment"], ["outcome"]).select("id", "outcome_group_mean", "outcome_group_std", "outcome_vs_group", "outcome_over_group")


@query("i1_source_text", "SELECT page_id, substr(trim(concat_ws(' ', coalesce(url, ''), CAST(page_id AS VARCHAR))), 1, 30) AS source FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", text.source_text(["url", "page_id"], 30).alias("source"))


@query("i2_hash_encode")
def _(spark, d):
    return text.hash_encode(read(spark, d, "pages").select("page_id", "url"), "url", 32).select("page_id", F.posexplode("vector").alias("place", "value"))


@query("i3_encode_distinct", f"WITH {TOKENS} SELECT user_id, day, length(seq) AS size FROM tokens", "size")
def _(spark, d):
    made = text.encode_distinct(tokens(spark, d), "seq", lambda s: s.str.len().to_numpy().reshape(-1, 1).astype("float32"))
    return made.select("user_id", "day", F.col("vector")[0].cast("double").alias("size"))


_IDF = "x AS (SELECT DISTINCT user_id, day, unnest(string_split(seq, ',')) AS item FROM tokens), w AS (SELECT item, count(*) AS df, ln((1 + (SELECT count(*) FROM tokens)) / (1 + count(*))) + 1 AS idf FROM x GROUP BY 1)"


@query("i4_item_weights", f"WITH {TOKENS}, {_IDF} SELECT * FROM w", "idf")
def _(spark, d):
    return text.item_weights(tokens(spark, d), "seq")


@query("i4_list_aggregate", f"WITH {TOKENS}, {_IDF}, i AS (SELECT CAST(user_id AS VARCHAR) || '|' || CAST(day AS VARCHAR) AS key, unnest(string_split(seq, ',')) AS item FROM tokens) SELECT key, avg(length(item)) AS mean, sum(length(item)) AS total, sum(length(item) * idf) / sum(idf) AS weighted FROM i JOIN w USING (item) GROUP BY 1", "mean total weighted")
def _(spark, d):
    rows = tokens(spark, d).withColumn("key", F.concat_ws("|", "user_id", "day"))
    values = rows.select(F.explode(F.split("seq", ",")).alias("item")).distinct().withColumn("value", F.length("item").cast("double"))
    return text.list_aggregate(rows, "key", "seq", values)


@query("i5_chunk_pool", "SELECT page_id, greatest(ceil(length(coalesce(url, '')) / 16), 1) AS chunks, length(coalesce(url, '')) / greatest(ceil(length(coalesce(url, '')) / 16), 1) AS mean_size FROM pages", "mean_size", "chunks")
def _(spark, d):
    made = text.chunk_pool(read(spark, d, "pages").select("page_id", "url"), "page_id", "url", 16, lambda s: s.str.len().to_numpy().reshape(-1, 1).astype("float32"), 1)
    return made.select("page_id", "chunks", F.col("vector")[0].alias("mean_size"))


@query("i10_quantile_bin_feature", f"{S}, e AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(outcome, [0, 0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1]), lambda x: round(x, 9)))) AS e FROM sample WHERE split = 'train') SELECT id, len(list_filter(list_slice(e, 2, len(e) - 1), lambda x: x <= outcome)) + 1 AS score_bin FROM sample, e")
def _(spark, d):
    rows = sample(spark, d)
    return features.quantile_bin_feature(rows.filter("split = 'train'"), rows, "outcome").select("id", "score_bin")


@query("i11_text_presence", "SELECT page_id, CAST(length(trim(coalesce(url, ''))) > 0 AS BIGINT) AS url_present, CASE WHEN length(trim(coalesce(url, ''))) > 0 THEN length(url) END AS masked FROM pages")
def _(spark, d):
    rows = text.text_presence(read(spark, d, "pages").select("page_id", "url"), ["url"]).withColumn("n", F.length("url"))
    return rows.select("page_id", "url_present", text.masked_score("n", "url_present").alias("masked"))


@query("i12_feature_metrics_by_split", f"""{L}, a AS ({auc_sql('long', 'split, feature', 'value')}), g AS (SELECT split, feature, value AS s, sum(label) AS p, sum(1 - label) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3),
    w AS (SELECT *, sum(p) OVER o AS cp, sum(n) OVER o AS cn FROM g WINDOW o AS (PARTITION BY split, feature ORDER BY s DESC)), r AS (SELECT split, feature, sum(p * cp / (cp + cn)) / nullif(sum(p), 0) AS pr_auc FROM w GROUP BY 1, 2) SELECT split, feature, a AS auc, pr_auc FROM a JOIN r USING (split, feature)""", "auc pr_auc")
def _(spark, d):
    return text.feature_metrics_by_split(long_sample(spark, d), "label")


@query("i12_conditional_auc", f"{S}, r AS (SELECT *, CAST(floor(i * 10 / n) AS BIGINT) AS decile FROM (SELECT *, row_number() OVER (ORDER BY score, id) - 1 AS i, count(*) OVER () AS n FROM sample)), a AS ({auc_sql('r', 'decile', 'c_acctbal')}), c AS (SELECT decile, count(*) AS \"rows\" FROM r GROUP BY 1) SELECT decile, \"rows\", a AS auc FROM c JOIN a USING (decile)", "auc")
def _(spark, d):
    return text.conditional_auc(sample(spark, d), "c_acctbal", "score", "label", "id")


@query("i12_spearman", f"{S}, r AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS a, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS b FROM sample) SELECT corr(a, b) AS spearman FROM r", "spearman")
def _(spark, d):
    return text.spearman(sample(spark, d), "score", "c_acctbal")
