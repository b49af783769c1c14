"""Queries of sources, typing, contracts, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.primitives import melt, written
from plumbline.operators import splits, typing
from plumbline.sources import tables

from .registry import query
from .views import RANGES, SAMPLE, read, sample

S = f"WITH {SAMPLE}"
_DAY = "SELECT o_custkey, strftime(o_orderdate, '%Y%m%d') AS dt, sum(o_totalprice) AS day_total, count(*) AS day_orders FROM orders GROUP BY 1, 2"


def _day_features(spark, d):
    orders = read(spark, d, "orders").withColumn("dt", F.date_format("o_orderdate", "yyyyMMdd"))
    return orders.groupBy("o_custkey", "dt").agg(F.sum("o_totalprice").alias("day_total"), F.count("*").alias("day_orders"))


@query("a1_read_sample", "SELECT count(*) AS n_rows, sum(o_totalprice) AS total, count(DISTINCT o_custkey) AS customers FROM orders", "total")
def _(spark, d):
    return tables.read_sample(spark, f"{d}/orders.parquet").agg(F.count("*").alias("n_rows"), F.sum("o_totalprice").alias("total"), F.count_distinct("o_custkey").alias("customers"))


@query("a2_read_shards", "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1", "quantity")
def _(spark, d):
    rows = read(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,2)"))
    halves = [written(rows.filter(F.col("l_orderkey") % 2 == k), "shard") for k in (0, 1)] + [written(rows.limit(0), "shard")]
    paths = [f.rsplit("/", 1)[0] for h in halves for f in h.inputFiles()[:1]]
    return tables.read_shards(spark, paths).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("a3_fetch_wide", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-12-31' AND o_totalprice > 1000", "o_totalprice", "label")
def _(spark, d):
    return tables.fetch_wide(read(spark, d, "orders"), "o_orderdate", "1996-01-01", "1996-12-31", "CAST(o_orderstatus = 'F' AS INT)", ["o_orderkey", "o_custkey"], ["o_totalprice", "o_custkey"], "o_totalprice > 1000")


@query("a4_fetch_sample_features", f"{S}, f AS ({_DAY}) SELECT s.id, s.o_custkey, s.pday AS dt, s.label, f.day_total, f.day_orders FROM sample s LEFT JOIN f ON f.o_custkey = s.o_custkey AND f.dt = s.pday WHERE s.pday BETWEEN '19960101' AND '19991231'", "day_total", "label")
def _(spark, d):
    base = sample(spark, d).select("id", "o_custkey", F.col("pday").alias("dt"), "label")
    return tables.fetch_sample_features(base, _day_features(spark, d), ["o_custkey", "dt"], "dt", "19960101", "19991231")


@query("a5_fetch_lagged_features", f"{S}, f AS ({_DAY}) SELECT s.id, s.o_custkey, s.pday AS dt, s.label, f.day_total, f.day_orders FROM sample s LEFT JOIN f ON f.o_custkey = s.o_custkey AND f.dt = strftime(s.dt - INTERVAL 1 DAY, '%Y%m%d') WHERE s.pday BETWEEN '19960101' AND '19991231'", "day_total", "label")
def _(spark, d):
    base = sample(spark, d).select("id", "o_custkey", F.col("pday").alias("dt"), "label")
    return tables.fetch_sample_features(base, _day_features(spark, d), ["o_custkey", "dt"], "dt", "19960101", "19991231", lag_day=1)


@query("a6_derive_feature_list", "SELECT 'o_totalprice' AS feature, 0 AS position, 'kept' AS status, count(o_totalprice) AS n, count(DISTINCT o_totalprice) AS levels FROM orders UNION ALL SELECT 'o_missing', 1, 'missing', NULL, NULL UNION ALL SELECT 'o_orderstatus', 2, 'kept', count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders", longs="position")
def _(spark, d):
    """The list, with what each kept column holds."""
    orders = read(spark, d, "orders")
    listed = tables.derive_feature_list(orders, ["o_orderkey", "o_orderdate"], ["o_totalprice", "o_missing", "o_orderstatus"])
    kept = [r.feature for r in listed.filter("status = 'kept'").collect()]  # a row for each column
    held = melt(orders, kept, text=True).groupBy("feature", "value").agg(F.count("value").alias("c")).groupBy("feature").agg(F.sum("c").alias("n"), F.count("value").alias("levels"))
    return listed.join(F.broadcast(held), "feature", "left")


@query("a7_write_splits", f"{S} SELECT split, count(*) AS n, count(DISTINCT id) AS keys, sum(label) AS positives FROM sample GROUP BY 1", longs="positives")
def _(spark, d):
    rows = sample(spark, d).select("id", "dt", "label", "outcome", "c_mktsegment", "split")
    out = written(rows.limit(0), "planes").inputFiles()
    folder = out[0].rsplit("/", 1)[0] + "-planes"
    planes = tables.write_splits(rows, folder, "id", "dt", "label", ["c_mktsegment"])
    labels = tables.read_plane(spark, folder, "labels")
    return labels.join(spark.read.parquet(planes["features"]).drop("split"), "id").groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("id").alias("keys"), F.sum("label").alias("positives"))


@query("a8_assert_plane_clean", "SELECT o_orderkey, o_totalprice FROM orders", "o_totalprice")
def _(spark, d):
    return tables.assert_plane_clean(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderstatus"])


@query("a9_write_table", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    made = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    path = written(made.limit(0), "sink").inputFiles()[0].rsplit("/", 1)[0] + ".csv"
    tables.write_table(made, path)
    return tables.read_sample(spark, path).select("c_mktsegment", F.col("n").cast("long").alias("n"))


_TEXTS = "SELECT id, pday, CASE WHEN id % 50 = 0 THEN 'x' ELSE CAST(outcome AS VARCHAR) END AS most, CASE WHEN id % 3 = 0 THEN 'x' ELSE '7' END AS few FROM sample"


@query("b1_coerce_numeric", f"""{S}, t AS ({_TEXTS}), r AS (
    SELECT unnest(['pday', 'most', 'few']) AS feature, unnest([count(*), count(*), count(*)]) AS n_rows, unnest([count(pday), count(most), count(few)]) AS non_null,
           unnest([count(try_cast(pday AS DOUBLE)), count(try_cast(most AS DOUBLE)), count(try_cast(few AS DOUBLE))]) AS parsed FROM t)
    SELECT *, parsed >= 0.95 * non_null AS is_numeric FROM r""")
def _(spark, d):
    rows = sample(spark, d).select("id", "pday", F.when(F.col("id") % 50 == 0, "x").otherwise(F.col("outcome").cast("string")).alias("most"), F.when(F.col("id") % 3 == 0, "x").otherwise("7").alias("few"))
    return typing.coercible(rows, ["pday", "most", "few"]).withColumnsRenamed({"rows": "n_rows", "numeric": "is_numeric"})


@query("b2_normalize_date", f"{S} SELECT id, dt, dt AS iso, CASE WHEN id % 10 = 0 THEN NULL ELSE dt END AS odd FROM sample")
def _(spark, d):
    odd = F.when(F.col("id") % 10 == 0, "not a day").otherwise(F.date_format("dt", "yyyy-MM-dd"))
    return sample(spark, d).select("id", typing.normalize_date("pday").alias("dt"), typing.normalize_date(F.date_format("dt", "yyyy-MM-dd")).alias("iso"), typing.normalize_date(odd).alias("odd"))


@query("b3_month_label", f"{S} SELECT id, strftime(dt, '%Y-%m') AS compact, strftime(dt, '%Y-%m') AS first_day, CASE WHEN day(dt) = 1 THEN strftime(dt, '%Y-%m') END AS daily FROM sample")
def _(spark, d):
    m = typing.month_label
    return sample(spark, d).select("id", m(F.date_format("dt", "yyyyMM")).alias("compact"), m(F.trunc("dt", "month")).alias("first_day"), m("dt").alias("daily"))


@query("b4_validate_label", f"""{S}, c AS (SELECT count(*) AS n, count(*) FILTER (label IS NULL) AS nulls, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM sample)
    SELECT n AS "rows", nulls, positives, negatives, n - nulls - positives - negatives AS others, positives / (positives + negatives) AS rate, positives > 0 AND negatives > 0 AND n = nulls + positives + negatives AS ok,
           positives / (positives + negatives) < 0.001 OR positives / (positives + negatives) > 0.999 AS extreme FROM c""", "rate")
def _(spark, d):
    return typing.validate_label(sample(spark, d), "label")


@query("b5_validate_contract", f"""{S}, c AS (SELECT count(*) AS n, count(*) FILTER (label NOT IN (0, 1)) AS bad FROM sample)
    SELECT unnest(['missing_columns', 'rows', 'bad_labels', 'bad_dates', 'base_score_share']) AS "check", unnest([1.0, n, bad, 0, 1.0]) AS value, unnest([false, n > 0, bad = 0, true, true]) AS ok FROM c""", "value")
def _(spark, d):
    return typing.validate_contract(sample(spark, d), ["id", "dt", "nowhere"], "label", "pday", "score")


@query("b6_resolve_features", f"{S} SELECT 'outcome' AS feature, 0 AS position, count(outcome) AS n, avg(outcome) AS mean FROM sample UNION ALL SELECT 'c_acctbal', 1, count(c_acctbal), avg(c_acctbal) FROM sample UNION ALL SELECT 'sum_qty', 2, count(sum_qty), avg(sum_qty) FROM sample", "mean", longs="position")
def _(spark, d):
    """The resolved features, with what each holds."""
    rows = sample(spark, d).select("id", "dt", "label", "arm", "outcome", "c_acctbal", "sum_qty", "pday")
    names = typing.resolve_features(rows.columns, target="label", time="dt", ids=["id"], treatment="arm", unparsed=["pday"])
    listed = spark.createDataFrame([(f, k) for k, f in enumerate(names)], "feature string, position long")
    held = melt(rows, names).groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return listed.join(F.broadcast(held), "feature", "left")


@query("b7_apply_treatment_semantics", f"""{S}, m AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 0 WHEN '4-NOT SPECIFIED' THEN 0 END AS t, label AS y FROM sample)
    SELECT count(*) AS "rows", count(*) FILTER (t = 1) AS treated, count(*) FILTER (t = 0) AS control, count(*) FILTER (t IS NULL) AS unmapped_treatment, 0 AS unmapped_outcome,
           sum(y) FILTER (t = 1) AS treated_outcome, sum(y) FILTER (t = 0) AS control_outcome, count(*) FILTER (t IS NULL) > 0 AS blocked FROM m""", "treated_outcome control_outcome", "unmapped_outcome")
def _(spark, d):
    made = typing.apply_treatment_semantics(sample(spark, d), "o_orderpriority", "label", {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 0, "4-NOT SPECIFIED": 0}, {0: 0, 1: 1})
    return typing.treatment_evidence(made)


@query("b8_infer_covariate_types", f"""{S} SELECT unnest(['arm', 'c_acctbal', 'o_orderpriority', 'pday', 'label', 'const_f']) AS variable,
    unnest([count(DISTINCT arm), count(DISTINCT c_acctbal), count(DISTINCT o_orderpriority), count(DISTINCT pday), count(DISTINCT label), count(DISTINCT const_f)]) AS levels,
    unnest(['binary', 'numeric', 'categorical', 'skipped', 'leaky', 'binary']) AS kind FROM sample""")
def _(spark, d):
    return typing.infer_covariate_types(sample(spark, d), ["arm", "c_acctbal", "o_orderpriority", "pday", "label", "const_f"])


@query("b9_sample_key", """WITH r AS (SELECT event_type, user_id, substr(sha256(event_type || chr(31) || CAST(user_id AS VARCHAR)), 1, 24) AS k, substr(sha256(CAST(event_id AS VARCHAR)), 1, 24) AS rest, event_id FROM events)
    SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN k || '-' || rest ELSE k END AS sample_key FROM r""")
def _(spark, d):
    rows = read(spark, d, "events").select("event_id", "user_id", "event_type")
    return typing.sample_key(rows, "event_type", "user_id").select("event_id", "sample_key")


@query("b10_align_by_key", f"{S} SELECT id, score AS new_score, score_old AS old_score FROM sample", "new_score old_score")
def _(spark, d):
    rows = sample(spark, d)
    return typing.align_by_key(rows.select("id", "score"), rows.select("id", F.col("score_old").alias("score")), ["id"])


_COUNT = "SELECT split, count(*) AS n, sum(id) AS ids FROM x GROUP BY 1"
R3 = "CASE WHEN r < round_even(n * 0.6, 0) THEN 'train' WHEN r < round_even(n * 0.8, 0) THEN 'test' ELSE 'oot' END"


def _tally(df):
    return df.groupBy("split").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("c1_split_by_ranges", f"""{S} SELECT coalesce(CASE WHEN dt BETWEEN '1995-01-01' AND '1998-12-31' THEN 'train' WHEN dt BETWEEN '1999-01-01' AND '1999-12-31' THEN 'test' WHEN dt BETWEEN '2000-01-01' AND '2000-12-31' THEN 'oot' END, 'dropped') AS split, count(*) AS "rows" FROM sample GROUP BY 1""")
def _(spark, d):
    return splits.range_counts(sample(spark, d).drop("split"), "dt", [*RANGES[:2], ("oot", "2000-01-01", "2000-12-31")])


@query("c2_split_by_day_ratio", f"""{S}, b AS (SELECT dt, (sum(n) OVER (ORDER BY dt) - n) / sum(n) OVER () AS share FROM (SELECT dt, count(*) AS n FROM sample GROUP BY 1)),
    x AS (SELECT id, CASE WHEN share < 0.7 THEN 'train' WHEN share < 0.85 THEN 'test' ELSE 'oot' END AS split FROM sample JOIN b USING (dt)) {_COUNT}""", longs="ids")
def _(spark, d):
    return _tally(splits.split_by_day_ratio(sample(spark, d), "dt", [0.7, 0.15, 0.15]))


@query("c3_split_by_row_ratio", f"{S}, y AS (SELECT id, row_number() OVER (ORDER BY dt, id) - 1 AS r, count(*) OVER () AS n FROM sample), x AS (SELECT id, {R3} AS split FROM y) {_COUNT}", longs="ids")
def _(spark, d):
    return _tally(splits.split_by_row_ratio(sample(spark, d), "dt", [0.6, 0.2, 0.2], "id"))


@query("c4_split_by_distinct_time", f"""{S}, t AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT dt FROM sample)),
    c AS (SELECT *, CAST(floor(n * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT) AS cut FROM t),
    x AS (SELECT id, CASE WHEN i < floor(cut * (1 - CAST(0.1 AS DOUBLE))) THEN 'train' WHEN i < cut THEN 'val' ELSE 'oot' END AS split FROM (SELECT id, dt FROM sample) JOIN c USING (dt)) {_COUNT}""", longs="ids")
def _(spark, d):
    return _tally(splits.split_by_distinct_time(sample(spark, d), "dt", 0.2, 0.1))


_MD5 = "row_number() OVER (ORDER BY md5('7|' || CAST(id AS VARCHAR)), id) - 1 AS r, count(*) OVER () AS n"
_RANDOM = "CASE WHEN r < n - CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) - CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) THEN 'train' WHEN r < n - CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT) THEN 'valid' ELSE 'test' END"


@query("c5_split_random", f"{S}, y AS (SELECT id, {_MD5} FROM sample), x AS (SELECT id, {_RANDOM} AS split FROM y) {_COUNT}", longs="ids")
def _(spark, d):
    return _tally(splits.split_random(sample(spark, d), {"train": 0.7, "valid": 0.2, "test": 0.1}, "id", 7))


@query("c6_split_by_group", f"""{S}, g AS (SELECT o_custkey, row_number() OVER (ORDER BY md5('7|' || CAST(o_custkey AS VARCHAR)), o_custkey) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM sample)),
    x AS (SELECT id, CASE WHEN r < floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' WHEN r < floor(n * CAST(0.8 AS DOUBLE)) THEN 'test' ELSE 'oot' END AS split FROM (SELECT id, o_custkey FROM sample) JOIN g USING (o_custkey)) {_COUNT}""", longs="ids")
def _(spark, d):
    return _tally(splits.split_by_group(sample(spark, d), "o_custkey", [0.6, 0.2, 0.2], 7))


@query("c7_split_stratified", f"{S}, y AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || CAST(id AS VARCHAR)), id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM sample), x AS (SELECT id, {R3} AS split FROM y) {_COUNT}", longs="ids")
def _(spark, d):
    return _tally(splits.split_stratified(sample(spark, d), "label", [0.6, 0.2, 0.2], "id", 7))


@query("c8_split_by_windows", f"""{S}, x AS (SELECT id, CASE WHEN dt BETWEEN '1996-01-01' AND '1998-12-31' THEN 'train' WHEN dt BETWEEN '1998-06-01' AND '1999-06-30' THEN 'validation' WHEN strftime(dt, '%Y-%m') = '1999-07' THEN 'shadow_test'
    WHEN dt BETWEEN '2000-01-05' AND '2001-12-31' THEN 'final_test' ELSE 'train' END AS split FROM sample) {_COUNT}""", longs="ids")
def _(spark, d):
    windows = {"train": ["1996-01~1998-12"], "validation": ["1998-06~1999-06"], "shadow_test": ["1999-07"], "final_test": ["2000-01-05~2001-12-31"]}
    return _tally(splits.split_by_windows(sample(spark, d), "dt", windows))


@query("c9_split_oot_then_random", f"""{S}, i AS (SELECT id, dt >= '2000-01-01' AND dt < '2001-01-01' AS o FROM sample), y AS (SELECT id, {_MD5} FROM i WHERE NOT o),
    x AS (SELECT id, {_RANDOM} AS split FROM y UNION ALL SELECT id, 'oot' FROM i WHERE o) {_COUNT}""", longs="ids")
def _(spark, d):
    return _tally(splits.split_oot_then_random(sample(spark, d), "dt", ("2000-01-01", "2001-01-01"), {"train": 0.7, "valid": 0.2, "test": 0.1}, "id", 7))


@query("c10_split_by_filters", f"{S}, x AS (SELECT id, CASE WHEN dt < '1999-01-01' THEN 'train' ELSE 'test' END AS split FROM sample) {_COUNT}", longs="ids")
def _(spark, d):
    return _tally(splits.split_by_filters(sample(spark, d), "dt < '1999-01-01'", None))


@query("c10_filter_audit", f"""{S}, x AS (SELECT dt < '1999-01-01' AS a, dt BETWEEN '1998-12-01' AND '1999-12-31' AS b, dt >= '2000-06-01' AS c FROM sample)
    SELECT count(*) AS "rows", count(*) FILTER (a AND b) AS train_test, count(*) FILTER (a AND c) AS train_oot, count(*) FILTER (b AND c) AS test_oot, avg(CAST(a OR b OR c AS INT)) AS coverage, avg(CAST(a OR b OR c AS INT)) < 0.95 AS low_coverage FROM x""", "coverage")
def _(spark, d):
    return splits.filter_audit(sample(spark, d), "dt < '1999-01-01'", "dt BETWEEN '1998-12-01' AND '1999-12-31'", "dt >= '2000-06-01'")


@query("c11_validate_splits", f"""{S}, c AS (SELECT split, count(*) AS n, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM sample GROUP BY 1)
    SELECT split, n AS "rows", positives, negatives, n >= 10 AND positives > 0 AND negatives > 0 AS ok, CASE WHEN n < 100 THEN 'under 100 rows' WHEN split = 'train' AND n < 10000 THEN 'under 10000 train rows' END AS warning FROM c""")
def _(spark, d):
    return splits.validate_splits(sample(spark, d), "label")


@query("c12_split_summary", f"""{S}, c AS (SELECT split, count(*) AS n, sum(label) AS positives, avg(label) AS rate, CAST(min(dt) AS VARCHAR) AS first_day, CAST(max(dt) AS VARCHAR) AS last_day FROM sample GROUP BY 1)
    SELECT split, n AS "rows", positives, rate, first_day, last_day, n / sum(n) OVER () AS share, (max(rate) OVER () - min(rate) OVER ()) * 100 AS rate_gap FROM c""", "rate share rate_gap", "positives")
def _(spark, d):
    return splits.split_summary(sample(spark, d), "label", "dt")


@query("c13_prefix_label_check", f"""{S}, x AS (SELECT label, row_number() OVER (ORDER BY dt, md5(CAST(dt AS VARCHAR) || '|' || CAST(id AS VARCHAR)), id) - 1 AS r, count(*) OVER () AS n FROM sample)
    SELECT count(*) FILTER (r < floor(n * 0.125)) AS prefix_rows, avg(label) FILTER (r < floor(n * 0.125)) AS prefix_rate, avg(label) AS rate FROM x""", "prefix_rate rate")
def _(spark, d):
    return splits.prefix_label_check(sample(spark, d), "dt", "id", "label")


@query("c14_systematic_sample", f"""{S}, c AS (SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY dt, id) - 1 AS r, count(*) OVER (PARTITION BY split) AS n, count(*) OVER () AS t FROM sample),
    m AS (SELECT *, CASE WHEN t <= 2000 THEN n ELSE least(n, CAST(round_even(n * 2000 / CAST(t AS DOUBLE), 0) AS BIGINT)) END AS m FROM c),
    i AS (SELECT *, CAST(floor(r * m / CAST(n AS DOUBLE)) AS BIGINT) AS i FROM m), j AS (SELECT *, CAST(ceil(i * n / CAST(m AS DOUBLE)) AS BIGINT) AS a, CAST(ceil((i + 1) * n / CAST(m AS DOUBLE)) AS BIGINT) AS b FROM i)
    SELECT id, split FROM j WHERE r = a + ('0x' || substr(md5('7|' || split || '|' || CAST(i AS VARCHAR)), 1, 8))::BIGINT % (b - a)""")
def _(spark, d):
    return splits.systematic_sample(sample(spark, d), 2000, ["dt", "id"], 7).select("id", "split")


@query("c15_seeded_subsamples", f"{S}, x AS (SELECT id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS VARCHAR) || '|' || CAST(id AS VARCHAR)), id) AS r FROM sample, (SELECT unnest([1, 2, 3]) AS seed)) SELECT id, seed FROM x WHERE r <= 500", longs="seed")
def _(spark, d):
    return splits.seeded_subsamples(sample(spark, d).select("id"), 500, [1, 2, 3], "id")


@query("c16_time_segments", f"""{S}, b AS (SELECT dt, (sum(n) OVER (ORDER BY dt) - n) / sum(n) OVER () AS share FROM (SELECT dt, count(*) AS n FROM sample GROUP BY 1))
    SELECT CASE WHEN share < 0.8 THEN 'fit' WHEN share < 0.85 THEN 'early_stop' ELSE 'holdout' END AS segment, count(*) AS n, sum(id) AS ids FROM sample JOIN b USING (dt) GROUP BY 1""", longs="ids")
def _(spark, d):
    return splits.time_segments(sample(spark, d), "dt").groupBy("segment").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("c17_kfold", f"{S} SELECT id, ('0x' || substr(md5('7|' || CAST(id AS VARCHAR)), 1, 8))::BIGINT % 5 AS fold FROM sample", longs="fold")
def _(spark, d):
    return splits.kfold(sample(spark, d), 5, "id", 7).select("id", "fold")


@query("c18_balanced_cases", f"{S}, x AS (SELECT id, label, outcome, row_number() OVER (PARTITION BY label ORDER BY md5('7|' || CAST(id AS VARCHAR)), id) AS r FROM sample) SELECT id, label, round(outcome, 4) AS outcome FROM x WHERE r <= 100", "outcome", "label")
def _(spark, d):
    return splits.balanced_cases(sample(spark, d).select("id", "label", "outcome"), "label", 200, "id", 7)
