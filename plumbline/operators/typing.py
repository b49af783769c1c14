"""Types, dates, labels, contracts and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, rows, non_null, parsed: how many values of each string column read as numbers, in one pass."""
    counts = [F.struct(F.lit(c).alias("feature"), F.count("*").alias("rows"), F.count(c).alias("non_null"), F.count(F.expr(f"try_cast(`{c}` AS double)")).alias("parsed")) for c in cols]
    return df.agg(F.explode(F.array(*counts)).alias("r")).select("r.*") if cols else df.sparkSession.createDataFrame([], "feature string, rows long, non_null long, parsed long")


def coercible(df: DataFrame, cols: Sequence[str], min_ratio: float = 0.95, min_coverage: float = 0.0) -> DataFrame:
    """parse_rates with numeric: enough of the non-null values parse, and enough of all rows."""
    rates = parse_rates(df, cols)
    enough = (F.col("non_null") > 0) & (F.col("parsed") >= min_ratio * F.col("non_null")) & (F.col("parsed") >= min_coverage * F.col("rows"))
    return rates.withColumn("numeric", enough)


def coerce_numeric(df: DataFrame, cols: Sequence[str], min_ratio: float = 0.95, min_coverage: float = 0.0) -> DataFrame:
    """df with those columns as double that are numeric by coercible; other values of them become null."""
    chosen = {r.feature for r in coercible(df, cols, min_ratio, min_coverage).filter("numeric").collect()}  # a row for each column
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in chosen}) if chosen else df


def normalize_date(c: Column | str) -> Column:
    """Eight digits as yyyyMMdd first, else a general date; null if neither."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    eight = F.when(s.rlike(r"^[0-9]{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")))
    return F.coalesce(eight, F.try_to_timestamp(s)).cast("date")


def month_label(c: Column | str) -> Column:
    """yyyy-MM from yyyy-MM, yyyyMM or a first-of-month date; null for others, daily dates too."""
    s = (F.col(c) if isinstance(c, str) else c).cast("string")
    dashed = F.when(s.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])(-01)?$"), F.substring(s, 1, 7))
    return F.coalesce(dashed, F.when(s.rlike(r"^[0-9]{4}(0[1-9]|1[0-2])$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2))))


def validate_label(df: DataFrame, label: str) -> DataFrame:
    """One row of checks: rows, nulls, positives, others (neither 0 nor 1), rate, ok, extreme."""
    y = F.col(label)
    t = df.agg(F.count("*").alias("rows"), F.count_if(y.isNull()).alias("nulls"), F.count_if(y == 1).alias("positives"), F.count_if(y == 0).alias("negatives"))
    t = t.withColumn("others", F.col("rows") - F.col("nulls") - F.col("positives") - F.col("negatives"))
    t = t.withColumn("rate", F.expr("try_divide(positives, positives + negatives)"))
    return t.withColumn("ok", (F.col("others") == 0) & (F.col("positives") > 0) & (F.col("negatives") > 0)).withColumn("extreme", (F.col("rate") < 0.001) | (F.col("rate") > 0.999))


def validate_contract(df: DataFrame, required: Sequence[str], label: str, date: str, base_score: str | None = None) -> DataFrame:
    """check, value, ok: required columns, rows, labels outside 0/1, unparsed dates, share of numeric base scores."""
    missing = [c for c in required if c not in df.columns]
    y, d = F.col(label), F.col(date)
    checks = {
        "missing_columns": (F.lit(float(len(missing))), lambda v: v == 0),
        "rows": (F.count("*").cast("double"), lambda v: v > 0),
        "bad_labels": (F.count_if(y.isNull() | ~y.isin(0, 1)).cast("double"), lambda v: v == 0),
        "bad_dates": (F.count_if(normalize_date(d).isNull()).cast("double"), lambda v: v == 0),
    }
    if base_score:
        s = F.expr(f"try_cast(`{base_score}` AS double)")
        checks["base_score_share"] = (F.coalesce(F.count(s) / F.nullif(F.count(base_score), F.lit(0)), F.lit(0.0)), lambda v: v >= 0.95)
    row = df.agg(*[v.alias(k) for k, (v, _) in checks.items()])
    out = F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("value"), ok(F.col(k)).alias("ok")) for k, (_, ok) in checks.items()])
    return row.select(F.explode(out).alias("r")).select("r.*")


def resolve_features(columns: Sequence[str], *, target: str, time: str | None = None, ids: Sequence[str] = (), treatment: str | None = None, banned: Sequence[str] = (), unparsed: Sequence[str] = (), white_list: Sequence[str] | None = None) -> list[str]:
    """Candidate features by name; a white list must exist and may not name banned columns."""
    out = {target, time, treatment, *ids, *banned, *unparsed} - {None}
    if white_list is not None:
        if lost := [c for c in white_list if c not in columns]:
            raise ValueError(f"not in the table: {lost}")
        if clash := [c for c in white_list if c in out]:
            raise ValueError(f"listed and excluded: {clash}")
        return list(white_list)
    return [c for c in columns if c not in out]


def mapped(c: Column | str, values: dict) -> Column:
    """values[c]; null for what is not a key."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(None).cast("int")
    for raw, made in values.items():
        out = F.when(c == F.lit(raw), F.lit(made)).otherwise(out)
    return out


def apply_treatment_semantics(df: DataFrame, treatment: str, outcome: str, treatment_map: dict, outcome_map: dict | None = None) -> DataFrame:
    """df with __treatment and __outcome: raw values as 0/1, a numeric outcome as it is without a map."""
    y = mapped(outcome, outcome_map) if outcome_map else F.col(outcome).cast("double")
    return df.withColumns({"__treatment": mapped(treatment, treatment_map), "__outcome": y})


def treatment_evidence(df: DataFrame) -> DataFrame:
    """One row: rows by arm, unmapped rows, positives or sum of the outcome by arm, blocked."""
    t, y = F.col("__treatment"), F.col("__outcome")
    out = df.agg(
        F.count("*").alias("rows"), F.count_if(t == 1).alias("treated"), F.count_if(t == 0).alias("control"), F.count_if(t.isNull()).alias("unmapped_treatment"),
        F.count_if(y.isNull()).alias("unmapped_outcome"), F.sum(F.when(t == 1, y)).cast("double").alias("treated_outcome"), F.sum(F.when(t == 0, y)).cast("double").alias("control_outcome"),
    )
    return out.withColumn("blocked", F.expr("unmapped_treatment > 0 OR unmapped_outcome > 0 OR treated = 0 OR control = 0"))


#: Parts of names that give the target or the arm away.
LEAKY_WORDS = ("label", "target", "outcome", "treat", "response", "conversion", "uplift")


def infer_covariate_types(df: DataFrame, cols: Sequence[str], max_levels: int = 10) -> DataFrame:
    """variable, levels, kind: binary up to two values, numeric, categorical, skipped above max_levels, leaky by name."""
    kinds = dict(df.dtypes)
    row = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in cols])
    out = []
    for c in cols:
        number = kinds[c] not in ("string", "boolean", "date", "timestamp")
        rest = F.lit("numeric") if number else F.when(F.col(c) > max_levels, "skipped").otherwise("categorical")
        kind = F.lit("leaky") if any(w in c.lower() for w in LEAKY_WORDS) else F.when(F.col(c) <= 2, "binary").otherwise(rest)
        out.append(F.struct(F.lit(c).alias("variable"), F.col(c).alias("levels"), kind.alias("kind")))
    return row.select(F.explode(F.array(*out)).alias("r")).select("r.*")


def sample_key(df: DataFrame, time: str, id_: str, label: str | None = None) -> DataFrame:
    """df with sample_key: 24 hex digits of SHA-256 over time and id; repeated keys get a hash of the other columns but the label, then an occurrence number."""
    text = lambda cols: F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    short = lambda c: F.substring(F.sha2(c, 256), 1, 24)
    rest = [c for c in df.columns if c not in {time, id_, label}]
    rows = df.withColumns({"__key": short(text([time, id_])), "__rest": short(text(rest))})
    repeated = rows.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1").select("__key", F.lit(True).alias("__twice"))
    rows = rows.join(repeated, "__key", "left")
    again = rows.filter("__twice").groupBy("__key", "__rest").agg(F.count("*").alias("__m")).filter("__m > 1").select("__key", "__rest", F.lit(True).alias("__thrice"))
    rows = rows.join(again, ["__key", "__rest"], "left")
    # occurrence numbers only among rows that are equal but for the label; others need no window
    nth = F.row_number().over(Window.partitionBy("__key", "__rest").orderBy(label if label else F.lit(1)))
    equal = rows.filter("__thrice").withColumn("__nth", nth)
    rows = rows.filter("__thrice IS NULL").withColumn("__nth", F.lit(None).cast("int")).unionByName(equal)
    key = F.concat_ws("-", "__key", F.when(F.col("__twice"), F.col("__rest")), F.col("__nth").cast("string"))
    return rows.select(*df.columns, key.alias("sample_key"))


def align_by_key(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and the columns of both sides (new_*, old_*), one to one; an error if a key repeats or is missing on a side."""
    keys = list(keys)
    left = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new.columns if c not in keys])
    right = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys])
    faults = alignment_faults(new, old, keys).first()
    if any(faults):
        raise ValueError(f"sides can't be aligned: {faults.asDict()}")
    return left.join(right, keys)


def alignment_faults(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys that repeat on a side, and keys that only one side has."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(new, "n").join(count(old, "o"), list(keys), "full")
    c = F.count_if
    return both.agg(c(F.col("n") > 1).alias("repeated_new"), c(F.col("o") > 1).alias("repeated_old"), c(F.col("o").isNull()).alias("only_new"), c(F.col("n").isNull()).alias("only_old"))
