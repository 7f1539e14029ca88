"""Gates that features pass before they are clustered, and what outliers of a feature mean.

Statistics come as rows of one aggregation; every rule is a column over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import FEATURES
from .profile import numeric_columns, stacked

# Names of gates, decisions and statuses.
GATES = ("Interpretability", "DataQuality", "Leakage", "ZeroVariance", "Redundancy", "Stability", "ShapiroWilk")
DIAGNOSTIC = "DIAGNOSTIC_ONLY"
ELIGIBILITY = {
    "RETAIN_CANDIDATE": "ELIGIBLE",
    "PENDING_REVIEW": "ELIGIBLE_WORKING_ASSUMPTION",
    "EXCLUDE": "EXCLUDED",
    "ADJUST": "PENDING_HUMAN",
    "UNSUPPORTED": "EXCLUDED",
}


def known_features(spark, names: Sequence[str], descriptions: Mapping[str, str] | None = None) -> DataFrame:
    """feature, description and whether it is one of the features with a plain meaning."""
    rows = [(c, (descriptions or {}).get(c, ""), c in FEATURES) for c in names]
    return spark.createDataFrame(rows, "feature string, description string, is_interpretable boolean")


def feature_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n, n_missing, missing_ratio, variance (0 of fewer than two values) and whether
    it varies at all."""
    made = {
        "n": lambda c: F.count(F.lit(1)),
        "n_missing": lambda c: F.count_if(F.col(c).isNull()),
        "missing_ratio": lambda c: F.coalesce(F.avg(F.col(c).isNull().cast("double")), F.lit(0.0)),
        "variance": lambda c: F.coalesce(F.nanvl(F.var_samp(F.col(c).cast("double")), F.lit(0.0)), F.lit(0.0)),
        "varies": lambda c: F.coalesce(F.min(c) != F.max(c), F.lit(False)),
    }
    return stacked(df, columns, made, "feature")


def data_quality(missing_ratio: Column, most: float = 0.5) -> Column:
    return F.when(missing_ratio <= most, "PASS").when(missing_ratio < 0.9, "WARNING").otherwise("FAIL")


def gate_results(statistics: DataFrame, spark_names: DataFrame, leaking: Sequence[str] = (), most_missing: float = 0.5) -> DataFrame:
    """A row a feature with the status of every gate: the first four decide, the others are
    diagnostic whatever they say."""
    rows = statistics.join(F.broadcast(spark_names), "feature")
    return rows.select(
        "feature",
        F.when(F.col("is_interpretable"), "PASS").otherwise("WARNING").alias("Interpretability"),
        data_quality(F.col("missing_ratio"), most_missing).alias("DataQuality"),
        F.when(F.col("feature").isin(list(leaking)), "FAIL").otherwise("PASS").alias("Leakage"),
        F.when(F.col("varies"), "PASS").otherwise("FAIL").alias("ZeroVariance"),
        *(F.lit(DIAGNOSTIC).alias(g) for g in GATES[4:]),
    )


def selection_report(gates: DataFrame, pairs: DataFrame | None = None, unsupported: Sequence[str] = (), threshold: float = 0.95) -> DataFrame:
    """Decision, status of the gates and strongest correlation of each feature; features that
    were never made are UNSUPPORTED rows at the end. pairs has feature_a, feature_b and corr."""
    spark = gates.sparkSession
    if pairs is None:
        pairs = spark.createDataFrame([], "feature_a string, feature_b string, corr double")
    ends = pairs.select(F.explode(F.array("feature_a", "feature_b")).alias("feature"), F.abs("corr").alias("c"))
    top = ends.groupBy("feature").agg(F.max("c").alias("MaxCorrelation"))
    statuses = F.array(*(F.col(g) for g in GATES))
    strong = F.array_contains(statuses, DIAGNOSTIC) & (F.coalesce("MaxCorrelation", F.lit(0.0)) >= threshold)
    decision = (
        F.when(F.array_contains(statuses, "FAIL"), "EXCLUDE").when(F.array_contains(statuses, "WARNING") | strong, "PENDING_REVIEW").otherwise("RETAIN_CANDIDATE")
    )
    found = gates.join(F.broadcast(top), "feature", "left").withColumn("Decision", decision)
    made = found.select(F.col("feature").alias("Feature"), "Decision", *(F.col(g).alias(f"GateStatus_{g}") for g in GATES), "MaxCorrelation")
    more = spark.createDataFrame([(f, "UNSUPPORTED") for f in unsupported], "Feature string, Decision string")
    return made.unionByName(more.withColumns({f"GateStatus_{g}": F.lit("N/A") for g in GATES} | {"MaxCorrelation": F.lit(None).cast("double")}))


def eligibility_status(decision: Column) -> Column:
    """What a selection decision makes of a feature; no or an unknown decision leaves it
    eligible as a working assumption."""
    out = F.lit("ELIGIBLE_WORKING_ASSUMPTION")
    for name, status in ELIGIBILITY.items():
        out = F.when(decision == name, status).otherwise(out)
    return out


def eligibility(df: DataFrame, decisions: DataFrame, candidates: Sequence[str] = FEATURES, key: str = "CustomerID", most_missing: float = 0.5) -> DataFrame:
    """feature, decision, status, reason, variance and missing_ratio of each column of df.

    decisions has Feature and Decision, as selection_report makes them. The key is metadata; a
    column that is no candidate, was decided against, isn't numeric, doesn't vary or has too
    many missing values is excluded, for the first of these reasons that holds."""
    spark = df.sparkSession
    numeric = [c for c in numeric_columns(df, leave=(key,)) if c in candidates]
    kinds = spark.createDataFrame([(c, c == key, c in candidates, c in numeric, i) for i, c in enumerate(df.columns)], "feature string, is_key boolean, is_candidate boolean, is_numeric boolean, place int")
    own = decisions.select(F.col("Feature").alias("feature"), F.col("Decision").alias("decision"))
    rows = kinds.join(F.broadcast(own), "feature", "left")
    if numeric:
        rows = rows.join(F.broadcast(feature_statistics(df, numeric).select("feature", "variance", "missing_ratio")), "feature", "left")
    else:
        rows = rows.withColumns({"variance": F.lit(None).cast("double"), "missing_ratio": F.lit(None).cast("double")})
    status = eligibility_status(F.col("decision"))
    reasons = (
        (F.col("is_key"), "METADATA_ONLY", "identifier"),
        (~F.col("is_candidate"), "EXCLUDED", "no candidate"),
        (status == "EXCLUDED", "EXCLUDED", "decision"),
        (status == "PENDING_HUMAN", "PENDING_HUMAN", "decision"),
        (~F.col("is_numeric"), "EXCLUDED", "not numeric"),
        (F.coalesce("variance", F.lit(0.0)) == 0, "EXCLUDED", "zero variance"),
        (F.col("missing_ratio") > most_missing, "EXCLUDED", "missing ratio"),
    )
    made, why = status, F.lit("passed")
    for condition, value, reason in reversed(reasons):
        made, why = F.when(condition, value).otherwise(made), F.when(condition, reason).otherwise(why)
    return rows.select("feature", "decision", made.alias("status"), why.alias("reason"), "variance", "missing_ratio")


#: Skewness above which a distribution has a long tail, and a unit price that is large.
LONG_TAIL, LARGE_PRICE = 2.0, 1000.0


def interpretations(profiles: DataFrame, filter_mode: str = "all_rows") -> DataFrame:
    """feature, verdict, recommendation, status and evidence (codes) for each profiled feature.

    profiles has feature, skewness, min, max, negatives, candidates and rate. Extremes are
    never called errors on their own: the verdict is AMBIGUOUS where there are candidates and
    INSUFFICIENT_EVIDENCE where there are none or the feature has no rule; only a unit price
    that isn't positive is a DATA_ERROR, which belongs to cleaning."""
    name = F.col("feature")
    ruled = name.isin("Quantity", "UnitPrice", "LineRevenue")
    whole = F.lit(filter_mode == "all_rows")
    error = (name == "UnitPrice") & (F.col("min") <= 0)
    evidence = F.array_compact(F.array(
        F.when(error, "NOT_POSITIVE"),
        F.when(~error & (name == "Quantity") & F.lit(filter_mode == "clean_purchase"), "PURCHASES_ONLY"),
        F.when(~error & (name == "Quantity") & whole, "CANCELLATIONS_INCLUDED"),
        F.when(~error & name.isin("Quantity", "LineRevenue") & whole & (F.col("negatives") > 0), "NEGATIVE_VALUES"),
        F.when(~error & ruled & (F.col("skewness") > LONG_TAIL), "LONG_TAIL"),
        F.when(~error & (name == "UnitPrice") & (F.col("max") > LARGE_PRICE), "LARGE_MAXIMUM"),
        F.when(~ruled, "NO_RULE"),
    ))
    verdict = F.when(error, "DATA_ERROR").when(ruled & (F.col("candidates") > 0), "AMBIGUOUS").otherwise("INSUFFICIENT_EVIDENCE")
    counted = ~error & (~ruled | (name == "Quantity") | (F.col("candidates") > 0))
    return profiles.select(
        "feature",
        verdict.alias("verdict"),
        F.lit("KEEP").alias("recommendation"),
        F.when(error, "WORKING_ASSUMPTION").otherwise("PENDING_MENTOR_REVIEW").alias("status"),
        F.when(error, "all_rows").otherwise(filter_mode).alias("filter_mode"),
        F.array_join(evidence, ",").alias("evidence"),
        F.when(error, 0).otherwise(F.col("candidates")).alias("candidates"),
        F.when(counted, F.col("rate")).otherwise(0.0).alias("rate"),
    )


def top_candidates(df: DataFrame, mask: Column, columns: Sequence[str] = ("Quantity", "UnitPrice", "LineRevenue"), n: int = 10) -> DataFrame:
    """The n flagged rows with the greatest absolute value in any of the columns, ties by the
    columns' values."""
    own = [c for c in columns if c in df.columns]
    if not own:
        raise ValueError("none of the columns is there")
    size = F.greatest(*(F.abs(F.col(c).cast("double")) for c in own)) if len(own) > 1 else F.abs(F.col(own[0]).cast("double"))
    return df.where(mask).select(*own).orderBy(size.desc_nulls_last(), *own).limit(n)


def string_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """value and count of the n most frequent values that aren't numbers, of all rows; NULL is
    a missing number and no such value."""
    x = F.trim(F.col(column).cast("string"))
    if isinstance(df.schema[column].dataType, T.NumericType):
        return df.select(x.alias("value"), F.lit(0).cast("long").alias("count")).limit(0)
    odd = df.where(x.isNotNull() & x.try_cast("double").isNull()).groupBy(F.col(column).cast("string").alias("value"))
    return odd.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(n)


def strings_for_objects(df: DataFrame) -> DataFrame:
    """Columns that are no number, boolean, date or string, as JSON or plain strings."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    nested = (T.StructType, T.ArrayType, T.MapType)
    made = {f.name: F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string") for f in df.schema if not isinstance(f.dataType, plain)}
    return df.withColumns(made) if made else df


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    """Columns whose type is numeric, integer, float, object, string, datetime or bool."""
    integers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kinds = {
        "numeric": T.NumericType, "integer": integers, "float": (T.FloatType, T.DoubleType), "object": (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType),
        "string": T.StringType, "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType), "bool": T.BooleanType,
    }
    if kind not in kinds:
        raise ValueError(f"no such kind: {kind}; there are {sorted(kinds)}")
    return [f.name for f in df.schema if isinstance(f.dataType, kinds[kind])]


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    gone = [c for c in names if c not in df.columns]
    if gone:
        raise KeyError(f"missing columns: {gone}")


def feature_kinds(df: DataFrame, columns: Sequence[str], threshold: int = 20) -> DataFrame:
    """feature and kind: unknown without values, categorical for booleans and for other columns
    of at most `threshold` distinct values, numerical for numbers, else text_or_id."""
    types = {f.name: f.dataType for f in df.schema}
    rows = stacked(df, columns, {"n": lambda c: F.count(c)}, "feature")
    others = [c for c in columns if not isinstance(types[c], (T.BooleanType, T.NumericType))]
    few = F.lit(False)
    if others:  # values are counted by column before they are shuffled: one pass for all columns
        cells = F.explode(F.array(*(F.struct(F.lit(c).alias("_f"), F.col(c).cast("string").alias("v")) for c in others)))
        values = df.select(cells.alias("r")).select("r.*").where("v IS NOT NULL").distinct().groupBy("_f").agg(F.count(F.lit(1)).alias("_k"))
        rows = rows.join(F.broadcast(values), F.col("feature") == F.col("_f"), "left")  # a row a column
        few = F.coalesce(F.col("_k") <= threshold, F.lit(False))
    booleans = [c for c in columns if isinstance(types[c], T.BooleanType)]
    numbers = [c for c in columns if isinstance(types[c], T.NumericType)]
    kind = F.when(F.col("n") == 0, "unknown").when(F.col("feature").isin(booleans), "categorical").when(F.col("feature").isin(numbers), "numerical")
    return rows.select("feature", kind.when(few, "categorical").otherwise("text_or_id").alias("kind"))
