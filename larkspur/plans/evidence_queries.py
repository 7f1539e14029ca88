"""Queries of gates, evidence, comparison and validation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import skew
from ..operators import cleaning, evidence, features, gates, profile, segments, validate
from ..sources import retail
from .queries import _REL, _RESULTS, _SEG, _SEG_FEATURES, BASE, DROP_SQL, FEAT, RAW, _features, _results, _segmented, query, rnd

# --- gates and interpretation --------------------------------------------------------------

_GATED = ("l_quantity", "l_tax", "l_linestatus_code", "Recency")


def _gated(spark: SparkSession, d: str) -> DataFrame:
    t = retail.table(spark, d, "lineitem")
    gap = F.when(F.col("l_linenumber") % 5 == 0, F.col("l_tax"))
    return t.select("l_quantity", gap.alias("l_tax"), F.lit(1).alias("l_linestatus_code"), F.col("l_partkey").alias("Recency"))


_GATED_SQL = "WITH g AS (SELECT l_quantity::DOUBLE AS l_quantity, CASE WHEN l_linenumber % 5 = 0 THEN l_tax END::DOUBLE AS l_tax, 1::DOUBLE AS l_linestatus_code, l_partkey::DOUBLE AS \"Recency\" FROM lineitem), s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg((\"{c}\" IS NULL)::INT) AS missing_ratio, coalesce(var_samp(\"{c}\"), 0) AS variance, count(DISTINCT \"{c}\") > 1 AS varies FROM g" for c in _GATED) + ")"
_STATUS_SQL = _GATED_SQL + ", gates AS (SELECT feature, CASE WHEN feature = 'Recency' THEN 'PASS' ELSE 'WARNING' END AS Interpretability, CASE WHEN missing_ratio <= 0.5 THEN 'PASS' WHEN missing_ratio < 0.9 THEN 'WARNING' ELSE 'FAIL' END AS DataQuality, CASE WHEN feature = 'l_tax' THEN 'FAIL' ELSE 'PASS' END AS Leakage, CASE WHEN varies THEN 'PASS' ELSE 'FAIL' END AS ZeroVariance, 'DIAGNOSTIC_ONLY' AS Redundancy, 'DIAGNOSTIC_ONLY' AS Stability, 'DIAGNOSTIC_ONLY' AS ShapiroWilk FROM s)"


def _gates(spark: SparkSession, d: str) -> DataFrame:
    return gates.gate_results(gates.feature_statistics(_gated(spark, d), _GATED), gates.known_features(spark, _GATED), leaking=("l_tax",))


@query(_STATUS_SQL + " SELECT * FROM gates")
def feature_gates(spark, d):
    return _gates(spark, d)


_PAIR = [("l_quantity", "Recency", -0.97), ("l_quantity", "l_tax", 0.2)]


@query(_STATUS_SQL + ", top AS (SELECT * FROM (VALUES ('l_quantity', 0.97), ('Recency', 0.97), ('l_tax', 0.2)) v(feature, c)), r AS (SELECT feature AS \"Feature\", CASE WHEN 'FAIL' IN (Interpretability, DataQuality, Leakage, ZeroVariance) THEN 'EXCLUDE' WHEN 'WARNING' IN (Interpretability, DataQuality, Leakage, ZeroVariance) OR coalesce(c, 0) >= 0.95 THEN 'PENDING_REVIEW' ELSE 'RETAIN_CANDIDATE' END AS \"Decision\", Interpretability AS \"GateStatus_Interpretability\", DataQuality AS \"GateStatus_DataQuality\", Leakage AS \"GateStatus_Leakage\", ZeroVariance AS \"GateStatus_ZeroVariance\", Redundancy AS \"GateStatus_Redundancy\", Stability AS \"GateStatus_Stability\", ShapiroWilk AS \"GateStatus_ShapiroWilk\", c::DOUBLE AS \"MaxCorrelation\" FROM gates LEFT JOIN top USING (feature)) SELECT * FROM r UNION ALL SELECT 'CategoryCount', 'UNSUPPORTED', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', 'N/A', NULL")
def selection_report(spark, d):
    pairs = spark.createDataFrame(_PAIR, "feature_a string, feature_b string, corr double")
    return gates.selection_report(_gates(spark, d), pairs, ["CategoryCount"])


_DECIDED = [("Recency", "RETAIN_CANDIDATE"), ("Frequency", "EXCLUDE"), ("Monetary", "ADJUST"), ("TenureDays", "PENDING_REVIEW"), ("BasketSize", "RETAIN_CANDIDATE")]
_ELIGIBLE_COLUMNS = ("CustomerID", "Recency", "Frequency", "Monetary", "TenureDays", "ActiveDays", "BasketSize", "PurchaseIntervalStd", "note")


@query(FEAT + ", d AS (SELECT * FROM (VALUES ('Recency', 'RETAIN_CANDIDATE'), ('Frequency', 'EXCLUDE'), ('Monetary', 'ADJUST'), ('TenureDays', 'PENDING_REVIEW'), ('BasketSize', 'RETAIN_CANDIDATE')) v(feature, decision)), f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, coalesce(var_samp({e}), 0) AS variance, avg(({e} IS NULL)::INT) AS missing_ratio FROM feat" for c, e in (("Recency", "Recency"), ("Frequency", "Frequency"), ("Monetary", "Monetary"), ("TenureDays", "TenureDays"), ("ActiveDays", "ActiveDays"), ("BasketSize", "(CASE WHEN BasketSize IS NOT NULL THEN 1.0 END)"), ("PurchaseIntervalStd", "(CASE WHEN CustomerID % 4 = 0 THEN CustomerID END)"))) + "), c AS (SELECT unnest(['CustomerID', 'Recency', 'Frequency', 'Monetary', 'TenureDays', 'ActiveDays', 'BasketSize', 'PurchaseIntervalStd', 'note']) AS feature) SELECT c.feature, d.decision, CASE WHEN c.feature = 'CustomerID' THEN 'METADATA_ONLY' WHEN c.feature = 'note' THEN 'EXCLUDED' WHEN d.decision = 'EXCLUDE' THEN 'EXCLUDED' WHEN d.decision = 'ADJUST' THEN 'PENDING_HUMAN' WHEN variance = 0 OR missing_ratio > 0.5 THEN 'EXCLUDED' WHEN d.decision = 'RETAIN_CANDIDATE' THEN 'ELIGIBLE' ELSE 'ELIGIBLE_WORKING_ASSUMPTION' END AS status, CASE WHEN c.feature = 'CustomerID' THEN 'identifier' WHEN c.feature = 'note' THEN 'no candidate' WHEN d.decision IN ('EXCLUDE', 'ADJUST') THEN 'decision' WHEN variance = 0 THEN 'zero variance' WHEN missing_ratio > 0.5 THEN 'missing ratio' ELSE 'passed' END AS reason, round(variance, 2) + 0 AS variance, round(missing_ratio, 2) + 0 AS missing_ratio FROM c LEFT JOIN d USING (feature) LEFT JOIN f USING (feature)", 2)
def feature_eligibility(spark, d):
    f = _features(spark, d)
    made = f.withColumns({"BasketSize": F.when(F.col("BasketSize").isNotNull(), F.lit(1.0)), "PurchaseIntervalStd": F.when(F.col("CustomerID") % 4 == 0, F.col("CustomerID")), "note": F.lit("x")})
    return gates.eligibility(made.select(*_ELIGIBLE_COLUMNS), spark.createDataFrame(_DECIDED, "Feature string, Decision string"))


_TX_COLUMNS = ("Quantity", "UnitPrice", "LineRevenue")
_SKEW_SQL = "CASE WHEN count({c}) >= 3 THEN coalesce(skewness({c}), 0) END"


@query("WITH " + retail.CLEAN_SQL + ", p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_SKEW_SQL.format(c=f'{c}::DOUBLE')} AS skewness, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, count(*) FILTER (WHERE {c} < 0) AS neg, count(*) FILTER (WHERE {c} > 5) AS candidates, count(*) FILTER (WHERE {c} > 5)::DOUBLE / count(*) AS rate FROM tx" for c in _TX_COLUMNS) + ") SELECT feature, CASE WHEN feature = 'UnitPrice' AND lo <= 0 THEN 'DATA_ERROR' WHEN candidates > 0 THEN 'AMBIGUOUS' ELSE 'INSUFFICIENT_EVIDENCE' END AS verdict, 'KEEP' AS recommendation, CASE WHEN feature = 'UnitPrice' AND lo <= 0 THEN 'WORKING_ASSUMPTION' ELSE 'PENDING_MENTOR_REVIEW' END AS status, 'all_rows' AS filter_mode, concat_ws(',', CASE WHEN feature = 'Quantity' THEN 'CANCELLATIONS_INCLUDED' END, CASE WHEN feature <> 'UnitPrice' AND neg > 0 THEN 'NEGATIVE_VALUES' END, CASE WHEN skewness > 2 THEN 'LONG_TAIL' END, CASE WHEN feature = 'UnitPrice' AND hi > 1000 THEN 'LARGE_MAXIMUM' END) AS evidence, candidates, round(rate, 4) AS rate FROM p")
def outlier_interpretation(spark, d):
    t = cleaning.line_revenue(retail.clean(spark, d))
    made = {"skewness": skew, "min": lambda c: F.min(F.col(c).cast("double")), "max": lambda c: F.max(F.col(c).cast("double")), "negatives": lambda c: F.count_if(F.col(c) < 0), "candidates": lambda c: F.count_if(F.col(c) > 5), "rate": lambda c: F.count_if(F.col(c) > 5) / F.count(F.lit(1))}
    return gates.interpretations(profile.stacked(t, _TX_COLUMNS, made, "feature"))


@query("SELECT l_quantity::DOUBLE AS l_quantity, l_extendedprice::DOUBLE AS l_extendedprice FROM lineitem WHERE l_discount > 0.05 ORDER BY greatest(abs(l_quantity), abs(l_extendedprice)) DESC, l_quantity, l_extendedprice LIMIT 10")
def top_outliers(spark, d):
    t = retail.table(spark, d, "lineitem").withColumns({c: F.col(c).cast("double") for c in ("l_quantity", "l_extendedprice")})
    return gates.top_candidates(t, F.col("l_discount") > 0.05, ("l_quantity", "l_extendedprice"))


@query(RAW + " SELECT InvoiceNo AS value, count(*) AS count FROM raw WHERE InvoiceNo IS NOT NULL AND try_cast(trim(InvoiceNo) AS DOUBLE) IS NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def string_pattern(spark, d):
    return gates.string_values(retail.raw(spark, d), "InvoiceNo")


# --- evidence of experiments ---------------------------------------------------------------

_RUNS_SQL = _RESULTS + ", runs AS (SELECT *, CASE WHEN CAST(run_id AS BIGINT) % 5 = 0 THEN 'h1' ELSE 'h' || (CAST(run_id AS BIGINT) % 3)::VARCHAR END AS labels_hash, (CAST(run_id AS BIGINT) % 3) * 0.5 AS sigma FROM res)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("run_id").cast("long")
    return _results(spark, d).withColumns({"labels_hash": F.when(i % 5 == 0, "h1").otherwise(F.concat(F.lit("h"), (i % 3).cast("string"))), "sigma": (i % 3) * 0.5})


_OK = "FILTER (WHERE status = 'SUCCESS')"


def _repeats_sql(group: str) -> str:
    aggs = [f"count(*) AS n_runs, count(*) {_OK} AS n_successful, count(*) FILTER (WHERE status <> 'SUCCESS') AS n_failed, count(DISTINCT labels_hash) {_OK} AS labels_hash_unique_count, count(DISTINCT k) {_OK} AS k_unique_count"]
    for m in (*evidence.ALL_METRICS, "runtime"):
        aggs.append(", ".join(f"round({f}({m}) {_OK}, 3) + 0 AS {m}_{n}" for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"))))
    return f"SELECT {group}, {', '.join(aggs)} FROM runs GROUP BY {group}"


_SAME = "labels_hash_unique_count = 1 AND " + " AND ".join(f"coalesce({m}_min = {m}_max, true)" for m in evidence.ALL_METRICS)


@query(_RUNS_SQL + f", a AS ({_repeats_sql('experiment_id, algorithm')}) SELECT *, CASE WHEN n_successful = 0 THEN 'PENDING_REVIEW' WHEN {_SAME} THEN 'REPRODUCIBILITY_VERIFIED' ELSE 'REPRODUCIBILITY_FAILED' END AS decision_status FROM a", 3)
def repeated_runs(spark, d):
    return evidence.repeated_runs(_runs(spark, d), ("experiment_id", "algorithm"))


@query(_RUNS_SQL + f", a AS ({_repeats_sql('algorithm')}) SELECT *, CASE WHEN n_successful = 0 THEN 'PENDING_REVIEW' ELSE 'STABILITY_EVIDENCE_GENERATED' END AS decision_status FROM a", 3)
def seeded_runs(spark, d):
    return evidence.seeded_runs(_runs(spark, d))


@query(_RUNS_SQL + f", a AS ({_repeats_sql('algorithm, sigma')}), f AS (SELECT algorithm, sigma, arg_min(labels_hash, run_id) AS own FROM runs WHERE status = 'SUCCESS' GROUP BY ALL) SELECT a.*, CASE WHEN a.sigma = 0 THEN own = 'h1' END AS sigma_zero_match, CASE WHEN a.sigma = 0 THEN CASE WHEN own = 'h1' THEN 'SIGMA_ZERO_BASELINE_MATCH' WHEN own <> 'h1' THEN 'SIGMA_ZERO_BASELINE_MISMATCH' ELSE 'PENDING_REVIEW' END WHEN n_successful > 0 THEN 'PERTURBATION_EVIDENCE_GENERATED' ELSE 'PENDING_REVIEW' END AS decision_status FROM a LEFT JOIN f USING (algorithm, sigma)", 3)
def perturbed_runs(spark, d):
    base = spark.createDataFrame([(f"alg{k}", "h1") for k in range(4)], "algorithm string, labels_hash string")
    return evidence.perturbed_runs(_runs(spark, d), base)


@query(_RUNS_SQL + f", a AS ({_repeats_sql('k')}) SELECT k, n_runs, n_successful, runtime_mean, runtime_std, n_successful > 0 AND {_SAME} AS determinism_verified, CASE WHEN n_successful > 0 AND {_SAME} THEN 'CANDIDATE_SCENARIO' ELSE 'PENDING_REVIEW' END AS decision_status FROM a", 3)
def scenario_runs(spark, d):
    return evidence.scenario_runs(_runs(spark, d), ("k",))


@query(_RESULTS + " SELECT algorithm, k, " + ", ".join(f"round(arg_max({m}, run_id), 3) + 0 AS {m}" for m in (*evidence.ALL_METRICS, "runtime")) + " FROM (SELECT algorithm, k, run_id, " + ", ".join(f"coalesce({m}, NULL) AS {m}" for m in (*evidence.ALL_METRICS, "runtime")) + " FROM res WHERE status = 'SUCCESS') GROUP BY ALL", 3)
def metric_curves(spark, d):
    return evidence.metric_curves(_results(spark, d))


_IDS = "SELECT event_id, 'EXP-03-alg-' || (CASE event_id % 4 WHEN 0 THEN 'init' WHEN 1 THEN 'm' WHEN 2 THEN 'other' ELSE 'linkage' END) || '-stage' || (CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'X' END) || '-r' || (event_id % 7)::VARCHAR AS id FROM events"


@query(f"SELECT regexp_extract(id, 'stage([ABC])', 1) AS stage, CASE event_id % 4 WHEN 0 THEN 'init_method' WHEN 1 THEN 'fuzziness_m' WHEN 3 THEN 'linkage' END AS family, CAST(regexp_extract(id, '-r([0-9]+)$', 1) AS INT) AS repeat, count(*) AS n FROM ({_IDS}) GROUP BY ALL")
def parsed_ids(spark, d):
    i = F.col("event_id")
    token = F.when(i % 4 == 0, "init").when(i % 4 == 1, "m").when(i % 4 == 2, "other").otherwise("linkage")
    made = F.concat(F.lit("EXP-03-alg-"), token, F.lit("-stage"), F.when(i % 3 == 0, "A").when(i % 3 == 1, "B").otherwise("X"), F.lit("-r"), (i % 7).cast("string"))
    t = retail.table(spark, d, "events").select(made.alias("id"))
    return t.groupBy(evidence.stage(F.col("id")).alias("stage"), evidence.family(F.col("id")).alias("family"), evidence.repeat_index(F.col("id")).alias("repeat")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT user_id % 4 AS run, count(DISTINCT event_id % 9) AS k, max(n) AS largest, min(n) AS smallest, max(noise) AS noise FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id % 4, event_id % 9) AS n, count(*) FILTER (WHERE event_id % 9 = 0) OVER (PARTITION BY user_id % 4) AS noise FROM events) WHERE event_id % 9 <> 0 GROUP BY 1) SELECT run::VARCHAR AS run_id, k::INT AS k, largest, smallest, noise::DOUBLE AS noise FROM s")
def cluster_size_facts(spark, d):
    labels = retail.table(spark, d, "events").select((F.col("user_id") % 4).cast("string").alias("run_id"), (F.col("event_id") % 9 - 1).cast("int").alias("label"))
    return evidence.cluster_sizes(labels).select("run_id", evidence.size_facts(F.col("sizes")).alias("f")).select("run_id", "f.*")


@query(_RESULTS + " SELECT DISTINCT status FROM res WHERE status = 'FAILED'")
def unknown_statuses(spark, d):
    return evidence.unknown_statuses(_results(spark, d), "status", ("SUCCESS",))


@query(_RESULTS + ", s AS (SELECT algorithm, run_id AS experiment_id, k AS selected_k, " + ", ".join(f"{m} AS selected_{m}" for m in evidence.ALL_METRICS) + " FROM res WHERE CAST(run_id AS BIGINT) % 10 = 0), b AS (SELECT algorithm, status AS baseline_status, k AS baseline_k, " + ", ".join(f"{m} AS baseline_{m}" for m in evidence.ALL_METRICS) + " FROM res WHERE algorithm <> 'alg3' QUALIFY row_number() OVER (PARTITION BY algorithm ORDER BY CAST(run_id AS BIGINT)) = 1) SELECT algorithm, experiment_id, selected_k, baseline_k, " + ", ".join(rnd(f"selected_{m}", f"baseline_{m}", f"selected_{m} - baseline_{m} AS {m}_difference", digits=3) for m in evidence.ALL_METRICS) + ", coalesce(baseline_status, 'MISSING') AS baseline_status FROM s LEFT JOIN b USING (algorithm)", 3)
def compared_selection(spark, d):
    r = _results(spark, d)
    first = r.groupBy("algorithm").agg(F.min(F.col("run_id").cast("long")).cast("string").alias("run_id"))
    base = r.join(F.broadcast(first), ["algorithm", "run_id"]).where("algorithm <> 'alg3'")
    return evidence.compared_selection(base, r.where(F.col("run_id").cast("long") % 10 == 0).withColumn("experiment_id", F.col("run_id")))


@query(_RUNS_SQL + ", a AS (SELECT DISTINCT algorithm FROM runs), s AS (SELECT algorithm, count(DISTINCT k) AS n FROM runs GROUP BY 1), n AS (SELECT algorithm, count(DISTINCT sigma) AS n FROM runs WHERE algorithm <> 'alg2' GROUP BY 1) SELECT algorithm, CASE WHEN algorithm = 'alg1' THEN 'VERIFIED' WHEN algorithm = 'alg2' THEN 'NOT_VERIFIED' ELSE 'NOT_ASSESSABLE' END AS reproducibility, CASE WHEN s.n >= 5 THEN 'RAW_EVIDENCE_AVAILABLE_NO_METRIC' ELSE 'PARTIAL_RAW_EVIDENCE' END AS seeds, CASE WHEN n.n >= 3 THEN 'RAW_EVIDENCE_AVAILABLE_NO_METRIC' WHEN n.n > 0 THEN 'PARTIAL_RAW_EVIDENCE' ELSE 'NOT_ASSESSABLE' END AS perturbation, s.n AS n_seeds, coalesce(n.n, 0) AS n_sigmas FROM a JOIN s USING (algorithm) LEFT JOIN n USING (algorithm)")
def stability_evidence(spark, d):
    runs = _runs(spark, d)
    repeats = spark.createDataFrame([("alg1", "REPRODUCIBILITY_VERIFIED"), ("alg2", "REPRODUCIBILITY_FAILED")], "algorithm string, decision_status string")
    return evidence.stability_evidence(runs, repeats, runs.select("algorithm", F.col("k").alias("random_seed")), runs.where("algorithm <> 'alg2'").select("algorithm", "sigma"))


# --- comparison and validation -------------------------------------------------------------


@query(_REL + ", pop AS (SELECT c.label, c.feature, CASE WHEN greatest(c.p75 - c.p25, o.p75 - o.p25) = 0 THEN (c.p25 = o.p25)::INT::DOUBLE ELSE greatest(0, least(c.p75, o.p75) - greatest(c.p25, o.p25)) / greatest(c.p75 - c.p25, o.p75 - o.p25) END AS lap FROM prof c JOIN prof o ON c.feature = o.feature AND o.scope = 'OVERALL' WHERE c.scope = 'CLUSTER') SELECT c.label, c.feature, c.n, " + rnd("c.mean AS mean", "c.median AS median", "c.p25 AS p25", "c.p75 AS p75", "c.min AS min", "c.max AS max", "c.std AS std", "o.mean AS overall_mean", "o.median AS overall_median", "o.p25 AS overall_p25", "o.p75 AS overall_p75", "d.pct AS rel_diff_median_pct", "CASE WHEN abs(o.mean) > 1e-9 THEN (c.mean - o.mean) / abs(o.mean) * 100 END AS rel_diff_mean_pct", "pop.lap AS overlap_with_population", digits=3) + ", o.n AS overall_n, CASE WHEN abs(o.median) <= 1e-9 THEN 'ZERO_REFERENCE' ELSE 'OK' END AS reference_status, d.direction FROM prof c JOIN prof o ON c.feature = o.feature AND o.scope = 'OVERALL' JOIN dir d ON d.label = c.label AND d.feature = c.feature JOIN pop ON pop.label = c.label AND pop.feature = c.feature WHERE c.scope = 'CLUSTER'", 3)
def segment_comparison(spark, d):
    return segments.comparison_matrix(segments.feature_profiles(_segmented(spark, d), _SEG_FEATURES))


@query(_SEG + ", s AS (SELECT label, count(DISTINCT CustomerID) AS n FROM seg GROUP BY label) SELECT label AS segment_id, n AS count, round(n * 100.0 / (SELECT sum(n) FROM s), 2) AS percentage_input, round(CASE WHEN label <> -1 THEN n * 100.0 / (SELECT sum(n) FROM s WHERE label <> -1) END, 2) AS percentage_of_non_noise, label = -1 AS is_noise FROM s", 2)
def sizes_long(spark, d):
    return segments.sizes_long(segments.sizes(_segmented(spark, d)))


@query(FEAT + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {rnd(f'avg({c}) AS mean', f'quantile_cont({c}::DOUBLE, 0.5) AS median', f'stddev_samp({c}) AS std', digits=3)} FROM feat" for c in ("Recency", "Monetary")), 3)
def dataset_stats(spark, d):
    return segments.dataset_stats(_features(spark, d), ["Recency", "Monetary", "absent"])


_KIND_SQL = "SELECT '{f}' AS feature, CASE WHEN count({x}) = 0 THEN 'unknown' WHEN {number} THEN 'numerical' WHEN count(DISTINCT {x}) <= 20 THEN 'categorical' ELSE 'text_or_id' END AS kind FROM events"


@query(" UNION ALL ".join(_KIND_SQL.format(f=f, x=x, number=number) for f, x, number in (("event_type", "event_type", "false"), ("props", "'p' || event_id", "false"), ("value", "value", "true"), ("nothing", "CASE WHEN event_id IS NULL THEN event_type END", "false"))))
def feature_kinds(spark, d):
    t = retail.table(spark, d, "events").select("event_type", "value", "event_id", F.lit(None).cast("string").alias("nothing"))
    t = t.withColumn("props", F.concat(F.lit("p"), F.col("event_id").cast("string")))
    return gates.feature_kinds(t, ["event_type", "props", "value", "nothing"])


_PASS = " UNION ALL ".join


def _checks_sql(table: str, rules: dict[str, str], warn: tuple[str, ...] = ()) -> str:
    return _PASS(f"SELECT '{k}' AS check_id, CASE WHEN coalesce(({v}), false) THEN 'PASS' ELSE '{'WARNING' if k in warn else 'FAIL'}' END AS status FROM {table}" for k, v in rules.items())


_NONE = "count(*) FILTER (WHERE {}) = 0".format


@query(BASE + " " + _checks_sql("base", {"V-01 not empty": "count(*) > 0", "V-02 key present": _NONE("CustomerID IS NULL"), "V-03 key unique": "count(CustomerID) = count(DISTINCT CustomerID)", "V-04 invoices": _NONE("DistinctInvoiceCount < 1"), "V-05 lines": _NONE("TransactionLineCount < DistinctInvoiceCount"), "V-06 products": _NONE("DistinctProducts < 1"), "V-07 dates": _NONE("FirstPurchaseDate > LastPurchaseDate"), "V-08 cancellations": _NONE("CancellationInvoiceCount > DistinctInvoiceCount"), "V-09 returns": _NONE("ReturnInvoiceCount > DistinctInvoiceCount"), "V-10 frequency": _NONE("PurchaseFrequency <> DistinctInvoiceCount"), "V-11 average": _NONE("abs(AverageTransactionValue * DistinctInvoiceCount - TotalMonetary) > 0.01")}))
def validate_base(spark, d):
    return validate.customer_base(features.customer_base(cleaning.with_flags(retail.clean(spark, d))))


@query(FEAT + " " + _checks_sql("feat", {"key unique": "count(CustomerID) = count(DISTINCT CustomerID)", "interval of single purchases": "count(*) FILTER (WHERE Frequency < 2) > 0 AND count(*) FILTER (WHERE Frequency < 2 AND PurchaseIntervalMean IS NOT NULL) = 0", "no NaN": "count(*) >= 0", "one monetary": "count(*) >= 0", "one frequency": "count(*) >= 0", "one quantity set": "count(*) >= 0", "no category count": "count(*) >= 0", "no leakage": "count(*) >= 0"}))
def validate_candidates(spark, d):
    return validate.candidates(_features(spark, d))


@query(FEAT + " " + _checks_sql("feat", {"rows": "count(*) >= 2", "finite": _NONE("NOT (Recency IS NOT NULL AND Frequency IS NOT NULL AND Monetary IS NOT NULL)"), "keys present": _NONE("CustomerID IS NULL"), "keys unique": "count(CustomerID) = count(DISTINCT CustomerID)", "no constant": "coalesce(var_samp(Recency), 0) > 0 AND coalesce(var_samp(Frequency), 0) > 0 AND coalesce(var_samp(Monetary), 0) > 0", "numeric": "count(*) >= 0"}, ("no constant",)))
def validate_matrix(spark, d):
    return validate.matrix(_features(spark, d), ["Recency", "Frequency", "Monetary"])


@query(RAW + f" SELECT count(*) AS rows_in, count(*) FILTER (WHERE NOT ({DROP_SQL})) AS rows_valid, (SELECT count(*) FROM (SELECT DISTINCT * FROM raw WHERE NOT ({DROP_SQL}))) AS rows_out, count(*) FILTER (WHERE starts_with(InvoiceNo, 'C')) AS flagged_cancellations, count(*) FILTER (WHERE Quantity < 0) AS flagged_returns FROM raw")
def cleaning_summary(spark, d):
    return cleaning.summary(retail.raw(spark, d))


@query(FEAT + " SELECT 'identifiers absent' AS check_id, 'PASS' AS status UNION ALL SELECT 'labels absent', 'PASS' UNION ALL SELECT 'key in metadata', 'PASS' UNION ALL SELECT 'rows match', CASE WHEN (SELECT count(*) FROM feat) = (SELECT count(DISTINCT CustomerID) FROM tx) THEN 'PASS' ELSE 'FAIL' END")
def leakage_check(spark, d):
    customers = retail.clean(spark, d).select("CustomerID").distinct()  # of the lines that the features are made of
    return validate.leakage(_features(spark, d).drop("CustomerID"), customers)



_REPO = _RESULTS + ", repo AS (SELECT 'EXP-0' || (1 + run_id::BIGINT % 5) AS source_experiment, 'EXP-03-' || CASE WHEN run_id::BIGINT % 7 = 0 THEN 'dbscan' ELSE algorithm END || '-' || (['init', 'n_init', 'eps', 'other'])[1 + run_id::BIGINT % 4] || '-stageB' AS experiment_id, CASE WHEN run_id::BIGINT % 7 = 0 THEN 'dbscan' ELSE algorithm END AS algorithm, '{\"v\": ' || (run_id::BIGINT % 6) || '}' AS hyperparameters, k AS n_clusters, (['none', 'log1p', NULL])[1 + run_id::BIGINT % 3] AS transformation, (['robust', 'standard'])[1 + run_id::BIGINT % 2] AS scaling, 'median' AS imputation, run_id::BIGINT % 3 AS noise_count, silhouette, davies_bouldin, calinski_harabasz, wcss FROM res)"
_SPREAD = ", ".join(f"count({m}) AS {m}_n, round(min({m}), 3) AS {m}_min, round(max({m}), 3) AS {m}_max, round(avg({m}), 3) AS {m}_mean" for m in evidence.ALL_METRICS)


def _repository(spark: SparkSession, d: str) -> DataFrame:
    """Runs made of the events as rows of the repository of experiments."""
    i = F.col("run_id").cast("long")
    pick = lambda values, n: F.array(*(F.lit(v).cast("string") for v in values))[(i % n).cast("int")]
    algorithm = F.when(i % 7 == 0, "dbscan").otherwise(F.col("algorithm"))
    return _results(spark, d).select(
        F.concat(F.lit("EXP-0"), 1 + i % 5).alias("source_experiment"), F.concat(F.lit("EXP-03-"), algorithm, F.lit("-"), pick(("init", "n_init", "eps", "other"), 4), F.lit("-stageB")).alias("experiment_id"),
        algorithm.alias("algorithm"), F.concat(F.lit('{"v": '), i % 6, F.lit("}")).alias("hyperparameters"), F.col("k").alias("n_clusters"), pick(("none", "log1p", None), 3).alias("transformation"),
        pick(("robust", "standard"), 2).alias("scaling"), F.lit("median").alias("imputation"), (i % 3).alias("noise_count"), *evidence.ALL_METRICS,
    )


@query(_REPO + f" SELECT algorithm, t AS hyperparameter_family, count(*) AS n_rows, count(DISTINCT hyperparameters) AS n_unique_values, min(n_clusters) AS k_min, max(n_clusters) AS k_max, {_SPREAD} FROM (SELECT *, CASE string_split(experiment_id, '-')[4] WHEN 'init' THEN 'init_method' WHEN 'n_init' THEN 'n_init' WHEN 'eps' THEN 'eps' END AS t FROM repo WHERE source_experiment = 'EXP-03') WHERE t IS NOT NULL GROUP BY ALL", 3)
def hyperparameter_comparison(spark, d):
    return evidence.by_hyperparameter(_repository(spark, d))


@query(_REPO + f" SELECT algorithm, transformation || '|' || scaling || '|' || imputation AS scenario, count(*) AS n_rows, {_SPREAD} FROM repo WHERE source_experiment = 'EXP-04' AND transformation IS NOT NULL GROUP BY ALL", 3)
def preprocessing_comparison(spark, d):
    return evidence.by_preprocessing(_repository(spark, d))


_ALL = " AND ".join(f"{m} IS NOT NULL" for m in evidence.ALL_METRICS)


@query(
    _REPO + ", n AS (SELECT count(*) AS n FROM repo) SELECT 'rows' AS part, 'all' AS name, n, NULL::DOUBLE AS fraction FROM n UNION ALL SELECT 'rows', 'all metrics', count(*) FILTER (WHERE " + _ALL + "), round(count(*) FILTER (WHERE " + _ALL + ") / count(*), 4) FROM repo"
    + " UNION ALL SELECT 'algorithms', 'all', count(DISTINCT algorithm), NULL FROM repo UNION ALL SELECT 'noise', 'dbscan', coalesce(sum(noise_count) FILTER (WHERE algorithm = 'dbscan'), 0)::BIGINT, NULL FROM repo"
    + "".join(f" UNION ALL SELECT 'metric', '{m}', count({m}), round(count({m}) / count(*), 4) FROM repo" for m in evidence.ALL_METRICS)
    + " UNION ALL SELECT 'algorithm', algorithm, count(*) FILTER (WHERE " + _ALL + "), round(count(*) FILTER (WHERE " + _ALL + ") / count(*), 4) FROM repo GROUP BY algorithm"
)
def quality_overview(spark, d):
    return evidence.quality_overview(_repository(spark, d))
