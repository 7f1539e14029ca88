"""Profiles of segments, how they differ, their names and the rules that judge them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import quantile, ratio
from .profile import numeric_columns, stacked, with_quantiles
from .quantiles import quantiles
from .tables import written

NOISE = -1
# Thresholds of the classification rules.
HIGHER_PCT, LOWER_PCT, ZERO = 10.0, -10.0, 1e-9
OVERLAP_HIGH, OVERLAP_LOW, EFFECT_HIGH, EFFECT_MODERATE = 0.7, 0.5, 50.0, 15.0
SIZE_BANDS = ((50.0, "DOMINANT"), (25.0, "LARGE"), (5.0, "MEDIUM"), (1.0, "SMALL"))
RELIABLE = 30


def sizes(labels: DataFrame, label: str = "label", key: str = "key") -> DataFrame:
    """label, n, pct_of_assigned (noise not counted), pct_of_total and relative size."""
    g = labels.groupBy(F.col(label).alias("label")).agg(F.count_distinct(key).alias("n"))
    total = g.agg(F.sum("n").alias("_t"), F.sum(F.when(F.col("label") != NOISE, F.col("n"))).alias("_a"), F.count_if(F.col("label") != NOISE).alias("_k"))
    j = g.crossJoin(F.broadcast(total))
    real = F.col("label") != NOISE
    out = j.withColumns({
        "pct_of_assigned": F.when(real, ratio("n", "_a") * 100),
        "pct_of_total": ratio("n", "_t") * 100,
        "relative_size": F.when(real, ratio(F.col("n") * F.col("_k"), "_a")),
    })
    return out.select("label", "n", "pct_of_assigned", "pct_of_total", "relative_size")


def noise_summary(labels: DataFrame, label: str = "label") -> DataFrame:
    return labels.agg(F.count_if(F.col(label) == NOISE).alias("noise"), (F.avg((F.col(label) == NOISE).cast("double")) * 100).alias("noise_pct"))


def distribution_indicators(size_rows: DataFrame) -> DataFrame:
    """Largest, smallest, their ratio and range, mean deviation from equal sizes, median."""
    real = size_rows.where(F.col("label") != NOISE)
    mean = real.agg(F.avg("n").alias("_m"))
    g = real.crossJoin(F.broadcast(mean)).agg(
        F.count(F.lit(1)).alias("k"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.avg(F.abs(F.col("n") - F.col("_m"))).alias("mean_abs_deviation"), quantile("n", 0.5).alias("median")
    )
    return g.withColumns({"size_ratio": ratio("largest", "smallest"), "size_range": F.col("largest") - F.col("smallest")})


def feature_profiles(points: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Statistics of each feature in each cluster, and over all of them (label NULL, scope OVERALL).

    Noise is left out. The rows' features and labels are written once; moments are one
    aggregation over grouping sets, quartiles come from bracketed order statistics."""
    held = written(points.where(F.col(label) != NOISE).select(F.col(label).alias("label"), *(F.col(c).cast("double").alias(c) for c in features)), "profiled")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in features)))
    long = held.select("label", cells.alias("r")).select("label", "r.*")
    g = long.groupingSets([["label", "feature"], ["feature"]], "label", "feature").agg(
        F.grouping("label").alias("_all"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_samp("v").alias("std")
    )
    both = held.withColumn("_every", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("label", F.when(F.col("_every") == 0, F.col("label")))
    of = quantiles(both, features, (0.25, 0.5, 0.75), ["label", "_every"])
    of = of.select(F.col("label").alias("_label"), "column", "_every", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("feature") == F.col("column")) & (F.col("_all") == F.col("_every"))
    g = g.join(F.broadcast(of), same, "left")  # a row a cluster and feature
    g = g.withColumn("scope", F.when(F.col("_all") == 1, "OVERALL").otherwise("CLUSTER"))
    return written(g.select("label", "feature", "n", "mean", "min", "max", "std", "p25", "median", "p75", "scope"), "profiles")


def direction(pct: Column) -> Column:
    return F.when(pct.isNull(), "NA").when(pct >= HIGHER_PCT, "HIGHER").when(pct <= LOWER_PCT, "LOWER").otherwise("COMPARABLE")


def percent_difference(a: Column, ref: Column) -> Column:
    """(a - ref) / |ref| in percent; NULL where the reference is next to zero."""
    return F.when(F.abs(ref) > ZERO, (a - ref) / F.abs(ref) * 100)


def relative_comparison(profiles: DataFrame) -> DataFrame:
    """Each cluster's medians against the overall ones: difference in percent, status, direction."""
    ref = profiles.where("scope = 'OVERALL'").select("feature", F.col("median").alias("overall"))
    rows = profiles.where("scope = 'CLUSTER'").join(F.broadcast(ref), "feature")
    pct = percent_difference(F.col("median"), F.col("overall"))
    status = F.when(F.col("median").isNull() | F.col("overall").isNull(), "NA").when(F.abs("overall") <= ZERO, "ZERO_REFERENCE").otherwise("OK")
    return rows.select("label", "feature", "median", "overall", pct.alias("rel_diff_pct"), status.alias("status"), direction(pct).alias("direction"))


def behavior_sentences(relative: DataFrame) -> DataFrame:
    """A plain sentence for each cluster and feature."""
    words = F.when(F.col("direction") == "HIGHER", "is higher than").when(F.col("direction") == "LOWER", "is lower than").when(F.col("direction") == "COMPARABLE", "is comparable to").otherwise("can't be compared with")
    return relative.withColumn("sentence", F.concat(F.col("feature"), F.lit(" of cluster "), F.col("label").cast("string"), F.lit(" "), words, F.lit(" the overall median")))


def iqr_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Width of the common range over the greater width; of two points, 1 if they are equal, else 0."""
    width = F.greatest(hi_a - lo_a, hi_b - lo_b)
    common = F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b))
    known = lo_a.isNotNull() & hi_a.isNotNull() & lo_b.isNotNull() & hi_b.isNotNull()
    return F.when(known, F.when(width == 0, (lo_a == lo_b).cast("double")).otherwise(F.try_divide(common, width)))


def pair_overlaps(profiles: DataFrame) -> DataFrame:
    """The overlap of interquartile ranges of each pair of clusters, for each feature."""
    c = profiles.where("scope = 'CLUSTER'")
    a = c.select("feature", *(F.col(x).alias(f"{x}_a") for x in ("label", "p25", "p75")))
    b = c.select("feature", *(F.col(x).alias(f"{x}_b") for x in ("label", "p25", "p75")))
    j = a.join(b, "feature").where("label_a < label_b")
    return j.select("feature", "label_a", "label_b", iqr_overlap(*(F.col(x) for x in ("p25_a", "p75_a", "p25_b", "p75_b"))).alias("overlap"))


def population_overlaps(profiles: DataFrame) -> DataFrame:
    """The overlap of each cluster's interquartile range with the overall one."""
    o = profiles.where("scope = 'OVERALL'").select("feature", F.col("p25").alias("o25"), F.col("p75").alias("o75"))
    j = profiles.where("scope = 'CLUSTER'").join(F.broadcast(o), "feature")
    return j.select("label", "feature", iqr_overlap(*(F.col(x) for x in ("p25", "p75", "o25", "o75"))).alias("overlap"))


def distinguishing(profiles: DataFrame) -> DataFrame:
    """feature, effect range in percent of the overall median, mean overlap of pairs, class."""
    g = profiles.where("scope = 'CLUSTER'").groupBy("feature").agg(F.min("median").alias("lo"), F.max("median").alias("hi"), F.count("median").alias("k"))
    over = profiles.where("scope = 'OVERALL'").select("feature", F.col("median").alias("overall"))
    lap = pair_overlaps(profiles).groupBy("feature").agg(F.avg("overlap").alias("overlap_mean"))
    j = g.join(F.broadcast(over), "feature").join(F.broadcast(lap), "feature", "left")
    effect = F.when(F.abs("overall") > ZERO, (F.col("hi") - F.col("lo")) / F.abs("overall") * 100)
    j = j.withColumn("effect_range_pct", effect)
    e, o = F.col("effect_range_pct"), F.col("overlap_mean")
    kind = (
        F.when((F.col("k") < 2) | e.isNull() | o.isNull(), "NOT_ASSESSABLE").when(o >= OVERLAP_HIGH, "HIGH_OVERLAP")
        .when((e >= EFFECT_HIGH) & (o <= OVERLAP_LOW), "HIGH").when(e >= EFFECT_MODERATE, "MODERATE").otherwise("LOW")
    )
    return j.select("feature", "effect_range_pct", "overlap_mean", kind.alias("class"))


def tier(c: Column, lower: str, higher: str) -> Column:
    return F.when(c == "LOWER", lower).when(c == "HIGHER", higher).otherwise("Mixed")


def segment_names(relative: DataFrame, distinct: DataFrame) -> DataFrame:
    """A name for each cluster from its recency, frequency and monetary directions and the
    first behaviour that fits; noise has none."""
    classes = distinct.select("feature", "class")
    rows = relative.join(F.broadcast(classes), "feature", "left")
    d = lambda f: F.max(F.when(F.col("feature") == f, F.col("direction")))
    strong = lambda f: F.max(F.when((F.col("feature") == f) & F.col("class").isin("HIGH", "MODERATE"), F.col("direction")))
    g = rows.groupBy("label").agg(
        d("Recency").alias("r"), d("Frequency").alias("f"), d("Monetary").alias("m"), strong("TenureDays").alias("t"),
        strong("PurchaseIntervalStd").alias("s"), strong("AverageQuantity").alias("q"), strong("ActiveDays").alias("a"),
    )
    high = lambda c: F.coalesce(F.col(c) == "HIGHER", F.lit(False))
    modifier = F.when(high("t"), "LongTenured").when(high("s"), "IrregularCadence").when(high("q"), "Bulk").when(high("a"), "Active")
    g = g.select(
        "label", tier(F.col("r"), "Recent", "Older").alias("recency_tier"), tier(F.col("f"), "Occasional", "Frequent").alias("frequency_tier"),
        tier(F.col("m"), "LowValue", "HighValue").alias("monetary_tier"), modifier.alias("modifier"),
    )
    same = (F.col("frequency_tier") == "Occasional") & (F.col("monetary_tier") == "LowValue")
    money = F.when((F.col("monetary_tier") != "Mixed") & ~same, F.col("monetary_tier"))
    name = F.concat_ws(" ", "recency_tier", "frequency_tier", money, "modifier")
    status = F.when(F.col("label") == NOISE, "NOISE").when((F.col("recency_tier") == "Mixed") & (F.col("frequency_tier") == "Mixed"), "COMPARATIVE").otherwise("NAMED")
    return g.withColumns({"segment_name": F.when(F.col("label") != NOISE, name), "status": status})


def size_bands(size_rows: DataFrame) -> DataFrame:
    band = F.lit("MICRO")
    for least, name in reversed(SIZE_BANDS):
        band = F.when(F.col("pct_of_assigned") >= least, name).otherwise(band)
    low = F.when(F.col("n") < RELIABLE, "LOW").otherwise("OK")
    return size_rows.where(F.col("label") != NOISE).select("label", "n", "pct_of_assigned", band.alias("size_band"), low.alias("reliability"))


RATES = ("CancellationRate", "ReturnRate")


def distinctiveness(relative: DataFrame, distinct: DataFrame, redundant: Sequence[tuple[str, str]] = (("AverageQuantity", "BasketSize"),)) -> DataFrame:
    """How many HIGH features set a cluster apart, one of each redundant pair counted."""
    second = [b for _, b in redundant]
    rows = relative.where(~F.col("feature").isin(second)).join(F.broadcast(distinct.select("feature", "class")), "feature", "left")
    strong = F.count_if((F.col("class") == "HIGH") & F.col("direction").isin("HIGHER", "LOWER"))
    g = rows.groupBy("label").agg(strong.alias("n_high"), F.count_if(F.col("direction") != "NA").alias("known"))
    status = F.when(F.col("known") == 0, "NOT_ASSESSABLE").when(F.col("n_high") >= 2, "DISTINCT").when(F.col("n_high") == 1, "LIMITED").otherwise("NOT_DISTINCT")
    return g.select("label", "n_high", status.alias("distinctiveness"))


def business_relevance(relative: DataFrame) -> DataFrame:
    g = relative.where(~F.col("feature").isin(*RATES)).groupBy("label").agg(F.count_if(F.col("direction").isin("HIGHER", "LOWER")).alias("n_directional"))
    return g.withColumn("relevance", F.when(F.col("n_directional") >= 3, "SUPPORTED").when(F.col("n_directional") >= 1, "LIMITED").otherwise("NOT_ASSESSABLE"))


def interpretability(relative: DataFrame, most: int = 6) -> DataFrame:
    g = relative.groupBy("label").agg(F.count_if(F.col("direction").isin("HIGHER", "LOWER")).alias("n_directional"))
    return g.select("label", F.when(F.col("n_directional") > most, "PARTIALLY_INTERPRETABLE").otherwise("INTERPRETABLE").alias("interpretability"))


def consistency(names: DataFrame, relative: DataFrame) -> DataFrame:
    """Whether each tier of a name has its direction, and each modifier a known one."""
    d = lambda f: F.max(F.when(F.col("feature") == f, F.col("direction")))
    seen = relative.groupBy("label").agg(d("Recency").alias("r"), d("Frequency").alias("f"), d("Monetary").alias("m"), d("TenureDays").alias("t"), d("PurchaseIntervalStd").alias("s"), d("AverageQuantity").alias("q"), d("ActiveDays").alias("a"))
    j = names.join(F.broadcast(seen), "label", "left")
    fits = lambda t, c, lower, higher: (F.col(t) == "Mixed") | ((F.col(t) == lower) & (F.col(c) == "LOWER")) | ((F.col(t) == higher) & (F.col(c) == "HIGHER"))
    rfm = fits("recency_tier", "r", "Recent", "Older") & fits("frequency_tier", "f", "Occasional", "Frequent") & fits("monetary_tier", "m", "LowValue", "HighValue")
    mod = F.when(F.col("modifier") == "LongTenured", F.col("t")).when(F.col("modifier") == "IrregularCadence", F.col("s")).when(F.col("modifier") == "Bulk", F.col("q")).when(F.col("modifier") == "Active", F.col("a"))
    status = (
        F.when(F.col("status") == "NOISE", "NOT_ASSESSABLE").when(~F.coalesce(rfm, F.lit(False)), "RFM_INCONSISTENT")
        .when(F.col("modifier").isNull() | (mod == "HIGHER"), "CONSISTENT").when(mod.isNull() | (mod == "NA"), "PARTIALLY_CONSISTENT").otherwise("MODIFIER_INCONSISTENT")
    )
    return j.select("label", status.alias("consistency"))


def final_definitions(names: DataFrame, bands: DataFrame, relative: DataFrame, distinct: DataFrame) -> DataFrame:
    """All judgements of a segment in a row, whether it's ready to interpret, and how far."""
    out = names.select("label", "segment_name", "status").join(bands, "label", "left")
    for part in (distinctiveness(relative, distinct), business_relevance(relative), interpretability(relative), consistency(names, relative)):
        out = out.join(F.broadcast(part), "label", "left")
    ready = F.col("distinctiveness").isin("DISTINCT", "LIMITED") & (F.col("interpretability") != "LIMITED") & F.col("consistency").isin("CONSISTENT", "PARTIALLY_CONSISTENT") & (F.col("relevance") != "NOT_ASSESSABLE") & (F.col("status") != "NOISE")
    ready = F.coalesce(ready, F.lit(False))
    level = F.when(~ready, "LIMITED").when(F.col("size_band").isin("DOMINANT", "LARGE", "MEDIUM"), "READY").otherwise("CONDITIONAL")
    return out.withColumns({"is_ready": ready, "readiness": level})


def characteristics(points: DataFrame, features: Sequence[str], label: str = "label", z: float = 0.5) -> DataFrame:
    """mean_high and mean_low where a segment's mean is z deviations off, median_above else."""
    p = feature_profiles(points, features, label)
    all_ = p.where("scope = 'OVERALL'").select("feature", F.col("mean").alias("all_mean"), F.col("std").alias("all_std"), F.col("median").alias("all_median"))
    j = p.where("scope = 'CLUSTER'").join(F.broadcast(all_), "feature")
    kind = F.when(F.col("mean") >= F.col("all_mean") + z * F.col("all_std"), "mean_high").when(F.col("mean") <= F.col("all_mean") - z * F.col("all_std"), "mean_low").when(F.col("median") > F.col("all_median"), "median_above")
    return j.select("label", "feature", kind.alias("characteristic")).where("characteristic IS NOT NULL")


def categorical_profile(points: DataFrame, column: str, label: str = "label", top_k: int = 3) -> DataFrame:
    """A segment's most frequent values (ties by value), the rest, and the missing."""
    counts = points.groupBy(F.col(label).alias("label"), F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("label").orderBy(F.desc("n"), "value")
    ranked = counts.where("value IS NOT NULL").withColumn("place", F.row_number().over(w))
    top = ranked.where(F.col("place") <= top_k).select("label", "place", "value", "n")
    rest = ranked.groupBy("label").agg(F.coalesce(F.sum(F.when(F.col("place") > top_k, F.col("n"))), F.lit(0)).alias("other_count"))
    missing = counts.groupBy("label").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_count"))
    return top.join(rest, "label").join(missing, "label")


# The words of segment names.
WORDS = ("Recent", "Older", "Mixed", "Occasional", "Frequent", "LowValue", "HighValue", "LongTenured", "IrregularCadence", "Bulk", "Active")


def parsed_names(names: DataFrame, column: str = "segment_name") -> DataFrame:
    """The known and the other words of each name, and whether all are known."""
    tokens = F.filter(F.split(F.coalesce(F.trim(F.col(column)), F.lit("")), r"\s+"), lambda t: t != "")
    known = F.array(*(F.lit(w) for w in WORDS))
    out = names.withColumns({"known_tokens": F.array_intersect(tokens, known), "unmatched_tokens": F.array_except(tokens, known)})
    return out.withColumn("matched", (F.size("unmatched_tokens") == 0) & (F.size("known_tokens") > 0))


def recommendations(finals: DataFrame) -> DataFrame:
    """A row to review for each segment that isn't noise."""
    return finals.where("status <> 'NOISE'").select("label", "segment_name", F.lit("REVIEW_REQUIRED").alias("recommendation_status"))


def selection(stats: DataFrame, correlations: DataFrame, most_missing: float = 0.5, threshold: float = 0.95, leakage: Sequence[str] = ("target", "label", "class", "answer")) -> DataFrame:
    """EXCLUDE, PENDING or RETAIN for each feature from its gates and its strongest correlation.

    stats has feature, missing_ratio and n_unique. Columns named like a label leak."""
    ends = correlations.select(F.col("feature_a").alias("feature"), "corr").unionByName(correlations.select(F.col("feature_b").alias("feature"), "corr"))
    top = ends.groupBy("feature").agg(F.max(F.abs("corr")).alias("max_corr"))
    j = stats.join(top, "feature", "left")
    quality = F.when(F.col("missing_ratio") <= most_missing, "PASS").when(F.col("missing_ratio") < 0.9, "WARNING").otherwise("FAIL")
    leaks = F.lit(False)
    for w in leakage:
        leaks = leaks | F.lower("feature").contains(w)
    constant = F.when(F.col("n_unique") <= 1, "FAIL").otherwise("PASS")
    j = j.withColumns({"quality_gate": quality, "leakage_gate": F.when(leaks, "FAIL").otherwise("PASS"), "variance_gate": constant})
    gates = [F.col(g) for g in ("quality_gate", "leakage_gate", "variance_gate")]
    fails, warns = F.lit(False), F.lit(False)
    for g in gates:
        fails, warns = fails | (g == "FAIL"), warns | (g == "WARNING")
    decision = F.when(fails, "EXCLUDE").when(warns | (F.coalesce("max_corr", F.lit(0.0)) >= threshold), "PENDING").otherwise("RETAIN")
    return j.withColumn("decision", decision)


def comparison_matrix(profiles: DataFrame) -> DataFrame:
    """Each cluster's statistics of a feature beside the overall ones: differences in percent,
    direction, and the overlap of its interquartile range with the overall one."""
    names = ("n", "mean", "median", "p25", "p75")
    o = profiles.where("scope = 'OVERALL'").select("feature", *(F.col(c).alias(f"overall_{c}") for c in names))
    rel = relative_comparison(profiles).select("label", "feature", F.col("rel_diff_pct").alias("rel_diff_median_pct"), F.col("status").alias("reference_status"), "direction")
    lap = population_overlaps(profiles).select("label", "feature", F.col("overlap").alias("overlap_with_population"))
    j = profiles.where("scope = 'CLUSTER'").drop("scope").join(F.broadcast(o), "feature").join(F.broadcast(rel), ["label", "feature"], "left").join(F.broadcast(lap), ["label", "feature"], "left")
    j = j.withColumn("rel_diff_mean_pct", percent_difference(F.col("mean"), F.col("overall_mean")))
    return j.withColumns({"reference_status": F.coalesce("reference_status", F.lit("NA")), "direction": F.coalesce("direction", F.lit("NA"))})


def feature_summaries(comparison: DataFrame, distinct: DataFrame) -> DataFrame:
    """A cluster's features in short, with the class of each feature."""
    classes = distinct.select("feature", F.col("class").alias("classification"))
    j = comparison.join(F.broadcast(classes), "feature", "left")
    return j.select("label", "feature", "median", "p25", "p75", "overall_median", "rel_diff_median_pct", "direction", F.coalesce("classification", F.lit("NOT_ASSESSABLE")).alias("classification"))


def sizes_long(size_rows: DataFrame, decimals: int = 2) -> DataFrame:
    """A row a segment for a report: its count and percentages, none of the assigned for noise."""
    pct = lambda c: F.round(c, decimals)
    return size_rows.select(F.col("label").alias("segment_id"), F.col("n").alias("count"), pct("pct_of_total").alias("percentage_input"), pct("pct_of_assigned").alias("percentage_of_non_noise"), (F.col("label") == NOISE).alias("is_noise"))


def dataset_stats(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, mean, median and sample deviation of the numeric features that are there and
    have values."""
    own = [c for c in features if c in numeric_columns(df, leave=())]
    x = lambda c: F.col(c).cast("double")
    if not own:
        return df.sparkSession.createDataFrame([], "feature string, mean double, median double, std double")
    df = written(df.select(*own), "columns")  # read several times
    rows = stacked(df, own, {"n": lambda c: F.count(c), "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c))}, "column")
    found = with_quantiles(rows, df, own, {"median": 0.5}).where("n > 0")
    return found.select(F.col("column").alias("feature"), "mean", "median", "std")


def with_segments(points: DataFrame, labels: DataFrame, key: str = "CustomerID") -> DataFrame:
    """Points with their labels by key; points without a label are left out. Without a key on
    both sides there is no order to pair rows by, which is an error."""
    if key not in points.columns or key not in labels.columns:
        raise ValueError(f"both sides need {key}")
    return points.join(labels.select(key, "ClusterLabel", "IsNoise"), key)


def profile_rows(profiles: DataFrame, names: Sequence[str] = ("n", "mean", "median", "p25", "p75", "min", "max", "std")) -> DataFrame:
    """Profiles as label, scope, feature, statistic and value."""
    doubles = profiles.select("label", "scope", "feature", *(F.col(c).cast("double").alias(c) for c in names))
    return doubles.unpivot(["label", "scope", "feature"], list(names), "statistic", "value")


def template_slots(parsed: DataFrame, slots: Sequence[str] = ("recency", "frequency", "monetary", "modifier")) -> DataFrame:
    """The slots of a recommendation's template, all empty: their texts are for people to write."""
    return parsed.withColumns({f"slot_{s}": F.lit(None).cast("string") for s in slots})
