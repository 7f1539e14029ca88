"""From transactions to named segments: the stages in order, each kept by content id."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cleaning, cluster, features, metrics, prep, segments, store
from ..operators.tables import written


@dataclass(frozen=True)
class Plan:
    algorithm: str = "kmeans"
    params: tuple[tuple[str, object], ...] = (("n_clusters", 4),)
    columns: tuple[str, ...] = features.FEATURES
    transform: str = "yeo_johnson"
    scaler: str = "robust"


class Quality(Mapping):
    """The metrics of labelled points by name, computed when they are first read: a silhouette
    compares all pairs of points, and names and definitions don't ask for it."""

    def __init__(self, scored: DataFrame):
        self.scored = scored

    @cached_property
    def found(self) -> dict[str, object]:
        return metrics.internal_metrics(self.scored).first().asDict() | {"silhouette": metrics.silhouette(self.scored).first()[0]}

    def __getitem__(self, name: str) -> object:
        return self.found[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.found)

    def __len__(self) -> int:
        return len(self.found)


def segment_customers(raw: DataFrame, root: str | None = None, plan: Plan | None = None) -> dict[str, DataFrame | Mapping]:
    """clean, features, matrix, labels, metrics, profiles, names and final definitions; metrics
    are computed when they are read.

    With a root each of the first four is written under its content id; a run with the same
    input and plan finds them there."""
    p = plan or Plan()
    spark = raw.sparkSession
    parents: dict[str, str] = {}

    def kept(df: DataFrame, kind: str, name: str) -> DataFrame:
        if root is None:
            return written(df, name)
        made = store.save(df, root, kind, name, parents, {"plan": str(p)} if name in ("matrix", "labels") else {})
        parents[name] = made
        return store.load(spark, root, made)

    clean = kept(cleaning.clean_transactions(raw), "preprocessed", "clean")
    found = kept(features.candidate_features(clean), "preprocessed", "features")
    fitted = prep.fit(found, p.columns, p.transform, p.scaler)
    matrix = fitted.apply(found).select(F.col(features.KEY).alias("key"), F.array(*(F.col(c).cast("double") for c in p.columns)).alias("x"))
    matrix = kept(matrix, "preprocessed", "matrix")
    labels = kept(cluster.make(p.algorithm, **dict(p.params)).fit(matrix).labels.select("key", "label"), "clustering", "labels")
    quality = Quality(matrix.join(labels, "key"))
    points = found.join(labels, found[features.KEY] == labels["key"]).drop("key")
    profiles = segments.feature_profiles(points, p.columns)
    relative = segments.relative_comparison(profiles)
    distinct = segments.distinguishing(profiles)
    names = segments.segment_names(relative, distinct)
    bands = segments.size_bands(segments.sizes(labels))
    return {
        "clean": clean, "features": found, "matrix": matrix, "labels": labels, "metrics": quality, "profiles": profiles,
        "names": names, "final": segments.final_definitions(names, bands, relative, distinct),
    }
