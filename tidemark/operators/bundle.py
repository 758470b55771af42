"""A fitted model with all that is needed to use and watch it, in one folder of any store Spark writes to."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .drift import edges, shares
from .models import Learner, settings_mismatch


class CardMismatch(RuntimeError):
    """A bundle was made under other settings than the ones in force."""


@dataclass
class Bundle:
    """models: name -> learner. card: settings and facts of the fit. profile, bounds: the inputs' training distribution. rates: (cutoff, rows, fail_rate)."""

    models: dict[str, Learner]
    card: dict[str, str]
    profile: DataFrame
    bounds: DataFrame
    rates: DataFrame


def fit_bundle(rows: DataFrame, label: str, day: str, cutoff: str, makers: Mapping[str, Learner], card: Mapping[str, str], windows: Mapping[str, int] | None = None) -> Bundle:
    """Fits each model on its window of days (0: all) and describes the rows of the first one.

    The card gets each model's first and last fit day, number of days and rows beside what it is given.
    """
    facts, fitted, described = dict(card), {}, None
    for name, learner in makers.items():
        window = (windows or {}).get(name, 0)
        part = rows
        if window:
            newest = rows.agg(F.max(day).alias("_newest"))
            part = rows.crossJoin(F.broadcast(newest)).where(F.datediff("_newest", day) < window).drop("_newest")
        fitted[name] = learner.fit(part, label)
        span = part.agg(F.min(day), F.max(day), F.count_distinct(day), F.count("*")).first()
        facts |= {f"{name}.{k}": str(v) for k, v in zip(("first_day", "last_day", "days", "rows"), span, strict=True)}
        described = part if described is None else described
    first = next(iter(fitted.values()))
    bounds = edges(described, first.numeric)
    rates = described.groupBy(F.col(cutoff).alias("cutoff")).agg(F.count("*").alias("rows"), F.avg(F.col(label).cast("double")).alias("fail_rate"))
    return Bundle(fitted, facts, shares(described, first.numeric, first.categorical, bounds), bounds, rates)


def write_bundle(bundle: Bundle, spark: SparkSession, path: str) -> None:
    """Pipelines under models/<name>, and four tables: learners, card, profile with bounds, rates."""
    for name, learner in bundle.models.items():
        learner.fitted.write().overwrite().save(f"{path}/models/{name}")
    learners = [(n, i, x.kind, list(x.numeric), list(x.categorical), json.dumps(x.bounds)) for i, (n, x) in enumerate(bundle.models.items())]
    spark.createDataFrame(learners, "name string, nth int, kind string, numeric array<string>, categorical array<string>, bounds string").coalesce(1).write.mode("overwrite").parquet(f"{path}/learners")
    spark.createDataFrame(sorted(bundle.card.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/card")
    for name in ("profile", "bounds", "rates"):
        getattr(bundle, name).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, settings: Mapping[str, str] | None = None) -> Bundle:
    """The bundle; an error that names the differences if its card contradicts the settings in force."""
    card = {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/card").collect()}
    if settings and (wrong := settings_mismatch({k: v for k, v in card.items() if k in settings}, dict(settings))):
        raise CardMismatch("; ".join(f"{k}: {was!r} at the fit, {now!r} now" for k, was, now in wrong))
    models = {}
    for r in sorted(spark.read.parquet(f"{path}/learners").collect(), key=lambda r: r["nth"]):
        bounds = {k: tuple(v) for k, v in json.loads(r["bounds"]).items()}
        models[r["name"]] = Learner(r["numeric"], r["categorical"], r["kind"], bounds=bounds, fitted=PipelineModel.load(f"{path}/models/{r['name']}"))
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in ("profile", "bounds", "rates")}
    return Bundle(models, card, **tables)


def live_rates(bundle: Bundle, live: DataFrame, label: str, cutoff: str) -> DataFrame:
    """(cutoff, rows, fail_rate, fit_rate, difference): how often live rows fail against the rows of the fit."""
    now = live.groupBy(F.col(cutoff).alias("cutoff")).agg(F.count(label).alias("rows"), F.avg(F.col(label).cast("double")).alias("fail_rate"))
    return now.join(bundle.rates.select("cutoff", F.col("fail_rate").alias("fit_rate")), "cutoff", "left").withColumn("difference", F.col("fail_rate") - F.col("fit_rate"))


def inputs(bundle: Bundle) -> Sequence[str]:
    """All columns that some model of the bundle reads, each once."""
    return list(dict.fromkeys(c for m in bundle.models.values() for c in (*m.numeric, *m.categorical)))
