"""A feature pipeline that is fitted once and applied to later tables."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.ingest import fingerprint, load_lookup, save_lookup
from faultline.sources.scratch import materialize, stored

from .features import LEGACY, aligned, date_features, duration_stats, legacy_past, medians, path_features, path_lookup, placed_core, run_ranks, run_starts, since_failures
from .joins import refuse, require

#: Features may look back only; names that begin so are refused.
FORBIDDEN = "till_next_"
CORE = ("start_time", "duration", "feature_mean", "records_last_1hr", "records_last_24hr", "density_ratio")
PATH = ("transition_fail_rate_mean", "transition_fail_rate_max", "transition_fail_rate_std", "station_risk_mean", "path_count", "pair_cooccur_mean", "pair_cooccur_max", "pair_cooccur_std")
HISTORY = ("since_1", "since_5", "since_10")
DUPLICATES = ("run_size", "run_rank", "run_rank_desc")
DATES = ("in_week", "day", "hour", "log_duration", "z_duration", "is_long", "is_short")
#: Of the legacy block only what looks back, and what a part's own id says.
OLD = (*(f"last_{w}" for w in LEGACY), "week_part", "shift")
#: Feature lists of models. The rolling rate and the rates of paths join the core features, sensors the path features.
DATASET_G = (*CORE, "block_size", "rolling_fail_rate", "signature_failure_rate", "path_failure_rate", "duration_x_path_failure_rate", "feature_mean_x_duration")
DATASET_H = (*CORE, "time_block", "block_size", *PATH)
META = ("mean", "std", "max", "agreement", "pred", "pred_b", "pred_c")
WHOLE = frozenset({"records_last_1hr", "records_last_24hr", "path_count", *DUPLICATES, "day", "hour", "is_long", "is_short", *OLD})


def dataset_e1(stations: Sequence[str]) -> tuple[str, ...]:
    """The features of the sensor model for the given stations."""
    return (*DATASET_H, "sensor_nonull_count", "sensor_std", *(f"sensor_mean_{s}" for s in stations))


@dataclasses.dataclass
class FeaturePipeline:
    """fit learns path lookups, rates of categories, medians and the spread of durations from labelled parts; transform never reads a label of its input.

    Blocks: numeric columns as they are (nulls: fitted medians), categories by their fitted rate
    (unknown ones: the overall rate), runs of equal neighbours in time, core and path features,
    dates, the legacy block, and history. History needs the failures of a `context`. Without a
    context, or one without failures, it has its fitted medians - or transform raises, if
    `need_history`.

    transform sorts rows once, by (start_time, id). What else it says of a part is looked up by
    its times, path and categories, of which there are as many as differ; there is no join by id.
    """

    lookup: dict[str, DataFrame]
    overall: float
    medians: dict[str, float]
    mark: str
    stats: dict[str, float]
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    same: tuple[str, ...] = ("path_signature", "feature_mean")

    @classmethod
    def fit(cls, parts: DataFrame, label: str = "response", *, numeric: Sequence[str] = (), categorical: Sequence[str] = (), same: Sequence[str] = ("path_signature", "feature_mean")) -> FeaturePipeline:
        require(parts, "id", label, "start_time", "end_time", "duration", "feature_mean", "path_signature", *numeric, *categorical, *same)
        parts = stored(parts)
        times = materialize(parts.groupBy("end_time").agg(F.count("*").alias("__n")))
        m = medians(since_failures(times, label=label, failures=parts), HISTORY, "__n") | medians(parts, numeric)
        overall = parts.agg(F.avg(label)).first()[0] or 0.0
        lookup = path_lookup(parts, label=label)
        for c in categorical:
            lookup[f"category_{c}"] = materialize(parts.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.avg(label).alias("rate")))
        names = [*CORE, *PATH, *HISTORY, *DUPLICATES, *DATES, *OLD, *numeric, *categorical]
        return cls(lookup, float(overall), m, fingerprint(parts, names, label=label), duration_stats(parts), tuple(numeric), tuple(categorical), tuple(same))

    @property
    def contract(self) -> list[tuple[str, str, object]]:
        """Name, type and fill of every column that transform gives, in its order."""
        fill = {c: self.medians[c] for c in (*self.numeric, *HISTORY)} | {f"{c}_target_enc": self.overall for c in self.categorical}
        names = (*self.numeric, *(f"{c}_target_enc" for c in self.categorical), *DUPLICATES, *CORE, *PATH, *DATES, *OLD, *HISTORY)
        return [("id", "bigint", 0), *[(c, "bigint" if c in WHOLE else "double", fill.get(c, 0.0)) for c in names]]

    def transform(self, parts: DataFrame, context: DataFrame | None = None, *, need_history: bool = False, label: str = "response") -> DataFrame:
        """id and all features of parts, in the order and types of the contract."""
        parts = stored(parts).drop(label)
        if any(c.startswith(FORBIDDEN) for c in parts.columns):
            raise ValueError(f"columns that look ahead: {[c for c in parts.columns if c.startswith(FORBIDDEN)]}")
        require(parts, "id", "start_time", "end_time", "duration", "feature_mean", "path_signature", *self.numeric, *self.categorical, *self.same)
        failures = None if context is None else context.where(F.col(label) == 1).where(F.col("end_time").isNotNull())
        known = failures is not None and not failures.isEmpty()
        if need_history and not known:
            raise ValueError("there is no failure to look back to")
        starts = run_starts(parts, self.same, "start_time", "id")
        got = placed_core(run_ranks(starts), parts)
        paths = materialize(path_features(materialize(parts.select("path_signature").distinct()), self.lookup, self.overall))
        got = got.join(paths, "path_signature")
        for c in self.categorical:
            rates = self.lookup[f"category_{c}"].select(F.col("value").alias("__value"), F.col("rate").alias(f"{c}_target_enc"))
            got = got.join(rates, F.col(c).cast("string") == F.col("__value"), "left").drop("__value")
        got = legacy_past(date_features(got, self.stats), parts)
        if known:
            times = materialize(parts.select("end_time").distinct())
            past = since_failures(times, label=label, failures=failures).select(F.col("end_time").alias("__end"), *HISTORY)
            got = got.join(past, F.col("end_time") == F.col("__end"), "left")
        got = got.where(F.col("id").isNotNull())
        return refuse(aligned(got, self.contract), label)

    def save(self, path: str) -> None:
        told = {"mark": self.mark, "medians": self.medians, "stats": self.stats, "numeric": self.numeric, "categorical": self.categorical, "same": self.same}
        save_lookup(self.lookup, path, self.overall, json.dumps(told, sort_keys=True))

    @classmethod
    def load(cls, spark: SparkSession, path: str, names: Sequence[str] = ("station", "transition", "pair", "path")) -> FeaturePipeline:
        told = json.loads(spark.read.schema("overall double, fingerprint string").json(f"{path}/meta").first().fingerprint)
        lookup, overall = load_lookup(spark, path, names=(*names, *(f"category_{c}" for c in told["categorical"])))
        return cls(lookup, overall, told["medians"], told["mark"], told["stats"], tuple(told["numeric"]), tuple(told["categorical"]), tuple(told["same"]))
