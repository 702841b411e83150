"""Feature engineering: from plans, event log, holidays and city table to the engineered table,
and from there to train and test matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskframe.functions import bins, clean, dates, text
from riskframe.functions.fixed import (
    BMI_EDGES, BMI_LABELS, BMI_RANGE, DISTANCE_EDGES, FLAG_FEATURES, LAB_COLUMNS,
    NULL_TEXT_NULLABLE, WAIT_DAYS_EDGES, WAIT_DAYS_LABELS,
)
from riskframe.operators import encode, joins, profile, rates, stratify
from riskframe.operators.calendar import add_holiday_features
from riskframe.operators.ranks import median_of_counts, medians
from riskframe.session import settle, stage
from riskframe.sources.tables import require_columns

RATES = {
    "site_room_cancel_rate_smoothed": "site_room",
    "anesthesia_cancel_rate_smoothed": "anesthesia",
    "procedure_code_cancel_rate_smoothed": "procedure_code",
    "weekday_cancel_rate_smoothed": "__weekday",
    "distance_bucket_cancel_rate_smoothed": "distance_bucket",
}


def add_calendar_features(df: DataFrame) -> DataFrame:
    """Waiting time, its band, weekday, weekend flag and season."""
    df = df.withColumns({
        "request_date": clean.to_timestamp("request_date"), "surgery_date": clean.to_timestamp("surgery_date"),
    })
    df = df.withColumn("wait_days", dates.elapsed_days("surgery_date", "request_date"))
    return df.withColumns({
        "wait_days_category": bins.bin_label("wait_days", WAIT_DAYS_EDGES, WAIT_DAYS_LABELS),
        "surgery_weekday": dates.day_name("surgery_date"),
        "is_weekend": dates.is_weekend("surgery_date"),
        "season": dates.season("surgery_date"),
    })


def add_patient_features(df: DataFrame) -> DataFrame:
    """Age band, BMI band, number of lab values, list lengths. ``bmi_missing`` tells whether
    there was any text, before it is read as a number."""
    labs = [c for c in LAB_COLUMNS if c in df.columns]
    # numbers are parsed once, in a projection of their own
    df = df.withColumns({"age": clean.to_number("age"), "__bmi": clean.to_number("bmi"),
                         "num_existing_labs": profile.horizontal_present(labs)})
    return df.withColumns({
        "age_decade": dates.decade("age"),
        "bmi_missing": F.col("bmi").isNull(),
        "bmi_category": bins.bin_label("__bmi", BMI_EDGES, BMI_LABELS),
        "has_missing_labs": F.col("num_existing_labs") < len(labs) if labs else F.lit(True),
        "num_medications": text.count_items("medications"),
        "num_diagnoses": text.count_items("diagnoses"),
    }).drop("__bmi")


def add_city_cluster(df: DataFrame, city_dim: DataFrame, key: str = "city", value: str = "cluster") -> DataFrame:
    """City cluster by normalised name; unknown cities get the median over all rows."""
    named = city_dim.withColumn("socioeconomic_cluster", clean.to_number(value))
    joined = joins.lookup(df, key, named, key, ["socioeconomic_cluster"])
    counts, small = settle(
        joined.groupBy(F.col("socioeconomic_cluster").alias("value")).agg(F.count("*").alias("cnt"))
    )
    middle = median_of_counts(counts) if small else medians(joined, ["socioeconomic_cluster"])
    middle, _ = settle(middle)
    return joined.withColumn("socioeconomic_cluster", F.coalesce("socioeconomic_cluster", middle.scalar()))


def add_place_and_distance(df: DataFrame) -> DataFrame:
    df = df.withColumn("distance_km", clean.to_number("distance_km"))
    return df.withColumns({
        "site_room": text.site_room("surgery_site", "room"),
        "distance_bucket": bins.bin_label("distance_km", DISTANCE_EDGES, bins.DISTANCE_LABELS),
    })


def row_features(df: DataFrame) -> DataFrame:
    """All features that depend on one row alone."""
    return add_place_and_distance(add_patient_features(add_calendar_features(df)))


def engineer(
    plans: DataFrame, cancel_log: DataFrame | None, holidays: DataFrame, city_dim: DataFrame,
    fit_rates_on: DataFrame | None = None,
) -> DataFrame:
    """The engineered table: the plan columns and 25 features.

    By default the smoothed rates are fitted on the whole table, so a row's own label is in its
    rate. ``fit_rates_on`` (rows of this function's output) fits them elsewhere instead. Without a
    ``cancel_log`` the plans bring their label, a boolean ``was_canceled``.
    """
    require_columns(plans, ["plan_id", "request_date", "surgery_date"], "plans")
    if cancel_log is None:
        require_columns(plans, ["was_canceled"], "plans")
        df = plans
    else:
        require_columns(cancel_log, ["plan_id"], "cancel_log")
        df = joins.flag_members(plans, "plan_id", cancel_log, "plan_id", "was_canceled")
    # written once: the city counts, the rates and the output all read it
    df = stage(add_holiday_features(row_features(df), "surgery_date", holidays))
    df = add_city_cluster(df, city_dim)
    return with_rates(df, fit_rates_on)


def with_rates(df: DataFrame, fit_on: DataFrame | None = None) -> DataFrame:
    """Add the five smoothed rates. A missing weekday is a category of its own there."""
    def weekday(d: DataFrame) -> DataFrame:
        return d.withColumn("__weekday", F.coalesce("surgery_weekday", F.lit(NULL_TEXT_NULLABLE)))

    fitted = rates.fit_smoothed_rates(weekday(df if fit_on is None else fit_on), RATES, "was_canceled")
    return fitted.transform(weekday(df)).drop("__weekday")


def prepare(engineered: DataFrame, spec: encode.FeatureSpec | None = None) -> tuple[DataFrame, encode.FeatureSpec]:
    """Types and missing categories in the form the model needs: key, 0/1 label and features."""
    df = engineered.withColumn("was_canceled", clean.flag_to_int("was_canceled"))
    changed = {c: clean.flag_to_int(c) for c in FLAG_FEATURES if c in df.columns}
    if "sodium" in df.columns:
        changed["sodium"] = clean.to_number("sodium")
    if "bmi" in df.columns:
        changed["bmi"] = clean.clip(clean.to_number("bmi"), *BMI_RANGE)
    df = df.withColumns(changed)
    spec = spec or encode.FeatureSpec()
    df = df.withColumns({c: clean.category(c) for c in spec.categorical if c in df.columns})
    spec = spec.within(df)
    return spec.select(df), spec


@dataclass
class Matrices:
    data: DataFrame
    preprocessor: encode.Preprocessor
    spec: encode.FeatureSpec


def build_matrices(prepared: DataFrame, spec: encode.FeatureSpec) -> Matrices:
    """Split, fit on the training part, transform both: rows (key, label, is_test, features).

    ``prepared`` is read several times; pass a written table when it is costly to compute.
    """
    split = stratify.stratified_split(prepared, spec.label, [spec.key])
    fitted = encode.fit_preprocessor(split.filter("not is_test"), spec.numeric, spec.categorical)
    data = fitted.transform(split, [spec.key, spec.label, "is_test"])
    return Matrices(data, fitted, spec)
