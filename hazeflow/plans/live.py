"""Live features: raw payloads to feature vectors, row by row, for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import enrich
from ..sources.payloads import decode_cycle


def vectors_from_records(records: DataFrame, ts: str, impute_weather: bool = False) -> DataFrame:
    """Decoded records to feature columns; the label may still be NULL.

    The clock is the record's own time, so a replay gives the same vectors. The
    change rate of a single vector is 0.0; the stateful stream fills it.
    """
    out = records.transform(enrich.impute_pm10).transform(enrich.with_live_humidex)
    if impute_weather:
        out = enrich.impute_weather(out)
    return (
        out.transform(enrich.choose_label)
        .withColumn("aqi_change_rate", F.lit(0.0))
        .transform(lambda d: enrich.with_time_features(d, ts))
        .transform(enrich.cast_features)
    )


def live_vectors(landed: DataFrame, impute_weather: bool = False) -> tuple[DataFrame, DataFrame]:
    """Feature vectors with a label (plus source and label_scale), and rejects with a reason."""
    return decoded_vectors(decode_cycle(landed), impute_weather)


def decoded_vectors(decoded: DataFrame, impute_weather: bool = False) -> tuple[DataFrame, DataFrame]:
    """``live_vectors`` of payloads that are decoded; both results read them, so a job that wants both keeps them."""
    usable = F.col("source").isNotNull()
    vectors = vectors_from_records(decoded.where(usable), "fetched_at", impute_weather)
    labelled, unlabelled = enrich.split_labelled(vectors)
    raw = ["city", "fetched_at", "pollution", "weather", "station"]
    rejects = (
        decoded.where(~usable)
        .select(*raw, F.lit("no_source").alias("reject_reason"))
        .unionByName(unlabelled.select(*raw, "reject_reason"))
    )
    return labelled.select(*S.FEATURE_COLS, "source", "label_scale"), rejects
