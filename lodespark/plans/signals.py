"""Spectra of each event type's hourly totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodespark.operators import signals as G
from lodespark.sources import tables as S


def _samples(spark, d):
    e = S.table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.sum("value").alias("value"))
    return e.select(F.col("event_type").alias("signal"), F.unix_seconds("hour").alias("at"), "value")


def _fits(spark, d):
    return G.aperiodic_fit(G.psd(_samples(spark, d)), 0.02, 0.5)


def _peaks(spark, d):
    s = G.psd(_samples(spark, d))
    return G.peaks(s, G.aperiodic_fit(s, 0.02, 0.5), 0.05, 3)


def _quality(spark, d):
    s = G.psd(_samples(spark, d))
    fits = G.aperiodic_fit(s, 0.02, 0.5)
    return G.quality(fits, G.peaks(s, fits, 0.05, 10).groupBy("signal").agg(F.count(F.lit(1)).alias("n_peaks")))


def _trend(spark, d):
    """Line through the hourly totals in log-log: the part of a fit that SQL has."""
    s = _samples(spark, d).where("value > 0")
    return s.groupBy("signal").agg(F.round(F.regr_slope(F.log10("value"), F.log10("at")), 4).alias("slope"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "welch_psd": (lambda s, d: G.psd(_samples(s, d)), None),
    "aperiodic_fit": (_fits, None),
    "spectral_peaks": (_peaks, None),
    "spectral_quality": (_quality, None),
    "log_log_trend": (_trend, "WITH s AS (SELECT event_type AS signal, epoch(date_trunc('hour', ts)) AS at, sum(value) AS value FROM events GROUP BY ALL) SELECT signal, round(regr_slope(log10(value), log10(s.at)), 4) AS slope, count(*) AS n FROM s WHERE value > 0 GROUP BY signal"),
}
