"""Spectra of signals: Welch power, aperiodic fits, peaks, quality flags, one grouped task per signal.

A signal is one group (its samples in order); groups are bounded by the length of a recording, and the work on one is
numpy over Arrow. Everything after the spectrum is plain columns again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


def welch(x: np.ndarray, rate: float, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Welch spectrum: Hann window, half overlap, means removed."""
    n = min(segment, len(x))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = max(1, n // 2)
    parts = np.stack([x[k : k + n] for k in range(0, len(x) - n + 1, step)])
    parts = (parts - parts.mean(1, keepdims=True)) * window
    power = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).mean(0) / (rate * (window**2).sum())
    power[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / rate), power


def psd(samples: DataFrame, rate: float = 1.0, segment: int = 64) -> DataFrame:
    """(signal, freq, power) of (signal, at, value) samples; too short, flat or non-finite signals give no rows."""
    kind = samples.schema["signal"].dataType.simpleString()

    def spectrum(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy(), kind="stable")
        x = table.column("value").to_numpy()[order].astype(float)
        ok = len(x) >= 8 and np.isfinite(x).all() and np.ptp(x) > 0
        f, p = welch(x, rate, segment) if ok else (np.zeros(0), np.zeros(0))
        own = table.column("signal").combine_chunks().take(pa.array(np.zeros(len(f), np.int64)))
        return pa.table({"signal": own, "freq": pa.array(f, pa.float64()), "power": pa.array(p, pa.float64())})

    return samples.select("signal", "at", "value").groupBy("signal").applyInArrow(spectrum, f"signal {kind}, freq double, power double")


def aperiodic_fit(spectra: DataFrame, low: float, high: float) -> DataFrame:
    """Line through log power over log frequency within a band (no DC): offset, exponent, R squared, bins."""
    band = spectra.where((F.col("freq") > 0) & (F.col("freq") >= low) & (F.col("freq") <= high) & (F.col("power") > 0))
    x, y = F.log10("freq"), F.log10("power")
    return band.groupBy("signal").agg(F.count(F.lit(1)).alias("n_bins"), F.regr_intercept(y, x).alias("offset"), (-F.regr_slope(y, x)).alias("exponent"), F.regr_r2(y, x).alias("r2"))


def peaks(spectra: DataFrame, fits: DataFrame, threshold: float, top: int) -> DataFrame:
    """Local maxima of the log power above the fitted line, the highest ``top`` of each signal."""
    j = spectra.where("freq > 0 AND power > 0").join(fits, "signal").withColumn("residual", F.log10("power") - (F.col("offset") - F.col("exponent") * F.log10("freq")))
    w = Window.partitionBy("signal").orderBy("freq")
    j = j.withColumn("before", F.lag("residual").over(w)).withColumn("after", F.lead("residual").over(w))
    best = F.row_number().over(Window.partitionBy("signal").orderBy(F.col("residual").desc(), "freq"))
    j = j.where((F.col("residual") > F.col("before")) & (F.col("residual") > F.col("after")) & (F.col("residual") >= threshold))
    return j.withColumn("rank", best).where(F.col("rank") <= top).select("signal", "freq", F.round("residual", 6).alias("height"), "rank")


def quality(fits: DataFrame, n_peaks: DataFrame, least_r2: float = 0.8, least_bins: int = 8, most_peaks: int = 6) -> DataFrame:
    """Flags of each fit and its verdict: any severe flag fails, any other warns."""
    j = fits.join(n_peaks, "signal", "left").fillna(0, ["n_peaks"])
    flag = lambda c, n: F.when(c, F.lit(n))
    flags = F.array_compact(F.array(flag(F.col("r2") < least_r2 / 2, "bad_fit"), flag((F.col("r2") >= least_r2 / 2) & (F.col("r2") < least_r2), "weak_fit"), flag(F.col("n_bins") < least_bins, "few_bins"), flag(F.col("n_peaks") > most_peaks, "many_peaks")))
    verdict = F.when(F.array_contains(flags, "bad_fit") | F.array_contains(flags, "few_bins"), "fail").when(F.size(flags) > 0, "warn").otherwise("pass")
    return j.select("signal", F.array_join(flags, ",").alias("flags"), verdict.alias("verdict"))
