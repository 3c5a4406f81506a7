"""Waveform features: column expressions where they suffice, one Arrow kernel for the rest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.functions import kernels

#: Features that relate a pulse to its data set: name -> (feature, divided by).
NORMALISED = {
    "norm_absolute_amplitude": ("absolute_amplitude", "floor"), "norm_peak_amplitude_positive": ("peak_amplitude_positive", "floor"),
    "norm_peak_amplitude_negative": ("peak_amplitude_negative", "floor"), "norm_peak_to_peak_amplitude": ("peak_to_peak_amplitude", "floor"),
    "norm_rms_amplitude": ("rms_amplitude", "floor"), "norm_slew_rate": ("slew_rate", "floor / dt"), "norm_energy": ("energy", "floor * floor * span"),
    "norm_charge": ("charge", "floor * span"), "norm_rise_time": ("rise_time", "pulse_width"), "norm_fall_time": ("fall_time", "pulse_width"),
    "norm_equivalent_time": ("equivalent_time", "span"), "norm_equivalent_bandwidth": ("equivalent_bandwidth", "span"),
    "norm_cumulative_energy_rise_time": ("cumulative_energy_rise_time", "pulse_width"), "norm_pulse_width": ("pulse_width", "span"),
    "norm_dominant_frequency": ("dominant_frequency", "0.5D / dt"), "norm_center_frequency": ("center_frequency", "0.5D / dt"),
    "norm_bandwidth_3db": ("bandwidth_3db", "0.5D / dt"), "norm_zero_crossing_rate": ("zero_crossing_count", "samples"), "norm_oscillation_rate": ("oscillation_count", "samples"),
}


def _batches(values: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) for each waveform length in a batch; nulls and empties are skipped."""
    length = values.map(lambda x: 0 if x is None else len(x)).to_numpy()
    for n in np.unique(length[length > 0]):
        at = np.flatnonzero(length == n)
        yield at, np.stack([np.asarray(values.iloc[i], dtype=float) for i in at])


def intrinsic_names() -> list[str]:
    return list(kernels.pulse_features(np.zeros((1, 64)), 1.0))


def intrinsic_features(pulses: DataFrame, keys: Sequence[str], waveform: str, dt: float) -> DataFrame:
    """(keys..., features): one kernel call per batch and waveform length. Waveforms that
    are null or empty, or hold a null or NaN sample, give null features."""
    names = intrinsic_names()
    types = dict(pulses.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keys)].copy()
            grid = np.full((len(batch), len(names)), np.nan)
            for at, rows in _batches(batch[waveform]):
                sound = np.isfinite(rows).all(axis=1)
                if sound.any():
                    found = kernels.pulse_features(rows[sound], dt)
                    grid[at[sound]] = np.stack([found[k] for k in names], axis=1)
            frame = pd.DataFrame(grid, columns=names, index=out.index)
            yield pd.concat([out, frame], axis=1)

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{n} double" for n in names)])
    got = pulses.select(*keys, waveform).mapInPandas(run, schema)
    bad = F.isnan("absolute_amplitude")
    return got.select(*keys, *[F.when(~bad, F.col(n)).alias(n) for n in names])


def with_normalised(features: DataFrame, dataset: str, samples: int, dt: float, step: float = kernels.ADC_STEP) -> DataFrame:
    """Adds the features that relate a pulse to its data set's noise floor, window and
    sampling: 74 in all with the phase angle. The floor is one aggregate per data set."""
    floors = features.groupBy(dataset).agg(F.greatest(F.lit(step), F.min("absolute_amplitude") - step).alias("floor"))
    f = floors.withColumnRenamed(dataset, "_ds")
    rows = features.join(f, features[dataset].eqNullSafe(f["_ds"])).drop("_ds")
    rows = rows.withColumns({"dt": F.lit(dt), "samples": F.lit(float(samples)), "span": F.lit(samples * dt)})
    ratio = {name: F.coalesce(F.try_divide(F.col(c), F.expr(by)), F.lit(0.0)) for name, (c, by) in NORMALISED.items()}
    out = rows.withColumns(ratio).withColumn("signal_to_noise_ratio", F.col("norm_absolute_amplitude"))
    if "phase_angle" not in features.columns:
        out = out.withColumn("phase_angle", F.lit(0.0))
    return out.drop("floor", "dt", "samples", "span")


def basic_features(pulses: DataFrame, keys: Sequence[str], waveform: str, dt: float, head: int = 50) -> DataFrame:
    """The features that higher-order functions express, without leaving the JVM. Null
    and empty waveforms are left out."""
    x = F.transform(waveform, lambda v: v.cast("double"))
    rows = pulses.where(F.size(waveform) > 0).select(*keys, x.alias("x"))
    n = F.size("x")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, v: s + v)
    base = F.when(n > head, total(F.slice("x", 1, head)) / head).otherwise(total(F.col("x")) / n)
    rows = rows.withColumn("base", base).select(*keys, F.transform("x", lambda v: v - F.col("base")).alias("w"))
    rows = rows.withColumns({
        "hi": F.array_max("w"), "lo": F.array_min("w"), "n": F.size("w"), "e": total(F.transform("w", lambda v: v * v)), "c": total(F.transform("w", F.abs)),
        "up": total(F.transform("w", lambda v: F.when(v > 0, v * v).otherwise(0.0))), "down": total(F.transform("w", lambda v: F.when(v < 0, v * v).otherwise(0.0))),
        "step": F.coalesce(F.array_max(F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda v, i: F.abs(v - F.get("w", i)))), F.lit(0.0)),
        "turn": F.size(F.filter(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda v, i: (v < 0) != (F.get("w", i) < 0))),
    })
    top = F.greatest(F.abs("hi"), F.abs("lo"))
    wide = F.filter(F.transform("w", lambda v, i: F.when(F.abs(v) >= 0.5 * top, i)), lambda i: i.isNotNull())
    rms = F.sqrt(F.col("e") / F.col("n"))
    area = F.when(F.col("down") > 0, F.col("up") / F.when(F.col("down") > 0, F.col("down"))).when(F.col("up") > 0, F.lit(float("inf"))).otherwise(1.0)
    out = {
        "peak_amplitude_positive": F.col("hi"), "peak_amplitude_negative": F.col("lo"), "absolute_amplitude": top, "peak_to_peak_amplitude": F.col("hi") - F.col("lo"),
        "rms_amplitude": rms, "crest_factor": F.coalesce(F.try_divide(top, rms), F.lit(0.0)), "pulse_width": (F.array_max(wide) - F.array_min(wide)) * dt,
        "slew_rate": F.col("step") / dt, "energy": F.col("e") * dt, "charge": F.col("c") * dt, "energy_charge_ratio": F.coalesce(F.try_divide("e", "c"), F.lit(0.0)),
        "cumulative_energy_area_ratio": area, "zero_crossing_count": F.col("turn").cast("double"),
    }
    return rows.select(*keys, *[c.alias(k) for k, c in out.items()])


def polarity_methods(pulses: DataFrame, keys: Sequence[str], waveform: str) -> DataFrame:
    """(keys..., one sign per method); null for null or empty waveforms."""
    names = list(kernels.polarities(np.ones((1, 4))))
    types = dict(pulses.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[list(keys)].copy()
            grid = np.zeros((len(batch), len(names)), dtype=int)
            for at, rows in _batches(batch[waveform]):
                found = kernels.polarities(rows)
                grid[at] = np.stack([found[k] for k in names], axis=1)
            yield pd.concat([out, pd.DataFrame(grid, columns=names, index=out.index)], axis=1)

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{n} int" for n in names)])
    got = pulses.select(*keys, waveform).mapInPandas(run, schema)
    return got.select(*keys, *[F.when(F.col(n) != 0, F.col(n)).alias(n) for n in names])


def window_comparison(pulses: DataFrame, group: str, waveform: str, dt: float) -> DataFrame:
    """Per group and window method: waveforms, mean length, reduction against the original
    and share of windows with several pulses. Batches are added up before the shuffle."""
    types = dict(pulses.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, matrix in _batches(batch[waveform]):
                for i, w in zip(at, kernels.baselined(matrix), strict=True):
                    for method in kernels.WINDOW_METHODS:
                        lo, hi = kernels.window_bounds(w, dt, method)
                        rows.append((batch[group].iloc[i], method, 1, hi - lo, len(w), int(len(kernels.pulse_peaks(w[lo:hi], dt)) > 1)))
            frame = pd.DataFrame(rows, columns=[group, "method", "n", "kept", "whole", "multi"])
            yield frame.groupby([group, "method"], as_index=False, dropna=False).sum()

    parts = pulses.select(group, waveform).mapInPandas(run, f"{group} {types[group]}, method string, n long, kept long, whole long, multi long")
    sums = parts.groupBy(group, "method").agg(*[F.sum(c).alias(c) for c in ("n", "kept", "whole", "multi")])
    return sums.select(
        group, "method", F.col("n").alias("n_waveforms"), (F.col("kept") / F.col("n")).alias("mean_length"),
        (1 - F.col("kept") / F.col("whole")).alias("reduction"), (F.col("multi") / F.col("n")).alias("multi_pulse_share"),
    )



def best_windows(comparison: DataFrame, group: str, whole: str = "original") -> DataFrame:
    """(group, method, multi_pulse_reduction): the method that leaves the smallest share of
    windows with several pulses, by how much of the whole waveforms' share it takes away;
    the first in the order of the methods if several do. Null and 0 where none helps.
    ``comparison`` is the result of window_comparison."""
    place = F.coalesce(*[F.when(F.col("method") == m, i) for i, m in enumerate(kernels.WINDOW_METHODS)], F.lit(len(kernels.WINDOW_METHODS)))
    best = comparison.groupBy(group).agg(
        F.max(F.when(F.col("method") == whole, F.col("multi_pulse_share"))).alias("_whole"),
        F.min(F.when(F.col("method") != whole, F.struct(F.col("multi_pulse_share").alias("share"), place.alias("place"), "method"))).alias("_best"),
    )
    less = F.col("_best.share") < F.col("_whole")
    return best.select(
        group, F.when(less, F.col("_best.method")).alias("method"), F.coalesce(F.when(less, 1 - F.try_divide(F.col("_best.share"), F.col("_whole"))), F.lit(0.0)).alias("multi_pulse_reduction")
    )
