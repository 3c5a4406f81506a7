"""Binary records: FastFrame ``WFM#003`` files and ``PDN`` streams of big-endian floats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the file layout.
MAGIC, MAGIC_AT = b":WFM#003", 2
LENGTH_AT, STEP_AT, DATA_AT, DATA_DEFAULT = 0x48, (0xA0, 0xA8, 0xE0, 0x20), (300, 500, 750, 838, 1000), 838
STEP_RANGE, STEP_DEFAULT, FRAME_CAP, FULL_SCALE = (1e-12, 1e-3), 4e-9, 500, 32768.0


def decode_wfm(data: bytes) -> tuple[float, np.ndarray]:
    """(sample interval, frames) of one file; raises ValueError on another magic."""
    if data[MAGIC_AT : MAGIC_AT + len(MAGIC)] != MAGIC:
        raise ValueError("no WFM#003 file")
    length = int(np.frombuffer(data, "<u4", 1, LENGTH_AT)[0]) if len(data) >= LENGTH_AT + 4 else 0
    steps = [float(np.frombuffer(data, "<f8", 1, at)[0]) for at in STEP_AT if len(data) >= at + 8]
    dt = next((s for s in steps if STEP_RANGE[0] < s < STEP_RANGE[1]), STEP_DEFAULT)

    def lively(at: int) -> bool:
        part = data[at : at + 200]
        return len(part) == 200 and np.frombuffer(part, "<i2").astype(float).var() > 1000

    start = next((at for at in DATA_AT if lively(at)), DATA_DEFAULT)
    body = data[start : start + (len(data) - start) // 2 * 2] if len(data) > start else b""
    volts = np.frombuffer(body, "<i2").astype(float) / FULL_SCALE
    if not len(volts):
        return dt, volts.reshape(0, 0)
    samples = len(volts) // max(length, 1) if length > 1000 else length
    samples = min(max(samples, 1), len(volts))
    frames = len(volts) // samples
    frames = frames if length > 1000 else min(frames, FRAME_CAP)
    return dt, volts[: frames * samples].reshape(frames, samples)


def decode_pdn(data: bytes) -> np.ndarray:
    """Samples after the 8-byte header; a broken last value is left out."""
    body = data[8 : 8 + max(len(data) - 8, 0) // 4 * 4]
    return np.frombuffer(body, ">f4").astype(float)


def _binary(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def wfm_waveforms(spark: SparkSession, path: str) -> DataFrame:
    """(path, pulse_id, waveform, sample_interval, error): a row per frame; a file that is
    no WFM#003 gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "pulse_id", "waveform", "sample_interval", "error"]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    dt, frames = decode_wfm(bytes(data))
                    rows = [(name, i, f.tolist(), dt, None) for i, f in enumerate(frames)]
                except ValueError as e:
                    rows = [(name, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=columns).astype({"pulse_id": "Int64"})

    return _binary(spark, path, "*.wfm").mapInPandas(run, "path string, pulse_id long, waveform array<double>, sample_interval double, error string")


def pdn_samples(spark: SparkSession, path: str) -> DataFrame:
    """(path, samples) of each PDN file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "samples": [decode_pdn(bytes(x)).tolist() for x in batch["content"]]})

    return _binary(spark, path, "*.pdn").mapInPandas(run, "path string, samples array<double>")


def compare_samples(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tolerance: float = 1e-5) -> DataFrame:
    """(keys..., n, same, max_difference, mean_difference) of two arrays by position."""
    both = left.join(right, keys)
    off = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= 1e-8 + tolerance * F.abs(y))
    total = F.aggregate(off, F.lit(0.0), lambda s, x: s + x)
    return both.select(*keys, F.size(a).alias("n"), F.forall(near, lambda ok: F.coalesce(ok, F.lit(False))).alias("same"), F.array_max(off).alias("max_difference"), F.try_divide(total, F.size(off)).alias("mean_difference"))
