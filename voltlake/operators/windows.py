"""Windows around events by band: their width, and which are kept where they overlap."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlake.operators.events import CHUNK, with_previous
from voltlake.runtime import materialize, row_count_up_to

# Samples before and after an event of each band at 250 million a second.
BAND_WINDOWS = {"D1": (50, 200), "D2": (100, 400), "D3": (250, 1000), "D4": (500, 2000), "D5": (1000, 4000)}
RATE = 250e6


def scaled_windows(rate: float = RATE) -> dict[str, tuple[int, int]]:
    """The windows of the bands at another sampling rate."""
    return {band: (int(pre * rate / RATE), int(post * rate / RATE)) for band, (pre, post) in BAND_WINDOWS.items()}


def band_range(level: int, rate: float) -> tuple[float, float]:
    """Lowest and highest frequency of a detail band."""
    return rate / 2 / 2**level, rate / 2 / 2 ** (level - 1)


def kept_windows(events: DataFrame, channel: str, index: str, key: str, band: str, windows: Mapping[str, tuple[int, int]] = BAND_WINDOWS) -> DataFrame:
    """(channel, key, index, band, start, stop) of the events whose window begins behind the
    end of the window kept before, walking each channel by (index, key). ``stop`` is one
    behind the last sample; windows that only touch overlap, as start <= stop counts.

    Events without a known band or an index, or whose window begins before 0, have no
    window and hide no other. Keys are unique; repeated rows of a key count once.

    An event farther behind its predecessor than any two windows reach is always kept.
    Any other kept event is the first of its band that begins behind the window of the one
    kept before, so each event points to that one, and pointers are doubled from the
    always kept ones on.
    """
    pre = F.coalesce(*[F.when(F.col("b") == b, p) for b, (p, _) in windows.items()])
    post = F.coalesce(*[F.when(F.col("b") == b, q) for b, (_, q) in windows.items()])
    rows = events.select(F.col(channel).alias("ch"), F.col(key).alias("k"), F.col(index).cast("long").alias("x"), F.col(band).alias("b"))
    rows = rows.withColumn("s", F.col("x") - pre).withColumn("e", F.col("x") + post).where(F.col("s") >= 0).dropDuplicates(["ch", "k"])
    reach = max(p for p, _ in windows.values()) + max(q for _, q in windows.values())
    width = max(CHUNK, 4 * reach)
    marked = with_previous(materialize(rows, "windows"), "ch", "x", ["k"], width)
    marked = marked.withColumn("head", F.col("_prev").isNull() | (F.col("x") - F.col("_prev") > reach)).drop("_prev")

    own = F.floor(F.col("x") / width)
    copies = F.explode(F.when(F.col("x") - own * width <= 2 * reach + 1, F.array(own, own - 1)).otherwise(F.array(own)))
    spread = marked.select("*", own.alias("_own"), copies.alias("_c"))
    order = Window.partitionBy("ch", "_c").orderBy("x")
    nexts = []
    for mine, (_, after) in windows.items():
        # one frame for each band that may follow; the bands are few and fixed
        firsts = [F.min(F.when(F.col("b") == b, F.struct("x", "k"))).over(order.rangeBetween(after + before + 1, 2 * reach + 1)) for b, (before, _) in windows.items()]
        nexts.append(F.when(F.col("b") == mine, F.least(*firsts) if len(firsts) > 1 else firsts[0]))
    pointed = spread.withColumn("_n", F.coalesce(*nexts)).where(F.col("_c") == F.col("_own"))
    pointed = materialize(pointed.select("ch", "k", "x", "b", "s", "e", "head", F.col("_n.k").alias("to")), "pointers")

    jumps = [pointed.where(F.col("to").isNotNull()).select("ch", "k", "to")]
    while row_count_up_to(jumps[-1], 0):
        a = jumps[-1]
        b = a.select(F.col("ch").alias("_ch"), F.col("k").alias("_k"), F.col("to").alias("far"))
        jumps.append(materialize(a.join(b, a["ch"].eqNullSafe(b["_ch"]) & (a["to"] == b["_k"])).select("ch", "k", F.col("far").alias("to")), "jumps"))
    kept = pointed.where("head").select("ch", "k")
    for jump in reversed(jumps[:-1]):
        j = jump.select(F.col("ch").alias("_ch"), F.col("k").alias("_k"), "to")
        more = kept.join(j, kept["ch"].eqNullSafe(j["_ch"]) & (kept["k"] == j["_k"])).select("ch", F.col("to").alias("k"))
        kept = materialize(kept.unionByName(more).distinct(), "kept")
    found = kept.select(F.col("ch").alias("_ch"), F.col("k").alias("_k"))
    both = pointed.join(found, pointed["ch"].eqNullSafe(found["_ch"]) & (pointed["k"] == found["_k"]))
    return both.select(F.col("ch").alias(channel), F.col("k").alias(key), F.col("x").alias(index), F.col("b").alias(band), F.col("s").alias("start"), F.col("e").alias("stop"))
