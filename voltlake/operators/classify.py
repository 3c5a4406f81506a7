"""Discharge types from group statistics: a table of scored tests as column arithmetic.

A test is (features to look up, default, low, high): it holds if the first feature that
exists lies between the bounds. Rules give points to a score if all their tests hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


@dataclass(frozen=True)
class Test:
    """low < feature < high, or with ``closed`` low <= feature <= high; ``size`` tests |feature|."""

    feature: str
    default: float
    low: float = -INF
    high: float = INF
    closed: bool = False
    size: bool = False


@dataclass(frozen=True)
class Rule:
    score: str
    points: float
    tests: tuple[Test, ...]


def _r(score: str, points: float, *tests: Test) -> Rule:
    return Rule(score, points, tests)


# Feature, default if missing, bounds and points of each test.
RULES = (
    _r("noise", 0.15, Test("spectral_flatness", 0.0, low=0.6)),
    _r("noise", 0.15, Test("slew_rate", 1e9, high=1e6)),
    _r("noise", 0.15, Test("crest_factor", 10.0, high=3.0)),
    _r("noise", 0.10, Test("cross_correlation", 0.5, high=0.3)),
    _r("noise", 0.10, Test("oscillation_count", 5.0, low=20.0)),
    _r("noise", 0.15, Test("signal_to_noise_ratio", 10.0, high=3.0)),
    _r("noise", 0.10, Test("coefficient_of_variation", 0.0, low=2.0)),
    _r("noise", 0.05, Test("bandwidth_3db", 1e9, high=2e6)),
    _r("noise", 0.10, Test("dominant_frequency", 1e6, high=1e6)),
    _r("noise", 0.10, Test("phase_entropy", 0.0, low=0.95)),
    _r("noise", 0.08, Test("amplitude_coefficient_of_variation", 0.0, low=1.5)),
    _r("noise", 0.10, Test("pulses_per_cycle", 0.0, low=20.0, high=1000.0)),
    _r("noise", 0.15, Test("signal_to_noise_ratio", 10.0, high=6.0)),
    _r("noise", 0.10, Test("absolute_amplitude", 0.01, high=0.001)),
    _r("protect_focused", 0.20, Test("phase_entropy", 1.0, high=0.6), Test("signal_to_noise_ratio", 0.0, low=7.0)),
    _r("protect_spread", 0.40, Test("phase_spread", 0.0, low=100.0), Test("oscillation_count", 0.0, low=20.0)),
    _r("protect_symmetric", 0.20, Test("discharge_asymmetry", 1.0, high=0.3, size=True), Test("cross_correlation", 0.0, low=0.3)),
    _r("surface", 4, Test("phase_spread", 0.0, low=30.0)),
    _r("surface", 4, Test("phase_entropy", 1.0, high=0.6), Test("signal_to_noise_ratio", 0.0, low=7.0), Test("slew_rate", 1e7, high=1e7)),
    _r("surface", 3, Test("slew_rate", 1e7, high=5e6)),
    _r("surface", 3, Test("spectral_power_ratio", 0.5, high=0.5)),
    _r("surface", 3, Test("coefficient_of_variation", 0.3, low=0.4)),
    _r("surface", 2, Test("crest_factor", 5.0, 4.0, 10.0, closed=True)),
    _r("surface", 2, Test("cross_correlation", 0.5, 0.4, 0.6, closed=True)),
    _r("surface", 1, Test("spectral_flatness", 0.4, 0.4, 0.5, closed=True)),
    _r("surface", 1, Test("repetition_rate_variance", 0.4, low=0.5)),
    _r("surface", 1, Test("dominant_frequency", 3e6, 1e6, 5e6, closed=True)),
    _r("corona", 4, Test("discharge_asymmetry", 0.0, low=0.6, size=True)),
    _r("internal", 4, Test("discharge_asymmetry", 0.0, -0.9, 0.9, closed=True)),
    _r("corona", 4, Test("phase_of_max_activity", 0.0, 180.0, 360.0, closed=True)),
    _r("corona", 4, Test("phase_of_max_activity", 0.0, 0.0, 90.0, closed=True)),
    _r("internal", 4, Test("phase_of_max_activity", 0.0, 45.0, 90.0, closed=True)),
    _r("internal", 4, Test("phase_of_max_activity", 0.0, 225.0, 270.0, closed=True)),
    _r("internal", 4, Test("amplitude_phase_correlation", 0.4, 0.5, INF, closed=True)),
    _r("corona", 4, Test("amplitude_phase_correlation", 0.4, -INF, 0.3, closed=True)),
    _r("internal", 4, Test("spectral_power_low", 0.7, 0.85, INF, closed=True)),
    _r("corona", 4, Test("spectral_power_low", 0.7, -INF, 0.6, closed=True)),
    _r("corona", 2, Test("slew_rate", 1e7, low=5e7)),
    _r("internal", 2, Test("slew_rate", 1e7, 1e7, 5e7, closed=True)),
    _r("corona", 2, Test("oscillation_count", 50.0, 90.0, INF, closed=True)),
    _r("internal", 2, Test("oscillation_count", 50.0, high=90.0)),
    _r("corona", 2, Test("crest_factor", 5.0, 7.0, INF, closed=True)),
    _r("internal", 2, Test("crest_factor", 5.0, 4.0, 6.5, closed=True)),
    _r("corona", 2, Test("spectral_power_ratio", 1.0, low=1.5)),
    _r("internal", 2, Test("spectral_power_ratio", 1.0, 0.8, 1.5, closed=True)),
    _r("corona", 2, Test("norm_slew_rate", 6.0, 8.0, INF, closed=True)),
    _r("internal", 2, Test("norm_slew_rate", 6.0, -INF, 5.0, closed=True)),
    _r("corona", 2, Test("dominant_frequency", 1e7, 1.5e7, INF, closed=True)),
    _r("internal", 2, Test("dominant_frequency", 1e7, 5e6, 3e7, closed=True)),
    _r("corona", 1, Test("coefficient_of_variation", 0.2, high=0.15)),
    _r("internal", 1, Test("coefficient_of_variation", 0.2, 0.15, 0.35, closed=True)),
    _r("corona", 1, Test("quadrant_3_percentage", 40.0, low=55.0)),
    _r("internal", 1, Test("quadrant_3_percentage", 40.0, 35.0, 50.0, closed=True)),
    _r("corona", 1, Test("repetition_rate", 60.0, low=100.0)),
    _r("internal", 1, Test("repetition_rate", 60.0, 20.0, 100.0, closed=True)),
)

# The codes of the types; rows without a cluster bear this label.
TYPE_CODES = {"NOISE": 0, "NOISE_MULTIPULSE": 5, "CORONA": 1, "INTERNAL": 2, "SURFACE": 3, "UNKNOWN": 4}
NO_CLUSTER = -1

# Fixed values of the decision: least scores and the most that each can reach.
NOISE_LIMIT, SURFACE_LIMIT, PAIR_LIMIT = 0.35, 8.0, 15.0
SURFACE_MOST, PAIR_MOST = 24.0, 31.0
SPREAD_LIMIT = 30.0


def num(x: float) -> str:
    """A literal that every SQL dialect reads as a double."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def lookup(feature: str, default: float, columns: Sequence[str], prefix: str = "mean_") -> str | None:
    """The column that holds a feature: its mean over pulses, or the group's own."""
    return next((c for c in (prefix + feature, feature) if c in columns), None)


def value_text(t: Test, columns: Sequence[str]) -> str:
    """SQL for the value that a test looks at."""
    column = lookup(t.feature, t.default, columns)
    text = f"coalesce({column}, {num(t.default)})" if column else num(t.default)
    return f"abs({text})" if t.size else text


def held_text(rule: Rule, columns: Sequence[str]) -> str:
    """SQL for whether all tests of a rule hold."""
    parts = []
    for t in rule.tests:
        less, value = "<=" if t.closed else "<", value_text(t, columns)
        if t.low > -INF:
            parts.append(f"{num(t.low)} {less} {value}")
        if t.high < INF:
            parts.append(f"{value} {less} {num(t.high)}")
    return " AND ".join(parts)


def score_texts(columns: Sequence[str], rules: Sequence[Rule] = RULES) -> dict[str, str]:
    """SQL expressions of the scores over the given columns; missing features take the
    rule's default, and tests whose outcome is then known are folded away."""
    scores: dict[str, list[str]] = {}
    for r in rules:
        scores.setdefault(r.score, []).append(f"CASE WHEN {held_text(r, columns)} THEN {num(r.points)} ELSE 0e0 END")
    return {k: " + ".join(v) for k, v in scores.items()}


def decision_texts(columns: Sequence[str], noise: str = "", surface: str = "", pair: str = "") -> dict[str, str]:
    """SQL expressions for ``pd_type`` and ``confidence`` from the score columns; the
    least scores may be columns too. A ``cluster`` of -1 is what no cluster took: noise."""
    noise_limit, surface_limit, pair_limit = noise or num(NOISE_LIMIT), surface or num(SURFACE_LIMIT), pair or num(PAIR_LIMIT)

    def get(feature: str, default: float) -> str:
        column = lookup(feature, default, columns)
        return f"coalesce({column}, {num(default)})" if column else num(default)

    noise = "greatest(0e0, greatest(0e0, greatest(0e0, noise - protect_focused) - protect_spread) - protect_symmetric)"
    many = f"({get('is_multi_pulse', 0.0)} > 5e-1 OR {get('pulse_count', 0.0)} >= 2)"
    spread = get("phase_spread", 0.0)
    kept = f"(({get('spectral_power_low', 0.0)} > 5e-1 OR {get('amplitude_phase_correlation', 0.0)} > 3e-1) AND {spread} > 80)"
    like_corona = f"({get('oscillation_count', 0.0)} > 20 AND {get('slew_rate', 1e9)} < 1e6)"
    skip = f"({spread} > {SPREAD_LIMIT} AND ({like_corona} OR {get('spectral_power_low', 0.0)} > 7e-1))"
    steps = [(f"cluster = {NO_CLUSTER}", "'NOISE'", "9.5e-1")] if "cluster" in columns else []
    steps += [
        (f"{many} AND NOT {kept}", "'NOISE_MULTIPULSE'", "9e-1"),
        (f"round({noise}, 9) >= {noise_limit}", "'NOISE'", f"least(5e-1 + {noise}, 9.5e-1)"),
        (f"{spread} > {SPREAD_LIMIT} AND NOT {skip}", "'SURFACE'", "8.5e-1"),
        (f"NOT {skip} AND surface >= {surface_limit}", "'SURFACE'", f"least(5e-1 + 4e-1 * surface / {num(SURFACE_MOST)}, 9e-1)"),
        (f"corona >= {pair_limit} AND corona > internal", "'CORONA'", f"least(5e-1 + 4e-1 * corona / {num(PAIR_MOST)}, 9.5e-1)"),
        (f"internal >= {pair_limit} AND internal > corona", "'INTERNAL'", f"least(5e-1 + 4e-1 * internal / {num(PAIR_MOST)}, 9.5e-1)"),
        (f"corona >= {pair_limit} AND internal >= {pair_limit} AND {get('discharge_asymmetry', 0.0)} < -2e-1", "'CORONA'", "6e-1"),
        (f"corona >= {pair_limit} AND internal >= {pair_limit}", "'INTERNAL'", "6e-1"),
        (f"corona > internal AND corona >= {pair_limit} / 2", "'CORONA'", "4.5e-1"),
        (f"internal > corona AND internal >= {pair_limit} / 2", "'INTERNAL'", "4.5e-1"),
    ]
    kind = "CASE " + " ".join(f"WHEN {c} THEN {k}" for c, k, _ in steps) + " ELSE 'UNKNOWN' END"
    sure = "CASE " + " ".join(f"WHEN {c} THEN {s}" for c, _, s in steps) + " ELSE 3e-1 END"
    return {"pd_type": kind, "confidence": sure}


def classified(groups, rules: Sequence[Rule] = RULES):
    """Adds the scores, ``pd_type`` and ``confidence`` to one row per group."""
    columns = groups.columns
    scored = groups.select("*", *[F.expr(text).alias(name) for name, text in score_texts(columns, rules).items()])
    return scored.select("*", *[F.expr(text).alias(name) for name, text in decision_texts(columns).items()])


def rule_outcomes(groups, keys: Sequence[str], rules: Sequence[Rule] = RULES):
    """(keys..., rule, score, features, value, points): every rule of every group with what
    its first test looked at, and the points it gave (0 where a test failed)."""
    columns = groups.columns
    outcomes = [
        F.struct(
            F.lit(i).alias("rule"), F.lit(r.score).alias("score"), F.lit(" ".join(t.feature for t in r.tests)).alias("features"),
            F.expr(value_text(r.tests[0], columns)).cast("double").alias("value"), F.expr(f"CASE WHEN {held_text(r, columns)} THEN {num(r.points)} ELSE 0e0 END").alias("points"),
        )
        for i, r in enumerate(rules)
    ]
    return groups.select(*keys, F.inline(F.array(*outcomes)))


def recall_by_type(judged, expected: str, predicted: str, weight: Column | None = None):
    """(expected, n, hits, recall): the share of each expected type that was found as that
    type; NOISE accepts NOISE_MULTIPULSE. A type without weight has a null recall."""
    w = weight if weight is not None else F.lit(1)
    right = F.col(expected).eqNullSafe(F.col(predicted)) | ((F.col(expected) == "NOISE") & (F.col(predicted) == "NOISE_MULTIPULSE"))
    sums = judged.groupBy(expected).agg(F.sum(w).alias("n"), F.sum(F.when(right, w).otherwise(0)).alias("hits"))
    return sums.withColumn("recall", F.try_divide("hits", "n"))


def type_code(kind: Column) -> Column:
    """The number of a type; that of UNKNOWN for any other name."""
    return F.coalesce(*[F.when(kind == k, n) for k, n in TYPE_CODES.items()], F.lit(TYPE_CODES["UNKNOWN"]))


def confusion(rows, expected: str, predicted: str, weight: Column | None = None):
    """(expected, predicted, n) with totals where either is null (all types)."""
    n = F.sum(weight if weight is not None else F.lit(1))
    return rows.cube(expected, predicted).agg(n.alias("n"))
