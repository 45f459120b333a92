"""Scores of candidates as column expressions: permeability, activity, toxicity, reward, verdicts.

Every function takes and returns columns and stays inside whole-stage code generation.
Null inputs give null unless a docstring says otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x held between low and high; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the points of the rules that hold."""
    out = F.lit(0.0)
    for condition, value in rules:
        out = out + F.when(condition, value).otherwise(0.0)
    return out


def bands(x: Column, *steps: tuple[float, object], otherwise) -> Column:
    """The label of the first bound that x exceeds."""
    out = F.lit(otherwise)
    for bound, label in reversed(steps):
        out = F.when(x > bound, F.lit(label)).otherwise(out)
    return out


# --- blood-brain barrier


def log_bb_line(logp: Column, tpsa: Column) -> Column:
    """Clark and Delaney's line."""
    return 0.152 * logp - 0.0148 * tpsa + 0.139


def log_bb(logp: Column, tpsa: Column, mw: Column, hbd: Column, hba: Column) -> Column:
    """The line less penalties for size and hydrogen bonding, one after another; -2 for a missing molecule.

    Less their sum it would differ in the last bit, and so fall on the other side of a band's bound.
    """
    out = log_bb_line(logp, tpsa)
    for condition, cost in ((mw > 450, 0.20), (hbd > 2, 0.15), (hba > 6, 0.10)):
        out = out - F.when(condition, cost).otherwise(0.0)
    return F.coalesce(out, F.lit(-2.0))


def bbb_band(x: Column) -> Column:
    return bands(x, (-0.1, "high"), (-0.3, "medium"), (-0.5, "low"), otherwise="very_low")


def bbb_score(x: Column) -> Column:
    return clamp((x + 1.0) / 1.5)


# --- activity and toxicity


def activity(logp: Column, mw: Column, tpsa: Column, aromatic_n: Column) -> Column:
    """Predicted pIC50; 4 for a missing molecule."""
    hits = points((logp > 3, 0.3), ((mw > 300) & (mw < 600), 0.25), (tpsa < 100, 0.25), (aromatic_n, 0.2))
    return F.when(logp.isNull(), 4.0).otherwise(F.least(F.lit(9.0), 5.0 + 2.0 * hits))


def toxicity(logp: Column, mw: Column, reactive: Column) -> Column:
    lipophilic = F.when(logp > 4.5, 0.8).otherwise(0.1)
    large = F.when(mw > 600, 0.3).otherwise(0.05)
    return F.least(F.lit(8.0), 4.0 + 2.0 * (lipophilic + 0.2 * reactive + large))


def toxicity_score(logp, mw, reactive, pains, nih, brenk, herg, cyp) -> Column:
    """The alert-based score between 0 and 1."""
    score = (
        bands(logp, (5.0, 0.30), (4.5, 0.20), (4.0, 0.10), otherwise=0.0)
        + F.least(F.lit(0.30), 0.05 * reactive + F.when(reactive > 0, 0.05).otherwise(0.0))
        + F.least(F.lit(0.20), 0.05 * pains)
        + F.least(F.lit(0.10), 0.02 * (nih + brenk))
        + points((herg, 0.20), (cyp, 0.05))
        + bands(mw, (650.0, 0.10), (600.0, 0.05), otherwise=0.0)
    )
    return F.least(F.lit(1.0), score)


def activity_norm(a: Column) -> Column:
    return clamp((a - 5.0) / 3.0)


def toxicity_norm(t: Column) -> Column:
    return clamp(1.0 - (t - 4.0) / 4.0)


def selectivity(a: Column, t: Column) -> Column:
    return F.when(t > 0, a / t).otherwise(0.0)


def druglikeness(mw, logp, hbd, hba, qed) -> Column:
    passes = sum(((c).cast("int") for c in (mw <= 500, logp <= 5, hbd <= 5, hba <= 10)), F.lit(0))
    return clamp(0.5 * (passes / 4.0) + 0.5 * qed)


def synthetic_access(heavy: Column, rings: Column, chiral: Column) -> Column:
    """The fallback score of synthetic accessibility, 1 to 10."""
    zero = F.lit(0)
    return clamp(8.0 - 0.05 * F.greatest(zero, heavy - 50) - 0.5 * F.greatest(zero, rings - 4) - 0.2 * chiral, 1.0, 10.0)


def synthetic_access_legacy(mw: Column, rings: Column, chiral: Column, hetero_ratio: Column) -> Column:
    """The older rule: what exceeds 500 Da, three rings or no stereo centre costs, a share of hetero atoms over 0.3 pays; 3 for a missing molecule."""
    zero = F.lit(0.0)
    cost = F.greatest(zero, mw - 500.0) / 100.0 + 0.5 * F.greatest(zero, rings - 3.0) + 0.3 * chiral
    return F.when(mw.isNotNull(), clamp(8.0 - cost + F.when(hetero_ratio > 0.3, 0.5).otherwise(0.0), 1.0, 10.0)).otherwise(3.0)


def composite(bbb, act, tox, access, drug) -> Column:
    """Weighted mean of the five normalised scores."""
    return 0.35 * bbb + 0.25 * act + 0.15 * tox + 0.20 * access / 10.0 + 0.05 * drug


def assessment(score: Column, band: Column) -> Column:
    word = bands(score, (0.8, "excellent"), (0.6, "good"), (0.4, "moderate"), otherwise="poor")
    return F.concat(word, F.lit(" candidate, composite "), F.format_string("%.2f", F.round(score - 1e-9, 2)), F.lit(", permeability "), band)


# --- physical reward


@dataclass(frozen=True)
class Cutoffs:
    """Hard cut-offs; a caller's own values replace single ones."""

    vina: float = -5.0
    dili: float = 0.95
    herg: float = 0.90
    mw_low: float = 200.0
    mw_high: float = 700.0
    tpsa_low: float = 20.0
    tpsa_high: float = 140.0
    delta: float = 0.05


@dataclass(frozen=True)
class Weights:
    vina: float = 0.30
    dili: float = 0.20
    herg: float = 0.20
    bbb: float = 0.20
    physchem: float = 0.10


def pseudo_dock(mw: Column, logp: Column, tpsa: Column) -> Column:
    return clamp(-0.08 * mw + 0.4 * logp - 0.008 * tpsa - 5.5, -12.0, -4.0)


def vina_norm(vina: Column) -> Column:
    """0.5 where there is no docking score."""
    return F.coalesce(clamp((-4.0 - vina) / 8.0), F.lit(0.5))


def tpsa_norm(t: Column) -> Column:
    falling = F.greatest(F.lit(-1.0), 1.0 - 2.0 * (t - 90.0) / 50.0)
    return (
        F.when(t > 140, -1.0).when(t > 90, falling).when(t >= 40, 1.0).when(t >= 20, 0.5 + 0.5 * (t - 20.0) / 20.0).when(t < 20, -1.0)
    )


def mw_norm(mw: Column) -> Column:
    return F.when(mw < 300, mw / 300.0).when(mw <= 500, 1.0).when(mw > 500, F.greatest(F.lit(0.0), 1.0 - (mw - 500.0) / 200.0))


def reward(vina_n, dili, herg, bbb, tpsa_n, mw_n, weights: Weights = Weights()) -> Column:
    """Weighted geometric mean; zero where the surface term is negative."""
    floor = lambda x: F.greatest(x, F.lit(1e-8))
    physchem = F.sqrt(floor(tpsa_n) * floor(mw_n))
    parts = ((vina_n, weights.vina), (1.0 - dili, weights.dili), (1.0 - herg, weights.herg), (bbb, weights.bbb), (physchem, weights.physchem))
    total = F.lit(0.0)
    for value, weight in parts:
        total = total + F.lit(weight) * F.ln(floor(value))
    return F.when(tpsa_n < 0, 0.0).otherwise(clamp(F.exp(total)))


def verdict(r: Column, strict: bool = False) -> Column:
    """sure or likely; with ``strict`` also impossible below 0.4."""
    out = F.when(r >= 0.7, "sure")
    return (out.when(r < 0.4, "impossible") if strict else out).otherwise("likely")


def prune_reason(vina, dili, herg, mw, tpsa, base_dili=None, base_herg=None, cut: Cutoffs = Cutoffs()) -> Column:
    """The first hard cut-off that is missed, or null.

    Toxicity over its cut-off is forgiven where it rose by no more than ``delta`` over the
    parent's value; a missing parent value forgives nothing.
    """

    def over(x, bound, base):
        high = x > bound
        return high if base is None else high & ~F.coalesce(x - base <= cut.delta, F.lit(False))

    rules = (
        (vina > cut.vina, "vina"),
        (over(dili, cut.dili, base_dili), "dili"),
        (over(herg, cut.herg, base_herg), "herg"),
        ((mw < cut.mw_low) | (mw > cut.mw_high), "mw"),
        (tpsa > cut.tpsa_high, "tpsa_high"),
        (tpsa < cut.tpsa_low, "tpsa_low"),
    )
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules])


def herg_probability(alerts: Column, warhead: Column, logp: Column, mw: Column, basic_n: Column) -> Column:
    base = 0.20 * alerts * F.when(warhead & (alerts > 0), 0.75).otherwise(1.0)
    return clamp(base + bands(logp, (5.5, 0.20), (4.5, 0.10), otherwise=0.0) + points((mw > 600, 0.10), (basic_n >= 2, 0.15)))


def dili_probability(alerts: Column, warhead: Column, logp: Column, mw: Column, pains: Column) -> Column:
    base = (0.25 * alerts + F.when(alerts >= 2, 0.25).otherwise(0.0)) * F.when(warhead & (alerts > 0), 0.25).otherwise(1.0)
    late = bands(mw, (800.0, 0.15), (700.0, 0.05), otherwise=0.0) + bands(logp, (5.5, 0.10), (4.5, 0.05), otherwise=0.0)
    return clamp(base + late + F.when(pains, 0.20).otherwise(0.0))


def admet_composite(tox: Column, bbb: Column, passed: Column, pains: Column, herg: Column) -> Column:
    return 0.35 * (1.0 - tox) + 0.35 * bbb + points((passed, 0.1), (pains == 0, 0.1), (~herg, 0.1))


# --- filters with reasons


@dataclass(frozen=True)
class Limits:
    """Windows of the strict filter."""

    mw: tuple[float, float] = (200.0, 600.0)
    logp: tuple[float, float] = (1.0, 4.5)
    tpsa: tuple[float, float] = (40.0, 90.0)
    most: dict = field(default_factory=lambda: {"hbd": 3, "hba": 7, "rotatable": 8, "pains": 0, "nih": 2, "brenk": 1})
    least: dict = field(default_factory=lambda: {"heavy": 10, "rings": 1})


def reasons(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in rules]))


def admet_reasons(limits: Limits = Limits(), strict: bool = True, **columns: Column) -> Column:
    """All failed rules of the strict filter among the columns given by name."""
    rules = []
    for name in ("mw", "logp", "tpsa"):
        if name in columns:
            low, high = getattr(limits, name)
            rules.append(((columns[name] < low) | (columns[name] > high), name))
    rules += [(columns[n] > bound, n) for n, bound in limits.most.items() if n in columns]
    rules += [(columns[n] < bound, n) for n, bound in limits.least.items() if n in columns]
    if strict and "herg" in columns:
        rules.append((columns["herg"], "herg"))
    return reasons(*rules)


def basic_filter(mw, heavy, hetero, logp) -> Column:
    return F.coalesce((mw >= 150) & (mw <= 800) & (heavy >= 8) & (hetero > 0) & (logp <= 6), F.lit(False))


def is_druglike(mw: Column, tpsa: Column) -> Column:
    return mw.between(150, 700) & tpsa.between(20, 140)


def range_check(tpsa: Column, mw: Column, tpsa_low: float, tpsa_high: float) -> Column:
    """ok and a message for the first window that is missed (mass window 100 to 900)."""
    message = F.coalesce(
        F.when(~tpsa.between(tpsa_low, tpsa_high), F.lit("tpsa out of range")), F.when(~mw.between(100, 900), F.lit("mw out of range")), F.lit("")
    )
    return F.struct((message == "").alias("ok"), message.alias("message"))


def cns_warnings(tpsa, logp, mw, hbd, hba) -> Column:
    return reasons(
        (tpsa > 90, "TPSA above 90"), ((logp < 1) | (logp > 4.5), "logP outside 1 to 4.5"), (mw > 450, "MW above 450"), (hbd > 2, "HBD above 2"), (hba > 6, "HBA above 6")
    )


def cns_like(tpsa: Column, logp: Column) -> Column:
    return (tpsa <= 90) & logp.between(1.0, 4.5)


# --- similarity and distance


def tanimoto(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def distance(ax, ay, az, bx, by, bz) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))


def fisher_z(r: Column) -> Column:
    c = clamp(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)), -0.999999, 0.999999)
    return 0.5 * F.ln((1.0 + c) / (1.0 - c))


#: Bounds of the liver risk words: the evaluator's, and the stricter one of the search.
LIVER_BANDS = {"evaluator": ((0.5, "high"), (0.3, "moderate")), "search": ((0.8, "very high"), (0.5, "high"), (0.3, "moderate"))}


def feedback_text(vina, dili, bbb, mw=None, logp=None, tpsa=None, reward=None, prune=None, error=None, liver: str = "evaluator") -> Column:
    """Advice by bands, joined with bars: binding, liver, permeability, then the parts that are given.

    A missing docking score shows its error, if one is given; other missing values leave their part out.
    """
    none = F.lit(None).cast("string")
    failed = F.concat(F.lit("binding failed: "), error) if error is not None else none
    parts = [
        F.when(vina > -7, "binding weak").when(vina < -10, "binding strong").when(vina.isNotNull(), "binding moderate").otherwise(F.coalesce(failed, F.lit("binding unknown"))),
        F.when(dili.isNotNull(), F.concat(F.lit("liver risk "), bands(dili, *LIVER_BANDS[liver], otherwise="low"))),
        F.when(bbb.isNotNull(), F.concat(F.lit("permeability "), bands(bbb, (0.7, "good"), (0.4, "fair"), otherwise="poor"))),
    ]
    if mw is not None:
        parts.append(F.format_string("MW=%.1f, LogP=%.2f, TPSA=%.1f", mw, logp, tpsa))
    if reward is not None:
        parts.append(F.format_string("reward=%.4f", reward))
    if prune is not None:
        parts.append(F.concat(F.lit("pruned: "), prune))
    return F.concat_ws(" | ", *parts)


def success_case(score: Column, band: Column, ratio: Column, least: float = 0.8, wanted: str = "high", least_ratio: float = 5.0) -> Column:
    """A composite and a selectivity above their bounds, and the wanted permeability band."""
    return F.coalesce((score > least) & (band == wanted) & (ratio > least_ratio), F.lit(False))


def any_alert(matches: Column) -> Column:
    """Whether any pattern of an array of (name, count) matches."""
    return F.coalesce(F.exists(matches, lambda m: m["count"] > 0), F.lit(False))


def cyp_flag(matches: Column, least: int = 2) -> Column:
    """Whether all matches of an array of (name, count) together are enough."""
    return F.coalesce(F.aggregate(matches, F.lit(0).cast("long"), lambda a, m: a + m["count"]) >= least, F.lit(False))


def named_counts(matches: Column) -> Column:
    """The matches of an array of (name, count) as name(count), zeros left out."""
    found = F.filter(matches, lambda m: m["count"] > 0)
    return F.transform(found, lambda m: F.concat(m["name"], F.lit("("), m["count"].cast("string"), F.lit(")")))


def occurrences(text: Column, part: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def aromatic_nitrogen(line: Column) -> Column:
    """Whether a line notation has an aromatic nitrogen: an n outside or alone in brackets."""
    return F.regexp_replace(line, r"\[(?!n)[^\]]*\]", "").contains("n")


# What each predictor says of a molecule that cannot be read.
MISSING = {
    "toxicity": {"toxicity_score": 0.5, "pIC50": 6.5, "reactive_group_count": 0, "pains_alerts": 0, "nih_alerts": 0, "brenk_alerts": 0, "herg_risk": False, "cyp_risk": False},
    "permeability": {"logBB_est": -1.0, "bbb_score": 0.0, "classification": "very_low", "cns_drug_like": False, "score": 0.0},
}


def or_missing(readable: Column, predictor: str, **columns: Column) -> dict[str, Column]:
    """The columns of a predictor, or its fixed values where the molecule is not readable."""
    return {n: F.when(readable, x).otherwise(F.lit(MISSING[predictor][n])).alias(n) for n, x in columns.items()}


#: Digits that results are shown with.
SHOWN = {"mw": 2, "logp": 2, "tpsa": 2, "vina_norm": 4, "dili_norm": 4, "herg_norm": 4, "bbb_norm": 4, "reward": 4}


def shown(columns: list[str], digits: dict[str, int] = SHOWN) -> list[Column]:
    """The columns, rounded where they are shown with few digits."""
    return [F.round(n, digits[n]).alias(n) if n in digits else F.col(n) for n in columns]
