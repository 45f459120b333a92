"""The physical evaluation of candidates as one operator, and verdicts of mixed texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reagentql.functions import scoring as S
from reagentql.functions import text as T

NEEDED = ("mw", "logp", "tpsa", "hbd", "hba")


def physical_evaluation(df: DataFrame, weights: S.Weights = S.Weights(), cutoffs: S.Cutoffs = S.Cutoffs(), strict: bool = False) -> DataFrame:
    """``df`` with norms, reward, prune_reason, is_pruned and verdict.

    Needs mw, logp, tpsa, hbd, hba, vina, dili, herg, and may have base_dili and base_herg of the
    parent.  Descriptors come first, then norms, cut-offs, reward and verdict.  A row without
    descriptors is an exception: all norms and the reward are 0, it is not pruned, its reason says
    so and its verdict is likely.  A missing docking score counts as middling.
    """
    readable = F.lit(True)
    for name in NEEDED:
        readable = readable & F.col(name).isNotNull()
    c = F.col
    base = {k: c(k) for k in ("base_dili", "base_herg") if k in df.columns}
    norms = {
        "vina_norm": S.vina_norm(c("vina")),
        "dili_norm": 1.0 - c("dili"),
        "herg_norm": 1.0 - c("herg"),
        "bbb_norm": S.bbb_score(S.log_bb(*map(c, ("logp", "tpsa", "mw", "hbd", "hba")))),
        "tpsa_norm": S.tpsa_norm(c("tpsa")),
        "mw_norm": S.mw_norm(c("mw")),
    }
    out = df.withColumns({n: F.when(readable, x).otherwise(0.0) for n, x in norms.items()})
    reason = S.prune_reason(c("vina"), c("dili"), c("herg"), c("mw"), c("tpsa"), cut=cutoffs, **base)
    reward = S.reward(c("vina_norm"), c("dili"), c("herg"), c("bbb_norm"), c("tpsa_norm"), c("mw_norm"), weights)
    out = out.withColumns({"reward": F.when(readable, reward).otherwise(0.0), "prune_reason": F.when(readable, reason).otherwise("no descriptors")})
    out = out.withColumn("is_pruned", readable & c("prune_reason").isNotNull())
    return out.withColumn("verdict", F.when(readable, F.when(c("is_pruned"), "impossible").otherwise(S.verdict(c("reward"), strict))).otherwise("likely"))


def verdicts(texts: DataFrame, evaluated: DataFrame, text: str = "text", key: str = "smiles") -> DataFrame:
    """Each different text with its verdict, once: the evaluation's where it looks like a candidate and has one, else by words."""
    once = texts.select(text).distinct()
    known = evaluated.select(F.col(key).alias(text), F.col("verdict").alias("__v")).dropDuplicates([text])
    found = F.when(T.looks_like_candidate(F.col(text)), F.col("__v"))
    return once.join(known, text, "left").select(text, F.coalesce(found, T.heuristic_verdict(F.col(text))).alias("verdict"))


def connection_scores(cells: DataFrame, signature: DataFrame, normalise: str | None = None, selected: DataFrame | None = None) -> DataFrame:
    """cell, z, mean: each cell's connection to a signature, as it is, scaled to [0, 1] or as z-scores.

    ``mean`` is that of the selected cells: null if none were asked for, NaN if none of them is there.
    """
    from reagentql.operators.relational import min_max, z_scores
    from reagentql.operators.vectors import spearman_to_signature

    z = spearman_to_signature(cells, signature).select("cell", "z")
    if normalise is not None:
        z = {"minmax": min_max, "zscore": z_scores}[normalise](z, ["z"])
    if selected is None:
        return z.withColumn("mean", F.lit(None).cast("double"))
    inside = z.join(selected.select("cell").distinct(), "cell", "left_semi").agg(F.avg("z").alias("mean"))
    return z.join(F.broadcast(inside.select(F.coalesce("mean", F.lit(float("nan"))).alias("mean"))))
