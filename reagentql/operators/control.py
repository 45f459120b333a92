"""Control of a search over recorded responses: retries, fallbacks, budgets, counters, the tree itself."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.operators.relational import top_per_group


def last_good(attempts: DataFrame, call: str, attempt: str, ok: str, values: list[str]) -> DataFrame:
    """call, attempt, the values, n, solved: of each call's attempts the last that was good, if there is one, and how many were made."""
    best = F.max_by(F.when(F.col(ok), F.struct(attempt, *values)), F.when(F.col(ok), F.col(attempt)))
    out = attempts.groupBy(call).agg(best.alias("__b"), F.count("*").alias("n"), F.max(F.col(ok)).alias("solved"))
    return out.select(call, *[F.col(f"__b.{x}").alias(x) for x in (attempt, *values)], "n", "solved")


def retry_requests(attempts: DataFrame, call: str, attempt: str, prompt: str, warning: str, tokens: str, temperature: float = 0.8, top_p: float = 0.95, most: int = 3, share: float = 0.6) -> DataFrame:
    """``attempts`` with what each was asked with: request, temperature, top_p, tokens, source; those after ``most`` a call are left out.

    The first attempt of a call is asked with the prompt alone.  A retry keeps no history: its
    request is the warning that the attempt before it left, if it left one, and the prompt; it is
    asked at temperature 0.2 and top_p 0.85, for ``share`` of the tokens.
    """
    order = Window.partitionBy(call).orderBy(attempt)
    rows = attempts.withColumns({"__n": F.row_number().over(order), "__warning": F.lag(warning).over(order)}).where(F.col("__n") <= most)
    retry = F.col("__n") > 1
    asked = F.when(F.length("__warning") > 0, F.concat_ws("\n\n", F.col("__warning"), F.col(prompt))).otherwise(F.col(prompt))
    rows = rows.withColumn("request", F.when(retry, asked).otherwise(F.col(prompt)))
    rows = rows.withColumn("temperature", F.when(retry, 0.2).otherwise(temperature)).withColumn("top_p", F.when(retry, 0.85).otherwise(top_p))
    return rows.withColumn("tokens", F.when(retry, F.floor(F.col(tokens) * share)).otherwise(F.col(tokens)).cast("int")).drop("__n", "__warning")


def last_resort(attempts: DataFrame, call: str, attempt: str, ok: str, value: str, base: DataFrame, most: int = 3) -> DataFrame:
    """call, value, source: the first good attempt of each call among ``most``; without one the base model's answer, else the last attempt's.

    ``base`` has the call and the value; it is looked at only for calls that no attempt solved.
    """
    order = Window.partitionBy(call).orderBy(attempt)
    tried = attempts.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most)
    best = tried.groupBy(call).agg(F.min_by(value, F.when(F.col(ok), F.col("__n"))).alias("__good"), F.max(F.coalesce(F.col(ok), F.lit(False))).alias("__ok"), F.max_by(value, "__n").alias("__last"))
    rows = best.join(base.select(call, F.col(value).alias("__base"), F.lit(True).alias("__has")), call, "left")
    source = F.when(F.col("__ok"), "attempt").when(F.col("__has"), "base").otherwise("last")
    chosen = F.when(F.col("__ok"), F.col("__good")).when(F.col("__has"), F.col("__base")).otherwise(F.col("__last"))
    return rows.select(call, chosen.alias(value), source.alias("source"))


def with_fallback(keys: DataFrame, primary: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, source: the primary's value, else the fallback's; both have one row a key."""
    one = primary.select(key, F.col(value).alias("__a"))
    two = fallback.select(key, F.col(value).alias("__b"))
    rows = keys.join(one, key, "left").join(two, key, "left")
    source = F.when(F.col("__a").isNotNull(), "primary").when(F.col("__b").isNotNull(), "fallback")
    return rows.select(key, F.coalesce("__a", "__b").alias(value), source.alias("source"))


def corrected(answers: DataFrame, corrections: list[DataFrame], key: str, ok: Column) -> DataFrame:
    """Each key's answer, or the first correction that is good; only what still fails goes to the next correction.

    ``answers`` has one row a key, each table of ``corrections`` at most one; keys that nothing
    corrects keep their first answer.  ``tries`` counts the corrections looked at.
    """
    done = answers.where(ok).withColumn("tries", F.lit(0))
    failed = answers.where(~F.coalesce(ok, F.lit(False)))
    for k, table in enumerate(corrections, 1):
        now = table.join(failed.select(key), key, "left_semi").select(*answers.columns).where(ok)
        done = done.unionByName(now.withColumn("tries", F.lit(k)))
        failed = failed.join(now.select(key), key, "left_anti")
    return done.unionByName(failed.withColumn("tries", F.lit(len(corrections))))


def within_budget(rows: DataFrame, run: str, order: list[str], cost: str, calls: int, seconds: float) -> DataFrame:
    """``rows`` with ``allowed``: a call is made while fewer than ``calls`` came before it and they cost less than ``seconds``."""
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made, spent = F.count("*").over(before), F.coalesce(F.sum(cost).over(before), F.lit(0.0))
    return rows.withColumn("allowed", (made < calls) & (spent < seconds))


def guardrails(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row of how often each rule held, and of all calls."""
    return rows.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()], F.count("*").alias("calls"))


def tree_search(levels: list[DataFrame], width: int, enough: float) -> DataFrame:
    """The best nodes of the last level with their paths, level by level.

    Each table has parent, node, round, reward and pruned; the first one's parents are null.  A
    pruned node is out.  Rounds after the first refine a level: they count only while no node of
    an earlier round, below the nodes kept above, has a reward of ``enough``.  Of each parent's
    children the ``width`` with the highest rewards stay.
    """
    kept = None
    for table in levels:
        rows = table.where(~F.col("pruned"))
        own = F.array(F.col("node").cast("string"))
        if kept is None:
            rows = rows.withColumn("path", own)
        else:
            above = kept.select(F.col("node").alias("parent"), F.col("path").alias("__path"))
            rows = rows.join(above, "parent").withColumn("path", F.concat("__path", own)).drop("__path")
        # One row: the first round that had enough.
        stop = rows.where(F.col("reward") >= enough).agg(F.min("round").alias("__stop"))
        rows = rows.join(F.broadcast(stop)).where(F.col("__stop").isNull() | (F.col("round") <= F.col("__stop"))).drop("__stop")
        kept = top_per_group(rows, ["parent"], [F.desc("reward"), F.col("node")], width, "__k").drop("__k")
    return kept


@dataclass(frozen=True)
class Variant:
    """What a run uses: its model and prompt, its last ``levels`` (null: all), feedback, evaluation."""

    name: str
    model: str = "domain"
    prompt: str = "domain"
    levels: int | None = None
    feedback: bool = True
    evaluated: bool = True


#: The whole search and the runs that go without one part of it.
VARIANTS = (
    Variant("full"),
    Variant("single_step", prompt="single", levels=1),
    Variant("reasoning", prompt="reasoning", levels=1),
    Variant("no_feedback", feedback=False),
    Variant("constant_evaluator", evaluated=False),
    Variant("generic_prompt", prompt="generic"),
    Variant("general_adapter", model="general"),
    Variant("base_only", model="base", prompt="single", levels=1, evaluated=False),
    Variant("direct", prompt="simple", levels=1),
)
#: The reward that the constant evaluator gives to all; it prunes nothing.
CONSTANT_REWARD = 1.0


def variant_search(responses: DataFrame, variant: Variant, width: int, enough: float, depth: int) -> DataFrame:
    """``tree_search`` over the recorded responses that a variant would have seen, with its name in ``variant``.

    ``responses`` has model, prompt, level (0 to ``depth`` - 1) and the columns of ``tree_search``.
    Without feedback only the first round of a level counts, without evaluation every response
    has CONSTANT_REWARD and none is pruned.  The first level of a shorter run has no parents.
    """
    c = F.col
    rows = responses.where((c("model") == variant.model) & (c("prompt") == variant.prompt))
    if not variant.feedback:
        rows = rows.where(c("round") == 0)
    if not variant.evaluated:
        rows = rows.withColumns({"reward": F.lit(CONSTANT_REWARD), "pruned": F.lit(False)})
    first = depth - (depth if variant.levels is None else variant.levels)
    rows = rows.withColumn("parent", F.when(c("level") > first, c("parent")))
    levels = [rows.where(c("level") == n).select("parent", "node", "round", "reward", "pruned") for n in range(first, depth)]
    return tree_search(levels, width, enough).withColumn("variant", F.lit(variant.name))


def run_targets(targets: DataFrame, results: DataFrame, target: str) -> DataFrame:
    """target, n, status of every target asked for: saved, or empty where nothing came of it."""
    n = results.groupBy(target).agg(F.count("*").alias("n"))
    out = targets.join(n, target, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(target, "n", F.when(F.col("n") > 0, "saved").otherwise("empty").alias("status"))
