"""URL filter: rules first, then gradient-boosted trees over lexical features.

Everything is DataFrame and SQL expressions.  Training takes a bounded sample of the
labelled URLs, bins each feature, and grows each tree from sums of gradients per node,
feature and bin (one aggregate a level, whose size depends on the parameters alone).  The
finished trees are one column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): a host, then the start of a path.
Rule = tuple[str, str]
# The production rules.
RULES: tuple[Rule, ...] = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Parts into which the sample is dealt, so that its features are computed side by side.
SAMPLE_PARTS = 12
#: Rows of the sample that a suffix needs for a rate of its own.
LEAST_SUFFIX = 20
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "suffix_rate", "longest_label")


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """``df`` with host and path, both empty for a null url or one without ``://``."""
    rest = F.when(F.col(url_col).contains("://"), F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def rule_column(rules: tuple[Rule, ...], value: int) -> Column:
    """The rule (value 0) or its verdict (value 1) of the longest fitting rule, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = rule[0].partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


def with_features(df: DataFrame, url_col: str, suffix_rates: dict[str, float]) -> DataFrame:
    """``df`` with the lexical features of FEATURES, computed from the url alone."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    size = F.length(url)
    count = lambda c: size - F.length(F.replace(url, F.lit(c)))
    lowered = F.translate(url, UPPER, LOWER)
    seen = lambda c: (size - F.length(F.replace(lowered, c, F.lit("")))).cast("double")
    letters = F.array_distinct(F.filter(F.split(lowered, ""), lambda c: c != ""))
    runs = F.aggregate(letters, F.lit(0.0), lambda a, c: a + seen(c) * F.log2(seen(c)))
    labels = F.split("host", r"\.")
    # One literal map: at most a sample's suffixes, each of LEAST_SUFFIX rows or more.
    known = [F.lit(x) for item in sorted(suffix_rates.items()) for x in item]
    rate = F.coalesce(F.try_element_at(F.create_map(*known), F.col("suffix")), F.lit(0.0)) if known else F.lit(0.0)
    df = df.withColumn("suffix", F.element_at(labels, -1))
    return df.withColumns(
        {
            "length": size.cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
            "digit_ratio": F.when(size > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / size).otherwise(0.0),
            "entropy": F.when(size > 0, F.log2(size.cast("double")) - runs / size).otherwise(0.0),
            "parameters": (count("&") + count("=")).cast("double"),
            "labels": F.size(labels).cast("double"),
            "hyphens": count("-").cast("double"),
            "suffix_rate": rate,
            "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        }
    )


@dataclass
class UrlModel:
    """Trees as nested ("split", feature, bound, left, right) and ("leaf", value)."""

    suffix_rates: dict[str, float] = field(default_factory=dict)
    start: float = -1.0
    trees: list[tuple] = field(default_factory=list)

    def score(self) -> Column:
        """Log-odds of block as a column over the features."""

        def grow(node: tuple) -> Column:
            if node[0] == "leaf":
                return F.lit(node[1])
            _, name, bound, left, right = node
            return F.when(F.col(name) <= bound, grow(left)).otherwise(grow(right))

        out = F.lit(self.start)
        for tree in self.trees:
            out = out + grow(tree)
        return out


def train(
    labelled: DataFrame,
    url_col: str,
    label_col: str,
    sample: int = 10_000,
    trees: int = 6,
    depth: int = 2,
    bins: int = 16,
    rate: float = 0.4,
) -> UrlModel:
    """Fit on at most ``sample`` labelled URLs (label 1: block), picked by hash.

    Without rows of both labels the model has no trees and allows everything, so does an empty
    table's.  Prior and suffix rates are of the whole sample; a suffix with fewer than
    LEAST_SUFFIX rows in it has none, so there are at most ``sample`` / LEAST_SUFFIX of them.
    Equal rows count as often as they occur; null labels are no rows; a null url is an empty one.
    """
    picked = labelled.where(F.col(label_col).isNotNull()).orderBy(F.xxhash64(url_col), url_col, label_col).limit(sample).repartition(SAMPLE_PARTS, url_col)
    by_suffix = with_parts(picked, url_col).groupBy(F.element_at(F.split("host", r"\."), -1).alias("suffix"))
    counts = by_suffix.agg(F.count("*").alias("n"), F.sum(label_col).alias("bad"))
    seen = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.collect_list(F.when(F.col("n") >= LEAST_SUFFIX, F.struct("suffix", "n", "bad"))).alias("suffixes"),
    ).first()
    total, bad = seen["n"], seen["bad"]
    if not 0 < bad < total:
        return UrlModel()
    prior = math.log(bad / (total - bad))
    model = UrlModel(
        {r["suffix"]: math.log((r["bad"] + 1) / (r["n"] - r["bad"] + 1)) - prior for r in seen["suffixes"]}, prior
    )
    features = with_features(with_parts(picked, url_col), url_col, model.suffix_rates)
    cuts = features.agg(
        *[F.percentile_approx(f, [i / bins for i in range(1, bins)], 1000).alias(f) for f in FEATURES]
    ).first()
    bounds = {f: sorted(set(cuts[f] or [])) for f in FEATURES}
    # Equal rows of bins are one row with a weight; every tree reads this small table.
    upper = lambda f: F.get(F.expr(f"filter(array({','.join(f'{b!r}D' for b in bounds[f])}), b -> b >= `{f}`)"), F.lit(0))
    binned = (
        features.select(F.col(label_col).cast("double").alias("y"), *[F.coalesce(upper(f), F.lit(math.inf)).alias(f) for f in FEATURES])
        .groupBy("y", *FEATURES)
        .agg(F.count("*").alias("w"))
        .persist()
    )
    try:
        for _ in range(trees):
            model.trees.append(_tree(binned, model.score(), bounds, depth, rate))
    finally:
        binned.unpersist()
    return model


def _tree(binned: DataFrame, score: Column, bounds: dict[str, list[float]], depth: int, rate: float) -> tuple:
    splits: dict[int, tuple[str, float]] = {}
    totals: dict[int, tuple[float, float]] = {}
    for level in range(depth):
        node = F.lit(1)
        for _ in range(level):
            step = node * 2
            for k, (name, bound) in splits.items():
                step = F.when(node == k, node * 2 + (F.col(name) > bound).cast("int")).otherwise(step)
            node = step
        p = 1 / (1 + F.exp(-F.col("s")))
        sums = (
            binned.withColumn("s", score)
            .withColumns({"node": node, "g": (F.col("y") - p) * F.col("w"), "h": p * (1 - p) * F.col("w")})
            .select("node", "g", "h", F.posexplode(F.array(*FEATURES)).alias("f", "bin"))
            .groupBy("node", "f", "bin")
            .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            .orderBy("node", "f", "bin")
            .collect()
        )
        for k in sorted({r["node"] for r in sums}):
            of = [r for r in sums if r["node"] == k]
            g_all, h_all = (sum(r[c] for r in of if r["f"] == 0) for c in "gh")
            totals[k] = g_all, h_all
            best = 1e-6
            for f, name in enumerate(FEATURES):
                g = h = 0.0
                for r in (r for r in of if r["f"] == f):
                    g, h = g + r["g"], h + r["h"]
                    if r["bin"] == math.inf:
                        continue
                    gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all * g_all / (h_all + 1)
                    if gain > best + 1e-9:
                        best, splits[k] = gain, (name, r["bin"])
                        totals[2 * k], totals[2 * k + 1] = (g, h), (g_all - g, h_all - h)

    def build(k: int) -> tuple:
        if k in splits:
            return "split", *splits[k], build(2 * k), build(2 * k + 1)
        g, h = totals.get(k, (0.0, 0.0))
        return "leaf", round(rate * g / (h + 1), 9)

    return build(1)


def judge_urls(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, sample: int = 10_000
) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``.

    The longest fitting rule decides; URLs that no rule fits are judged by trees.  There are no
    other labels than the rules' own verdicts: the trees are trained on the URLs that a rule
    fits (at most ``sample`` of them), so they carry the rules over to other URLs that look
    alike.  ``score`` is the trees' log-odds of block for every URL.  A null url has empty parts
    and fits no rule; URLs may have any length; further columns are not read; repeated rows give
    repeated results; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    parts = with_parts(rows, "url").withColumns({"rule": rule_column(rules, 0), "by_rule": rule_column(rules, 1)})
    labelled = parts.where(F.col("by_rule").isNotNull()).select("url", (F.col("by_rule") == "block").cast("int").alias("label"))
    model = train(labelled, "url", "label", sample)
    judged = with_features(parts, "url", model.suffix_rates).withColumn("score", F.round(model.score(), 6))
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
