"""Assembly of prompts and guidance from knowledge rows, as column expressions.

The wording is data: templates, sections and advice are parameters, read from the user's own
files (``sources.readers.templates``); these functions join them by the rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reagentql.functions.text import alert_advice


def filled(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns; a null value leaves nothing."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def section(title: str, items: Column, most: int | None = None, bullet: str = "- ") -> Column:
    """A titled list of the first items of an array; null where there are none."""
    some = F.filter(items, lambda x: x.isNotNull())
    some = some if most is None else F.slice(some, 1, most)
    lines = F.array_join(F.transform(some, lambda x: F.concat(F.lit(bullet), x)), "\n")
    return F.when(F.size(some) > 0, F.concat(F.lit(title + "\n"), lines))


def constraint_lines(constraints: dict[str, tuple[Column, Column]]) -> Column:
    """name: low-high of each constraint that has both ends."""
    parts = [F.when(low.isNotNull() & high.isNotNull(), F.concat(F.lit(f"{name}: "), low.cast("string"), F.lit("-"), high.cast("string"))) for name, (low, high) in constraints.items()]
    return F.array_compact(F.array(*parts))


def domain_prompt(base: str, generic: str, requirements: Column, target: Column, insights: Column, constraints: Column, guidance: Column) -> Column:
    """The base with its requirements, then target, insights, constraints and guidance, each as a paragraph.

    Null parts are left out; without a target the generic text stands for base and target.
    """
    known = F.concat_ws("\n\n", filled(base, specific_requirements=requirements), target, insights, constraints, guidance)
    return F.when(target.isNotNull(), known).otherwise(F.concat_ws("\n\n", F.lit(generic), constraints))


def reasoning_prompt(domain: Column, steps: str, target_reasoning: Column, similar: Column, most: int = 3) -> Column:
    """The domain text, the steps of reasoning, what holds for the target, and the first similar molecules."""
    return F.concat_ws("\n\n", domain, F.lit(steps), target_reasoning, section("Similar molecules:", similar, most))


def step_prompt(templates: dict[int, str], level: Column, feedback: Column, **values: Column) -> Column:
    """The template of a level filled in, with feedback before it where there is some."""
    out = F.lit(None).cast("string")
    for n, template in templates.items():
        out = F.when(level == n, filled(template, **values)).otherwise(out)
    said = F.when(F.length(feedback) > 0, F.concat(F.lit("Feedback on the previous candidate:\n"), feedback))
    return F.when(out.isNotNull(), F.concat_ws("\n\n", said, out))


#: Advice by thresholds on the current molecule.
ADVICE = {"logp_low": "raise lipophilicity", "logp_high": "lower lipophilicity", "mw_high": "reduce the size"}


def structural_guidance(known: Column, logp: Column, mw: Column, advice: dict[str, str] = ADVICE) -> Column:
    """What is known of the target's structures, then advice for a molecule under logP 2, over 4, or over 500 Da; null if there is nothing."""
    hints = F.array_compact(F.array(F.when(logp < 2, advice["logp_low"]).when(logp > 4, advice["logp_high"]), F.when(mw > 500, advice["mw_high"])))
    return F.nullif(F.concat_ws("\n", known, section("Advice:", hints)), F.lit(""))


def site_summary(sites: Column, most: int = 3, residues: int = 5) -> Column:
    """One line per site (site_name, key_residues): number, name and the first residues."""
    line = lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["site_name"], F.lit(": "), F.array_join(F.slice(s["key_residues"], 1, residues), ", "))
    return F.array_join(F.transform(F.slice(sites, 1, most), line), "\n")


def _draw(key: Column, salt: str, n: int) -> Column:
    """A whole number from 0 to n - 1 by hash of the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + "-"), key)), 1, 8), 16, 10).cast("long") % n


# What may be put after an amide.
CHANGES = ("", "C", "CC", "O", "N", "Cl", "F")


def seeded_line(key: Column, scaffolds: Column, share: int = 30, otherwise: str = "CC(=O)Nc1ccccc1") -> Column:
    """One of an array of scaffolds by hash of the key, in ``share`` of 100 cases with a change after its amide.

    The hash is the engine's own, so results repeat; an empty or null array gives ``otherwise``.
    """
    pick = F.try_element_at(scaffolds, (_draw(key, "scaffold", 1 << 30) % F.greatest(F.size(scaffolds), F.lit(1)) + 1).cast("int"))
    change = F.element_at(F.array(*[F.lit(x) for x in CHANGES]), (_draw(key, "change", len(CHANGES)) + 1).cast("int"))
    changed = F.replace(pick, F.lit("C(=O)N"), F.concat(F.lit("C(=O)N"), change))
    return F.coalesce(F.when(_draw(key, "share", 100) < share, changed).otherwise(pick), F.lit(otherwise))


def answered(response: Column, line: Column, placeholder: str = "placeholder") -> Column:
    """The response, or, where it is missing or holds the placeholder, the line under its label."""
    return F.when(response.isNull() | F.contains(response, F.lit(placeholder)), F.concat(F.lit("SMILES: "), line)).otherwise(response)


def toxicity_feedback(alerts: Column, fixes: dict[str, str], generic: str, deltas: dict[str, Column], least: float = 0.05) -> Column:
    """A line per alert with its fix or the generic advice, then a line per value that rose by more than ``least``."""
    rises = F.array_compact(F.array(*[F.when(d > least, F.concat(F.lit(f"{n} rose by "), F.format_string("%.2f", d))) for n, d in deltas.items()]))
    return F.array_join(F.concat(alert_advice(alerts, fixes, generic), rises), "\n")


# What each aim of a profile asks for; where two are listed, the first for scores above STRONG.
STRONG = 7.0
AIMS = {
    "bbb": {"high": ("BBB: high permeability (logBB > 0)", "BBB: good permeability (logBB > -0.5)"), "moderate": ("BBB: moderate permeability (logBB > -0.5)",)},
    "activity": {"high": ("GBM Activity: high", "GBM Activity: good"), "moderate": ("GBM Activity: moderate",)},
    "toxicity": {"low": ("Toxicity: low",), "moderate": ("Toxicity: moderate acceptable",)},
    "selectivity": {"high": ("Selectivity: high (GBM/normal ratio)",), "moderate": ("Selectivity: moderate",)},
}


def target_metrics(profile: dict[str, Column], score: Column | None = None) -> Column:
    """What a profile (bbb, activity, toxicity, selectivity) asks for, joined by semicolons.

    With a score the aims above STRONG ask for more.  Without one, as in the plain data set, they
    ask for the most, and a moderate selectivity is not named.
    """

    def said(aim: str, level: str, texts: tuple[str, ...]) -> Column | None:
        if score is None and (aim, level) == ("selectivity", "moderate"):
            return None
        text = F.lit(texts[0]) if score is None or len(texts) == 1 else F.when(score > STRONG, texts[0]).otherwise(texts[1])
        return F.when(profile[aim] == level, text)

    parts = [F.coalesce(*[x for level, texts in levels.items() if (x := said(aim, level, texts)) is not None]) for aim, levels in AIMS.items()]
    return F.array_join(F.array_compact(F.array(*parts)), "; ")


def metric_instruction(description: Column, metrics: Column) -> Column:
    """The instruction of a sample: what is asked, the metrics, and the form of the answer."""
    return F.concat(F.lit("Generate a GBM drug candidate SMILES for "), description, F.lit(".\nTarget metrics: "), metrics, F.lit("\nOutput format: SMILES: <canonical_SMILES>"))
