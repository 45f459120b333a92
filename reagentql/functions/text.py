"""Extraction and checking of candidate strings in free text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERED = r"(?im)^\s*SMILES\s*\d+\s*[:=]\s*(\S+)"
LABELLED = r"(?i)smiles\s*[:=]\s*([A-Za-z0-9@+\-\[\]()=#$]{3,100})"
LISTED = r"(?m)^\s*\d+\s*[.):]\s*(\S+)"
# Words that mark a text as prose about design rather than a molecule.
DESIGN_WORDS = ("scaffold", "strategy", "warhead", "rationale", "enhancer", "estimated", "expected", "name:", "base mw", "bbb potential")
# Texts that are no line notation, parts that none holds, and names of ring systems.
NOT_ALONE = (
    "chain-of-thought", "valid_smiles", "smiles_string", "<valid_smiles>", "analysis", "reasoning", "design", "output", "format", "scaffold",
    "strategy", "warhead", "enhancer", "rationale",
)
NOT_WITHIN = (
    "synthetic", "complexity", "therefore", "suggests", "moderately", "challenging", "retrosynthesis", "synthesize", "procedure",
    "designed molecule", "designed scaffold",
)
RING_NAMES = ("quinazoline", "pyrimidine", "indole", "imidazotetrazine", "benzimidazole", "purine", "pyridine", "pyrrole", "thiazole")
#: Words that the loose rule refuses.
STOP_WORDS = ("smiles", "none", "molecule", "invalid", "example", "unknown", "null")
# Labels before a line notation, in two languages.
LABELS = ("SMILES:", "分子式[:：]", "分子结构[:：]", "SMILES字符串[:：]")
# How a sentence's word begins and ends that looks like a line notation.
PROSE_STARTS = (
    "Cytosine", "Quinazoline", "Pyrimidine", "Indole", "Pyridine", "Compound", "Molecule", "Scaffold", "Strategy", "Designed", "Therefore",
    "However", "Moreover", "Furthermore", "Synthesis", "Solution", "Mixture", "Product", "Reaction", "Procedure", "Step", "Example",
    "Following", "According", "Resulting", "Generat", "Output", "Format", "SMILES", "Name", "Ration",
)
PROSE_ENDS = ("ing", "ted", "nal", "lar", "ble", "tion")
# Bracketed atoms, bonds and marks, and what each becomes, in order.
BRACKETS = (
    ("[C]", "C"), ("[c]", "c"), ("[N]", "N"), ("[n]", "n"), ("[O]", "O"), ("[o]", "o"), ("[S]", "S"), ("[s]", "s"), ("[P]", "P"), ("[p]", "p"),
    ("[F]", "F"), ("[I]", "I"), ("[B]", "B"), ("[Br]", "Br"), ("[Cl]", "Cl"), ("[N+1]", "N+"), ("[N-1]", "N-"), ("[O+1]", "O+"), ("[O-1]", "O-"),
    ("[H]", ""), ("[H2]", ""), ("[H3]", ""), ("[OH]", "O"), ("[NH2]", "N"), ("[NH]", "N"), ("[C@]", "C@"), ("[C@@]", "C@@"), ("[C@H]", "C@H"),
    ("[C@@H]", "C@@H"), ("[C@H1]", "C@H"), ("[=C]", "C"), ("[=N]", "N"), ("[=O]", "O"), ("[=S]", "S"), ("[#C]", "C"), ("[#N]", "N"),
    ("[Ring1]", ""), ("[Ring2]", ""), ("[Ring3]", ""), ("[Branch1]", ""), ("[Branch2]", ""), ("[Branch3]", ""), ("[=Branch1]", ""),
    ("[=Branch2]", ""), ("[#Branch1]", ""), ("[#Branch2]", ""), ("[se]", "Se"), ("[Se]", "Se"), ("[Si]", "Si"),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract_all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def clean(token: Column) -> Column:
    """Without leading and trailing space and punctuation."""
    return F.regexp_replace(F.trim(token), r"^[.,;:'\"`]+|[.,;:'\"`]+$", "")


def format_ok(token: Column) -> Column:
    """Shape of a line notation: 5 to 150 ASCII characters, no blanks, not letters only, a fair first character."""
    return (
        F.length(token).between(5, 150)
        & ~token.rlike("^[A-Za-z]+$")
        & ~token.rlike(r"\s")
        & token.rlike("^[ -~]+$")
        & token.rlike(r"^[A-Za-z\[(]")
    )


def strict_ok(token: Column, compat: bool = False) -> Column:
    """The strict text rule: alphabet, length, as many opening as closing brackets, two carbons, no prose.

    With ``compat`` double bonds, stereo marks, ring numbers after % and backslashes are refused
    too, as the original rule does.
    """
    without = lambda chars: F.length(F.translate(token, chars, ""))
    low = F.lower(token)
    # Cheap tests first: most words of prose end there.
    ok = (
        F.length(token).between(5, 600)
        & token.rlike("[Cc][^Cc]*[Cc]")
        & token.rlike(r"^[A-Za-z0-9@+\-\[\]()=#%/\\.]+$")
        & token.rlike("[CBNOSPFIH]")
        & (without("([") == without(")]"))
        & ~token.rlike(r"^\[[A-Za-z][A-Za-z0-9]*[+-]?\]$")
        & ~low.isin(*NOT_ALONE, *RING_NAMES)
        & ~low.rlike("|".join(NOT_WITHIN))
    )
    return ok & ~token.rlike(r"[=@%\\]") if compat else ok


def loose_ok(token: Column, low: int = 5, high: int = 300, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Length, stop words, and at least half of the characters from the chemical alphabet."""
    chemical = F.length(F.regexp_replace(token, r"[^BCNOPSFIbcnops0-9()\[\]=#@+\-]", ""))
    return F.length(token).between(low, high) & ~F.lower(token).isin(*stop_words) & (chemical * 2 >= F.length(token))


@dataclass(frozen=True)
class LooseRule:
    """A loose validator: length, words that are refused anywhere or near the start, and what else it asks."""

    low: int
    high: int
    words: tuple[str, ...]
    near_start: int | None = None
    shape: str | None = None
    share: float = 0.0
    surface: tuple[float, float] | None = None


# Words that the loose validators refuse, by validator.
BASE_WORDS = (
    "chain-of-thought", "analysis", "reasoning", "design", "scaffold", "strategy", "rationale", "therefore", "synthetic", "procedure", "output",
    "format", "here is", "valid_smiles", "smiles_string", "note:", "note :", "example", "generated", "molecule", "compound",
)
ADAPTER_WORDS = (
    "chain-of-thought", "analysis", "reasoning", "scaffold", "strategy", "rationale", "therefore", "synthetic", "procedure", "output", "format",
    "here is", "valid_smiles", "smiles_string", "note:", "note :", "example", "generated", "molecule", "compound", "retrsynthesis", "nmr",
    "yellow solid", "preparation", "intermediate", "furthermore", "specifically", "preferably", "similarly", "chloro", "bromo", "fluoro",
    "soluble", "solubility", "colorless", "tert-butyl", "dimethylamino", "dimethyl", "isocyanato", "hydroxysuccinimide", "carboxamide", "phenyl",
    "benzyl", "acetyl", "glycyl", "methyl", "dmso", "etoh", "meoh", "thf", "dcm",
)
CHAT_WORDS = (
    "in conclusion", "i think", "thank", "however", "therefore", "moreover", "previous", "in my opinion", "in addition", "the molecule is",
    "instructions", "please", "response", "answer", "helpful", "hope", "you must", "your response", "as a side", "this has nothing", "let me",
    "i cannot", "i will", "it was the first",
)
#: Validators of runs with the base model, with an adapter and with a chat model.
LOOSE_RULES = {
    "base": LooseRule(5, 600, BASE_WORDS, shape=r"^\S+$", surface=(40.0, 120.0)),
    "adapter": LooseRule(5, 600, ADAPTER_WORDS, shape=r"^[CNOSFPBIrl][A-Za-z0-9@+\-\[\]()=#%/\\.]*$", surface=(20.0, 150.0)),
    "chat": LooseRule(1, 1000, CHAT_WORDS, near_start=100, share=0.5),
}


def passes_loose(token: Column, rule: LooseRule, surface: Column | None = None) -> Column:
    """Whether a token passes a loose validator.  Whether a molecule can be read from it is not asked; its polar surface is an input.

    A token without a surface fails a rule that asks for one.
    """
    t = F.trim(token) if rule.near_start is None else token
    low = F.lower(t) if rule.near_start is None else F.substring(F.lower(t), 1, rule.near_start)
    ok = F.length(t).between(rule.low, rule.high) & ~low.rlike("|".join(rule.words))
    if rule.shape:
        ok = ok & t.rlike(rule.shape)
    if rule.share:
        ok = ok & (F.length(F.regexp_replace(t, r"[^BCNOPSFIbcnosp\[\]()=#@+\-0-9]", "")) >= rule.share * F.length(t))
    if rule.surface:
        ok = ok & F.coalesce(surface.between(*rule.surface), F.lit(False))
    return ok


def looks_like_candidate(text: Column) -> Column:
    """Longer than ten characters, some structural character, no design word."""
    return (F.length(text) > 10) & text.rlike(r"[()\[\]=#@+/-]") & ~F.lower(text).rlike("|".join(DESIGN_WORDS))


def first_seen(tokens: Column, most: int | None = None) -> Column:
    """Distinct tokens in order, the first ``most`` of them."""
    out = F.array_distinct(tokens)
    return out if most is None else F.slice(out, 1, most)


def extract_cascade(text: Column, most: int = 5) -> Column:
    """Numbered lines, else labelled tokens, else list items, else long free tokens, of strict shape, first seen.

    Of a reaction the right side counts; fragments are taken apart.  Each stage is computed once.
    """
    right = lambda t: F.element_at(F.split(t, ">>"), -1)
    parts = lambda tokens: F.flatten(F.transform(tokens, lambda t: F.split(clean(right(t)), r"\.")))
    free = r"\b([CNOSPFI][A-Za-z0-9@+\-\[\]()=#%/.]{10,})\b"
    stages = [F.filter(F.transform(parts(extract_all(text, p)), clean), lambda t: strict_ok(t)) for p in (NUMBERED, LABELLED, LISTED, free)]
    return first_seen(F.coalesce(F.get(F.filter(F.array(*stages), lambda x: F.size(x) > 0), F.lit(0)), F.array().cast("array<string>")), most)


def extract_lines(text: Column, separator: str = r"[,;\n]") -> Column:
    """Chunks between separators without label, number, dash and quotes."""
    chunks = F.split(text, separator)
    bare = F.transform(chunks, lambda c: clean(F.regexp_replace(c, r"(?i)^\s*(smiles\s*\d*\s*[:=]|\d+\s*[.):]|[-*])\s*", "")))
    return first_seen(F.filter(bare, format_ok))


def bracket_to_line(text: Column, replacements: tuple[tuple[str, str], ...] = BRACKETS) -> Column:
    """Atom-bond notation to line notation by ordered literal replacements; bond orders, rings and branches are lost."""
    out = text
    for old, new in replacements:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def bracket_run(text: Column) -> Column:
    """The atom-bond notation of a text: all its short brackets joined, as line notation; null under five characters."""
    bare = F.regexp_replace(F.element_at(F.split(text, "### Response:"), -1), r"<[^>\n]*>", "")
    joined = F.array_join(extract_all(bare, r"(\[[^\]]{1,6}\])"), "")
    return let(joined, lambda j: F.when(F.length(j) >= 5, bracket_to_line(j)))


# Words near the start of a line that make it prose.
PROSE_LINE = (
    "the molecule", "this molecule", "i think", "in conclusion", "in my opinion", "in addition", "however", "therefore", "thank", "previous",
    "response", "instructions", "please", "you must", "your response", "i hope", "i cannot", "let me", "it was", "moreover", "as a side",
    "first time", "helpful", "hopeful", "answer", "conclusion", "final", "citation", "note", "indeed", "kindness", "person", "meet", "enjoy",
    "together", "equipped", "bothered", "work out", "glad", "completed", "inhibitor", "drug candidate",
)


def bracket_candidates(text: Column) -> Column:
    """The joined brackets of a text, then its lines that are not prose and at most 60 % letters, each once, as line notation."""
    bare = F.regexp_replace(F.element_at(F.split(text, "### Response:"), -1), r"<[^>\n]*>", "")
    lines = F.transform(F.split(bare, r"[,;\n]"), lambda x: F.trim(x))
    share = lambda x: F.length(F.regexp_replace(x, "[^A-Za-z]", "")) * 10 <= F.length(x) * 6
    prose = lambda x: F.lower(F.substring(x, 1, 60)).rlike("|".join(PROSE_LINE))
    kept = F.filter(lines, lambda x: (F.length(x) >= 4) & share(x) & ~prose(x) & x.rlike(r"[CNOSPFIcnosp\[\]]"))
    cut = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[-*•]\s*", ""), r"^(\d+[.):]+\s*)?([Ss][Mm][Ii][Ll][Ee][Ss]\s*[:-]?\s*)?|```+", ""))
    found = F.transform(F.transform(kept, cut), lambda x: F.when(F.contains(x, F.lit("][")), bracket_to_line(x)).otherwise(x))
    whole = F.array_compact(F.array(bracket_run(text)))
    return F.array_distinct(F.filter(F.concat(whole, found), lambda x: strict_ok(x)))


def labelled_first(text: Column) -> Column:
    """The first valid line notation after a label, else the first valid token of the text, else null."""
    token = r"([A-Za-z0-9@+\-\[\]()=#]+)"
    after = [extract_all(text, rf"(?i){label}\s*{token}") for label in LABELS]
    alone = [extract_all(text, rf"\b({start}[A-Za-z0-9@+\-\[\]()=#]+)\b") for start in ("[A-Za-z]", "[0-9]")]
    alone = [F.filter(x, lambda t: F.length(t).between(3, 100)) for x in alone]
    every = F.concat(*after, *alone)
    return F.get(F.filter(F.transform(every, clean), lambda t: strict_ok(t)), F.lit(0))


def extraction_trace(text: Column) -> Column:
    """Every candidate of a text as (pattern, position, match, cleaned, valid): what each pattern found, valid or not."""
    token = r"([A-Za-z0-9@+\-\[\]()=#]+)"
    patterns = (rf"SMILES:\s*{token}", rf"smiles:\s*{token}", r"\b([A-Za-z][A-Za-z0-9@+\-\[\]()=#]+)\b", r"\b([0-9][A-Za-z0-9@+\-\[\]()=#]+)\b")
    row = lambda k: lambda t, i: F.struct(F.lit(k).alias("pattern"), i.alias("position"), t.alias("match"), clean(t).alias("cleaned"), strict_ok(clean(t)).alias("valid"))
    return F.concat(*[F.transform(extract_all(text, p), row(k)) for k, p in enumerate(patterns)])


def embedded_candidates(text: Column, most: int = 5) -> Column:
    """Line notations inside sentences: at least nine characters, two different atoms, a structural character, not like a word."""
    found = F.array_distinct(extract_all(text, r"([A-Z][A-Za-z0-9@+\-\[\]()=#%/.]{8,})"))
    atoms = lambda t: F.size(F.array_distinct(F.split(F.regexp_replace(t, "[^CBNOSPFIH]", ""), "")))
    starts, ends = "^(" + "|".join(PROSE_STARTS) + ")", "(" + "|".join(PROSE_ENDS) + ")$"
    good = F.filter(found, lambda t: ~t.rlike(starts) & ~F.lower(t).rlike(ends) & (atoms(t) >= 2) & t.rlike(r"[()\[\]=#@+/-]"))
    return F.slice(good, 1, most)


def several_patterns(text: Column) -> Column:
    """SMILESn: and SMILES: values of fair shape, then free tokens with more than letters, first seen."""
    labelled = F.transform(extract_all(text, r"SMILES\d*:\s*([A-Za-z0-9@+\-\[\]()=#%/ ]+)"), lambda x: F.trim(x))
    free = extract_all(text, r"\b([A-Z][A-Za-z0-9@+\-\[\]()=#]{4,100})\b")
    return F.array_distinct(F.concat(F.filter(labelled, format_ok), F.filter(free, lambda t: ~t.rlike("^[A-Za-z]+$"))))


def _valid(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: strict_ok(t))


def _unbracketed(text: Column) -> Column:
    """Without anything in parentheses and the blanks before it, as the original rule does to remarks and branches alike."""
    return F.regexp_replace(text, r"\s*\([^)]*\)", "")


def reclaimed(field_text: Column) -> Column:
    """Line notations of a field into which remarks and steps have slipped: the whole if it is valid, else its valid parts."""
    bare = F.regexp_replace(F.regexp_replace(_unbracketed(field_text), r"(?i)This\s+is\s+step\s+\d+[^,;.]*[,;.]?", ""), r"(?i)step\s+\d+[^,;.]*[,;.]?", "")
    return let(bare, lambda b: let(F.trim(b), lambda whole: F.when(strict_ok(whole), F.array(whole)).otherwise(_valid(F.transform(F.split(b, r"[,;\n]"), lambda x: F.trim(x))))))


def segment_candidates(segment: Column) -> Column:
    """A segment without remarks, opening phrase and last punctuation if that is valid, else its valid words."""
    phrase = r"(?i)^(to\s+synthesize|for\s+the\s+synthesis\s+of|target\s+molecule|final\s+product)\s+"
    bare = F.regexp_replace(F.trim(F.regexp_replace(_unbracketed(segment), phrase, "")), r"[,;.]+$", "")
    return let(bare, lambda b: F.when(strict_ok(b), F.array(b)).otherwise(_valid(F.split(b, r"[\s,;]+"))))


# Phrases before a target, marks of lines about steps, words that no target holds.
TARGET_PHRASES = (r"To\s+synthesize", r"for\s+the\s+synthesis\s+of", r"target\s+molecule\s+is", r"final\s+product\s+is")
STEP_MARKS = ("This is step", "Step", "step", "synthesis process", "retrosynthes", " retrosyn")
NO_TARGET = (
    "chain", "analysis", "reasoning", "scaffold", "strategy", "rationale", "synthetic", "procedure", "therefore", "suggest", "step", "synthes",
    "available", "example", "reference",
)


def target_candidates(text: Column) -> Column:
    """(token, context) of a retrosynthesis text, first seen.

    In order: what target phrases name, labelled values, lines that are no step and hold nothing
    bought, tokens before a parenthesis, and long tokens without words of procedures.
    """
    named = F.concat(*[F.flatten(F.transform(extract_all(text, rf"(?i){p}\s+([^\n]+?)(?:\s*[,;.(\n]|$)"), segment_candidates)) for p in TARGET_PHRASES])
    labelled = F.transform(extract_all(text, r"(?i)SMILES\s*\d*\s*:\s*([^\n]+)"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), r"^[,.;]+|[,.;]+$", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike("|".join(STEP_MARKS)) & ~x.rlike(r"(?i)\(available\)|\(not\s+available\)") & x.rlike("[CNOSPFIcnosp]"))
    before = extract_all(text, r"([CNOSPFI][A-Za-z0-9@+\-\[\]()=#%/.\\]+)\s*\(")
    long = F.filter(extract_all(text, r"\b([CNOSPFI][A-Za-z0-9@+\-\[\]()=#%/.\\]{8,})\b"), lambda x: ~F.lower(x).rlike("|".join(NO_TARGET)))
    stages = (("target_phrase", named), ("smiles_label", labelled), ("step_line", F.flatten(F.transform(lines, segment_candidates))), ("paren_prefix", before), ("greedy_pattern", long))
    tag = lambda name: lambda t: F.struct(t.alias("token"), F.lit(name).alias("context"))
    return first_of_each(F.concat(*[F.transform(_valid(tokens), tag(name)) for name, tokens in stages]))


def rows_of(df: DataFrame, array: Column, keep: list[str], name: str = "token") -> DataFrame:
    """A row per struct of an array.  The outer form computes the array once; the inner one would also test its size first."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(name).isNotNull())


def first_of_each(rows: Column, name: str = "token") -> Column:
    """Of an array of structs the first with each value of a field, in order; the array is computed once."""
    return let(rows, lambda r: let(r[name], lambda names: F.filter(r, lambda x, i: F.array_position(names, x[name]) == i + 1)))


def strip_special(text: Column) -> Column:
    """Without chat-template tokens and hash marks."""
    return F.trim(F.regexp_replace(text, r"<\|[^|>]*\|>|</?s>|#", ""))


def before_marker(text: Column, marker: str = "SMILES", otherwise: int = 800) -> Column:
    """The reasoning before the first marker, else the first characters."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.substring(text, 1, otherwise))


def strip_echo(text: Column, marker: str, share: float = 0.3) -> Column:
    """Cut at a marker that stands in the first ``share`` of the text."""
    at = F.instr(text, marker)
    return F.when((at > 0) & (at <= F.length(text) * share), F.substring(text, at, F.length(text))).otherwise(text)


def field(text: Column, name: str) -> Column:
    """The value of a ``Name: value`` line, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\s*{name}\s*:\s*(.*)$", 1)), F.lit(""))


def number_range(text: Column, low: float, high: float) -> Column:
    """(low, high) of 'a-b', with defaults for what cannot be read."""
    part = lambda i: F.regexp_extract(text, r"^\s*([0-9.]+)\s*-\s*([0-9.]+)\s*$", i).try_cast("double")
    return F.struct(F.coalesce(part(1), F.lit(low)).alias("low"), F.coalesce(part(2), F.lit(high)).alias("high"))


def heuristic_verdict(text: Column) -> Column:
    """impossible, likely or sure from a mass in Da and from words, in any letter case."""
    low = F.lower(text)
    mass = F.regexp_extract(low, r"(\d+)\s*da", 1).try_cast("int")
    good, bad = low.rlike("high|excellent|strong"), low.rlike("low|poor|limited")
    return F.when((mass < 200) | (mass > 600), "impossible").when((mass > 500) | (mass < 250), "likely").when(good & ~bad, "sure").otherwise("likely")


def docking_score(output: Column) -> Column:
    """The first line 'int float', else the first '<float> kcal'."""
    first = F.regexp_extract(output, r"(?m)^\s*\d+\s+(-?\d+\.\d+)", 1)
    second = F.regexp_extract(output, r"(-?\d+\.\d+)\s*kcal", 1)
    return F.coalesce(first.try_cast("double"), second.try_cast("double"))


# Words that no target molecule of a procedure holds.
PROCEDURE_WORDS = (
    "available", "synthesize", "synthesis", "procedure", "step", "requires", "applied", "reaction", "follow", "example", "intermediate",
    "dissolved", "stirred", "heated", "mmol", "equiv", "buffer", "column", "chromatography", "concentrated", "washed", "solution", "mixture",
    "compound", "reagent", "tert", "butyl", "butoxycarbonyl", "piperazine", "phenyl", "methyl", "methoxy", "ethoxy", "ethoxycarbonyl", "indole",
    "purified", "sodium", "potassium", "magnesium", "soluble", "hexane", "acetate", "ether", "chloroform", "palladium", "chromium", "copper",
    "bromide", "chloride", "iodide", "reduct", "oxid", "catalyst", "ligand", "chromene", "quinazoline", "sulfonamide", "nicotinamide",
    "benzamide", "pyridine", "pyridazine", "pyridinyl", "benzylidene", "acetonitrile", "dichloromethane", "dimethylsulfoxide", "triethylamine",
    "hydrochloride", "equivalents", "room temperature", "overnight", "reflux", "purification", "extraction", "filtration", "concentration",
    "evaporation", "saturated", "brine", "anhydrous", "sulfate", "celite", "silica", "gradient",
)


# The phrases and tokens that the four strategies look for.
DESIGNED = r"(?i)Therefore,?\s+the\s+designed\s+molecule\s+is\s*[:.]?\s*(?:\d+:\s*)?([A-Za-z0-9@+\-\[\]()=#%/.\\]+)\."
APPLIED, REQUIRED = r"The\s+applied\s+reaction\s+is", r"requires\s+the\s+reactants?"
AFTER_APPLIED, AFTER_REQUIRED = r"(?i),?\s*which\s+requires.*$", r"(?i)\s*This\s+is\s+step.*$"
FIRST_STEP = r"This\s+is\s+step\s*1"
LONG_TOKEN = r"\b([CNOSPFI][A-Za-z0-9@+\-\[\]()=#%/.\\]{12,})\b"


def retrosynthesis_candidates(text: Column, window: int = 600) -> Column:
    """(strategy, token) of a retrosynthesis text, first seen across strategies, in their order.

    0: the designed molecule, up to the sentence's end; 1: the parts of applied reactions; 2: the
    reactants required; 3: long tokens between the conclusion and step 1.  1 and 2 look at
    ``window`` characters after their phrase and at parts of eight characters or more.
    """
    after = lambda phrase: extract_all(text, rf"(?is){phrase}\s*:\s*(?=(.{{0,{window}}}))")
    ended = lambda x: F.trim(F.regexp_replace(F.trim(x), r"[.,]+$", ""))
    designed = F.array(F.regexp_extract(text, DESIGNED, 1))
    applied = F.flatten(F.transform(after(APPLIED), lambda x: F.split(ended(F.regexp_replace(x, AFTER_APPLIED, "")), r"\.")))
    applied = F.filter(F.transform(applied, ended), lambda x: (F.length(x) >= 8) & ~x.rlike("^[0-9]"))
    needed = F.flatten(F.transform(after(REQUIRED), lambda x: F.split(F.regexp_replace(x, AFTER_REQUIRED, ""), r",\s*")))
    needed = F.filter(F.transform(needed, lambda x: ended(_unbracketed(x))), lambda x: F.length(x) >= 8)
    step = FIRST_STEP
    until = F.when(text.rlike(rf"(?i){step}"), F.regexp_extract(text, rf"(?is)^(.*?{step})", 1)).otherwise(F.substring(text, 1, 2000))
    place = F.when(text.rlike(rf"(?is)Therefore.*{step}"), F.regexp_extract(text, rf"(?is)(Therefore.*?{step})", 1)).otherwise(until)
    greedy = F.filter(extract_all(place, LONG_TOKEN), lambda t: ~F.lower(t).rlike("|".join(PROCEDURE_WORDS)))
    tag = lambda k: lambda t: F.struct(F.lit(k).alias("strategy"), t.alias("token"))
    return first_of_each(F.concat(*[F.transform(_valid(tokens), tag(k)) for k, tokens in enumerate((designed, applied, needed, greedy))]))


# Ring systems that a text without a block may name, and what such a proposal says.
KNOWN_RINGS = (
    "quinazoline", "pyrimidine", "indole", "imidazotetrazine", "benzimidazole", "purine", "pyridine", "pyrrole", "thiazole", "quinoline",
    "isoquinoline", "benzothiazole", "triazine", "morpholine",
)
KNOWN_WARHEADS = ("acrylamide", "cyanoacrylamide", "reversible", "covalent", "nitrogen mustard", "epoxide", "alkyl halide")
KNOWN_ENHANCERS = ("fluorine", "methoxy", "methyl", "trifluoromethyl", "chloro", "bromo")


def scaffold_proposals(text: Column, most: int = 3) -> Column:
    """(name, rationale, base_mw, bbb_potential) of each block that begins with a Name line, else of the ring systems named.

    A block without a mass has 150, without a potential medium; the i-th ring system has 150 + 20 i,
    and the first two a high potential.
    """
    blocks = F.filter(F.transform(F.split(text, r"(?im)^(?=\s*(?:Scaffold\s+\d+:\s*)?Name:)"), lambda b: F.struct(field(b, r"(?:Scaffold\s+\d+:\s*)?Name").alias("name"), b.alias("b"))), lambda x: F.coalesce(F.length(x["name"]) < 50, F.lit(False)))
    parsed = F.transform(
        blocks,
        lambda x: F.struct(
            x["name"].alias("name"),
            F.coalesce(F.substring(field(x["b"], "Rationale"), 1, 200), F.lit("Suitable for GBM drug design")).alias("rationale"),
            F.coalesce(F.regexp_extract(field(x["b"], r"Base\s+MW"), r"(\d+)", 1).try_cast("int"), F.lit(150)).alias("base_mw"),
            F.coalesce(F.nullif(F.lower(F.regexp_extract(field(x["b"], r"BBB\s+Potential"), "(?i)(high|medium|low)", 1)), F.lit("")), F.lit("medium")).alias("bbb_potential"),
        ),
    )
    named = F.filter(F.array(*[F.lit(r) for r in KNOWN_RINGS]), lambda r: F.contains(F.lower(text), r))
    rings = F.transform(
        named,
        lambda r, i: F.struct(r.alias("name"), F.concat(F.lit("Suitable scaffold for "), r).alias("rationale"), (150 + (i + 1) * 20).alias("base_mw"), F.when(i < 2, "high").otherwise("medium").alias("bbb_potential")),
    )
    return F.slice(F.when(F.size(parsed) > 0, parsed).otherwise(rings), 1, most)


def assembly_strategies(text: Column, most: int = 3) -> Column:
    """(warhead, enhancers, mw, logp, tpsa, rationale) of each block that begins with a Warhead line, else one of what the text names."""
    blocks = F.filter(F.split(text, r"(?im)^(?=\s*Warhead:)"), lambda b: field(b, "Warhead").isNotNull() & field(b, "Rationale").isNotNull())
    parsed = F.transform(
        blocks,
        lambda b: F.struct(
            field(b, "Warhead").alias("warhead"),
            field(b, r"BBB\s+Enhancers").alias("enhancers"),
            F.regexp_extract(field(b, r"Estimated\s+Total\s+MW"), r"(\d+)", 1).try_cast("int").alias("mw"),
            field(b, r"Expected\s+LogP").alias("logp"),
            field(b, r"Expected\s+TPSA").alias("tpsa"),
            field(b, "Rationale").alias("rationale"),
        ),
    )
    first = lambda names: F.coalesce(F.get(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(F.lower(text), n)), F.lit(0)), F.lit(names[0]))
    warhead = first(KNOWN_WARHEADS)
    fallback = F.struct(
        warhead.alias("warhead"),
        first(KNOWN_ENHANCERS).alias("enhancers"),
        F.coalesce(F.regexp_extract(text, r"(\d{3})", 1).try_cast("int"), F.lit(450)).alias("mw"),
        F.lit("2.5-3.5").alias("logp"),
        F.lit("60-90").alias("tpsa"),
        F.concat(F.lit("Extracted from output: warhead="), warhead).alias("rationale"),
    )
    return F.slice(F.when(F.size(parsed) > 0, parsed).otherwise(F.array(fallback)), 1, most)


def alert_advice(alerts: Column, fixes: dict[str, str], generic: str) -> Column:
    """A line per alert, each once, with its fix or, for an alert without one, the generic advice."""
    known = F.create_map(*[F.lit(x) for pair in fixes.items() for x in pair])
    return F.transform(F.array_distinct(alerts), lambda a: F.concat(a, F.lit(": "), F.coalesce(F.try_element_at(known, a), F.lit(generic))))


def alert_lines(alerts: Column, fixes: dict[str, str], generic: str) -> Column:
    """The lines of ``alert_advice`` as one text."""
    return F.array_join(alert_advice(alerts, fixes, generic), "\n")
