"""Evaluators by name, and extraction rules as SQL table functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reagentql.functions import scoring as S
from reagentql.functions import text as T


@dataclass(frozen=True)
class Evaluator:
    """A named score: the columns it needs, and the expression over them."""

    needs: tuple[str, ...]
    score: Callable[..., Column]


@dataclass
class Evaluators:
    """Evaluators that are applied by name; a copy with others in their place is how a run swaps one."""

    known: dict[str, Evaluator] = field(default_factory=dict)

    def add(self, name: str, needs: tuple[str, ...], score: Callable[..., Column]) -> None:
        """Add an evaluator; a name that is taken is an error (see ``replaced``)."""
        if name in self.known:
            raise ValueError(f"evaluator {name} is there already")
        self.known[name] = Evaluator(needs, score)

    def replaced(self, **others: Callable[..., Column]) -> Evaluators:
        """A copy in which some evaluators have other expressions over the same columns."""
        unknown = others.keys() - self.known.keys()
        if unknown:
            raise KeyError(f"no such evaluators: {', '.join(sorted(unknown))}")
        return Evaluators(self.known | {n: Evaluator(self.known[n].needs, f) for n, f in others.items()})

    def evaluate(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """``rows`` with a column for each name; unknown names and missing columns are errors before anything runs."""
        for n in names:
            if n not in self.known:
                raise KeyError(f"no such evaluator: {n}")
            missing = [x for x in self.known[n].needs if x not in rows.columns]
            if missing:
                raise ValueError(f"{n} needs the columns {', '.join(missing)}")
        return rows.withColumns({n: self.known[n].score(*map(F.col, self.known[n].needs)) for n in names})


def default_evaluators() -> Evaluators:
    """The engine's own scores."""
    out = Evaluators()
    out.add("log_bb", ("logp", "tpsa", "mw", "hbd", "hba"), S.log_bb)
    out.add("docking", ("mw", "logp", "tpsa"), S.pseudo_dock)
    out.add("vina_norm", ("vina",), S.vina_norm)
    out.add("tpsa_norm", ("tpsa",), S.tpsa_norm)
    out.add("mw_norm", ("mw",), S.mw_norm)
    return out


#: Patterns whose first group is a token, by the name of the table function.
TABLE_FUNCTIONS = {"numbered": T.NUMBERED, "labelled": T.LABELLED, "listed": T.LISTED}


def register_table_functions(spark: SparkSession, patterns: dict[str, str] = TABLE_FUNCTIONS, prefix: str = "extract_") -> list[str]:
    """Temporary SQL functions (body) -> table of place (from 0) and token, one for each pattern; their names.

    They are SQL, so a query that calls them in a LATERAL join stays in the JVM, and the pattern is
    part of the function: ``SELECT id, x.* FROM texts, LATERAL extract_listed(text) x``.
    """
    made = []
    for name, pattern in patterns.items():
        quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
        found = f"posexplode(regexp_extract_all(body, '{quoted}', 1))"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(body STRING) RETURNS TABLE(place INT, token STRING) RETURN SELECT pos, col FROM {found}")
        made.append(prefix + name)
    return made
