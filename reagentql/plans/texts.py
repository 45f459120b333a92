"""Text extraction, checking and rendering over composed responses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reagentql.functions import text as T
from reagentql.plans.proxies import read
from reagentql.sources.readers import spread

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


# A response per order: numbered lines, a labelled token or a list, made from the order's numbers.
RESPONSE = """CASE o_orderkey % 4
 WHEN 0 THEN concat('Here are two.', chr(10), 'SMILES 1: C', repeat('C', CAST(o_custkey % 5 AS INTEGER)), '(N)O', chr(10), 'SMILES 2: "CC', o_orderkey % 9, 'N>>OCC', o_custkey % 7, '(F)C"')
 WHEN 1 THEN concat('I propose SMILES: CN', o_orderkey % 9, 'CC(O)', repeat('C', CAST(o_custkey % 4 AS INTEGER)), ' with MW of ', 150 + o_custkey % 500, ' Da and good affinity')
 WHEN 2 THEN concat('1. CC(C)N', o_orderkey % 9, chr(10), '2) OCC(=O)', o_custkey % 9, 'C', chr(10), '3: none')
 ELSE concat('<|im_start|>No candidate today', o_custkey % 3, '; weak and poor, ', 150 + o_custkey % 500, ' Da') END"""
RESP_SQL = f"r AS (SELECT o_orderkey AS id, {RESPONSE} AS text FROM orders)"
CLEAN = r"regexp_replace(trim({0}), '^[.,;:''\"`]+|[.,;:''\"`]+$', '', 'g')"
# The strict rule, said once more: no constant is shared with the engine.
STRICT = r"""(regexp_matches({0}, '^[A-Za-z0-9@+\-\[\]()=#%/\\.]+$') AND len({0}) BETWEEN 5 AND 600
 AND lower({0}) NOT IN ('chain-of-thought', 'valid_smiles', 'smiles_string', '<valid_smiles>', 'analysis', 'reasoning', 'design', 'output', 'format', 'scaffold', 'strategy', 'warhead', 'enhancer', 'rationale',
   'quinazoline', 'pyrimidine', 'indole', 'imidazotetrazine', 'benzimidazole', 'purine', 'pyridine', 'pyrrole', 'thiazole')
 AND NOT regexp_matches(lower({0}), 'synthetic|complexity|therefore|suggests|moderately|challenging|retrosynthesis|synthesize|procedure|designed molecule|designed scaffold')
 AND NOT regexp_matches({0}, '^\[[A-Za-z][A-Za-z0-9]*[+-]?\]$') AND len({0}) - len(replace(replace({0}, 'C', ''), 'c', '')) >= 2
 AND len(replace(replace({0}, '(', ''), '[', '')) = len(replace(replace({0}, ')', ''), ']', '')) AND regexp_matches({0}, '[BCFHINOPS]'))"""
STOP = "('smiles', 'none', 'molecule', 'invalid', 'example', 'unknown', 'null')"
NUMBERED, LABELLED, LISTED = r"(?im)^\s*SMILES\s*\d+\s*[:=]\s*(\S+)", r"(?i)smiles\s*[:=]\s*([A-Za-z0-9@+\-\[\]()=#$]{3,100})", r"(?m)^\s*\d+\s*[.):]\s*(\S+)"
DISTINCT = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"


def _stage(pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(text, '{pattern}', 1), lambda t: {CLEAN.format('string_split(t, chr(62) || chr(62))[-1]')}), lambda t: {STRICT.format('t')})"


def responses(spark, sf):
    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.expr(RESPONSE).alias("text"))


@query(f"WITH {RESP_SQL}, x AS (SELECT id, unnest(regexp_extract_all(text, '{NUMBERED}', 1)) AS token FROM r) SELECT id, token FROM x")
def q_extract_numbered(spark, sf):
    return responses(spark, sf).select("id", F.explode(T.extract_all(c("text"), T.NUMBERED)).alias("token"))


@query(
    f"WITH {RESP_SQL}, s AS (SELECT id, {_stage(NUMBERED)} AS a, {_stage(LABELLED)} AS b, {_stage(LISTED)} AS c FROM r), y AS (SELECT id, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END AS l FROM s) "
    f"SELECT id, array_to_string({DISTINCT.format('l')}[1:5], ' ') AS tokens FROM y"
)
def q_extract_cascade(spark, sf):
    return responses(spark, sf).select("id", F.array_join(T.extract_cascade(c("text"), 5), " ").alias("tokens"))


WORD_SQL = "w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) UNION SELECT unnest(string_split(text, ' ')) FROM r)"


@query(
    f"WITH {RESP_SQL}, {WORD_SQL} SELECT word, len(word) BETWEEN 5 AND 150 AND NOT regexp_matches(word, '^[A-Za-z]+$') AND NOT regexp_matches(word, '\\s') AND regexp_matches(word, '^[ -~]+$') AND regexp_matches(word, '^[A-Za-z\\[(]') AS format_ok, "
    f"{STRICT.format('word')} AS strict_ok, {STRICT.format('word')} AND NOT regexp_matches(word, '[=@%\\\\]') AS compat_ok, len(word) BETWEEN 5 AND 300 AND lower(word) NOT IN {STOP} AND len(regexp_replace(word, '[^BCNOPSFIbcnops0-9()\\[\\]=#@+\\-]', '', 'g')) * 2 >= len(word) AS loose_ok FROM w"
)
def q_text_validator(spark, sf):
    words = read(spark, sf, "documents").select("text").union(responses(spark, sf).select("text")).where(c("text").isNotNull())
    words = words.select(F.explode(F.split("text", " ")).alias("word")).distinct()
    w = c("word")
    return words.select("word", T.format_ok(w).alias("format_ok"), T.strict_ok(w).alias("strict_ok"), T.strict_ok(w, True).alias("compat_ok"), T.loose_ok(w).alias("loose_ok"))


BLOCK = "concat('Name: scaffold ', o_orderkey % 50, chr(10), CASE WHEN o_custkey % 3 > 0 THEN concat('Base MW: ', 100 + o_custkey % 200, chr(10)) ELSE '' END, 'BBB Potential: ', CASE o_orderkey % 2 WHEN 0 THEN 'high' ELSE '' END, chr(10), 'MW Range: ', CASE WHEN o_orderkey % 5 = 0 THEN 'unclear' ELSE concat(200 + o_orderkey % 90, '-', 300 + o_custkey % 200) END)"
FIELD = r"nullif(trim(regexp_extract(t, '(?im)^\s*{0}\s*:\s*(.*)$', 1)), '')"
RNG = r"try_cast(regexp_extract({0}, '^\s*([0-9.]+)\s*-\s*([0-9.]+)\s*$', {1}) AS DOUBLE)"


@query(
    f"WITH b AS (SELECT o_orderkey AS id, {BLOCK} AS t FROM orders), f AS (SELECT id, {FIELD.format('Name')} AS name, coalesce(try_cast({FIELD.format('Base MW')} AS DOUBLE), 150) AS base, coalesce({FIELD.format('BBB Potential')}, 'medium') AS bbb, {FIELD.format('MW Range')} AS rng FROM b) "
    f"SELECT id, name, base, bbb, coalesce({RNG.format('rng', 1)}, 200) AS low, coalesce({RNG.format('rng', 2)}, 500) AS high, coalesce({RNG.format('rng', 2)}, 500) - base AS budget FROM f"
)
def q_block_parser(spark, sf):
    blocks = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.expr(BLOCK).alias("t"))
    rng = T.number_range(T.field(c("t"), "MW Range"), 200.0, 500.0)
    out = blocks.select(
        "id", T.field(c("t"), "Name").alias("name"), F.coalesce(T.field(c("t"), "Base MW").try_cast("double"), F.lit(150.0)).alias("base"), F.coalesce(T.field(c("t"), "BBB Potential"), F.lit("medium")).alias("bbb"), rng.alias("r")
    )
    return out.select("id", "name", "base", "bbb", c("r.low").alias("low"), c("r.high").alias("high"), (c("r.high") - c("base")).alias("budget"))


@query("SELECT conv_id, turn, md5(CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) ELSE substr(text, 1, 800) END) AS prefix_md5, md5(CASE WHEN instr(text, 'on') > 0 AND instr(text, 'on') <= len(text) * 0.3e0 THEN substr(text, instr(text, 'on')) ELSE text END) AS echo_md5 FROM conversations")
def q_cot_prefix(spark, sf):
    t = c("text")
    return read(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.before_marker(t, "the")).alias("prefix_md5"), F.md5(T.strip_echo(t, "on")).alias("echo_md5"))


@query(
    f"WITH {RESP_SQL}, m AS (SELECT id, text, try_cast(regexp_extract(lower(text), '(\\d+)\\s*da', 1) AS INTEGER) AS mass, regexp_matches(text, '(?i)high|excellent|strong') AS hi, regexp_matches(text, '(?i)low|poor|limited') AS lo FROM r) "
    "SELECT id, CASE WHEN mass < 200 OR mass > 600 THEN 'impossible' WHEN mass > 500 OR mass < 250 THEN 'likely' WHEN hi AND NOT lo THEN 'sure' ELSE 'likely' END AS verdict, "
    "len(text) > 10 AND regexp_matches(text, '[()\\[\\]=#@+/-]') AND NOT regexp_matches(text, '(?i)scaffold|strategy|warhead|rationale|enhancer|estimated|expected|name:|base mw|bbb potential') AS candidate, md5(trim(regexp_replace(text, '<\\|[^|>]*\\|>|</?s>|#', '', 'g'))) AS bare_md5 FROM m"
)
def q_heuristic_verdict(spark, sf):
    t = c("text")
    return responses(spark, sf).select("id", T.heuristic_verdict(t).alias("verdict"), T.looks_like_candidate(t).alias("candidate"), F.md5(T.strip_special(t)).alias("bare_md5"))


DOCK = "CASE o_orderkey % 3 WHEN 0 THEN concat('mode affinity', chr(10), '   1      -', 4 + o_custkey % 8, '.', o_orderkey % 10, '  0.0', chr(10), '   2   -3.1') WHEN 1 THEN concat('estimated -', o_custkey % 11, '.', o_orderkey % 10, ' kcal/mol') ELSE 'failed' END"


@query(rf"WITH d AS (SELECT o_orderkey AS id, {DOCK} AS t FROM orders) SELECT id, coalesce(try_cast(regexp_extract(t, '(?m)^\s*\d+\s+(-?\d+\.\d+)', 1) AS DOUBLE), try_cast(regexp_extract(t, '(-?\d+\.\d+)\s*kcal', 1) AS DOUBLE)) AS score FROM d")
def q_docking_parse(spark, sf):
    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.expr(DOCK).alias("t")).select("id", T.docking_score(c("t")).alias("score"))


RETRO = """concat('Therefore, the designed molecule is: 1: CC(N)CCO', o_orderkey % 9, '. The applied reaction is: CCOC(C)N', o_custkey % 4, '.NCC(F)CO', o_custkey % 9,
 ', which requires the reactants: CCN(C)CCCO', o_orderkey % 5, ' (available), OCCCCCF', o_custkey % 3, ' (not available). This is step 1, then CCCCCCCCCCCCCCO')"""


# The rows that the text was made to hold.
@query("""WITH d AS (SELECT o_orderkey AS id, o_orderkey AS o, o_custkey AS c FROM orders)
  SELECT id, 0 AS strategy, concat('CC(N)CCO', o % 9) AS token FROM d UNION ALL SELECT id, 1, concat('CCOC(C)N', c % 4) FROM d UNION ALL SELECT id, 1, concat('NCC(F)CO', c % 9) FROM d
  UNION ALL SELECT id, 2, concat('CCNCCCO', o % 5) FROM d UNION ALL SELECT id, 2, concat('OCCCCCF', c % 3) FROM d UNION ALL SELECT id, 3, concat('CCOC(C)N', c % 4, '.NCC(F)CO', c % 9) FROM d""")
def q_retro_extract(spark, sf):
    rows = spread(read(spark, sf, "orders").select("o_orderkey", "o_custkey")).select(c("o_orderkey").alias("id"), F.expr(RETRO).alias("t"))
    return T.rows_of(rows, T.retrosynthesis_candidates(c("t")), ["id"])


@query("SELECT o_orderkey AS id, concat('COccBrN+', CASE o_orderkey % 3 WHEN 0 THEN 'CN' WHEN 1 THEN 'C@Se' ELSE '[Xe]-' END, o_orderkey % 7) AS line FROM orders")
def q_bracket_to_line(spark, sf):
    tail = F.when(c("o_orderkey") % 3 == 0, "[=C][#N][Branch1]").when(c("o_orderkey") % 3 == 1, "[C@][Ring2][se]").otherwise("[Xe]-")
    text = F.concat(F.lit("[C][OH][c][c][Br][H][N+1]"), tail, (c("o_orderkey") % 7).cast("string"))
    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), T.bracket_to_line(text).alias("line"))


@query("""WITH s AS (SELECT event_id AS id, event_type AS state, round(value / 50, 3) AS score FROM events), p AS (SELECT id, state, score, list_filter([CASE WHEN state IN ('view', 'signup') THEN 'permeability: high' ELSE 'permeability: moderate' END, CASE WHEN score > 7 THEN 'activity: high' END, CASE WHEN state = 'error' THEN 'toxicity: low' END], lambda v: v IS NOT NULL) AS c FROM s)
  SELECT id, 'Design for state ' || state || ' with score ' || printf('%.3f', score) || ': ' || array_to_string(c, '; ') AS instruction, CAST(len(c) AS INTEGER) AS n_constraints FROM p""")
def q_qa_instruction(spark, sf):
    rows = read(spark, sf, "events").select(c("event_id").alias("id"), c("event_type").alias("state"), F.round(c("value") / 50, 3).alias("score"))
    parts = F.array_compact(
        F.array(
            F.when(c("state").isin("view", "signup"), "permeability: high").otherwise("permeability: moderate"), F.when(c("score") > 7, "activity: high"), F.when(c("state") == "error", "toxicity: low")
        )
    )
    text = F.concat(F.lit("Design for state "), c("state"), F.lit(" with score "), F.format_string("%.3f", c("score")), F.lit(": "), F.array_join("c", "; "))
    return rows.withColumn("c", parts).select("id", text.alias("instruction"), F.size("c").alias("n_constraints"))


@query(f"WITH {RESP_SQL}, x AS (SELECT id, unnest(regexp_extract_all(text, '{LISTED}', 1)) AS token FROM r), k AS (SELECT token, min(id) AS first_id, count(*) AS n FROM x GROUP BY token) SELECT token, first_id, n FROM k")
def q_distinct_candidates(spark, sf):
    found = responses(spark, sf).select("id", F.explode(T.extract_all(c("text"), T.LISTED)).alias("token"))
    return found.groupBy("token").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
