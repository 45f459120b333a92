"""Readers, sinks and structures: driver tables written in the engine's formats and read back, with SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from reagentql.operators import relational as R
from reagentql.operators import structure as P
from reagentql.plans.proxies import read
from reagentql.plans.relational import RESIDUES
from reagentql.sources import mmcif, readers, sinks
from reagentql.sources.ledger import Ledger
from reagentql.storage import own_folder

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _folder(spark) -> str:
    return f"{own_folder(spark)}/files"


def _documents(rows, key: str, text):
    """A file for each key, with one text."""
    return rows.groupBy(c(key).alias("k")).agg(text.alias("value"))


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'EGFR' ELSE c_mktsegment END AS target, 'C' || c_nationkey AS smiles, c_custkey % 100 / 100e0 AS composite_score, CAST(c_custkey % 140 AS DOUBLE) AS tpsa FROM customer WHERE c_custkey % 4 > 0")
def q_read_candidates(spark, sf):
    """Candidates of each nation in a result document; invalid ones are left out, those without a target have the default one."""
    evaluation = F.struct((c("c_custkey") % 4 > 0).alias("valid"), F.struct((c("c_custkey") % 100 / 100.0).alias("composite_score")).alias("scores"), F.struct((c("c_custkey") % 140).cast("double").alias("tpsa")).alias("properties"))
    one = F.struct(F.concat(F.lit("c"), c("c_custkey").cast("string")).alias("id"), F.when(c("c_custkey") % 3 > 0, c("c_mktsegment")).alias("target"), F.concat(F.lit("C"), c("c_nationkey").cast("string")).alias("smiles"), evaluation.alias("evaluation"))
    folder = _folder(spark)
    _documents(read(spark, sf, "customer"), "c_nationkey", F.to_json(F.struct(F.collect_list(one).alias("results")))).write.partitionBy("k").text(folder)
    return readers.analysis_frame(readers.candidates(spark, f"{folder}/k=*")).select("id", "target", "smiles", "composite_score", "tpsa")


@query("SELECT p_partkey AS id, 'Instruction: make ' || p_name || chr(10) || 'Response: ' || p_brand AS text FROM part WHERE p_size > 10")
def q_read_instructions(spark, sf):
    """Instruction records, half of them in each shape, in a document a brand."""
    part = read(spark, sf, "part").where("p_size > 10")
    one = F.struct(F.concat(F.lit("make "), c("p_name")).alias("instruction"), c("p_partkey").cast("string").alias("input"), F.when(c("p_partkey") % 2 == 0, c("p_brand")).alias("output"), F.when(c("p_partkey") % 2 == 1, c("p_brand")).alias("response"))
    folder = _folder(spark)
    _documents(part, "p_brand", F.to_json(F.collect_list(one))).write.partitionBy("k").text(folder)
    found = readers.instructions(spark, f"{folder}/k=*")
    # Records keep no key, so the part is found by what its text says.
    named = part.select(c("p_partkey").alias("id"), F.concat(F.lit("make "), c("p_name")).alias("instruction"), c("p_brand").alias("response"))
    return named.join(found.distinct(), ["instruction", "response"]).select("id", "text")


@query("""WITH w AS (SELECT event_type AS cell_state, 'd' || user_id % 6 AS drug, round(sum(value), 3) AS score FROM events WHERE user_id % 6 > 0 OR event_type = 'view' GROUP BY ALL), s AS (SELECT DISTINCT event_type AS cell_state FROM events), d AS (SELECT unnest(['d0', 'd1', 'd2', 'd3', 'd4', 'd5']) AS drug)
  SELECT s.cell_state, d.drug, w.score FROM s CROSS JOIN d LEFT JOIN w ON w.cell_state = s.cell_state AND w.drug = d.drug""")
def q_read_connectivity(spark, sf):
    """A wide matrix as CSV, states by drugs, with empty cells."""
    rows = read(spark, sf, "events").where("user_id % 6 > 0 OR event_type = 'view'").select(c("event_type").alias("state"), F.concat(F.lit("d"), (c("user_id") % 6).cast("string")).alias("drug"), "value")
    folder = _folder(spark)
    rows.groupBy("state").pivot("drug", [f"d{i}" for i in range(6)]).agg(F.round(F.sum("value"), 3)).write.option("header", True).csv(folder)
    return readers.connectivity(spark, folder)


@query("SELECT p_brand || '+' || p_partkey AS Compounds, CASE WHEN p_size % 5 > 0 THEN p_size / 25e0 END AS Combination_Index FROM part")
def q_read_combinations(spark, sf):
    folder = _folder(spark)
    index = F.when(c("p_size") % 5 > 0, (c("p_size") / 25.0).cast("string")).otherwise("none")
    read(spark, sf, "part").select(F.concat(F.lit("  "), c("p_brand"), F.lit("+"), c("p_partkey").cast("string")).alias("Compounds"), index.alias("Combination_Index")).write.option("header", True).csv(folder)
    return readers.combinations(spark, folder)


@query("SELECT event_type AS target, 'u' || user_id AS smiles, printf('%.2f', max(value)) AS best, event_type || '_' || lpad(CAST(row_number() OVER (PARTITION BY event_type ORDER BY 'u' || user_id) - 1 AS VARCHAR), 5, '0') AS seq_id FROM events GROUP BY event_type, user_id")
def q_candidates_csv(spark, sf):
    """The candidate table as a user finds it in its CSV."""
    folder = _folder(spark)
    rows = read(spark, sf, "events").groupBy(c("event_type").alias("target"), F.concat(F.lit("u"), c("user_id").cast("string")).alias("smiles")).agg(F.max("value").alias("best"))
    sinks.write_candidates_csv(rows, folder)
    return spark.read.option("header", True).csv(folder).select("target", "smiles", "best", "seq_id")


@query("SELECT event_type AS target, user_id AS key, CASE WHEN bool_or(day(ts) <= 10) THEN 0 ELSE 1 END AS version FROM events GROUP BY ALL")
def q_append_new(spark, sf):
    """Keys of the first ten days, then all keys, appended to a ledger: the second adds only those that the first lacked."""
    ledger = Ledger(spark, _folder(spark))
    rows = read(spark, sf, "events").select(c("event_type").alias("target"), c("user_id").alias("key"), F.dayofmonth("ts").alias("d"))
    ledger.append_new(rows.where("d <= 10").select("target", "key"), ["target", "key"])
    ledger.append_new(rows.select("target", "key"), ["target", "key"])
    return ledger.read().select("target", "key", c("_version").cast("int").alias("version"))


@query("SELECT event_type AS target, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def q_last_state(spark, sf):
    """The state after the last of two attempts; the first covers half of the rows."""
    folder = _folder(spark)
    rows = read(spark, sf, "events").select(c("event_type").alias("target"), "user_id", "value")
    of = lambda part: part.groupBy("target").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    for attempt, part in ((1, rows.where("user_id % 2 = 0")), (2, rows), (2, rows)):
        sinks.write_state(of(part), folder, attempt)
    return sinks.last_state(spark, folder)


@query("""WITH o AS (SELECT doc_id, lang, row_number() OVER w AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WINDOW w AS (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id))
  SELECT lang, CASE WHEN i <= floor(n * 0.9e0) THEN 'train' ELSE 'held_out' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM o GROUP BY ALL""")
def q_written_splits(spark, sf):
    """A tenth held out, in a folder a split, counted as read back."""
    folder = _folder(spark)
    sinks.write_splits(R.split_rows(read(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", (("train", 0.9), ("held_out", 0.1))), folder)
    return spark.read.schema("doc_id long, lang string, split string").json(folder).groupBy("lang", "split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("SELECT count(*) AS total, round(avg(value), 6) AS mean, max(value) AS best FROM events")
def q_report(spark, sf):
    return sinks.report(read(spark, sf, "events"), "value").select(F.from_json("report", "total long, mean double, best double").alias("r")).select("r.*")


@query("SELECT p_partkey AS id, concat_ws(' | ', p_name, CASE WHEN p_size > 10 THEN 'size: ' || p_size END, printf('price: %.2f', p_retailprice)) AS line FROM part")
def q_console_lines(spark, sf):
    part = read(spark, sf, "part").select("p_partkey", "p_name", F.when(c("p_size") > 10, c("p_size")).alias("size"), c("p_retailprice").alias("price"))
    shown = sinks.console_lines(part.withColumn("title", F.concat_ws("#", "p_name", c("p_partkey").cast("string"))), "title", {"size": "%d", "price": "%.2f"})
    parts = F.split(c("title"), "#")
    return shown.select(parts[1].cast("long").alias("id"), F.concat(parts[0], F.substr(c("line"), F.length("title") + 1)).alias("line"))


# Atoms as a structure file would list them: heavy, alone or water; some without a number, some with a coordinate that is none.
ATOMS = f"""a AS (SELECT 'f' || l_suppkey % 4 AS file, CAST(l_orderkey * 8 + l_linenumber AS INTEGER) AS ordinal, l_linenumber = 7 AS het, CASE WHEN l_partkey % 11 > 0 THEN CAST(l_partkey % 300 + 1 AS INTEGER) END AS num,
    CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_partkey % 150 + 750 AS INTEGER) END AS auth, {list(RESIDUES)}[1 + l_partkey % 20] AS name, CASE WHEN l_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS chain FROM lineitem WHERE l_orderkey % 13 > 0),
  p AS (SELECT file, ordinal, num, coalesce(auth, num) AS auth, name, chain FROM a WHERE NOT het),
  r AS (SELECT file, chain, num, arg_max(auth, ordinal) AS auth, arg_min(name, ordinal) AS name, min(ordinal) AS ordinal FROM p WHERE num IS NOT NULL GROUP BY ALL)"""


def _atoms(spark, sf):
    text = lambda x: x.cast("string")
    number = F.when(c("l_partkey") % 11 > 0, c("l_partkey") % 300 + 1)
    fields = {
        "group_PDB": F.when(c("l_linenumber") == 7, "HETATM").otherwise("ATOM"), "type_symbol": F.lit("C"), "Cartn_x": text(c("l_quantity")), "Cartn_y": text(c("l_linenumber")), "Cartn_z": F.when(c("l_orderkey") % 13 > 0, "1.5").otherwise("bad"),
        "label_seq_id": text(number), "auth_seq_id": text(F.when(c("l_orderkey") % 5 > 0, c("l_partkey") % 150 + 750)), "label_comp_id": F.element_at(F.array(*map(F.lit, RESIDUES)), (c("l_partkey") % 20 + 1).cast("int")), "label_asym_id": F.when(c("l_suppkey") % 2 == 0, "A").otherwise("B"),
    }
    # Missing fields are left out of the map, as the reader leaves them out.
    pairs = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in fields.items()]))
    rows = read(spark, sf, "lineitem").select(F.concat(F.lit("f"), text(c("l_suppkey") % 4)).alias("file"), F.lit("b").alias("block"), F.lit("atom_site").alias("category"), (c("l_orderkey") * 8 + c("l_linenumber")).cast("int").alias("ordinal"), F.map_from_entries(pairs).alias("fields"), F.lit(None).cast("string").alias("error"))
    return mmcif.atoms(rows)


@query(f"WITH {ATOMS} SELECT file, chain, num AS residue_num, auth AS auth_num, name AS residue_name, ordinal FROM r")
def q_structure_residues(spark, sf):
    return P.residues(_atoms(spark, sf).where("grp = 'ATOM'"))


@query(f"WITH {ATOMS}, o AS (SELECT *, row_number() OVER (PARTITION BY file, auth ORDER BY ordinal) AS i FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ordinal) AS k FROM o WHERE i = 1 AND name IN ('ARG', 'LYS', 'GLU', 'ASP')) SELECT file, auth AS auth_num, name AS residue_name, ordinal FROM s WHERE k <= 20")
def q_structure_surface(spark, sf):
    return P.surface_residues(P.residues(_atoms(spark, sf).where("grp = 'ATOM'"))).select("file", "auth_num", "residue_name", "ordinal")


@query(f"""WITH {ATOMS}, g AS (SELECT file, coalesce(max(CASE WHEN auth = 855 THEN 855 END), max(CASE WHEN auth = 883 THEN 883 END), max(CASE WHEN auth = 338 THEN 338 END)) AS gate FROM r GROUP BY file),
  n AS (SELECT r.*, gate, abs(auth - gate) AS far, row_number() OVER (PARTITION BY r.file ORDER BY abs(auth - gate), ordinal) AS k FROM r JOIN g USING (file) WHERE gate IS NOT NULL AND auth BETWEEN 800 AND 900) SELECT file, auth AS auth_num, residue_num, far FROM (SELECT *, num AS residue_num FROM n) WHERE k <= 30""")
def q_structure_pocket(spark, sf):
    return P.atp_pocket(P.residues(_atoms(spark, sf).where("grp = 'ATOM'"))).select("file", "auth_num", "residue_num", "far")


@query(f"""WITH {ATOMS}, k AS (SELECT file, chain, num, CASE WHEN num // 5 % 3 = 0 THEN 'H' WHEN num // 5 % 3 = 1 THEN 'E' END AS kind FROM r), l AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND lag(num) OVER w = num - 1 THEN 0 ELSE 1 END AS fresh FROM k WINDOW w AS (PARTITION BY file, chain ORDER BY num)),
  m AS (SELECT *, sum(fresh) OVER (PARTITION BY file, chain ORDER BY num) AS run FROM l) SELECT file, chain, kind, min(num) AS start, max(num) AS "end", count(*) AS n FROM m WHERE kind IS NOT NULL GROUP BY file, chain, kind, run""")
def q_structure_secondary(spark, sf):
    turn = F.floor(c("residue_num") / 5) % 3
    kinds = P.residues(_atoms(spark, sf).where("grp = 'ATOM'")).select("file", "chain", "residue_num", F.when(turn == 0, "H").when(turn == 1, "E").alias("kind"))
    return P.secondary_structure(kinds)


@query("""WITH a AS (SELECT 'f' || l_suppkey % 4 AS file, ['LIG', 'ZN', 'HOH', 'FE'][1 + l_partkey % 4] || CASE WHEN l_partkey % 4 = 0 THEN CAST(l_partkey % 9 AS VARCHAR) ELSE '' END AS name, l_partkey % 4 AS k, CAST(l_quantity AS DOUBLE) AS x FROM lineitem WHERE l_linenumber = 7 AND l_orderkey % 40 = 3)
  SELECT file, name AS residue_name, CASE WHEN k IN (1, 3) AND count(*) = 1 THEN 'metal' ELSE 'ligand' END AS kind, count(*) AS n, round(avg(x), 6) AS x FROM a WHERE name <> 'HOH' GROUP BY file, name, k HAVING count(*) < 50""")
def q_structure_components(spark, sf):
    """Components of each file by name: single metals, ligands of fewer than 50 atoms; no water."""
    k = c("l_partkey") % 4
    rows = read(spark, sf, "lineitem").where("l_linenumber = 7 AND l_orderkey % 40 = 3").select(
        F.concat(F.lit("f"), (c("l_suppkey") % 4).cast("string")).alias("file"), F.lit("HETATM").alias("grp"), F.when(k == 1, "ZN").when(k == 3, "FE").otherwise("C").alias("element"), *[c("l_quantity").cast("double").alias(a) for a in "xyz"],
        F.when(k == 0, F.concat(F.lit("LIG"), (c("l_partkey") % 9).cast("string"))).when(k == 1, "ZN").when(k == 2, "HOH").otherwise("FE").alias("residue_name"),
    )
    return P.components(rows).select("file", "residue_name", "kind", "n", F.round("x", 6).alias("x"))


@query("""SELECT 'e' || s_suppkey AS entity_id, CASE s_suppkey % 3 WHEN 0 THEN 'VEGF_VEGFR' WHEN 1 THEN 'EGFR' ELSE 'other' END AS target, 'C' || s_nationkey AS smiles, CASE WHEN s_suppkey % 4 > 0 THEN round(s_acctbal, 2) END AS mw, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey % 2 = 0 END AS bbb_permeant,
  CAST(s_suppkey % 6 AS INTEGER) AS pains_alerts, CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'second' END AS dialect FROM supplier""")
def q_read_results(spark, sf):
    """External result tables in two header dialects; blanks are null, library names become targets."""
    folder = _folder(spark)
    rows = read(spark, sf, "supplier")
    library = F.when(c("s_suppkey") % 3 == 0, "VEGF_2").when(c("s_suppkey") % 3 == 1, "EFGR").otherwise("other")
    weight, permeant = F.when(c("s_suppkey") % 4 > 0, F.round("s_acctbal", 2).cast("string")).otherwise(" "), F.when(c("s_suppkey") % 5 > 0, F.when(c("s_suppkey") % 2 == 0, "Yes").otherwise("No"))
    for k, (name, alerts) in enumerate((("SMILES", "PAINS Alerts"), ("smiles", "PAINS #alerts"))):
        part = rows.where(c("s_suppkey") % 2 == k)
        part.select(
            F.concat(F.lit("e"), c("s_suppkey").cast("string")).alias("entity_id"), library.alias("library_name"), F.concat(F.lit("C"), c("s_nationkey").cast("string")).alias(name), weight.alias("MW"), permeant.alias("BBB permeant"), (c("s_suppkey") % 6).alias(alerts)
        ).write.option("header", True).csv(f"{folder}/{k}")
    found = readers.result_tables(spark, [f"{folder}/0", f"{folder}/1"])
    return found.select("entity_id", "target", "smiles", "mw", "bbb_permeant", "pains_alerts", F.when(c("source_file").endswith("/0"), "first").otherwise("second").alias("dialect"))


@query("""WITH m AS (SELECT s_nationkey AS k, string_agg('m' || s_suppkey, ', ' ORDER BY s_suppkey) AS m FROM supplier GROUP BY 1) SELECT n_name AS name, lower(n_name) AS description, CASE WHEN m IS NOT NULL THEN m WHEN n_nationkey % 2 = 0 THEN 'key ' || n_regionkey ELSE 'Not applicable' END AS mutations FROM nation LEFT JOIN m ON k = n_nationkey""")
def q_read_knowledge(spark, sf):
    """Knowledge on targets in a document a region; a missing list of mutations falls back to the markers."""
    mutations = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("m"))
    rows = read(spark, sf, "nation").join(mutations, c("n_nationkey") == c("s_nationkey"), "left")
    names = F.transform("m", lambda x: F.concat(F.lit("m"), x.cast("string")))
    markers = F.when(c("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("key "), c("n_regionkey").cast("string"))))
    one = F.struct(c("n_name").alias("name"), F.lower("n_name").alias("description"), names.alias("mutation_types"), markers.alias("key_markers"))
    folder = _folder(spark)
    _documents(rows, "n_regionkey", F.to_json(F.struct(F.collect_list(one).alias("gbm_targets")))).write.partitionBy("k").text(folder)
    return readers.targets(spark, f"{folder}/k=*").select("name", "description", "mutations")


@query("SELECT event_type AS property, min(value) AS min, max(value) AS max FROM events GROUP BY 1")
def q_property_ranges(spark, sf):
    """The ranges of a JSON map, as the constraints of a run."""
    ranges = read(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    folder = _folder(spark)
    ranges.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(c("event_type"), F.struct("min", "max"))))).alias("value")).write.text(folder)
    return readers.property_ranges(spark, folder)


@query("""SELECT r_name AS subtype, lower(r_name) AS note, count(n_nationkey) AS n_mechanisms, min(n_name) AS first_mechanism FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL""")
def q_read_clinical(spark, sf):
    """Subtypes and resistance mechanisms of a clinical document."""
    nations = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("m"))
    rows = read(spark, sf, "region").join(nations, c("n_regionkey") == c("r_regionkey"), "left")
    maps = rows.agg(
        F.map_from_entries(F.collect_list(F.struct(c("r_name"), F.create_map(F.lit("note"), F.lower("r_name"))))).alias("molecular_subtypes"),
        F.map_from_entries(F.collect_list(F.struct(c("r_name"), F.coalesce(c("m"), F.array().cast("array<string>"))))).alias("resistance_mechanisms"),
    )
    folder = _folder(spark)
    maps.select(F.to_json(F.struct(F.struct(F.array(F.lit("cost")).alias("treatment_challenges")).alias("clinical_data"), "*")).alias("value")).write.text(folder)
    known = readers.clinical(spark, folder)
    found = known.select("resistance_mechanisms", F.explode("molecular_subtypes").alias("subtype", "of"))
    mechanisms = F.try_element_at("resistance_mechanisms", c("subtype"))
    return found.select("subtype", F.try_element_at("of", F.lit("note")).alias("note"), F.size(mechanisms).cast("long").alias("n_mechanisms"), F.array_min(mechanisms).alias("first_mechanism"))
