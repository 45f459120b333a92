"""Readers, sinks, structures and streams on small files."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from reagentql.operators import relational as R
from reagentql.operators import structure as P
from reagentql.operators import vectors as V
from reagentql.sources import mmcif, readers, sinks
from reagentql.streaming import collect

CIF = """data_T
_entry.id 1ABC
_struct.title 'A small one'
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.auth_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM C ALA A 1 855 0.0 0.0 0.0
ATOM N ALA A 1 855 1.0 0.0 0.0
ATOM C LYS A 2 856 3.0 0.0 0.0
ATOM C GLU A 3 857 9.0 0.0 ?
HETATM ZN ZN B . . 2.0 0.0 0.0
HETATM O HOH C . . 2.1 0.0 0.0
#
"""


def test_mmcif(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    (tmp_path / "b.cif.gz").write_bytes(gzip.compress(CIF.encode()))
    (tmp_path / "c.cif").write_bytes(b"\xff\xfe\xff")
    rows = mmcif.read_mmcif(spark, str(tmp_path / "*cif*")).cache()
    assert {r.file for r in rows.where("error IS NOT NULL").collect()} == {"c.cif"}
    title = rows.where("category = 'struct' AND file = 'a.cif'").first()
    assert title.fields == {"title": "A small one"}
    some = mmcif.read_mmcif(spark, str(tmp_path / "*cif*"), ["struct"])
    assert sorted((r.file, r.fields["title"]) for r in some.where("error IS NULL").collect()) == [("a.cif", "A small one"), ("b.cif.gz", "A small one")]
    assert some.where("error IS NOT NULL").count() == 1 and some.where("category <> 'struct'").count() == 0
    both = mmcif.atoms(rows)
    # Every file's centres find its own residues only.
    centres = P.components(both).select("file", F.col("residue_name").alias("cid"), "x", "y", "z")
    found = P.nearby_residues(both.where("grp = 'ATOM'").withColumn("x", F.col("x") + F.when(F.col("file") == "a.cif", 50).otherwise(0)), centres, 3.5)
    assert {r.file for r in found.collect()} == {"b.cif.gz"}
    atoms = both.where("file = 'b.cif.gz'").cache()
    assert atoms.count() == 5  # the row without z is gone
    assert {(r.residue_name, r.auth_num) for r in P.residues(atoms).collect()} == {("ALA", 855), ("LYS", 856)}
    metal = P.components(atoms).collect()
    assert [(r.residue_name, r.kind) for r in metal] == [("ZN", "metal")]
    centre = P.components(atoms).select("file", F.col("residue_name").alias("cid"), "x", "y", "z")
    near = {(r.residue_name, r.d) for r in P.nearby_residues(atoms.where("grp = 'ATOM'"), centre, 3.5).collect()}
    assert near == {("ALA", 2.0), ("LYS", 1.0)}  # the first atom in range, not the nearest
    assert [r.residue_name for r in P.surface_residues(P.residues(atoms)).collect()] == ["LYS"]
    assert P.atp_pocket(P.residues(atoms)).count() == 2
    site = P.metal_sites(both).where("file = 'a.cif'").first()
    assert (site.site_id, site.metal, site.residues, site.coordination) == ("site_metal_zn", "ZN", ["ALA855", "LYS856"], [])
    sites = {(r.file, r.method, r.site_id) for r in P.binding_sites(both).collect()}
    assert sites == {(f, k, s) for f in ("a.cif", "b.cif.gz") for k, s in ((1, "site_atp_binding"), (2, "site_metal_zn"), (3, "site_allosteric"))}
    assert {r.target for r in mmcif.with_targets(rows, {"a": "EGFR"}).select("target").distinct().collect()} == {"EGFR", "b", "c"}


def test_cif_of_wrapped_rows_and_repeated_categories():
    text = """data_X
_struct.title
;two
lines
;
loop_
_a.x
_a.y
_a.z
1 'b c'
? 2 "q" # end
.
loop_
_a.x
9
_b.k v
"""
    assert list(mmcif.parse(text)) == [
        ("X", "a", 0, {"x": "1", "y": "b c"}), ("X", "a", 1, {"x": "2", "y": "q"}), ("X", "a_2", 0, {"x": "9"}), ("X", "struct", 0, {"title": "two\nlines"}), ("X", "b", 0, {"k": "v"}),
    ]


def test_first_listed_gatekeeper(spark):
    rows = spark.createDataFrame([("f", "A", i, n, "ALA", i) for i, n in enumerate((338, 855, 850, 860, 801, 900, 901))], "file string, chain string, residue_num int, auth_num int, residue_name string, ordinal int")
    assert [r.far for r in P.atp_pocket(rows).orderBy("far", "auth_num").collect()] == [0, 5, 5, 45, 54]


def test_secondary_structure_and_genes(spark):
    rows = spark.createDataFrame([("f", "A", n, k) for n, k in ((1, "H"), (2, "H"), (3, "E"), (4, None), (5, "E"), (7, "E"), (8, "E"))], "file string, chain string, residue_num int, kind string")
    got = sorted((r.kind, r.start, r.end, r.n) for r in P.secondary_structure(rows).collect())
    assert got == [("E", 3, 3, 1), ("E", 5, 5, 1), ("E", 7, 8, 2), ("H", 1, 2, 2)]
    names = spark.createDataFrame([("Epidermal Growth Factor Receptor",), ("Cellular tumor antigen p53",), ("something",), (None,)], "d string")
    assert [tuple(r) for r in names.select(P.gene_of(F.col("d")).alias("g")).select("g.*").collect()] == [("EGFR", "Homo sapiens"), ("TP53", "Homo sapiens"), (None, None), (None, None)]


def test_earlier_candidates_in_several_dialects(spark, tmp_path):
    (tmp_path / "EGFR_a.csv").write_text('id,SMILES,mw\n1,CCO,4\n2,"C,N",5\n3,,1\n')
    (tmp_path / "x_idh1.csv").write_text("\ufeffsmiles,id\nCCN,9\nCCN,8\n", encoding="utf-8")
    (tmp_path / "VEGF.csv").write_text("1,CCC\n2,CCF\n")
    got = {tuple(r) for r in readers.existing_candidates(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("EGFR", "CCO"), ("EGFR", "C,N"), ("IDH1_IDH2", "CCN")}


def test_earlier_candidates_with_line_breaks_and_many_files(spark, tmp_path):
    (tmp_path / "a_egfr.csv").write_text('note,smiles\n"two\nlines, one ""note""",CCO\nx,"C\nN"\n')
    (tmp_path / "b_vegf.csv").write_text("a,b,c,SMILES\n1,2,3,CCF\n1,2\n")
    (tmp_path / "c_idh1.csv").write_text("")
    got = {tuple(r) for r in readers.existing_candidates(spark, str(tmp_path / "*.csv")).collect()}
    assert got == {("EGFR", "CCO"), ("EGFR", "C\nN"), ("VEGF_VEGFR", "CCF")}


def test_whole_structure(spark, tmp_path):
    more = CIF.replace("loop_", "_struct.entry_id 1ABC\n_exptl.resolution 2.5\n_entity_poly.pdbx_strand_id B\n_entity_poly.pdbx_seq_one_letter_code ;MKV;\nloop_\n_entity.id\n_entity.pdbx_description\n1 other\n2 'Cellular tumor antigen P53'\nloop_", 1)
    (tmp_path / "a.cif").write_text(more)
    (tmp_path / "b.cif").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "d.cif").write_text("data_X\n_struct.title nothing\n")
    rows = mmcif.read_mmcif(spark, str(tmp_path / "*.cif")).cache()
    kinds = spark.createDataFrame([("a.cif", "A", 1, "H"), ("a.cif", "A", 2, "H")], "file string, chain string, residue_num int, kind string")
    whole = P.whole_structure(rows, mmcif.atoms(rows), kinds).cache()
    got = {r.file: r for r in whole.collect()}
    sinks.write_structures(whole, str(tmp_path / "out"))
    lines = {r.file: r for r in spark.read.json(str(tmp_path / "out/summaries")).collect()}
    assert (lines["a.cif"].n_sites, lines["a.cif"].n_components, lines["a.cif"].status, lines["b.cif"].status) == (3, 1, "success", "failed")
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out/totals")).select("total", "success", "failed").collect()] == [(3, 2, 1)]
    assert {p.name for p in (tmp_path / "out/structures").glob("file=*")} == {"file=a.cif", "file=b.cif", "file=d.cif"}
    assert got.keys() == {"a.cif", "b.cif", "d.cif"} and got["b.cif"].error.startswith("UnicodeDecodeError")
    a, d = got["a.cif"], got["d.cif"]
    assert (a.pdb_id, a.resolution, a.chains, a.gene, a.organism, a.sequence, a.sequence_length, a.n_atoms, a.n_residues, a.error) == ("1ABC", 2.5, ["B"], "TP53", "Homo sapiens", "MKV", 3, 5, 2, None)
    assert [(x.name, x.kind, x.weight) for x in a.components] == [("ZN", "metal", 65.38)]
    assert [x.site_id for x in a.sites] == ["site_atp_binding", "site_metal_zn", "site_allosteric"] and [(x.start, x.end, x.n) for x in a.secondary] == [(1, 2, 2)]
    assert (a.pharmacophore.hydrophobic_regions, a.pharmacophore.positive_charge, a.pharmacophore.negative_charge) == (["ALA855"], ["LYS856"], [])
    assert (d.title, d.pdb_id, d.n_atoms, d.sites, d.components, d.sequence, d.gene) == ("nothing", "XXXX", 0, [], [], "", None)


def test_responses_over_a_restart(spark, tmp_path):
    """Two files a batch; stopped after the first batch, the stream goes on with nothing lost or repeated."""
    from reagentql.sources.ledger import Ledger, to_ledger

    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.json").write_text("".join(f'{{"target": "t", "attempt": {i}, "pos": {k}, "response": "r"}}\n' for k in range(3)))
    ledger, seen = Ledger(spark, str(tmp_path / "out")), []

    def stop_later(batch):
        seen.append(batch)
        if len(seen) == 2:
            raise RuntimeError("stopped")

    for _ in range(2):
        q = to_ledger(collect.response_stream(spark, str(tmp_path / "in"), 2), ledger, str(tmp_path / "ck"), "responses", after_stage=stop_later).start()
        try:
            q.processAllAvailable()
        except Exception as e:
            assert "stopped" in str(e)
        finally:
            q.stop()
    assert sorted((r.attempt, r.pos) for r in ledger.read().collect()) == [(i, k) for i in range(5) for k in range(3)]
    assert [e["batch"] for e in ledger.versions()] == [0, 1, 2] and seen == [0, 1, 1, 2]


def test_smaller_readers_and_reports(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Compounds,Combination_Index\n a+b ,1.5\nc,x\n")
    assert [tuple(r) for r in readers.combinations(spark, str(tmp_path / "c.csv")).collect()] == [("a+b", 1.5), ("c", None)]
    (tmp_path / "t.yaml").write_text("a: 1\n")
    (tmp_path / "english_t.yaml").write_text("a: 2\n")
    pytest.importorskip("yaml")
    assert readers.templates(spark, str(tmp_path / "t.yaml")) == {"a": 2} and readers.templates(spark, str(tmp_path / "no.yaml")) == {}
    rows = spark.createDataFrame([("A", None), ("B", "broken")], "target_name string, error string")
    assert [r.target_name for r in readers.target_summary(rows, "A").collect()] == ["A"] and readers.target_summary(rows, "Z").count() == 0
    report = json.loads(sinks.summary_report(rows).first().report)
    assert (report["total"], report["success"], report["failed"]) == (2, 1, 1) and report["targets"][1] == {"target": "B", "status": "failed", "error": "broken"}
    for attempt in (1, 2, 2):
        sinks.write_state(rows.limit(attempt), str(tmp_path / "state"), attempt)
    assert sinks.last_state(spark, str(tmp_path / "state")).count() == 2
    shown = spark.createDataFrame([("A", 1.25, None)], "t string, score double, n int")
    assert sinks.console_lines(shown, "t", {"score": "%.1f", "n": "%d"}).first().line == "A | score: 1.3"
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_splits(rows.withColumn("split", F.lit("train")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "split=train").is_dir()


def test_saved_documents(spark, tmp_path):
    (tmp_path / "EGFR_raw.json").write_text(json.dumps([{"target": "x", "call": 1, "response": "r"}]))
    assert [(r.target, r.call, r.response) for r in readers.raw_responses(spark, str(tmp_path / "*_raw.json")).collect()] == [("EGFR", 1, "r")]
    (tmp_path / "q.json").write_text(json.dumps([{"instruction": "i", "output": "o"}, {"instruction": "j", "response": "p"}]))
    assert [r.text for r in readers.instructions(spark, str(tmp_path / "q.json")).collect()] == ["Instruction: i\nResponse: o", "Instruction: j\nResponse: p"]


def test_stream_attempt_over_two_batches(spark, tmp_path):
    """One dry attempt that arrives in two pieces counts once; skipped attempts count as dry."""
    schema = "target string, attempt int, pos int, smiles string"
    parts = [[("t", 1, 1, "a")], [("t", 2, 1, "a")], [("t", 2, 2, "a"), ("t", 3, 1, "b")], [("t", 6, 1, "c")]]
    folder = tmp_path / "in"
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = collect.collect_until_enough(stream, 9, 2).writeStream.format("memory").queryName("pieces").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r.smiles for r in spark.table("pieces").orderBy("total").collect()] == ["a", "b"]


def test_windows_and_distinct_over_a_stream(spark, tmp_path):
    schema = "k string, ts timestamp"
    folder, seen = tmp_path / "in", []
    spark.sql("SELECT 'a' AS k, timestamp'2024-01-01 00:01:00' AS ts UNION ALL SELECT 'a', timestamp'2024-01-01 00:04:00' UNION ALL SELECT 'b', timestamp'2024-01-01 00:11:00'").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(schema).parquet(str(folder))
    once = collect.to_idempotent_sink(collect.distinct_within(stream, ["k"], "ts", "1 hour"), lambda df, i: seen.append((i, sorted(r.k for r in df.collect()))), str(tmp_path / "c1")).start()
    counts = collect.windowed_counts(stream, "ts", "10 minutes", "5 minutes", "1 minute", ["k"]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        once.processAllAvailable()
        counts.processAllAvailable()
    finally:
        once.stop()
        counts.stop()
    assert seen[0] == (0, ["a", "b"])
    got = sorted((str(r.start)[11:16], r.k, r.n) for r in spark.table("counts").collect())
    assert got == [("00:00", "a", 2), ("00:05", "b", 1), ("00:10", "b", 1), ("23:55", "a", 2)]


def test_candidates_in_both_shapes(spark, tmp_path):
    row = {"id": "1", "smiles": "CCO", "evaluation": {"valid": True, "scores": {"composite_score": 0.7}, "properties": {"logp": 1.0}}}
    bad = {"smiles": "x", "evaluation": {"valid": False, "error": "parse"}}
    (tmp_path / "list.json").write_text(json.dumps([row, bad]))
    (tmp_path / "object.json").write_text(json.dumps({"results": [row, bad]}))
    for name in ("list", "object"):
        rows = readers.candidates(spark, str(tmp_path / f"{name}.json"))
        assert rows.count() == 2
        flat = readers.analysis_frame(rows).collect()
        assert [(r.id, r.target, r.composite_score, r.clinical_similarity) for r in flat] == [("1", "EGFR", 0.7, None)]


def test_result_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿靶点,SMILES,MW,Pgp substrate,BBB permeant,Vina Dock Score\nEGFR,CCO,46.1,No,Yes,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("entity_id,mol_id,library_name,smiles,drugclip_score,vina_docking_score\ne,m,VEGF,CCN,0.5,987.16\n")
    a, b = readers.result_tables(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert (a.target, a.bbb_permeant, a.pgp_substrate, a.vina_docking_score) == ("EGFR", True, False, None)
    assert (b.target, b.mw, b.vina_docking_score) == ("VEGF_VEGFR", None, 987.16)


def test_molecules_keep_last(spark, tmp_path):
    doc = {"gbm_drugs": [{"name": "A", "target": "x"}, {"name": "B"}], "clinical_candidates": [{"name": "A", "target": "y", "clinical_phase": "Phase 2"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    got = {r.name: (r.target, r.clinical_phase, r.limitations) for r in readers.molecules(spark, str(tmp_path / "m.json")).collect()}
    assert got == {"A": ("y", "Phase 2", "Not specified"), "B": (None, "Unknown", "Not specified")}


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("t", "CCO"), ("t", "CCO"), ("t", "CCN")], "target string, smiles string")
    path = str(tmp_path / "out")
    assert [sinks.append_new(rows, path, ["target", "smiles"]) for _ in range(2)] == [2, 0]
    more = rows.union(spark.createDataFrame([("u", "CCO")], rows.schema))
    assert sinks.append_new(more, path, ["target", "smiles"]) == 1


def test_candidate_csv(spark, tmp_path):
    sinks.write_candidates_csv(spark.createDataFrame([("E", "CCO", 46.069)], "target string, smiles string, mw double"), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part*"))
    assert text == "target,smiles,mw,seq_id\nE,CCO,46.07,E_00000\n"


def test_unpivoted_connectivity(spark, tmp_path):
    (tmp_path / "m.csv").write_text("state,d1,d2\nMES,0.5,x\nAC,0.4,0.9\n")
    got = {(r.cell_state, r.drug, r.score) for r in readers.connectivity(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {("MES", "d1", 0.5), ("MES", "d2", None), ("AC", "d1", 0.4), ("AC", "d2", 0.9)}


def test_stream_equals_batch(spark, tmp_path):
    """Collecting until enough over two micro-batches, whatever the order within them."""
    folder = tmp_path / "in"
    folder.mkdir()
    rows = [("t", 1, 2, "b"), ("t", 1, 1, "a"), ("t", 2, 1, "a"), ("t", 3, 1, "c"), ("t", 3, 2, "d")]
    schema = "target string, attempt int, pos int, smiles string"
    spark.createDataFrame(rows[:3], schema).coalesce(1).write.mode("append").parquet(str(folder))
    spark.createDataFrame(rows[3:], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = collect.collect_until_enough(stream, 3, 2).writeStream.format("memory").queryName("collected").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [(r.smiles, r.total) for r in spark.table("collected").orderBy("total").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3)]


def test_split_is_exact_and_stable(spark):
    df = spark.range(25).withColumn("s", F.lit("x"))
    one = {r.id: r.split for r in R.split_rows(df, "s", "id").collect()}
    two = {r.id: r.split for r in R.split_rows(df.repartition(7), "s", "id").collect()}
    assert one == two and sorted(map(list(one.values()).count, ("train", "valid", "test"))) == [2, 3, 20]


def test_constant_correlation_is_null(spark):
    got = {(r.a, r.b): r.r for r in R.correlations(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double"), ["a", "b"]).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): None, ("b", "b"): None}


def test_radius_join_is_strict(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, -0.9, 0.0, 0.0)], "pid int, x double, y double, z double")
    got = {(r.cid, r.pid) for r in V.within_radius(p, p.where("pid = 1").withColumnRenamed("pid", "cid"), 1.0).collect()}
    assert got == {(1, 1), (1, 3)}


def test_command_line(spark, tmp_path, capsys):
    from reagentql.__main__ import main

    main(["list"])
    assert "q_reward_topk" in capsys.readouterr().out.split()
    out = str(tmp_path / "out")
    main(["run", "q_run_targets", "--tables", "/root/testdata/sf0.001", "--out", out, "--format", "json"])
    assert {r.target for r in spark.read.json(out).collect()} == {"view", "click", "error", "none"}
    with pytest.raises(SystemExit):
        main(["run", "q_nothing", "--tables", out])
