"""Readers for candidate results, knowledge documents, result tables and raw responses.

All read through Spark with declared schemas, so any file system works and nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reagentql import schemas
from reagentql.operators.relational import keep_last
from reagentql.storage import hadoop_path


def file_stem() -> Column:
    """The name of the row's input file without folder and last extension."""
    return F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records from a JSON list or from an object with a ``results`` list."""
    item = T.StructType.fromDDL(schemas.CANDIDATE)
    wrapped = T.StructType(item.fields + [T.StructField("results", T.ArrayType(item))])
    rows = spark.read.schema(wrapped).json(path, multiLine=True)
    inner = F.coalesce("results", F.array(F.struct(*item.names)))
    return rows.select(F.inline(inner))


def analysis_frame(rows: DataFrame) -> DataFrame:
    """One flat row per valid candidate: id, target, scores and properties."""
    valid = rows.where(F.col("evaluation.valid"))
    return valid.select(
        F.coalesce("id", F.lit("unknown")).alias("id"), F.coalesce("target", F.lit("EGFR")).alias("target"), "smiles", "evaluation.scores.*", "evaluation.properties.*"
    )


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge on targets; a missing list of mutations falls back to markers, expression, 'Not applicable'."""
    rows = spark.read.schema(f"gbm_targets array<struct<{_struct(schemas.TARGET)}>>").json(path, multiLine=True).select(F.inline("gbm_targets"))
    filled = [F.when(F.size(c) > 0, F.array_join(c, ", ")) for c in ("mutation_types", "key_markers", "expression_pattern")]
    return rows.where("name IS NOT NULL").withColumn("mutations", F.coalesce(*filled, F.lit("Not applicable")))


def _struct(ddl: str) -> str:
    return T.StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def molecules(spark: SparkSession, path: str) -> DataFrame:
    """Approved drugs and clinical candidates together; of equal names the later one stays."""
    item = f"array<struct<{_struct(schemas.MOLECULE)}>>"
    both = spark.read.schema(f"gbm_drugs {item}, clinical_candidates {item}").json(path, multiLine=True)
    parts = [
        both.select(F.posexplode(name).alias("pos", "m")).select(F.lit(k).alias("src"), "pos", "m.*") for k, name in enumerate(("gbm_drugs", "clinical_candidates"))
    ]
    rows = keep_last(parts[0].unionByName(parts[1]), ["name"], [F.col("src"), F.col("pos")]).drop("src", "pos")
    return rows.withColumns({"clinical_phase": F.coalesce("clinical_phase", F.lit("Unknown")), "limitations": F.coalesce("limitations", F.lit("Not specified"))})


def clinical(spark: SparkSession, path: str) -> DataFrame:
    """Clinical knowledge as one row of maps."""
    nested = "map<string,string>"
    schema = f"clinical_data struct<standard_treatment:{nested},treatment_challenges:array<string>,failed_trials_insights:array<string>,successful_patterns:array<string>>, molecular_subtypes map<string,{nested}>, biomarkers map<string,{nested}>, resistance_mechanisms map<string,array<string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("clinical_data.*", "molecular_subtypes", "biomarkers", "resistance_mechanisms")


def property_ranges(spark: SparkSession, path: str) -> DataFrame:
    """property, min, max from a JSON map."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string,struct<min:double,max:double>>")
    return text.select(F.explode(parsed).alias("property", "r")).select("property", "r.min", "r.max")


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """target, document (JSON text) of every *_summary.json in a folder."""
    rows = spark.read.text(f"{folder}/*_summary.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("f"))
    return rows.select(F.regexp_extract("f", r"^(.*)_summary\.json$", 1).alias("target"), F.col("value").alias("document"))


# Names of a result column in its three header dialects.
RESULT_NAMES = {
    "target": ("靶点", "target"),
    "smiles": ("SMILES", "smiles"),
    "drugclip_score": ("DrugClip Score", "drugclip_score"),
    "vina_docking_score": ("Vina Dock Score", "vina_docking_score"),
    "mw": ("MW",),
    "tpsa": ("TPSA",),
    "consensus_logp": ("Consensus Log P",),
    "bbb_permeant": ("BBB permeant",),
    "pgp_substrate": ("Pgp substrate",),
    "pains_alerts": ("PAINS Alerts", "PAINS #alerts"),
    "brenk_alerts": ("Brenk Alerts", "Brenk #alerts"),
    "synthetic_accessibility": ("Synthetic Accessibility",),
    "entity_id": ("entity_id",),
    "mol_id": ("mol_id",),
    "library_name": ("library_name",),
}
# Library names by canonical target.
CANONICAL = {"VEGF": "VEGF_VEGFR", "VEGFR": "VEGF_VEGFR", "VEGF_2": "VEGF_VEGFR", "IDH1": "IDH1_IDH2", "EGFR": "EGFR", "EFGR": "EGFR"}


def result_table(spark: SparkSession, path: str) -> DataFrame:
    """One result CSV in any dialect, by column names, under the canonical schema; blanks are null."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    have = {n.lstrip("﻿").strip(): n for n in raw.columns}
    columns = []
    for f in T.StructType.fromDDL(schemas.RESULT):
        name = next((have[n] for n in RESULT_NAMES[f.name] if n in have), None)
        value = F.lit(None).cast("string") if name is None else F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        if f.dataType == T.BooleanType():
            value = F.when(value.isNotNull(), F.lower(value) == "yes")
        columns.append(value.try_cast(f.dataType).alias(f.name))
    rows = raw.select(*columns)
    names = F.create_map(*[F.lit(x) for pair in CANONICAL.items() for x in pair])
    return rows.withColumn("target", F.coalesce("target", F.try_element_at(names, F.col("library_name")), F.col("library_name")))


def result_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several result CSVs, each read in its own dialect, with their path."""
    out = None
    for path in paths:
        part = result_table(spark, path).withColumn("source_file", F.lit(path))
        out = part if out is None else out.unionByName(part)
    return out


def raw_responses(spark: SparkSession, pattern: str) -> DataFrame:
    """target (from the file name), call, response of saved raw responses."""
    rows = spark.read.schema(schemas.RAW_RESPONSE).option("multiLine", True).json(pattern)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"_raw\.json$", "").alias("target"), "call", "response")


def instructions(spark: SparkSession, path: str) -> DataFrame:
    """Instruction records of either shape with their training text; rows of neither shape raise."""
    rows = spark.read.schema("instruction string, input string, output string, response string").json(path, multiLine=True)
    answer = F.coalesce("response", "output")
    checked = F.when(F.col("instruction").isNull() | answer.isNull(), F.raise_error(F.lit("neither instruction shape"))).otherwise(answer)
    return rows.select("instruction", checked.alias("response"), F.concat(F.lit("Instruction: "), "instruction", F.lit("\nResponse: "), checked).alias("text"))


def connectivity(spark: SparkSession, path: str) -> DataFrame:
    """Long rows cell_state, drug, score of a wide CSV whose first column names the state."""
    wide = spark.read.option("header", True).csv(path)
    state, *drugs = wide.columns
    long = wide.select(F.col(f"`{state}`").alias("cell_state"), *[F.col(f"`{d}`").try_cast("double").alias(d) for d in drugs])
    return long.unpivot(["cell_state"], drugs, "drug", "score")


def combinations(spark: SparkSession, path: str) -> DataFrame:
    """Compounds and Combination_Index of a combination table; indices that cannot be read are null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.trim("Compounds").alias("Compounds"), F.col("Combination_Index").try_cast("double").alias("Combination_Index"))


def target_summary(summaries: DataFrame, name: str, column: str = "target_name") -> DataFrame:
    """One target of a summary table; no rows where it is missing."""
    return summaries.where(F.col(column) == name)


def templates(spark: SparkSession, path: str, language: str = "english") -> dict:
    """The settings of a template file, the English one of a pair by its name; a file that is not there has none.

    The file is read by Spark, so it may lie in any of its file systems.
    """
    import yaml

    folder, slash, base = path.rpartition("/")
    stem, dot, kind = base.rpartition(".")
    for chosen in (f"{folder}{slash}{language}_{stem}{dot}{kind}", path):
        where, files = hadoop_path(spark, chosen)
        if files.exists(where):
            return yaml.safe_load(spark.read.text(chosen, wholetext=True).first()[0]) or {}
    return {}


def spread(rows: DataFrame) -> DataFrame:
    """A table that was read from fewer pieces of files than there are cores, dealt over all cores; others stay as they are.

    For costly expressions over small files, whose one piece would keep all cores but one idle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def existing_candidates(spark: SparkSession, pattern: str) -> DataFrame:
    """Distinct target, smiles of earlier result CSVs; the target is found in the file name.

    Every file has its own header, so the place of its smiles column is read from its first line
    (the one at the start of its first piece; no file is held whole).  A file without such a column,
    or without a header, gives no rows.  Quoted fields may hold commas and line breaks.
    """
    path, name = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name")
    heads = spark.read.text(pattern).where("_metadata.file_block_start = 0").select(path, "value").withColumn("at", F.monotonically_increasing_id())
    first = heads.groupBy("path").agg(F.min_by("value", "at").alias("head"))
    names = F.transform(F.split(F.regexp_replace("head", "\ufeff", ""), ","), lambda n: F.lower(F.trim(F.replace(n, F.lit('"'), F.lit("")))))
    places = first.select("path", F.array_position(names, "smiles").cast("int").alias("at"), F.size(names).alias("width")).where("at > 0")
    width = places.agg(F.max("width")).first()[0] or 1
    columns = [f"c{i}" for i in range(width)]
    cells = spark.read.schema(", ".join(f"{n} string" for n in columns)).option("multiLine", True).option("quote", '"').option("escape", '"').csv(pattern)
    rows = cells.select(path, name, F.array(*columns).alias("cells")).join(places, "path")
    rows = rows.select("name", F.trim(F.try_element_at("cells", F.col("at"))).alias("smiles")).where("lower(smiles) <> 'smiles'")
    known = F.upper(F.col("name"))
    target = F.when(known.contains("VEGF"), "VEGF_VEGFR").when(known.contains("IDH1"), "IDH1_IDH2").when(known.contains("EGFR") | known.contains("EFGR"), "EGFR")
    return rows.select(target.alias("target"), "smiles").where("smiles <> ''").distinct()
