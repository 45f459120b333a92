"""Protein structure operators over atom rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.operators.ordered import exact_quantile
from reagentql.operators.relational import first_seen, top_per_group
from reagentql.operators.vectors import within_radius

# Residues that coordinate metals, metals, charged surface residues, gatekeeper numbers.
COORDINATING = ("CYS", "HIS", "ASP", "GLU", "MET")
METALS = ("ZN", "MG", "MN", "FE", "CU", "CA", "CO", "NI", "CD")
SURFACE = ("ARG", "LYS", "GLU", "ASP")
GATEKEEPERS = (855, 883, 338)
WATER = ("HOH", "WAT")


def residues(atoms: DataFrame) -> DataFrame:
    """One row per file, chain and residue number with its author's number (of the last atom) and name."""
    return atoms.where("residue_num IS NOT NULL").groupBy("file", "chain", "residue_num").agg(
        F.max_by("auth_num", "ordinal").alias("auth_num"), F.min_by("residue_name", "ordinal").alias("residue_name"), F.min("ordinal").alias("ordinal")
    )


def components(atoms: DataFrame) -> DataFrame:
    """Non-polymer components: ligand (more than one atom) or metal, with centroid; water excluded."""
    het = atoms.where((F.col("grp") == "HETATM") & (~F.col("residue_name").isin(*WATER)))
    g = het.groupBy("file", "residue_name").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "xyz"], F.first("element").alias("element"))
    kind = F.when((F.col("n") == 1) & F.upper("element").isin(*METALS), "metal").when(F.col("n") < 50, "ligand")
    return g.withColumn("kind", kind).where("kind IS NOT NULL")


def nearby_residues(atoms: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """cid, file, chain, auth_num, residue_name, d: residues with an atom closer than the radius to a centre of their own file.

    ``centres`` has file, cid, x, y, z.  The distance is that of the first such atom; water is left
    out.  A residue counts once per centre by its name, chain and number.
    """
    used = atoms.where(~F.col("residue_name").isin(*WATER)).withColumn("pid", F.struct("file", "ordinal", "chain", "auth_num", "residue_name"))
    found = within_radius(used, centres, radius, ["file"]).select("cid", "pid.*", "d")
    return first_seen(found, ["file", "cid", "chain", "auth_num", "residue_name"], [F.col("ordinal")]).drop("ordinal")


def metal_sites(atoms: DataFrame, radius: float = 3.5) -> DataFrame:
    """file, site_id, metal, x, y, z, residues, coordination: each metal with the residues around it and those that coordinate it.

    Metals without a residue closer than the radius have no site.
    """
    metals = components(atoms).where("kind = 'metal'")
    metals = metals.select("file", F.concat(F.lit("site_metal_"), F.lower("element")).alias("cid"), F.upper("element").alias("metal"), *"xyz")
    around = nearby_residues(atoms.where("grp <> 'HETATM'"), metals, radius)
    label = F.concat("residue_name", F.col("auth_num").cast("string"))
    sites = around.groupBy("file", "cid").agg(
        F.array_sort(F.collect_set(label)).alias("residues"), F.array_sort(F.collect_set(F.when(F.col("residue_name").isin(*COORDINATING), label))).alias("coordination")
    )
    return metals.join(sites, ["file", "cid"]).withColumnRenamed("cid", "site_id")


def secondary_structure(rows: DataFrame) -> DataFrame:
    """file, chain, kind, start, end, n: runs of residues in a row with the same kind (H, E, ...); null kinds are no run."""
    order = Window.partitionBy("file", "chain").orderBy("residue_num")
    new = F.coalesce((F.lag("kind").over(order) != F.col("kind")) | (F.lag("residue_num").over(order) != F.col("residue_num") - 1) | F.lag("kind").over(order).isNull(), F.lit(True))
    runs = rows.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(order)).where("kind IS NOT NULL")
    out = runs.groupBy("file", "chain", "kind", "__run").agg(F.min("residue_num").alias("start"), F.max("residue_num").alias("end"), F.count("*").alias("n"))
    return out.drop("__run")


def binding_sites(atoms: DataFrame, ligand_radius: float = 6.0) -> DataFrame:
    """file, method, site_id, residues of all sites, in the order of their methods: ligand, ATP pocket, metal, surface."""
    polymer, listed = atoms.where("grp <> 'HETATM'"), lambda x: F.array_sort(F.collect_set(x))
    label = F.concat("residue_name", F.col("auth_num").cast("string"))
    ligands = components(atoms).where("kind = 'ligand'").select("file", F.concat(F.lit("site_"), "residue_name").alias("cid"), *"xyz")
    near = nearby_residues(polymer, ligands, ligand_radius).groupBy("file", F.col("cid").alias("site_id")).agg(listed(label).alias("residues"))
    once = residues(polymer)
    atp = atp_pocket(once).groupBy("file").agg(listed(label).alias("residues")).select("file", F.lit("site_atp_binding").alias("site_id"), "residues")
    metal = metal_sites(atoms).select("file", "site_id", "residues")
    surface = surface_residues(once).groupBy("file").agg(listed(label).alias("residues")).select("file", F.lit("site_allosteric").alias("site_id"), "residues")
    out = None
    for k, part in enumerate((near, atp, metal, surface)):
        part = part.select("file", F.lit(k).alias("method"), "site_id", "residues")
        out = part if out is None else out.unionByName(part)
    return out


# Residues of each class of a pharmacophore.
RESIDUE_CLASSES = {
    "hydrophobic_regions": ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO"),
    "hydrogen_bond_donors": ("SER", "THR", "TYR", "CYS", "LYS", "ARG", "HIS", "TRP"),
    "hydrogen_bond_acceptors": ("SER", "THR", "TYR", "ASN", "GLN", "ASP", "GLU", "CYS"),
    "aromatic_regions": ("PHE", "TYR", "TRP", "HIS"),
    "positive_charge": ("LYS", "ARG", "HIS"),
    "negative_charge": ("ASP", "GLU"),
}
# Weights of elements, of an element that is not listed, and of metals that stand alone.
ELEMENT_WEIGHTS = {"C": 12.01, "N": 14.01, "O": 16.00, "S": 32.07, "H": 1.008, "P": 30.97, "F": 19.00, "CL": 35.45, "BR": 79.90, "I": 126.90}
OTHER_WEIGHT = 12.01
METAL_WEIGHTS = {"ZN": 65.38, "MG": 24.31, "MN": 54.94, "FE": 55.85}


def pharmacophore_lists(rows: DataFrame, by: list[str], name: str, number: str, order: list[str]) -> DataFrame:
    """by, and for each class of residues the names with numbers of those that belong to it, in order; empty where none does."""
    label = F.concat(F.col(name), F.col(number).cast("string"))
    listed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(name).alias("__name"), label.alias("__label")))).alias("__all"))
    of_class = lambda names: F.transform(F.filter("__all", lambda r: r["__name"].isin(*names)), lambda r: r["__label"])
    return listed.select(*by, *[of_class(names).alias(n) for n, names in RESIDUE_CLASSES.items()])


def _weights(table: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def component_weights(atoms: DataFrame, by: list[str], component: str, element: str) -> DataFrame:
    """by, component, weight: a lone metal's by its name, others' as the sum over their atoms."""
    each = F.coalesce(F.try_element_at(_weights(ELEMENT_WEIGHTS), F.col(element)), F.lit(OTHER_WEIGHT))
    sums = atoms.groupBy(*by, component).agg(F.sum(each).alias("__sum"))
    metal = F.try_element_at(_weights(METAL_WEIGHTS), F.col(component))
    return sums.select(*by, component, F.round(F.coalesce(metal, F.col("__sum")), 4).alias("weight"))


# Words of a description, and the gene each names, in order.
GENES = (
    ("epidermal growth factor receptor", "EGFR"), ("vascular endothelial growth factor", "VEGFA"), ("isocitrate dehydrogenase", "IDH1"), ("p53", "TP53"),
    ("mdm2", "MDM2"), ("mgmt", "MGMT"), ("programmed cell death protein 1", "PDCD1"), ("phosphatidylinositol-4,5-bisphosphate 3-kinase", "PIK3CA"),
)


def gene_of(description: Column) -> Column:
    """(gene, organism) by words of an entity's description; nulls where none is known."""
    low = F.lower(description)
    gene = F.coalesce(*[F.when(low.contains(words), F.lit(gene)) for words, gene in GENES])
    return F.struct(gene.alias("gene"), F.when(gene.isNotNull(), F.lit("Homo sapiens")).alias("organism"))


def surface_residues(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` charged residues of each file, one per author's number."""
    once = first_seen(rows, ["file", "auth_num"], [F.col("ordinal")]).where(F.col("residue_name").isin(*SURFACE))
    return top_per_group(once, ["file"], [F.col("ordinal")], n, "k").drop("k")


def atp_pocket(rows: DataFrame, low: int = 800, high: int = 900, n: int = 30) -> DataFrame:
    """Where a gatekeeper residue exists (the first listed one that does), the ``n`` residues numbered between low and high nearest to it by sequence."""
    places = F.array(*[F.lit(g) for g in GATEKEEPERS])
    gate = rows.where(F.col("auth_num").isin(*GATEKEEPERS)).groupBy("file").agg(F.min_by("auth_num", F.array_position(places, F.col("auth_num"))).alias("gate"))
    near = rows.join(gate, "file").where(F.col("auth_num").between(low, high)).withColumn("far", F.abs(F.col("auth_num") - F.col("gate")))
    return top_per_group(near, ["file"], [F.col("far"), F.col("ordinal")], n, "k").drop("k")


def pocket_radius(near: DataFrame, default: float = 5.0) -> DataFrame:
    """cid, radius (75th percentile of distances), volume."""
    r = exact_quantile(near, ["cid"], "d", 0.75, "radius").withColumn("radius", F.coalesce("radius", F.lit(default)))
    return r.withColumn("volume", 4.0 / 3 * F.pi() * F.pow("radius", F.lit(3)))


#: First residues of each class that are listed.
KEY_RESIDUES = {
    "hydrophobic_regions": 50, "hydrogen_bond_donors": 50, "hydrogen_bond_acceptors": 50, "aromatic_regions": 30, "positive_charge": 30, "negative_charge": 30,
}


def key_residues(features: Column, limits: dict[str, int] = KEY_RESIDUES) -> dict[str, Column]:
    """The first residues of each class of a pharmacophore; none where a class is missing."""
    return {name: F.coalesce(F.slice(features[name], 1, n), F.array()).alias(name) for name, n in limits.items()}


def model_input(rows: DataFrame) -> DataFrame:
    """target_id, sequence, sequence_length, binding_pockets, pharmacophore (counts) of target documents.

    ``rows`` has name, sequence, binding_sites (structs with site_id, site_name and more) and
    pharmacophore_features (a struct of arrays).  Missing parts are empty.
    """
    kind = rows.schema["pharmacophore_features"].dataType
    counts = [F.greatest(F.size(F.col(f"pharmacophore_features.{f.name}")), F.lit(0)).alias(f.name) for f in kind.fields]
    site = rows.schema["binding_sites"].dataType.elementType
    rename = {"site_id": "pocket_id", "site_name": "pocket_name", "center": "center_3d"}
    pockets = F.transform("binding_sites", lambda s: F.struct(*[s[f.name].alias(rename.get(f.name, f.name)) for f in site.fields]))
    return rows.select(
        F.col("name").alias("target_id"),
        F.coalesce("sequence", F.lit("")).alias("sequence"),
        F.coalesce(F.length("sequence"), F.lit(0)).alias("sequence_length"),
        F.coalesce(pockets, F.array().cast(rows.select(pockets.alias("p")).schema["p"].dataType)).alias("binding_pockets"),
        F.struct(*counts).alias("pharmacophore"),
    )


def compare_targets(rows: DataFrame, key: str, wanted: list) -> DataFrame:
    """name, length, sites of the targets wanted; those that are missing are left out."""
    n = F.greatest(F.size("binding_sites"), F.lit(0))
    return rows.where(F.col(key).isin(*wanted)).select("name", F.coalesce(F.length("sequence"), F.lit(0)).alias("length"), n.alias("sites"))


# One letter for each residue's name.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def _described(rows: DataFrame) -> DataFrame:
    """file, pdb_id, title, method, resolution, chains, gene, organism of every file that could be read."""
    field = lambda category, name: F.max(F.when((F.col("category") == category) & (F.col("ordinal") == 0), F.try_element_at("fields", F.lit(name))))
    names = F.when(F.col("category") == "entity", gene_of(F.try_element_at("fields", F.lit("pdbx_description"))))
    # The last entity that is known counts.
    gene = F.max_by(names, F.when(names["gene"].isNotNull(), F.col("ordinal")))
    out = rows.where("error IS NULL").groupBy("file").agg(
        F.coalesce(field("struct", "entry_id"), F.lit("XXXX")).alias("pdb_id"),
        F.coalesce(field("struct", "title"), F.lit("")).alias("title"),
        F.coalesce(field("exptl", "method"), F.lit("X-RAY DIFFRACTION")).alias("method"),
        field("exptl", "resolution").try_cast("double").alias("resolution"),
        F.array(F.coalesce(F.trim(field("entity_poly", "pdbx_strand_id")), F.lit("A"))).alias("chains"),
        field("entity_poly", "pdbx_seq_one_letter_code").alias("__code"),
        gene.alias("__gene"),
    )
    return out.select("*", "__gene.gene", "__gene.organism").drop("__gene")


def _sequences(rows: DataFrame) -> DataFrame:
    """file, __built: the residues of the polymer's table as letters, X for one that has none."""
    listed = rows.where("category = 'entity_poly_seq'").select("file", "ordinal", F.try_element_at("fields", F.lit("mon_id")).alias("r")).where("r <> ''")
    letter = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair]), F.col("r")), F.lit("X"))
    ordered = listed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ordinal", letter.alias("l")))).alias("s"))
    return ordered.select("file", F.array_join("s.l", "").alias("__built"))


def whole_structure(rows: DataFrame, atoms: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """One row a file with everything that is known of it, or with the error that kept it from being read.

    ``rows`` are those of ``read_mmcif``, ``atoms`` their atoms, ``kinds`` the residues' secondary
    structure (file, chain, residue_num, kind), if it is known.  The columns are the description
    (pdb_id, title, method, resolution, chains, gene, organism), sequence and its length, n_atoms,
    n_residues, components (name, kind, weight), sites (as of ``binding_sites``), runs of secondary
    structure, and the lists of the pharmacophore.  A part that a file lacks is empty.
    """
    found = residues(atoms.where("grp <> 'HETATM'"))
    counts = atoms.groupBy("file").agg(F.count("*").alias("n_atoms")).join(found.groupBy("file").agg(F.count("*").alias("n_residues")), "file", "left")
    weights = component_weights(atoms.where("grp = 'HETATM'"), ["file"], "residue_name", "element")
    parts = components(atoms).join(weights, ["file", "residue_name"]).groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.col("residue_name").alias("name"), "kind", "weight"))).alias("components"))
    sites = binding_sites(atoms).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("method", "site_id", "residues"))).alias("sites"))
    lists = pharmacophore_lists(found, ["file"], "residue_name", "auth_num", ["chain", "residue_num"])
    lists = lists.select("file", F.struct(*RESIDUE_CLASSES).alias("pharmacophore"))
    code = F.regexp_replace("__code", r"[;\s]", "")
    sequence = F.when(F.length("__built") >= 10, F.col("__built")).otherwise(F.coalesce(F.when(F.length(code) > 0, code), F.col("__built"), F.lit("")))
    out = _described(rows).join(_sequences(rows), "file", "left").withColumn("sequence", sequence).withColumn("sequence_length", F.length("sequence")).drop("__code", "__built")
    for part in (counts, parts, sites, lists):
        out = out.join(part, "file", "left")
    if kinds is not None:
        runs = secondary_structure(kinds).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("chain", "start", "end", "kind", "n"))).alias("secondary"))
        out = out.join(runs, "file", "left")
    lacking = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("n_atoms", "n_residues")}
    lacking |= {n: F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)) for n in ("components", "sites", "secondary") if n in out.columns}
    broken = rows.where("error IS NOT NULL").groupBy("file").agg(F.min("error").alias("error"))
    return out.withColumns(lacking).withColumn("error", F.lit(None).cast("string")).unionByName(broken, True)
