"""Schemas of the engine's records."""

from __future__ import annotations

SCORES = "bbb_permeability double, bbb_classification string, gbm_activity double, normal_cell_toxicity double, selectivity_index double, synthetic_accessibility double, druglikeness double, composite_score double, clinical_similarity double"
PROPERTIES = "molecular_weight double, logp double, tpsa double, hbd int, hba int, rotatable_bonds int, ring_count int, qed double"
EVALUATION = f"smiles string, valid boolean, error string, scores struct<{SCORES.replace(' ', ':').replace(',:', ',')}>, properties struct<{PROPERTIES.replace(' ', ':').replace(',:', ',')}>, assessment string"
CANDIDATE = f"id string, target string, smiles string, prompt string, generated_text string, timestamp string, evaluation struct<{EVALUATION.split(', scores')[0].replace(' ', ':').replace(',:', ',')},scores:struct<{SCORES.replace(' ', ':').replace(',:', ',')}>,properties:struct<{PROPERTIES.replace(' ', ':').replace(',:', ',')}>,assessment:string>"
RESULT = (
    "entity_id string, mol_id string, library_name string, target string, smiles string, drugclip_score double, vina_docking_score double, mw double, tpsa double, "
    "consensus_logp double, bbb_permeant boolean, pgp_substrate boolean, pains_alerts int, brenk_alerts int, synthetic_accessibility double"
)
TARGET = "name string, description string, mutation_types array<string>, expression_pattern array<string>, key_markers array<string>, current_drugs array<string>, challenges array<string>, structural_requirements map<string,string>"
MOLECULE = "name string, smiles string, target string, status string, clinical_phase string, mechanism string, limitations string, failure_reason string, structural_features map<string,string>"
RAW_RESPONSE = "call int, response string"
ATOM = "target string, ordinal int, element string, x double, y double, z double, residue_num int, auth_num int, residue_name string, chain string, grp string"
