"""Fixed schemas and closed vocabularies of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

#: Closed vocabularies.
ROLES = ("precipitant", "salt", "buffer", "additive", "cryo", "protein", "protein_buffer", "soak", "not_a_component", "unknown")
OUT_OF_SCOPE = ("protein_buffer", "soak")
NON_COMPONENT_REASONS = ("method_text", "unnamed_macromolecule", "screen_reference", "publication_reference", "splitter_fragment", "buffer_titrant")
UNITS = ("percent_w_v", "percent_v_v", "percent_unspecified", "molar", "millimolar", "micromolar", "nanomolar", "mg_ml", "g_l", "unitless")
PH_SOURCES = ("buffer", "final", "unstated")
TEMPERATURE_SOURCES = ("reported", "text", "both_agree", "conflict")
DISCARD_REASONS = ("EMPTY", "TOO_SHORT", "REFERENCE_ONLY", "METHOD_ONLY", "NO_REAGENT_MATCH", "UNPARSEABLE_RESIDUAL", "NON_CRYSTALLISATION_TEXT")
CHEM_CLASSES = ("peg", "organic", "salt", "buffer", "polyol", "detergent", "premix", "additive", "other")

RAW_ENTRY = (
    "rcsb_id string, exptl array<struct<method:string>>, "
    "exptl_crystal_grow array<struct<crystal_id:string,method:string,temp:string,temp_details:string,pH:string,pdbx_pH_range:string,pdbx_details:string,details:string>>, "
    "rcsb_accession_info struct<initial_release_date:string,revision_date:string,deposit_date:string,major_revision:int,minor_revision:int>, "
    "rcsb_entry_info struct<resolution_combined:array<double>,identification_combined:array<double>,polymer_entity_count:int,experimental_method:string>, "
    "polymer_entities array<struct<rcsb_id:string,entity_poly:struct<type:string,pdbx_seq_one_letter_code:string,pdbx_seq_one_letter_code_can:string,"
    "rcsb_sample_sequence_length:int,pdbx_strand_id:string>,rcsb_polymer_entity:struct<pdbx_description:string,formula_weight:double>,"
    "rcsb_polymer_entity_container_identifiers:struct<entity_id:string,uniprot_ids:array<string>,asym_ids:array<string>,auth_asym_ids:array<string>>,"
    "rcsb_entity_source_organism:array<struct<ncbi_scientific_name:string,ncbi_taxonomy_id:bigint>>>>"
)
COMPONENT = (
    "pdb_id string, crystal_id string, component_index int, role string, name_raw string, name_canonical string, chem_class string, peg_mw int, is_mme boolean, "
    "hofmeister_rank int, buffer_pka double, concentration double, unit string, unit_inferred boolean, concentration_is_range boolean, range_low double, range_high double, "
    "cryo_evidence string, premix_id string"
)
ANSWER = "array<struct<role:string,name:string,amount:double,unit:string>>"
CHAT = "array<struct<role:string,content:string>>"


def json_schema(schema: T.StructType, title: str) -> dict:
    """A JSON Schema of a Spark schema; extra keys are forbidden."""

    def of(kind: T.DataType) -> dict:
        if isinstance(kind, T.StructType):
            return {"type": "object", "additionalProperties": False, "properties": {f.name: of(f.dataType) for f in kind}, "required": [f.name for f in kind if not f.nullable]}
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType)}
        if isinstance(kind, T.MapType):
            return {"type": "object", "additionalProperties": of(kind.valueType)}
        if isinstance(kind, T.BooleanType):
            return {"type": ["boolean", "null"]}
        if isinstance(kind, T.IntegralType):
            return {"type": ["integer", "null"]}
        if isinstance(kind, T.NumericType):
            return {"type": ["number", "null"]}
        return {"type": ["string", "null"]}

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, **of(schema)}
