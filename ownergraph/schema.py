"""Fixed values of the legal-entity data model.

The CSV headers, dataset kinds, labels, relationship type literals and
defaults below are the published file format of the legal-entity golden copy
files; they must stay exactly as written for loads and answers to be right.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: Level 1 entity CSV header -> column (32 columns) ---------
LEVEL1_COLUMNS: dict[str, str] = {
    "LEI": "lei",
    "Entity.LegalName": "legal_name",
    "Entity.LegalAddress.FirstAddressLine": "legal_address_line1",
    "Entity.LegalAddress.AdditionalAddressLine.1": "legal_address_line2",
    "Entity.LegalAddress.City": "legal_address_city",
    "Entity.LegalAddress.Region": "legal_address_region",
    "Entity.LegalAddress.Country": "legal_address_country",
    "Entity.LegalAddress.PostalCode": "legal_address_postal_code",
    "Entity.HeadquartersAddress.FirstAddressLine": "hq_address_line1",
    "Entity.HeadquartersAddress.AdditionalAddressLine.1": "hq_address_line2",
    "Entity.HeadquartersAddress.City": "hq_address_city",
    "Entity.HeadquartersAddress.Region": "hq_address_region",
    "Entity.HeadquartersAddress.Country": "hq_address_country",
    "Entity.HeadquartersAddress.PostalCode": "hq_address_postal_code",
    "Entity.RegistrationAuthority.RegistrationAuthorityID": "registration_authority_id",
    "Entity.RegistrationAuthority.RegistrationAuthorityEntityID": "registration_authority_entity_id",
    "Entity.LegalJurisdiction": "legal_jurisdiction",
    "Entity.EntityCategory": "entity_category",
    "Entity.EntitySubCategory": "entity_sub_category",
    "Entity.LegalForm.EntityLegalFormCode": "legal_form_code",
    "Entity.LegalForm.OtherLegalForm": "legal_form_other",
    "Entity.EntityStatus": "entity_status",
    "Entity.EntityCreationDate": "entity_creation_date",
    "Entity.AssociatedEntity.AssociatedLEI": "associated_lei",
    "Entity.AssociatedEntity.type": "associated_entity_type",
    "Registration.InitialRegistrationDate": "initial_registration_date",
    "Registration.LastUpdateDate": "last_update_date",
    "Registration.RegistrationStatus": "registration_status",
    "Registration.NextRenewalDate": "next_renewal_date",
    "Registration.ManagingLOU": "managing_lou",
    "Registration.ValidationSources": "validation_sources",
    "ConformityFlag": "conformity_flag",
}

# --- fixed values: Level 2 relationship CSV header -> column (22 columns) ---
RELATIONSHIP_COLUMNS: dict[str, str] = {
    "Relationship.StartNode.NodeID": "start_node_id",
    "Relationship.StartNode.NodeIDType": "start_node_id_type",
    "Relationship.EndNode.NodeID": "end_node_id",
    "Relationship.EndNode.NodeIDType": "end_node_id_type",
    "Relationship.RelationshipType": "relationship_type",
    "Relationship.RelationshipStatus": "relationship_status",
    "Relationship.Period.1.startDate": "period_1_start_date",
    "Relationship.Period.1.endDate": "period_1_end_date",
    "Relationship.Period.1.periodType": "period_1_type",
    "Relationship.Qualifiers.1.QualifierDimension": "qualifier_1_dimension",
    "Relationship.Qualifiers.1.QualifierCategory": "qualifier_1_category",
    "Relationship.Quantifiers.1.MeasurementMethod": "quantifier_1_method",
    "Relationship.Quantifiers.1.QuantifierAmount": "quantifier_1_amount",
    "Relationship.Quantifiers.1.QuantifierUnits": "quantifier_1_units",
    "Registration.InitialRegistrationDate": "registration_initial_date",
    "Registration.LastUpdateDate": "registration_last_update",
    "Registration.RegistrationStatus": "registration_status",
    "Registration.NextRenewalDate": "registration_next_renewal",
    "Registration.ManagingLOU": "managing_lou",
    "Registration.ValidationSources": "validation_sources",
    "Registration.ValidationDocuments": "validation_documents",
    "Registration.ValidationReference": "validation_reference",
}

# --- fixed values: Level 2 reporting exception CSV header -> column ---------
EXCEPTION_COLUMNS: dict[str, str] = {
    "LEI": "lei",
    "Exception.Category": "exception_category",
    "Exception.Reason.1": "exception_reason_1",
    "Exception.Reference.1": "exception_reference_1",
}

# --- fixed values: dataset kinds and their display labels -------------------
KIND_ENTITIES = "lei2"
KIND_RELATIONSHIPS = "rr"
KIND_EXCEPTIONS = "repex"
DATASET_KINDS = (KIND_ENTITIES, KIND_RELATIONSHIPS, KIND_EXCEPTIONS)
DATASET_LABELS: dict[str, str] = {
    "lei2": "Level 1 - LEI Records",
    "rr": "Level 2 - Relationships",
    "repex": "Level 2 - Reporting Exceptions",
}
COLUMN_MAPS: dict[str, dict[str, str]] = {
    KIND_ENTITIES: LEVEL1_COLUMNS,
    KIND_RELATIONSHIPS: RELATIONSHIP_COLUMNS,
    KIND_EXCEPTIONS: EXCEPTION_COLUMNS,
}

# --- fixed values: relationship literals and defaults -----------------------
DIRECT_PARENT = "IS_DIRECTLY_CONSOLIDATED_BY"
ULTIMATE_PARENT = "IS_ULTIMATELY_CONSOLIDATED_BY"
ACTIVE = "ACTIVE"
MAX_HIERARCHY_DEPTH = 50
DEFAULT_SEARCH_LIMIT = 100
LEI_LENGTH = 20
UNKNOWN_PUBLISH_DATE = "unknown"
# Snapshot files are named "<stamp>-<publisher>-goldencopy-<kind>-<rest>"; the
# kind is taken from the part after "goldencopy-".
SNAPSHOT_KIND_PATTERN = r"-{publisher}-goldencopy-(lei2|rr|repex)-"

# Entity projection shared by lookups, parents and search (10 columns).
ENTITY_COLUMNS = [
    "lei",
    "legal_name",
    "entity_status",
    "registration_status",
    "entity_category",
    "legal_jurisdiction",
    "legal_address_city",
    "legal_address_country",
    "hq_address_city",
    "hq_address_country",
]
# Of these, the required ones become '' when empty; the rest become NULL.
REQUIRED_ENTITY_COLUMNS = ("legal_name", "entity_status", "registration_status")

METADATA_SCHEMA = T.StructType(
    [
        T.StructField("dataset_type", T.StringType()),
        T.StructField("publish_date", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
        T.StructField("record_count", T.IntegerType()),
    ]
)


def text_schema(columns) -> T.StructType:
    """All-text schema (the loads keep every column as text)."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


ENTITY_SCHEMA = text_schema(LEVEL1_COLUMNS.values())
RELATIONSHIP_SCHEMA = text_schema(RELATIONSHIP_COLUMNS.values())
EXCEPTION_SCHEMA = text_schema(EXCEPTION_COLUMNS.values())
