"""Schemas of the tables that the pipeline passes on, as DDL strings."""

DOCUMENT = "doc_ord BIGINT, iid STRING, text STRING"
TRIPLE = "doc_ord BIGINT, pos INT, s STRING, p STRING, o STRING"
DEFINITION = "doc_ord BIGINT, relation STRING, definition STRING"
SCHEMA = "ord BIGINT, relation STRING, definition STRING, origin STRING"
EMBEDDED_SCHEMA = SCHEMA + ", embedding ARRAY<FLOAT>"
RESULT = "iid STRING, triplets ARRAY<ARRAY<STRING>>"
#: The names are the trace format's own, the misspelt one included.
TRACE = (
    "index BIGINT, item_id STRING, input_text STRING, entity_hint ARRAY<STRING>, relation_hint STRING, oie ARRAY<ARRAY<STRING>>, schema_definition MAP<STRING, STRING>, "
    "canonicalization_candidates ARRAY<ARRAY<STRUCT<relation: STRING, score: DOUBLE>>>, schema_canonicalizaiton ARRAY<ARRAY<STRING>>"
)
