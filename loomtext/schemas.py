"""Schemas of records and working tables, as DDL."""

GENERATED = """
id STRING, format STRING,
profile STRUCT<initial_demographic_seed: MAP<STRING,STRING>, events_string: STRING, generated_profile_string: STRING,
  profile: MAP<STRING,STRING>, event_list: ARRAY<STRUCT<event: STRING, attributes: MAP<STRING,STRING>>>,
  id: STRING, attr_to_share: STRUCT<attr_type: STRING, attr_value: STRING>>,
situation STRUCT<text: STRING, prompt: STRING, id: STRING>,
record STRUCT<text: STRING, prompt: STRING, type: STRING, id: STRING, accepted_records: ARRAY<STRING>, rejected_records: ARRAY<STRING>,
  attributes: STRUCT<profile: MAP<STRING,STRING>, event: MAP<STRING,STRING>>,
  grouped_attributes: MAP<STRING, MAP<STRING,STRING>>>
"""

SPAN = "STRUCT<attr: ARRAY<STRING>, attr_type: ARRAY<STRING>, start: INT, end: INT, span: STRING, confidence: DOUBLE, sanitization_option: STRING, group_name: STRING>"

SANITIZED = (
    GENERATED
    + f""",
folder_num BIGINT, base_instruction STRING, smoothed_instruction STRING,
sanitized_record STRUCT<text: STRING,
  sequence_sanitization_mapping: MAP<INT, STRUCT<original_sequence: STRING, sanitized_sequence: STRING,
    target_attributes: ARRAY<STRING>, strategies_used: ARRAY<STRING>, spans: ARRAY<{SPAN}>>>,
  sanitization_info: STRUCT<abstract_targets: ARRAY<STRING>, drop_targets: ARRAY<STRING>, keep_targets: ARRAY<STRING>,
    individual_target_attributes: MAP<STRING, STRUCT<value: STRING, sanitization: STRING, group_name: STRING,
    inference_from_original_record: STRING>>, strategies: MAP<STRING,STRING>>>
"""
)

SEQUENCES = "record_id STRING, idx INT, seq STRING, terminator STRING, start INT"
ATTRIBUTES = "record_id STRING, source STRING, group_name STRING, attr_type STRING, attr_value STRING, ordinal INT"
TARGETS = "record_id STRING, attr_type STRING, attr_value STRING, sanitization STRING, group_name STRING, ordinal INT"
ERRORS = "record_id STRING, stage STRING, severity STRING, error STRING"
NAMES = "name STRING, F INT, M INT"
