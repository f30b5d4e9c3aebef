"""Explicit schemas of the engine's inputs; nothing is inferred."""

from __future__ import annotations

TEST_CASES = """
repo string, test_id string, repo_url string, commit string, file_path string, file_url string, framework string, test_name string,
test_status string, suite_status string, start_line int, end_line int, callback_start_line int, callback_end_line int,
describe_path array<string>, is_parameterized boolean, parameter_row_index int, parameter_row_count int,
fixtures_used array<string>, hook_instance_keys array<string>, has_expanded_ui_actions boolean, extraction_empty boolean
"""

FEATURES = """
repo string, test_id string, feature_type string, source_kind string, name string, raw_code string, line string,
source_start_offset int, source_end_offset int, file_path string, target_file string,
hook_instance_key string, hook_owner_kind string, is_shared_hook_feature boolean, attached_from_hook boolean,
helper_depth int, helper_name string, resolved boolean, fixture_param_name string,
locator_strategy_ast string, ui_action_category string, terminal_action_ast string, action_signature_json string, navigation_target_ast string,
control_flow_enclosure string, control_flow_branch_kind string, control_flow_branch_arm string, control_flow_loop_depth int, control_flow_branch_depth int,
wait_subtype_ast string, assertion_chain_root_id string, assertion_chain_index int, assertion_chain_length int, assertion_matcher string,
is_soft_assertion string, is_grouped_assertion string, input_source_ast string, value_summary string, input_provenance_ast string, linked_action_line int
"""

HELPER_EDGES = """
repo string, test_id string, hook_instance_key string, `from` string, `to` string, target_file string,
depth int, call_line int, call_start_offset int, call_end_offset int, resolved boolean
"""

STATIC_METRICS = """
repo string, test_id string, metrics_status string, test_body_ncloc int, test_body_statement_count int,
cyclomatic_basic int, cyclomatic_extended int, max_nesting int, has_dynamic_navigation boolean, static_url_literals_json string
"""

DECISIONS = """
model string, prompt_version string, input_hash string, label string, confidence string, abstain boolean,
evidence_fields array<string>, short_rationale string, codebook_step string
"""
