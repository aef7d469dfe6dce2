"""Event, rule and audit schemas, and the fixed ranks of severities, actions and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Event types, severities and actions in ascending order, step kinds with their gravity.
EVENT_TYPES = (
    "screen_frame", "ui_tree_delta", "process_focus", "network_flow", "clipboard_change", "agent_session_start", "agent_session_end", "form_fill", "deeplink", "permission_request",
    "memory_write", "memory_read", "environment_survey", "data_derive", "file_write", "file_delete", "process_exec", "data_flow", "declassify", "user_query",
)
LOW_KEYS = (
    "name", "food_preference", "language", "destination", "origin", "check_in", "check_out", "guest_count", "quantity", "order_note", "search_query", "loyalty_tier", "seat_preference", "diet_note",
)
HIGH_KEYS = ("phone_number", "email", "id_number", "home_address", "payment_info", "date_of_birth", "passport_number", "credit_card_number", "social_security_number", "medical_record_id")
SEVERITIES = ("info", "low", "medium", "high", "critical")
ACTIONS = ("allow", "log_only", "alert", "block")
STEP_GRAVITY = {"transfer_funds": 6, "confirm_payment": 5, "run_shell": 4, "network_egress": 3, "disclose_high": 2, "persist_memory": 1}

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("platform", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("source_app", T.StringType()),
        T.StructField("agent_context_id", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
RULE = "id string, name string, severity string, action string, require_confirm boolean, platforms array<string>, match_any_text array<string>, event_types array<string>, step_kind string"
DECISION = "action string, severity string, rule_id string, human_message string, require_confirm boolean"
TRACE = "ts long, kind string, request_id string, audit_id string, outcome string, approve boolean, source string, events long, protection_state string, rule_id string"


def _rank(c: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(None).cast("int")
    for i, n in enumerate(names):
        out = F.when(F.lower(c) == n, i).otherwise(out)
    return out


def severity_rank(c: Column) -> Column:
    return _rank(c, SEVERITIES)


def action_rank(c: Column) -> Column:
    """allow 0, log_only 1, alert 2, block 3; null for anything else."""
    return _rank(c, ACTIONS)


def step_gravity(c: Column) -> Column:
    out = F.lit(0)
    for k, g in STEP_GRAVITY.items():
        out = F.when(c == k, g).otherwise(out)
    return out
