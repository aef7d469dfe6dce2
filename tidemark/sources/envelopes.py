"""JSON envelopes of browser and device adapters as event rows; UI trees as text, events and form fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.fields import classify_field

ITEM = (
    "struct<type:string,app:string,text:string,field_id:string,profile_key:string,required:boolean,value_filled:boolean,is_trap:boolean,probe_type:string,url:string,"
    "session_id:string,package:string,marker:string,uri:string,item_key:string,necessity:string,granted:boolean,bytes:bigint,hint:string,"
    "signer_sha256:string,attest_error:string,app_label:string,icon_dhash:string,face_error:string,task_profile:string,task_apps:string,task_data_keys:string,task_hosts:string,"
    "broadcast_input_receivers:array<string>,foreign_a11y_services:array<string>,text_capturing_services:array<string>,assistive_system_services:array<string>,log_readers:array<string>,"
    "log_readers_enumerable:boolean,broadcast_actions:array<string>,scan_errors:array<string>>"
)
ENVELOPE = f"type string, source string, events array<{ITEM}>"
BROWSER = {"ui_text": "ui_tree_delta", "form_fill": "form_fill"}
DEVICE = BROWSER | {
    "session_start": "agent_session_start", "session_end": "agent_session_end", "overlay_marker": "ui_tree_delta", "deeplink": "deeplink", "permission_request": "permission_request",
    "env_survey": "environment_survey", "network_meta": "network_flow",
}
#: Markers of what a survey found.
SURVEY_MARKERS = (("broadcast_input_receivers", "[AG_BROADCAST_INPUT_SINK]"), ("foreign_a11y_services", "[AG_FOREIGN_A11Y_SERVICE]"), ("log_readers", "[AG_LOG_READER]"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of JSON files, one to a file or line, with the file's name."""
    return spark.read.schema(ENVELOPE).option("multiLine", True).json(path).withColumn("file", F.input_file_name())


def _kind(item: Column, kinds: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in kinds.items():
        out = F.when(item["type"] == k, v).otherwise(out)
    return out


def _metadata(i: Column) -> Column:
    """Metadata of an item by its type: what isn't told is left out, or has the default of its type; lists are joined by commas."""
    kind = i["type"]
    on = lambda names, v: F.when(kind.isin(*names.split()), v)
    text = lambda v, d="": F.coalesce(v, F.lit(d))
    said = lambda v: F.when(F.trim(v) != "", F.trim(v))
    some = lambda n: F.coalesce(F.size(i[n]), F.lit(-1))
    survey = "env_survey"
    markers = F.array_join(F.array_compact(F.array(*[F.when(some(n) > 0, F.lit(m)) for n, m in SURVEY_MARKERS])), " ")
    shown = (
        F.when(kind == "ui_text", text(i["text"])).when(kind == "overlay_marker", F.coalesce(i["marker"], i["text"], F.lit(""))).when(kind == "deeplink", text(i["uri"]))
        .when(kind == survey, markers).when(kind == "network_meta", F.coalesce(i["hint"], i["text"], F.lit("")))
    )
    surveyed = ((some("broadcast_input_receivers") >= 0) | (some("foreign_a11y_services") >= 0)) & (some("scan_errors") <= 0)
    joined = lambda n, by=",", least=0: on(survey, F.when(some(n) >= least, F.array_join(i[n], by)))
    entries = [
        ("package", i["package"]), ("url", i["url"]), ("bytes", i["bytes"].cast("string")), *[(n, said(i[n])) for n in ("signer_sha256", "attest_error", "app_label", "icon_dhash", "face_error")],
        *[(n, on("session_start", said(i[n]))) for n in ("task_profile", "task_apps", "task_data_keys", "task_hosts")], ("ui_text", shown), ("overlay_marker", on("overlay_marker", F.lit("true"))),
        ("field_id", on("form_fill", text(i["field_id"]))), ("profile_key", on("form_fill", text(i["profile_key"]))), *[(n, on("form_fill", F.coalesce(i[n], F.lit(d)).cast("string"))) for n, d in (("required", False), ("value_filled", True), ("is_trap", False))],
        ("probe_type", on("form_fill", i["probe_type"])), ("uri", on("deeplink", text(i["uri"]))), ("item_key", on("permission_request", text(i["item_key"]))), ("necessity", on("permission_request", text(i["necessity"], "unnecessary"))),
        ("granted", on("permission_request", F.coalesce(i["granted"], F.lit(False)).cast("string"))), *[(n, joined(n)) for n in ("broadcast_input_receivers", "foreign_a11y_services", "text_capturing_services", "log_readers")],
        *[(n, joined(n, ",", 1)) for n in ("assistive_system_services", "broadcast_actions")], ("scan_errors", joined("scan_errors", "; ", 1)), ("log_readers_enumerable", on(survey, i["log_readers_enumerable"].cast("string"))), ("env_surveyed", on(survey, surveyed.cast("string"))),
    ]
    return F.map_filter(F.create_map(*[x for k, v in entries for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def _app(item: Column, source: Column, platform: str) -> Column:
    """The acting app: its name, else its package, else the envelope's source, else the platform."""
    said = lambda v: F.when(F.trim(v) != "", F.trim(v))
    return F.coalesce(said(item["app"]), item["package"], source, F.lit(platform))


def items(envelopes: DataFrame) -> DataFrame:
    return envelopes.select("*", F.posexplode("events").alias("position", "item"))


def convert(envelopes: DataFrame, platform: str, kinds: dict[str, str] = BROWSER, id_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of envelopes: items of unknown kind are rejects (id, position, error), the rest events. Nothing fails as a whole."""
    rows = items(envelopes).withColumn("kind", _kind(F.col("item"), kinds))
    bad = rows.where("kind is null").select(id_col, "position", F.concat(F.lit("unknown event type: "), F.coalesce("item.type", F.lit("null"))).alias("error"))
    good = rows.where("kind is not null").select(
        F.concat_ws("-", id_col, "position").alias("event_id"), F.lit(0).cast("long").alias("timestamp_ms"), F.lit(platform).alias("platform"), F.col("kind").alias("event_type"),
        _app(F.col("item"), F.col("source"), platform).alias("source_app"), F.col("item.session_id").alias("agent_context_id"), _metadata(F.col("item")).alias("metadata"),
    )
    return good, bad


def convert_strict(envelopes: DataFrame, platform: str, kinds: dict[str, str] = BROWSER, id_col: str = "file") -> DataFrame:
    """Events of envelopes; an item of unknown kind fails the query."""
    rows = items(envelopes).withColumn("kind", F.coalesce(_kind(F.col("item"), kinds), F.raise_error(F.concat(F.lit("unknown event type: "), F.coalesce("item.type", F.lit("null"))))))
    return rows.select(
        F.concat_ws("-", id_col, "position").alias("event_id"), F.lit(0).cast("long").alias("timestamp_ms"), F.lit(platform).alias("platform"), F.col("kind").alias("event_type"),
        _app(F.col("item"), F.col("source"), platform).alias("source_app"), F.col("item.session_id").alias("agent_context_id"), _metadata(F.col("item")).alias("metadata"),
    )


#: A UI tree comes as its nodes in order, each with the number of its parent.
NODES = "array<struct<id:int,parent:int,role:string,text:string,value:string,editable:boolean,label:string>>"


def flatten_text(nodes: Column, most: int = 500) -> Column:
    """Texts of a tree's nodes in order, each cut to most characters, joined by blanks."""
    return F.array_join(F.transform(F.filter(nodes, lambda n: F.trim(F.coalesce(n["text"], F.lit(""))) != ""), lambda n: F.substring(F.trim(n["text"]), 1, most)), " ")


def snapshot_events(snapshots: DataFrame) -> DataFrame:
    """ui_tree_delta events of snapshots (event_id, timestamp_ms, platform, source_app, nodes)."""
    meta = F.create_map(F.lit("ui_text"), flatten_text(F.col("nodes")), F.lit("node_count"), F.size("nodes").cast("string"))
    return snapshots.select("event_id", "timestamp_ms", "platform", F.lit("ui_tree_delta").alias("event_type"), "source_app", F.lit(None).cast("string").alias("agent_context_id"), meta.alias("metadata"))


def snapshot_form_fills(snapshots: DataFrame) -> DataFrame:
    """form_fill events of the editable nodes of snapshots, classified by label."""
    rows = snapshots.select("event_id", "timestamp_ms", "platform", "source_app", F.explode(F.filter("nodes", lambda n: n["editable"])).alias("n")).withColumn("c", classify_field(F.coalesce("n.label", "n.text", F.lit(""))))
    filled = F.coalesce(F.trim("n.value") != "", F.lit(False)).cast("string")
    meta = F.create_map(F.lit("profile_key"), F.col("c.profile_key"), F.lit("required"), F.col("c.required").cast("string"), F.lit("is_trap"), F.col("c.is_trap").cast("string"), F.lit("value_filled"), filled)
    return rows.select(F.concat_ws("-", "event_id", "n.id").alias("event_id"), "timestamp_ms", "platform", F.lit("form_fill").alias("event_type"), "source_app", F.lit(None).cast("string").alias("agent_context_id"), meta.alias("metadata"))
