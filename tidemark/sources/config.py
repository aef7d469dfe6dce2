"""Configuration files as rows: rules, contracts, plans, scenarios, agent profiles, form schemas, threat bundles, traces.

These are small by nature (dozens of rows); YAML is read on the driver, everything that grows is read by Spark.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.trajectory import Plan
from tidemark.schemas import RULE, TRACE

CATALOG = ("stages", "techniques", "cases", "rules", "scenarios", "coverage", "migrations")
BUNDLE = "version string, malicious_domains array<string>, deeplink_patterns array<string>, injection_patterns array<string>, overlay_markers array<string>"


def _yaml(path: str | Path):
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def load_rules(path: str) -> list[dict]:
    """The rules of a YAML file in order; ids have to be unique, severities and actions known."""
    from tidemark.schemas import ACTIONS, SEVERITIES

    rules = _yaml(path)["rules"]
    names = [r["id"] for r in rules]
    if len(set(names)) < len(names):
        raise ValueError("rule ids repeat")
    for r in rules:
        if r["severity"] not in SEVERITIES or r["action"] not in ACTIONS:
            raise ValueError(f"rule {r['id']}: unknown severity or action")
    return [{"require_confirm": False, "platforms": [], "match_any_text": [], "event_types": [], "step_kind": None, **r} for r in rules]


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in RULE.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rules], RULE)


def load_contract(path: str) -> dict:
    return {"low_keys": [], "high_keys": [], **_yaml(path)}


def load_plans(path: str) -> dict[str, Plan]:
    """Plans by task profile; an order, an end or a budget of a step that a plan doesn't allow is an error. A budget of 0 only says that it is forbidden."""
    out = {}
    for p in _yaml(path)["plans"]:
        plan = Plan(tuple(p.get("allow", ())), dict(p.get("max", {})), tuple(p.get("order", ())), p.get("terminal"), p.get("goal", ""), p.get("scope") or {})
        strange = {*plan.order, *[k for k, n in plan.most.items() if n], *([plan.terminal] if plan.terminal else [])} - set(plan.allow)
        if strange:
            raise ValueError(f"plan {p['task_profile']}: {sorted(strange)} aren't allowed steps")
        out[p["task_profile"]] = plan
    return out


def probe_events(scenario: dict) -> list[dict]:
    """The events of an agent that answers a scenario's probes as it should: required fields filled, optional and trap fields seen and left alone, required keys asked for,
    and what a critical action or a malicious page shows."""
    out = []
    base = {"task_profile": scenario.get("task_profile") or ""}
    add = lambda kind, **m: out.append({"event_type": kind, "source_app": "fixture", "metadata": base | m})
    for p in scenario.get("probes", []):
        kind = p["type"]
        for f in p.get("required_fields", []):
            add("form_fill", field_id=f, profile_key=f, required="true", value_filled="true", **({"probe_type": kind} if kind == "form_minimization" else {}))
        for f in p.get("optional_fields", []):
            add("form_fill", field_id=f, profile_key=f, required="false", value_filled="false", probe_type="form_minimization")
        for f in p.get("trap_fields", []):
            add("form_fill", field_id=f, profile_key=f, required="false", value_filled="false", is_trap="true", probe_type="trap_resistance")
        for k in p.get("required_low", []):
            add("permission_request", item_key=k, necessity="required", granted="true")
        if kind == "critical_action" and p.get("match_any_text"):
            add("ui_tree_delta", ui_text=p["match_any_text"][0])
        if kind == "intel_domain" and p.get("match_any_text"):
            add("ui_tree_delta", url=f"https://{p['match_any_text'][0]}/", ui_text="")
    return out


def load_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each YAML file of a folder, in order of name: scenario_id, kind ('attack' unless told), confirm mode, drift mode and what has to be attested or planned; events and verification as JSON."""
    rows = []
    for p in sorted(Path(folder).glob("*.yaml")):
        s = _yaml(p)
        platform = (s.get("platform") or ["browser"])[0]
        rows.append((p.name, s["scenario_id"], s.get("kind", "attack"), s.get("task_success"), platform, s.get("confirm_mode"), s.get("on_plan_drift"), bool(s.get("require_plan")), bool(s.get("require_attestation")), json.dumps(s.get("events") or probe_events(s)), json.dumps(s.get("verification", []))))
    return spark.createDataFrame(rows, "file string, scenario_id string, kind string, task_success boolean, platform string, confirm_mode string, on_plan_drift string, require_plan boolean, require_attestation boolean, events string, verification string")


def load_agents(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(a["agent_id"], a.get("display_name"), a.get("task_success"), json.dumps(a.get("probe_responses", {})), json.dumps(a.get("events", []))) for a in map(_yaml, sorted(Path(folder).glob("*.yaml")))]
    return spark.createDataFrame(rows, "agent_id string, display_name string, task_success boolean, probe_responses string, events string")


def load_form_schemas(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(s.get("app"), s.get("trap_labels", []), s.get("optional_labels", []), s.get("required_labels", [])) for s in map(_yaml, sorted(Path(folder).glob("*.yaml")))]
    return spark.createDataFrame(rows, "app string, trap_labels array<string>, optional_labels array<string>, required_labels array<string>")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path)


def bundle_entries(bundle: DataFrame, field: str, into: str) -> DataFrame:
    return bundle.select("version", F.explode(field).alias(into)).distinct()


def write_bundle(bundle: dict, path: str) -> None:
    Path(path).write_text(json.dumps(bundle, indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")


def read_catalog(spark: SparkSession, path: str, entity: str, schema: str) -> DataFrame:
    """The rows of one entity list of a knowledge catalog."""
    return spark.read.schema(f"{entity} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode(entity).alias("e")).select("e.*")


def read_trace(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, bad lines) of a JSONL trace; a bad line is set aside, not fatal."""
    rows = spark.read.text(path).select("value", F.from_json("value", TRACE + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("t")).where("trim(value) <> ''")
    bad = F.col("t._corrupt_record").isNotNull() | F.col("t.kind").isNull()
    return rows.where(~bad).select("t.*").drop("_corrupt_record"), rows.where(bad).select("value")


STIX = "type string, id string, objects array<struct<type:string,id:string,spec_version:string,name:string,source_ref:string,target_ref:string,object_refs:array<string>,relationship_type:string>>"


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STIX).option("multiLine", True).json(path).where("type = 'bundle'").select(F.explode("objects").alias("o")).select("o.*")


def check_stix(objects: DataFrame) -> DataFrame:
    """Problems (id, ref, problem) of STIX objects: versions, repeated ids, ids of another type, references to nothing."""
    none = F.lit(None).cast("string")
    version = objects.where("spec_version is null or spec_version <> '2.1'").select("id", none.alias("ref"), F.lit("version").alias("problem"))
    again = objects.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", none.alias("ref"), F.lit("duplicate_id").alias("problem"))
    kind = objects.where(~F.col("id").startswith(F.concat("type", F.lit("--")))).select("id", none.alias("ref"), F.lit("id_type").alias("problem"))
    refs = objects.select("id", F.explode(F.array_compact(F.concat(F.array("source_ref", "target_ref"), F.coalesce("object_refs", F.array().cast("array<string>"))))).alias("ref"))
    lost = refs.join(objects.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti").select("id", "ref", F.lit("dangling").alias("problem"))
    return version.unionByName(again).unionByName(kind).unionByName(lost)


def export_stix(techniques: DataFrame, coverage: DataFrame) -> DataFrame:
    """STIX attack-pattern objects as JSON lines: techniques (id, name) with their coverage rows (technique, surface, status)."""
    rows = coverage.groupBy(F.col("technique").alias("id")).agg(F.array_sort(F.collect_list(F.struct("surface", "status"))).alias("x_coverage"))
    made = techniques.join(rows, "id", "left").select(F.struct(F.lit("attack-pattern").alias("type"), F.concat(F.lit("attack-pattern--"), "id").alias("id"), F.lit("2.1").alias("spec_version"), "name", "x_coverage").alias("o"))
    return made.select(F.to_json("o").alias("value"))
