"""Rule sets as JSON: reading, saving, and the older flat form."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from leadbook.operators.rules import RuleError, validate_rules


# Names of the older form, and what a condition has unless it says otherwise.
_RENAMED = {"col": "field", "vals": "values"}
_PLAIN_CONDITION = {"field": "", "op": "is", "values": []}


def upgrade_rule(rule: dict) -> dict:
    """A rule in the current form; the flat `{col, vals, category}` form is one `is` condition."""
    parts = [{"col": rule["col"], "vals": rule.get("vals")}] if rule.get("col") else rule.get("conditions") or []
    named = [{_RENAMED.get(key, key): value for key, value in sorted(part.items()) if value} for part in parts]
    conditions = [{**_PLAIN_CONDITION, **{k: part[k] for k in _PLAIN_CONDITION if k in part}} for part in named]
    return {"conditions": conditions, "category": "bad" if rule.get("category") == "bad" else "good"}


def import_rules(text: str) -> list[dict]:
    """Rules from an exported JSON document, older forms upgraded.

    A flat rule that assigned `unclassified` is dropped: no match means that now.
    """
    raw = json.loads(text)
    if not isinstance(raw, list):
        raise RuleError("Rules must be a list.")
    return validate_rules([upgrade_rule(r) for r in raw if isinstance(r, dict) and r.get("category") != "unclassified"])


def save_rules(spark: SparkSession, rules: object, path: str) -> list[dict]:
    """Validate, then store as one JSON line on shared storage."""
    valid = validate_rules(rules)
    line = spark.createDataFrame([(json.dumps(valid),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(path)
    return valid


def load_rules(spark: SparkSession, path: str) -> list[dict]:
    """Stored rules; a set that no longer validates leaves every lead unclassified."""
    first = spark.read.text(path).first()
    try:
        return validate_rules(json.loads(first["value"])) if first else []
    except (RuleError, json.JSONDecodeError):
        return []
