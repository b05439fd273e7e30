"""Validation of rule payloads before they become the clause table; on the driver, files are at most 1 MiB."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reckon.sources.files import canonical_json

ACTIONS, KINDS, STATUSES = ("include", "exclude", "needs_review"), ("exact", "prefix", "contains"), ("approved", "draft", "retired")
LISTS = ("required_substrings", "forbidden_substrings", "source_units", "excluded_units")
SCOPES = ("object_scopes", "stages", "target_processes", "scope_units")
CLAUSES = "content_hash string, rule_id string, status string, owner_approved boolean, clause_index long, action string, match_kind string, literal string, " + ", ".join(f"{x} array<string>" for x in LISTS + SCOPES) + ", include_quantity boolean, include_cost boolean"


def issues(payload: object) -> list[str]:
    """What is wrong with a payload {'rules': [{'rule_id', 'status', 'owner_approved', scopes, 'clauses': [...]}]}; paths and reasons, in order."""
    if not isinstance(payload, dict) or not isinstance(payload.get("rules"), list):
        return ["$: rules must be a list"]
    out, seen, owners = [], set(), {}
    for i, rule in enumerate(payload["rules"]):
        at = f"rules[{i}]"
        if not isinstance(rule, dict) or not isinstance(rule.get("rule_id"), str) or not rule["rule_id"]:
            out.append(f"{at}: rule_id must be a text")
            continue
        if rule["rule_id"] in seen:
            out.append(f"{at}: rule_id occurs twice")
        seen.add(rule["rule_id"])
        if rule.get("status") not in STATUSES:
            out.append(f"{at}: unknown status")
        if not rule.get("clauses"):
            out.append(f"{at}: no clauses")
        for j, c in enumerate(rule.get("clauses") or ()):
            here = f"{at}.clauses[{j}]"
            if c.get("action") not in ACTIONS or c.get("match_kind") not in KINDS or not str(c.get("literal") or "").strip():
                out.append(f"{here}: action, match_kind and literal are required")
            elif c["action"] == "include" and rule.get("exclusive"):
                key = (c["match_kind"], c["literal"], tuple(sorted(rule.get("object_scopes") or ())))
                if owners.setdefault(key, rule["rule_id"]) != rule["rule_id"]:
                    out.append(f"{here}: literal already owned by {owners[key]}")
    return out


def clause_table(spark: SparkSession, payload: dict) -> DataFrame:
    """The clause rows of a valid payload, with the hash of its canonical JSON."""
    if found := issues(payload):
        raise ValueError("; ".join(found))
    digest = sha256(canonical_json(payload).encode()).hexdigest()
    rows = [
        (digest, r["rule_id"], r["status"], bool(r.get("owner_approved")), j, c["action"], c["match_kind"], c["literal"].strip().lower(), *(list(c.get(x) or []) for x in LISTS), *(list(r.get(x) or []) for x in SCOPES), bool(c.get("include_quantity", True)), bool(c.get("include_cost", True)))
        for r in payload["rules"] for j, c in enumerate(r["clauses"])
    ]
    return spark.createDataFrame(rows, CLAUSES)


def conflicts(clauses: DataFrame) -> DataFrame:
    """(kind, rule_ids): rule ids with several definitions, and exclusive rules that own one exact literal in a common scope.

    clauses: the rule table with content_hash by definition and exclusive. An empty scope is every scope; objects and stages must
    both overlap. Rules meet by literal, so only those that share one are compared.
    """
    twice = clauses.groupBy("rule_id").agg(F.count_distinct("definition").alias("n")).filter("n > 1").select(F.lit("DUPLICATE_RULE_ID").alias("kind"), F.array_repeat("rule_id", F.col("n").cast("int")).alias("rule_ids"))
    owned = clauses.filter("exclusive and action = 'include' and match_kind = 'exact'").select("rule_id", F.lower("literal").alias("literal"), "object_scopes", "stages").distinct()
    a, b = owned.alias("a"), owned.alias("b")
    overlap = lambda k: (F.size(F.col(f"a.{k}")) == 0) | (F.size(F.col(f"b.{k}")) == 0) | F.arrays_overlap(F.col(f"a.{k}"), F.col(f"b.{k}"))
    pairs = a.join(b, F.col("a.literal") == F.col("b.literal")).filter("a.rule_id < b.rule_id").filter(overlap("object_scopes") & overlap("stages"))
    shared = pairs.select(F.lit("EXCLUSIVE_SCOPE_OVERLAP").alias("kind"), F.array("a.rule_id", "b.rule_id").alias("rule_ids")).distinct()
    return twice.unionByName(shared)
