"""Fingerprints of differences and the cascade of ignore rules: occurrence, location, report, account, global."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliodiff.functions.text import hash_of, joined

SCOPES = ("location", "report", "account", "global")


def fingerprints(diffs: DataFrame) -> DataFrame:
    """diffs with account_hash, report_hash and location_hash, and the key of each scope."""
    hashed = diffs.withColumns(
        {
            "account_hash": hash_of("account", F.col("account")),
            "report_hash": hash_of("report", F.col("group_label")),
            "location_hash": hash_of("location", F.col("location_signature")),
        }
    )
    rest = [F.col(c) for c in ("doc_type", "difference_type", "comparison_mode")]
    a, r, loc = (F.col(f"{k}_hash") for k in ("account", "report", "location"))
    return hashed.withColumns({"location_key": joined(a, r, loc, *rest), "report_key": joined(a, r, *rest), "account_key": joined(a, *rest), "global_key": joined(*rest)})


def index_rules(rules: DataFrame) -> DataFrame:
    """One rule a (scope, key): of a location the first, of the other scopes the last one made."""
    rank = F.when(F.col("scope") == "location", F.col("ord")).otherwise(-F.col("ord"))
    return rules.groupBy("scope", "key").agg(F.min(F.struct(rank.alias("rank"), "rule_id"))["rule_id"].alias("rule_id"))


def apply_rules(diffs: DataFrame, rules: DataFrame, session: DataFrame) -> DataFrame:
    """diffs with ignored_scope and rule_id of the first scope that has a rule. session: (occurrence) of ids ignored once.

    Joins are many-to-one on unique keys; Spark picks broadcast or shuffle by the size of the rules.
    """
    found = diffs.join(session.select(F.col("occurrence").alias("diff_id"), F.lit(True).alias("_once")).distinct(), "diff_id", "left")
    indexed = index_rules(rules)
    for scope in SCOPES:
        own = indexed.filter(F.col("scope") == scope).select(F.col("key").alias(f"{scope}_key"), F.col("rule_id").alias(f"_{scope}"))
        found = found.join(own, f"{scope}_key", "left")
    scope = F.when(F.col("_once"), "occurrence")
    for s in SCOPES:
        scope = scope.when(F.col(f"_{s}").isNotNull(), s)
    rule = F.when(F.col("_once"), F.lit(None)).otherwise(F.coalesce(*[F.col(f"_{s}") for s in SCOPES]))
    return found.withColumns({"ignored_scope": scope, "rule_id": rule}).drop("_once", *[f"_{s}" for s in SCOPES])


def visible(diffs: DataFrame, search: str = "", difference_type: str | None = None, group: str | None = None, show_ignored: bool = False) -> DataFrame:
    """Differences that hold the searched text in any of their texts, of one type and one report if given; those that a rule hides only on demand."""
    shown = diffs if show_ignored else diffs.filter("ignored_scope IS NULL")
    if difference_type:
        shown = shown.filter(F.col("difference_type") == difference_type)
    if group:
        shown = shown.filter(F.col("group_label") == group)
    text = F.lower(F.concat_ws("\n", "group_label", "location_label", "reference_text", "version_text"))
    return shown.filter(text.contains(search.lower())) if search else shown
