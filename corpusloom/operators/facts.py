"""Compiler facts as tables: validation, position lookups, call traces, contract queries.

Tables: sources (source_id, repo, path, snapshot_id), symbols (symbol_id, name, kind), occurrences (source_id, context_id,
start, end, symbol_id, role), bindings (binding_id, source_id, context_id, start, end, caller_id, callee_id, via_id),
implementations (interface_id, implementation_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 100


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """References that lead nowhere."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def bad_spans(rows: DataFrame) -> DataFrame:
    return rows.filter((F.col("start") < 0) | (F.col("end") < F.col("start")))


def bindings_at(bindings: DataFrame, sources: DataFrame, repo: str, path: str, offset: int, context: str | None = None) -> DataFrame:
    """Bindings that cover a position, innermost first. The file is picked before the join."""
    file = sources.filter((F.col("repo") == repo) & (F.col("path") == path)).select("source_id")
    rows = bindings.filter((F.col("start") <= offset) & (F.col("end") > offset))
    rows = rows.filter(F.col("context_id") == context) if context else rows
    return rows.join(file, "source_id", "left_semi").orderBy(F.col("end") - F.col("start"), "binding_id").limit(LIMIT)


def definitions(occurrences: DataFrame, sources: DataFrame, symbol_id: str) -> DataFrame:
    return occurrences.filter((F.col("symbol_id") == symbol_id) & (F.col("role") == "definition")).join(sources, "source_id").orderBy("repo", "path", "start").limit(LIMIT)


def file_symbols(occurrences: DataFrame, sources: DataFrame, symbols: DataFrame, repo: str, path: str, part: str = "") -> DataFrame:
    file = sources.filter((F.col("repo") == repo) & (F.col("path") == path)).select("source_id")
    own = occurrences.filter(F.col("role") == "definition").join(file, "source_id", "left_semi").select("symbol_id", "start")
    return own.join(symbols, "symbol_id").filter(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("start", "symbol_id").limit(LIMIT)


def call_edges(bindings: DataFrame) -> DataFrame:
    """Calls as graph edges, for graph.traverse."""
    return bindings.filter("caller_id IS NOT NULL AND callee_id IS NOT NULL").select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), F.lit("calls").alias("type"), F.lit(4).alias("tier"), F.col("binding_id").cast("string").alias("evidence"))


def implementations(facts: DataFrame, interface_id: str) -> DataFrame:
    return facts.filter(F.col("interface_id") == interface_id).select("implementation_id").distinct()


def contract_impact(bindings: DataFrame, facts: DataFrame, symbol_id: str) -> DataFrame:
    """Callers of a symbol, directly or through an interface that it implements."""
    via = facts.filter(F.col("implementation_id") == symbol_id).select(F.col("interface_id").alias("target"))
    targets = via.unionByName(via.sparkSession.createDataFrame([(symbol_id,)], "target string")).distinct()
    return bindings.join(targets, F.col("callee_id") == F.col("target")).select("caller_id", "callee_id", (F.col("callee_id") != symbol_id).alias("via_interface")).distinct()


def contract_paths(bindings: DataFrame, facts: DataFrame, caller: str, symbol_id: str) -> DataFrame:
    """Paths of at most one caller step from a caller to a symbol, also through an interface."""
    hit = contract_impact(bindings, facts, symbol_id)
    direct = hit.filter(F.col("caller_id") == caller).select(F.lit(None).cast("string").alias("step"), "callee_id", "via_interface")
    one = bindings.filter(F.col("caller_id") == caller).select(F.col("callee_id").alias("step")).distinct()
    return direct.unionByName(one.join(hit, F.col("step") == F.col("caller_id")).select("step", "callee_id", "via_interface")).distinct()


#: Rule and target roles of each kind of domain fact; whether it carries a lifetime.
DOMAIN_KINDS = (
    ("di_registration", "csharp-framework-v1", "service implementation", True),
    ("di_registration_if_absent", "csharp-framework-v5", "service implementation", True),
    ("di_keyed_registration", "csharp-keyed-di-v1", "service implementation key_type registration_api", True),
    ("di_keyed_registration_configuration", "csharp-keyed-di-v1", "service implementation key_type registration_api", True),
    ("di_open_generic_registration_configuration", "csharp-open-di-v1", "service_template implementation_template", True),
    ("storage_context_registration", "csharp-framework-v3", "service implementation", True),
    ("storage_entity", "csharp-framework-v1", "entity", False),
    ("storage_table", "csharp-framework-v1", "entity", False),
    ("storage_entity_use", "csharp-framework-v2", "entity", False),
    ("storage_entity_mapping", "csharp-framework-v2", "entity", False),
    ("message_publish", "csharp-framework-v1", "message", False),
    ("message_consumer", "csharp-framework-v1", "message", False),
    ("message_response", "csharp-framework-v5", "message", False),
    ("message_publish_configuration", "csharp-framework-v4", "message", False),
    ("message_event_configuration", "csharp-framework-v4", "message", False),
    ("message_request_configuration", "csharp-framework-v6", "request response_1 response_2", False),
    ("endpoint_post_configuration", "csharp-endpoint-v1", "handler", False),
    ("mediator_send_configuration", "csharp-mediatr-v1", "request response", False),
    ("mediator_assembly_scan_configuration", "csharp-mediatr-scan-v1", "assembly_marker", False),
    ("consumer_namespace_scan_configuration", "csharp-masstransit-scan-v1", "namespace_marker", False),
    ("activity_namespace_scan_configuration", "csharp-masstransit-scan-v1", "namespace_marker", False),
    ("routing_slip_activity_configuration", "csharp-routing-slip-v1", "activity arguments address_field formatter_api", False),
)
LIFETIMES = ("singleton", "scoped", "transient")


def bad_domain_facts(facts: DataFrame) -> DataFrame:
    """fact_id, reason of facts (fact_id, kind, rule, lifetime, route_pattern, targets of (role, symbol_id)) that break a rule."""
    rules = facts.sparkSession.createDataFrame([(k, r, roles.split(), life) for k, r, roles, life in DOMAIN_KINDS], "kind string, want_rule string, roles array<string>, has_lifetime boolean")
    met = facts.join(F.broadcast(rules), "kind", "left")  # the fixed table above
    route = F.coalesce(F.trim("route_pattern"), F.lit("")) != ""
    reason = (
        F.when(F.col("want_rule").isNull(), "kind")
        .when(~F.col("rule").eqNullSafe(F.col("want_rule")), "rule")
        .when(F.col("has_lifetime") & ~F.coalesce(F.col("lifetime").isin(*LIFETIMES), F.lit(False)), "lifetime")
        .when(~F.col("has_lifetime") & (F.coalesce("lifetime", F.lit("")) != ""), "lifetime")
        .when((F.col("kind") == "endpoint_post_configuration") != route, "route")
        .when(~F.transform("targets", lambda t: t["role"]).eqNullSafe(F.col("roles")), "roles")
        .when(F.exists("targets", lambda t: ~t["symbol_id"].startswith("symbol:") | (F.length(t["symbol_id"]) != 71)), "target")
        .when((F.col("kind") == "storage_context_registration") & (F.col("targets")[0]["symbol_id"] != F.get(F.col("targets"), F.lit(1))["symbol_id"]), "target")
    )
    return met.withColumn("reason", reason).filter("reason IS NOT NULL").select("fact_id", "reason")
