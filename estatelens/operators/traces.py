"""Service graphs from spans, and reachability across services.

A spans table has span_id, parent_span_id ('' or null for none), service, operation, ord (input order) and,
to join within traces only, trace_id. Traces only ever raise a verdict: absence in a window proves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.operators import graph


def span_pairs(spans: DataFrame, within_traces: bool = False) -> DataFrame:
    """Each span with its parent of another service. Of spans with one id, the last in order is the parent."""
    key = ["trace_id", "span_id"] if within_traces else ["span_id"]
    last = spans.groupBy(*key).agg(F.max_by("service", "ord").alias("from_service")).withColumnRenamed("span_id", "parent_span_id")
    child = spans.filter(F.coalesce("parent_span_id", F.lit("")) != "").select(*(["trace_id"] if within_traces else []), "parent_span_id", F.col("service").alias("to_service"), "operation", "ord")
    found = child.join(last, ["trace_id", "parent_span_id"] if within_traces else "parent_span_id").filter("from_service <> to_service")
    return found.select("from_service", "to_service", "operation", "ord")


def service_edges(spans: DataFrame, within_traces: bool = False) -> DataFrame:
    """from_service, to_service, observations, and the operation of the first span in order."""
    return span_pairs(spans, within_traces).groupBy("from_service", "to_service").agg(F.count("*").alias("observations"), F.min_by("operation", "ord").alias("operation"))


def trace_roots(spans: DataFrame) -> DataFrame:
    """Services that have a span without a parent, or with one that is not in the table."""
    none = F.coalesce("parent_span_id", F.lit("")) == ""
    known = spans.select(F.col("span_id").alias("parent_span_id")).distinct()
    orphans = spans.filter(~none).join(known, "parent_span_id", "left_anti")
    return spans.filter(none).select("service").union(orphans.select("service")).distinct()


def reachable_services(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Breadth-first search from roots: service, hops, path (services from a root on), first reached wins.

    The smallest path wins among equals, so the result does not depend on order. Edges are planned and written once.
    """
    arrows = edges.select(F.col("from_service").alias("from_key"), F.col("to_service").alias("to_key"), F.col("to_service").alias("edge"))
    found = graph.breadth_first(arrows, roots.select(F.col("service").alias("key"), F.array("service").alias("label")), lambda path, service: F.concat(path, F.array(service)))
    return found.select(F.col("key").alias("service"), "hops", F.col("label").alias("path"))


def apply_trace_reachability(occ: DataFrame, services: DataFrame) -> DataFrame:
    """occ (reachable, via, local_path nullable) with verdicts raised where traces reach the system.

    Roots (no hops) and occurrences observed on the wire keep their verdict.
    """
    far = services.filter("hops > 0").select(F.col("service").alias("system_id"), "hops", F.col("path").alias("trace_path"))
    raised = F.col("hops").isNotNull() & ~F.coalesce(F.col("via") == "OBSERVED", F.lit(False))
    return occ.join(far, "system_id", "left").withColumns({"reachable": F.when(raised, True).otherwise(F.col("reachable")), "via": F.when(raised, "TRACE").otherwise(F.col("via")), "raised": raised}).drop("hops")


def spans_from_otlp(payloads: DataFrame) -> DataFrame:
    """Spans of trace payloads in the OTLP JSON layout (resourceSpans column, parsed).

    A resource without service.name is skipped; an operation is the span's name, else rpc.method, else http.route.
    """
    value = lambda attributes, key: F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]
    text = lambda attributes, key: F.coalesce(value(attributes, key)["stringValue"], value(attributes, key)["intValue"])
    by_resource = payloads.select(F.posexplode("resourceSpans").alias("r", "rs")).select("r", text(F.col("rs.resource.attributes"), "service.name").alias("service"), F.col("rs.scopeSpans").alias("ss")).filter("service is not null")
    flat = by_resource.select("r", "service", F.posexplode("ss").alias("s", "scope")).select("r", "s", "service", F.posexplode("scope.spans").alias("k", "span"))
    name = F.coalesce(F.nullif("span.name", F.lit("")), F.nullif(text(F.col("span.attributes"), "rpc.method"), F.lit("")), F.nullif(text(F.col("span.attributes"), "http.route"), F.lit("")), F.lit(""))
    return flat.select("service", F.col("span.traceId").alias("trace_id"), F.col("span.spanId").alias("span_id"), F.coalesce("span.parentSpanId", F.lit("")).alias("parent_span_id"), name.alias("operation"), F.struct("r", "s", "k").alias("ord"))


#: The layout of OTLP JSON, for spark.read.schema() and from_json().
OTLP_SCHEMA = (
    "resourceSpans array<struct<resource:struct<attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean>>>>,"
    "scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,"
    "attributes:array<struct<key:string,value:struct<stringValue:string,intValue:string,boolValue:boolean>>>>>>>>>"
)


def redact_paths(rows: DataFrame, hidden: DataFrame, path: str = "path") -> DataFrame:
    """Rows with services that a reader may not see taken out of path and counted in hops_out_of_scope.

    hidden: one column of service names. Names are looked up by a join, however many are hidden, once for each distinct path.
    """
    every = rows.select(F.col(path).alias("_path")).distinct()
    steps = every.select("_path", F.posexplode_outer("_path").alias("_k", "_name"))
    names = hidden.select(F.col(hidden.columns[0]).alias("_name"), F.lit(True).alias("_out")).distinct()
    seen = steps.join(names, "_name", "left").groupBy("_path").agg(F.sort_array(F.collect_list(F.when(F.col("_out").isNull() & F.col("_k").isNotNull(), F.struct("_k", "_name")))).alias("_left"))
    shown = F.transform("_left", lambda x: x["_name"])
    named = rows.join(seen, rows[path].eqNullSafe(seen["_path"]), "left")
    return named.withColumns({path: F.when(F.col(path).isNotNull(), shown), "hops_out_of_scope": F.when(F.col(path).isNotNull(), F.size(path) - F.size("_left"))}).drop("_path", "_left")


#: Fixed value: what stands for a name that a reader may not see.
OUT_OF_SCOPE = "(out of scope)"


def scrub(text: Column, hidden: Column) -> Column:
    """text with each name of an array replaced, in the order of the array."""
    return F.aggregate(hidden, text, lambda s, name: F.replace(s, name, F.lit(OUT_OF_SCOPE)))


def promoted_systems(before: DataFrame, after: DataFrame) -> DataFrame:
    """Occurrences per system that are TRACE now and were not."""
    was = before.filter("via = 'TRACE'").select("occurrence_id")
    return after.filter("via = 'TRACE'").join(was, "occurrence_id", "left_anti").groupBy("system_id").agg(F.count("*").alias("promoted"))


def self_reachable_systems(occ: DataFrame) -> DataFrame:
    """Systems that are reached on their own."""
    return occ.filter(F.col("via").isin("ENTRY_POINT", "DEPLOYED_CONFIG", "OBSERVED")).select("system_id").distinct()


