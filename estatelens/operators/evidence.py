"""Findings to occurrences: grouping, confidence by independent evidence groups, assertion levels, factor trees.

A findings table has system_id, primitive, parameters (canonical JSON), purpose, control_class, modality,
locator, raw and assumption (null without one); one row per observation. Confidence needs only how often
each modality was seen, so findings shrink to at most 13 rows per occurrence before anything is gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatelens.common import cut_lineage
from estatelens.functions import dims
from estatelens.functions.assets import occurrence_id, round_half_up, with_asset_facts
from estatelens.operators.traces import scrub

KEYS = ["system_id", "asset_id", "control_class"]
#: Evidence rows that a factor cites.
CITED = 5


def identified(findings: DataFrame) -> DataFrame:
    """findings with the columns of their assets and the occurrence_id."""
    return with_asset_facts(findings).withColumn("occurrence_id", occurrence_id(F.col("system_id"), F.col("asset_id"), F.col("control_class")))


FOLD = ["system_id", "primitive", "parameters", "purpose", "control_class", "modality", "assumption"]


def folded(found: DataFrame) -> DataFrame:
    """Findings counted by all that their ids are hashed from, by modality and by assumption, as a written table.

    occurrences(), modality_tally(), group_winners() and assets() take it in place of findings, so that a question
    with several parts reads the findings once.
    """
    return cut_lineage(found.groupBy(*FOLD).agg(F.count("*").alias("fold_count")), "fold")


def _counted(found: DataFrame) -> DataFrame:
    """Findings, or a fold of them, counted with their ids.

    Only the counts, far fewer, are hashed; column pruning drops the ids and asset facts of single findings
    from the scan, and a plain count stays in generated code.
    """
    raw = found.withColumnRenamed("fold_count", "n") if "fold_count" in found.columns else found.groupBy(*FOLD).agg(F.count("*").alias("n"))
    rows = identified(raw).select("occurrence_id", *KEYS, "modality", "assumption", "n")
    return rows.join(F.broadcast(dims.modalities(found.sparkSession)), "modality")


def modality_tally(found: DataFrame) -> DataFrame:
    """Observations per occurrence and modality, with the modality's ceiling, group and place."""
    return _counted(found).groupBy("occurrence_id", *KEYS, "modality", "ceiling", "grp", "grp_ord").agg(F.sum("n").alias("n"))


def group_winners(tally: DataFrame) -> DataFrame:
    """Per occurrence and group: the modality of the highest ceiling (the first on a tie), all observations, those suppressed."""
    return tally.groupBy("occurrence_id", "grp").agg(
        F.max_by("modality", F.struct(F.col("ceiling"), -F.col("grp_ord"))).alias("contributing"), F.max("ceiling").alias("ceiling"), F.sum("n").alias("n"), (F.sum("n") - 1).alias("suppressed")
    )


def noisy_or(ceilings: list[Column]) -> Column:
    """1 - product of (1 - c) in the given order, nulls as 0, rounded to 4 places."""
    miss = F.lit(1.0)
    for c in ceilings:
        miss = miss * (1.0 - F.coalesce(c, F.lit(0.0)))
    return round_half_up(1.0 - miss, 4)


def tainted_level(confidence: Column, tainted: Column, threshold: float = dims.CONFIRM_THRESHOLD) -> Column:
    """The assertion level: nothing that rests on an assumption is CONFIRMED."""
    return F.when(~tainted & (confidence >= threshold), "CONFIRMED").when(confidence >= dims.OBSERVE_THRESHOLD, "OBSERVED").otherwise("SUSPECTED")


def downgrade_reason(confidence: Column, assumptions: Column, threshold: float = dims.CONFIRM_THRESHOLD) -> Column:
    """Why an occurrence is not CONFIRMED, null if it is."""
    tainted = F.concat(F.lit("provenance tainted by "), F.size(assumptions).cast("string"), F.lit(" assumption(s): "), F.array_join(assumptions, "; "))
    below = F.concat(F.lit("confidence "), confidence.cast("string"), F.lit(f" below confirm threshold {threshold:g}"))
    return F.when(F.size(assumptions) > 0, tainted).when(confidence < threshold, below)


def occurrences(found: DataFrame, threshold: float = dims.CONFIRM_THRESHOLD) -> DataFrame:
    """One row per occurrence: keys, evidence count, modalities, assumptions, confidence, level and reason."""
    by_group = [F.max(F.when(F.col("grp") == g, F.col("ceiling"))).alias(f"g{g}") for g in range(dims.GROUPS)]
    folded = _counted(found).groupBy("occurrence_id", *KEYS).agg(
        F.sum("n").alias("n_evidence"), F.array_sort(F.collect_set("modality")).alias("modalities"), F.array_sort(F.collect_set("assumption")).alias("assumptions"), *by_group
    )
    scored = folded.withColumn("confidence", noisy_or([F.col(f"g{g}") for g in range(dims.GROUPS)])).withColumn("tainted", F.size("assumptions") > 0)
    return scored.drop(*[f"g{g}" for g in range(dims.GROUPS)]).withColumns(
        {"level": tainted_level(F.col("confidence"), F.col("tainted"), threshold), "downgrade_reason": downgrade_reason(F.col("confidence"), F.col("assumptions"), threshold)}
    )


def assets(found: DataFrame) -> DataFrame:
    """The distinct assets with all their columns, derived after the distinct.

    The keys are read through the count, so that a filter on a derived column is not pushed below the
    aggregate, where it would be computed for each finding instead of each asset.
    """
    keys = ["primitive", "parameters", "purpose"]
    kinds = found.groupBy(*keys).agg(F.count("*").alias("_n")).select(*[F.when(F.col("_n") > 0, F.col(k)).alias(k) for k in keys])
    return with_asset_facts(kinds).select("asset_id", *keys, "quantum_vulnerable", "security_bits", "oid", "asset_name", "track")


def assembled(found: DataFrame) -> DataFrame:
    """Occurrences with all their evidence as a sorted array, duplicates kept; for export and drill-down."""
    evidence = F.array_sort(F.collect_list(F.struct("modality", "locator", "raw")))
    return found.groupBy("occurrence_id", *KEYS).agg(evidence.alias("evidence"))


#: What an occurrence's id is hashed from.
_HASHED = ["system_id", "primitive", "parameters", "purpose", "control_class"]


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    """Equality of columns, nulls equal."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def of_occurrence(found: DataFrame, occurrence_id: str) -> DataFrame:
    """The findings of one occurrence, met by the few combinations that its id stands for."""
    kinds = identified(found.groupBy(*_HASHED).agg(F.count("*").alias("_n"))).filter((F.col("_n") > 0) & (F.col("occurrence_id") == occurrence_id)).select(*_HASHED)
    return found.join(F.broadcast(kinds), _same(found, kinds, _HASHED), "left_semi")


def cited(found: DataFrame, fold: DataFrame | None = None) -> DataFrame:
    """Per occurrence and group: the first CITED rows of the winning modality by locator and raw.

    Rows are cut per group before they are gathered, so a hot occurrence costs a sort and not an array. Findings meet the
    winners by what ids are hashed from: only the kinds of findings are hashed, not each finding.
    """
    fold = folded(found) if fold is None else fold
    winners = group_winners(modality_tally(fold)).select("occurrence_id", "grp", F.col("contributing").alias("modality"))
    kinds = identified(fold.select(*_HASHED, "modality").distinct()).select("occurrence_id", *_HASHED, "modality")
    won = cut_lineage(kinds.join(winners, ["occurrence_id", "modality"]), "winners")
    order = Window.partitionBy("occurrence_id", "grp").orderBy("locator", "raw")
    rows = found.select(*_HASHED, "modality", "locator", "raw")
    met = rows.join(won, _same(rows, won, [*_HASHED, "modality"])).select("occurrence_id", "grp", rows["modality"], "locator", "raw")
    return met.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= CITED).select("occurrence_id", "grp", "modality", "ord", "locator", "raw")


def requires_corroboration(modalities: Column, value: Column, threshold: float = dims.CONFIRM_THRESHOLD) -> Column:
    """Confidence reaches the threshold although no single modality's ceiling does."""
    ceilings = {m[0]: m[1] for m in dims.MODALITIES}
    return (value >= threshold) & F.forall(modalities, lambda m: dims.lookup(m, ceilings) < threshold)


def factor_nodes(found: DataFrame) -> DataFrame:
    """The confidence of each occurrence as a table of tree nodes.

    root_id, path ('' for the root, then 0, 0.1 ...), parent, depth, kind, label, value, weight. Spark has
    no recursive struct; a tree is its nodes. The findings are read twice: for their counts, and for what is cited.
    """
    fold = folded(found)
    occ = occurrences(fold)
    winners = group_winners(modality_tally(fold))
    place = F.row_number().over(Window.partitionBy("occurrence_id").orderBy("grp")) - 1
    groups = winners.withColumn("place", place)
    leaf = cited(found, fold).join(groups.select("occurrence_id", "grp", "place"), ["occurrence_id", "grp"])
    null = F.lit(None).cast("string")
    root = occ.select(F.col("occurrence_id").alias("root_id"), F.lit("").alias("path"), null.alias("parent"), F.lit(0).alias("depth"), F.lit("INFERENCE").alias("kind"), F.lit("noisy-OR across independent evidence groups").alias("label"), F.col("confidence").alias("value"), F.lit(1.0).alias("weight"))
    middle = groups.select("occurrence_id", F.col("place").cast("string"), F.lit(""), F.lit(1), F.lit("INFERENCE"), F.concat(F.lit("group "), F.col("grp").cast("string"), F.lit(": "), F.col("contributing")), "ceiling", F.lit(1.0))
    leaves = leaf.select("occurrence_id", F.concat_ws(".", F.col("place").cast("string"), (F.col("ord") - 1).cast("string")), F.col("place").cast("string"), F.lit(2), F.lit("EVIDENCE"), F.concat(F.col("modality"), F.lit(" "), F.col("locator")), F.lit(1.0), F.lit(1.0))
    count = groups.groupBy("occurrence_id").agg(F.count("*").alias("n"))
    guesses = occ.select("occurrence_id", F.posexplode("assumptions").alias("k", "assumption")).join(count, "occurrence_id")
    assumed = guesses.select("occurrence_id", (F.col("n") + F.col("k")).cast("string"), F.lit(""), F.lit(1), F.lit("ASSUMPTION"), "assumption", F.lit(1.0), F.lit(0.0))
    return root.union(middle).union(leaves).union(assumed)


def addressed(nodes: DataFrame) -> DataFrame:
    """Nodes of factor_nodes() as a reader walks them: root_id, address (f, f.0, f.0.1 ...), depth, kind, label, value, weight,
    tainted (the node or one below it is an assumption) and is_evidence (it is cited, or rests on nothing).

    What holds below a node reaches it by an equality join with its own address: each node asks for the addresses above it.
    """
    address = F.when(F.col("path") == "", "f").otherwise(F.concat(F.lit("f."), F.col("path")))
    rows = cut_lineage(nodes.withColumn("address", address), "nodes")
    parts = F.split("address", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    each = rows.select("root_id", "kind", F.col("address").alias("own"), F.explode(above).alias("address"))
    below = each.groupBy("root_id", "address").agg(F.bool_or(F.col("kind") == "ASSUMPTION").alias("tainted"), F.bool_or(F.col("own") != F.col("address")).alias("rests"))
    out = rows.join(below, ["root_id", "address"])
    return out.select("root_id", "address", "depth", "kind", "label", "value", "weight", "tainted", ((F.col("kind") == "EVIDENCE") | ~F.col("rests")).alias("is_evidence"))


def redacted_nodes(nodes: DataFrame, hidden: DataFrame) -> DataFrame:
    """Nodes with names that a reader may not see replaced in their labels, wherever they stand in them.

    hidden: one column of names, replaced from the longest on. The list is gathered in one row; it is the caller's scope, not data.
    """
    name = F.col(hidden.columns[0])
    names = hidden.select(F.struct(F.length(name).alias("size"), name.alias("name")).alias("x")).distinct().agg(F.transform(F.sort_array(F.collect_list("x"), asc=False), lambda x: x["name"]).alias("_hidden"))
    return nodes.crossJoin(F.broadcast(names)).withColumn("label", scrub(F.col("label"), F.col("_hidden"))).drop("_hidden")


def explained(nodes: DataFrame) -> DataFrame:
    """Folds of each tree: nodes, depth, whether an assumption taints it, assumptions, citations."""
    return nodes.groupBy("root_id").agg(
        F.count("*").alias("n_nodes"),
        F.max("depth").alias("depth"),
        F.bool_or(F.col("kind") == "ASSUMPTION").alias("tainted"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "ASSUMPTION", F.col("label")))).alias("assumptions"),
        F.count_if(F.col("kind") == "EVIDENCE").alias("n_citations"),
    )


def level_summary(occ: DataFrame) -> DataFrame:
    """Occurrences per control class and assertion level: the flagship result."""
    return occ.groupBy("control_class", "level").agg(F.count("*").alias("occurrences"), F.count_if("tainted").alias("tainted"))


def histograms(found: DataFrame) -> DataFrame:
    """Findings by modality and by primitive: dimension, value, n."""
    both = F.explode(F.array(F.struct(F.lit("modality").alias("dimension"), F.col("modality").alias("value")), F.struct(F.lit("primitive").alias("dimension"), F.col("primitive").alias("value"))))
    return found.select(both.alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
