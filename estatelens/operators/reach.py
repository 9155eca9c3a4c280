"""Static reachability over a module graph: import resolution, breadth-first search, verdicts.

Vertices: file, lang, package (dir or null), is_test, entry_kind (null if none), published. Imports: file, spec, ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.operators import graph

#: What a local import may stand for, in the order in which it is tried.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py")
REWRITES = ((".js", ".ts"), (".jsx", ".tsx"), (".mjs", ".mts"), (".cjs", ".cts"))
#: Path patterns of tests, and of configuration that only shows how.
TEST_PATH = r"(^|/)(tests?|__tests__|spec|specs|fixtures?|mocks?|e2e)(/|$)|[._-](test|spec)\.[a-z]+$|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$"
EXAMPLE_PATH = r"(^|/)(examples?|samples?|templates?|docs?|tests?|fixtures?)(/|$)"


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def joined_path(base: Column, spec: Column) -> Column:
    """A relative import from a file's directory, with . and .. resolved."""
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.split(F.concat(folder, spec), "/")
    step = lambda done, p: F.when(p.isin("", "."), done).when((p == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def python_path(base: Column, spec: Column) -> Column:
    """A Python relative import as a path: leading dots are parent folders, other dots separators."""
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    rest = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    return joined_path(base, F.concat(F.repeat(F.lit("../"), dots - 1), rest))


def resolve_local(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (from_file, to_file, ordinal) of relative imports: the first candidate that is a file wins."""
    python = F.col("spec").rlike(r"^\.+[A-Za-z_]") & F.col("file").endswith(".py")
    at = F.when(python, python_path(F.col("file"), F.col("spec"))).otherwise(joined_path(F.col("file"), F.col("spec")))
    local = imports.filter(F.col("spec").startswith(".")).withColumn("at", at)
    plain = F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(F.col("at"), s))
    again = F.array(*[F.when(F.col("at").endswith(a), F.concat(F.substring(F.col("at"), F.lit(1), F.length("at") - len(a)), F.lit(b))) for a, b in REWRITES])
    tried = local.select("file", "ordinal", F.posexplode(F.concat(plain, F.array_compact(again))).alias("k", "candidate"))
    hit = tried.join(files.select(F.col("file").alias("candidate")), "candidate").filter("candidate <> file")
    return hit.groupBy("file", "ordinal").agg(F.min_by("candidate", "k").alias("to_file")).select(F.col("file").alias("from_file"), "to_file", "ordinal")


def resolve_packages(imports: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of imports of workspace packages (name, entry_dir): the longest package name that is a prefix.

    Prefixes are exploded and looked up, so no import is compared with all packages.
    """
    bare = imports.filter(~F.col("spec").startswith("."))
    parts = F.split("spec", "/")
    prefixes = bare.select("file", "ordinal", "spec", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"), parts.alias("p")).withColumn("name", F.array_join(F.slice("p", F.lit(1), F.col("n")), "/"))
    best = prefixes.join(packages, "name").groupBy("file", "ordinal").agg(F.max_by(F.struct("entry_dir", "spec", "name"), "n").alias("b"))
    rest = F.substring(F.col("b.spec"), F.length("b.name") + 2, F.lit(1 << 20))
    base = F.when(rest != "", F.concat_ws("/", "b.entry_dir", rest)).otherwise(F.concat_ws("/", "b.entry_dir", F.lit("src/index")))
    tried = best.select("file", "ordinal", F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(base, s))).alias("k", "candidate"))
    hit = tried.join(files.select(F.col("file").alias("candidate")), "candidate")
    return hit.groupBy("file", "ordinal").agg(F.min_by("candidate", "k").alias("to_file")).select(F.col("file").alias("from_file"), "to_file", "ordinal")


def resolve_suffix(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of aliased or absolute imports by unique path suffix; else unique in the importer's package.

    Each file is listed once per tail of its path (without extension); an import is one equi-join.
    """
    stem = F.regexp_replace(F.regexp_replace("file", r"\.[A-Za-z]+$", ""), r"/(index|__init__)$", "")
    parts = F.split(stem, "/")
    tails = files.select("file", "package", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("tail"))
    wanted = F.regexp_replace(F.regexp_replace(F.when(F.col("file").endswith(".py"), F.replace("spec", F.lit("."), F.lit("/"))).otherwise(F.col("spec")), r"^[@~]/", ""), r"\.(js|ts|jsx|tsx|mjs|cjs)$", "")
    aliased = imports.filter(~F.col("spec").startswith(".")).withColumn("tail", wanted)
    own = files.select("file", F.col("package").alias("own_package"))
    hits = aliased.join(own, "file").join(tails.withColumnRenamed("file", "to_file"), "tail").filter("to_file <> file")
    per = hits.groupBy("file", "ordinal").agg(
        F.count("*").alias("n"), F.min("to_file").alias("one"), F.count_if(F.col("package").eqNullSafe(F.col("own_package"))).alias("n_own"), F.min(F.when(F.col("package").eqNullSafe(F.col("own_package")), F.col("to_file"))).alias("own")
    )
    return per.filter("n = 1 or n_own = 1").select(F.col("file").alias("from_file"), F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("own")).alias("to_file"), "ordinal")


def entry_points(files: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """Files from which execution starts: entry kinds outside tests, and any that the caller adds."""
    found = files.filter("entry_kind is not null and not is_test").select("file")
    return (found.union(extra.select("file")) if extra is not None else found).distinct()


def walk(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Breadth-first search over files, to the end: file, hops, pred (the predecessor by import order, then name)."""
    by = F.struct(F.col("ordinal").alias("ordinal"), F.col("from_file").alias("from_file"))
    start = roots.select(F.col("file").alias("key"), F.lit(None).cast("struct<ordinal:int,from_file:string>").alias("label"))
    typed = edges.select(F.col("from_file").alias("from_key"), F.col("to_file").alias("to_key"), by.cast("struct<ordinal:int,from_file:string>").alias("edge"))
    found = graph.breadth_first(typed, start, lambda _, edge: edge)
    return found.select(F.col("key").alias("file"), "hops", F.col("label.from_file").alias("pred"))


def call_paths(walked: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paths from a root to each wanted file that is reached, by following predecessors."""
    return graph.paths(walked.select(F.col("file").alias("key"), "pred"), wanted.select(F.col("file").alias("key"))).withColumnRenamed("key", "file")


def live_functions(calls: DataFrame, exported: DataFrame) -> DataFrame:
    """Functions (file, name) that exported ones reach by calls within their file; calls: file, caller, callee."""
    key = lambda name: F.concat_ws("\0", F.col("file"), F.col(name))
    edges = calls.select(key("caller").alias("from_key"), key("callee").alias("to_key"), F.lit(0).alias("edge"))
    reached = graph.breadth_first(edges, exported.select(key("name").alias("key"), F.lit(0).alias("label")), lambda label, _: label)
    return reached.select(F.split_part("key", F.lit("\0"), F.lit(1)).alias("file"), F.split_part("key", F.lit("\0"), F.lit(2)).alias("name"))


def verdicts(evidence: DataFrame, walked: DataFrame, files: DataFrame, live: DataFrame | None = None, any_entry: bool = True) -> DataFrame:
    """reachable and via per occurrence, by precedence.

    evidence: occurrence_id, modality, file (null without a location), function (null if unknown). Live
    network evidence, then deployed configuration, then a path from an entry point, then a published
    surface; without source evidence or without any entry point the verdict is null.
    """
    source = F.col("modality").isin("SOURCE_AST", "SOURCE_CONFIG") & F.col("file").isNotNull()
    rows = evidence.join(walked.select("file", "hops"), "file", "left").join(files.select("file", "is_test", "published"), "file", "left")
    alive = F.lit(True)
    if live is not None:
        rows = rows.join(live.select("file", F.col("name").alias("function"), F.lit(True).alias("_live")), ["file", "function"], "left")
        alive = F.col("function").isNull() | F.coalesce("_live", F.lit(False))
    tested = F.coalesce("is_test", F.lit(False))
    path = source & ~tested & F.col("hops").isNotNull() & alive
    out = rows.groupBy("occurrence_id").agg(
        F.bool_or(F.col("modality").isin("NETWORK_ACTIVE", "NETWORK_PASSIVE")).alias("wire"),
        F.bool_or((F.col("modality") == "SOURCE_CONFIG") & F.col("file").isNotNull() & ~F.coalesce(F.col("file").rlike(EXAMPLE_PATH), F.lit(False))).alias("config"),
        F.bool_or(source).alias("source"),
        F.min(F.when(path, F.col("hops"))).alias("hops"),
        F.min_by("file", F.when(path, F.struct("hops", "file"))).alias("reached_file"),
        F.bool_or(source & ~tested & F.coalesce("published", F.lit(False))).alias("surface"),
    )
    via = (
        F.when(F.col("wire"), "OBSERVED").when(F.col("config"), "DEPLOYED_CONFIG").when(~F.col("source"), None).when(F.col("hops").isNotNull(), "ENTRY_POINT").when(F.col("surface"), "LIBRARY_SURFACE").otherwise("NONE")
    )
    if not any_entry:
        via = F.lit(None).cast("string")
    return out.withColumn("via", via).withColumn("reachable", F.when(F.col("via").isNotNull(), F.col("via") != "NONE")).select("occurrence_id", "reachable", "via", "hops", "reached_file")


def why_unreached(evidence: DataFrame, walked: DataFrame, files: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Per occurrence with source evidence: the distinct reasons why its places are not reached, sorted and joined."""
    rows = evidence.filter(F.col("modality").isin("SOURCE_AST", "SOURCE_CONFIG") & F.col("file").isNotNull())
    rows = rows.join(walked.select("file", "hops"), "file", "left").join(files.select("file", "is_test"), "file", "left")
    if live is not None:
        rows = rows.join(live.select("file", F.col("name").alias("function"), F.lit(True).alias("_live")), ["file", "function"], "left")
    idle = (F.col("function").isNotNull() & F.col("_live").isNull()) if live is not None else F.lit(False)
    reason = F.when(F.coalesce("is_test", F.lit(False)), "only a test uses it").when(F.col("hops").isNull(), "no entry point imports its file").when(idle, "no exported function calls it")
    return rows.groupBy("occurrence_id").agg(F.array_join(F.array_sort(F.collect_set(reason)), "; ").alias("reasons")).filter("reasons <> ''")
