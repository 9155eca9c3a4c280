"""Operators: goldens, invariance under order and partitioning, monotony, empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from estatelens.common import bucketed, cut_lineage
from estatelens.functions import mosca
from estatelens.operators import changes, evidence, export, order, ranking, reach, store, traces, views
from estatelens.operators import graph as graphs

SCHEMA = "system_id string, primitive string, parameters string, purpose string, control_class string, modality string, locator string, raw string, assumption string"


def finding(modality="SOURCE_AST", system="s", primitive="RSA", purpose="KEY_ESTABLISHMENT", control="SELF", locator="a:1", raw="r", assumption=None):
    return (system, primitive, '{"modulusLength":2048}' if primitive == "RSA" else "{}", purpose, control, modality, locator, raw, assumption)


def found(spark, rows):
    return evidence.identified(spark.createDataFrame(rows, SCHEMA))


def some(n=300, seed=1):
    rng = random.Random(seed)
    kinds = ["SOURCE_AST", "DEPENDENCY", "BINARY_STRING", "BINARY_CONSTANT", "HOST_AGENT", "NETWORK_ACTIVE", "RUNTIME_HOOK", "ASSERTED"]
    return [finding(rng.choice(kinds), f"s{rng.randrange(4)}", rng.choice(["RSA", "MD5", "X25519", "ML-KEM"]), locator=f"f:{rng.randrange(9)}", raw=str(rng.randrange(4)), assumption=rng.choice([None] * 9 + ["guess"])) for _ in range(n)]


def test_repetition_does_not_raise_confidence(spark):
    assert evidence.occurrences(found(spark, [finding("BINARY_STRING", locator=str(k)) for k in range(400)])).first()["confidence"] == 0.3


def test_independent_groups_combine(spark):
    row = evidence.occurrences(found(spark, [finding("SOURCE_AST"), finding("RUNTIME_HOOK")])).first()
    assert (row["confidence"], row["level"], row["n_evidence"]) == (0.9985, "CONFIRMED", 2)


def test_tie_in_a_group_goes_to_the_first(spark):
    assert evidence.group_winners(evidence.modality_tally(found(spark, [finding("HOST_AGENT"), finding("BINARY_CONSTANT")]))).first()["contributing"] == "BINARY_CONSTANT"


def test_an_assumption_caps_the_level(spark):
    row = evidence.occurrences(found(spark, [finding(), finding("RUNTIME_HOOK", assumption="b"), finding(assumption="a")])).first()
    assert (row["confidence"], row["level"], row["assumptions"]) == (0.9985, "OBSERVED", ["a", "b"])
    assert row["downgrade_reason"] == "provenance tainted by 2 assumption(s): a; b"


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_order_and_partitions_do_not_matter(spark, parts):
    rows = some()
    want = sorted(map(str, evidence.occurrences(found(spark, rows)).collect()))
    random.Random(parts).shuffle(rows)
    f = found(spark, rows).repartition(parts)
    assert sorted(map(str, evidence.occurrences(f).collect())) == want
    a, b = (export.document(evidence.occurrences(x), evidence.assets(x), "p@1", "t").first() for x in (f, found(spark, some())))
    assert a == b and a["serial_number"].startswith("urn:uuid:")


def test_more_evidence_never_lowers_confidence(spark):
    rows = some()
    less = {r["occurrence_id"]: r["confidence"] for r in evidence.occurrences(found(spark, rows[:150])).collect()}
    more = {r["occurrence_id"]: r["confidence"] for r in evidence.occurrences(found(spark, rows)).collect()}
    assert all(more[k] >= v for k, v in less.items())


def test_factor_trees(spark):
    f = found(spark, [finding(locator=str(k)) for k in range(8)] + [finding("RUNTIME_HOOK", assumption="g")])
    nodes = {r["path"]: r for r in evidence.factor_nodes(f).collect()}
    assert set(nodes) == {"", "0", "1", "2", "0.0", "0.1", "0.2", "0.3", "0.4", "1.0"} and nodes["2"]["kind"] == "ASSUMPTION"
    assert evidence.explained(evidence.factor_nodes(f)).first()["depth"] == 2


def test_ranking_buckets(spark):
    occ = evidence.occurrences(found(spark, [finding(), finding("DEPENDENCY", "t"), finding("SOURCE_AST", "u", "ML-KEM"), finding("SOURCE_AST", "v"), finding("SOURCE_AST", "w", purpose="DIGITAL_SIGNATURE")]))
    f = found(spark, some())
    verdict = F.when(F.col("system_id") == "v", False).when(F.col("system_id") == "w", True)
    rows = ranking.ranked(occ.withColumn("reachable", verdict).withColumn("via", F.lit(None).cast("string")), evidence.assets(f).union(evidence.assets(found(spark, [finding(purpose="DIGITAL_SIGNATURE")]))), mosca.EO_14412, 2026.66)
    assert {r["system_id"]: r["bucket"] for r in rows.collect()} == {"s": "confidentiality", "t": "hints", "v": "unreached", "w": "authenticity"}
    assert {r["reached_via"] for r in rows.collect()} == {"UNANALYZED"}
    head = ranking.headline(rows).first()
    assert (head["working"], head["late"]) == (2, 0)


def test_headline_of_nothing(spark):
    f = found(spark, [finding(primitive="ML-KEM")])
    assert tuple(ranking.headline(ranking.ranked(evidence.occurrences(f), evidence.assets(f), mosca.EO_14412, 2026.66)).first()) == (0, 0, 0, 0.0, 0.0)


def test_places_are_ranks(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([(f"{rng.randrange(1 << 96):024x}", rng.choice("ab"), rng.choice([1.0, 2.5, -3.0])) for _ in range(500)], "occurrence_id string, bucket string, slack_years double")
    got = ranking.placed(rows).collect()
    for bucket in "ab":
        part = [r for r in got if r["bucket"] == bucket]
        assert [r["place"] for r in sorted(part, key=lambda r: (r["slack_years"], r["occurrence_id"]))] == list(range(1, len(part) + 1))


def test_diff_reasons(spark):
    base = evidence.occurrences(found(spark, [finding(system=s) for s in "abcdefg"]))
    reach_ = lambda df, m: df.withColumn("reachable", F.try_element_at(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v).cast("boolean"))]), F.col("system_id")))
    before = reach_(base.filter("system_id <> 'a'"), {"c": False, "d": True, "e": None, "f": True, "g": None})
    after = reach_(base.filter("system_id <> 'b'"), {"c": True, "d": False, "e": True, "f": None, "g": None})
    got = {r["system_id"]: r["kind"] for r in changes.diff(before, after, evidence.assets(found(spark, [finding()]))).collect()}
    assert got == {"a": "APPEARED", "b": "REMEDIATED", "c": "REGRESSED", "d": "IMPROVED", "e": "RECLASSIFIED", "f": "RECLASSIFIED", "g": "UNCHANGED"}


def test_suppression_rules(spark):
    rows = spark.createDataFrame([("x", "too short", "2026-02-01"), ("y", "long enough to count", "2025-01-01"), ("z", "long enough to count", "2027-06-01"), ("w", "long enough to count", "2026-06-01")], "occurrence_id string, reason string, t string").withColumn("expires_at", F.to_timestamp("t"))
    got = {r["occurrence_id"]: r["problem"] for r in changes.valid_suppressions(rows, F.expr("timestamp '2026-01-01'")).collect()}
    assert got == {"x": "reason too short", "y": "already expired", "z": "longer than 365 days", "w": None}


def spans(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "span_id string, parent_span_id string, service string, operation string, ord int")


def test_service_graph(spark):
    s = spans(spark, [("1", "", "web", "GET"), ("2", "1", "api", "first"), ("3", "1", "api", "second"), ("4", "2", "db", "q"), ("5", "2", "api", "inner"), ("6", "9", "job", "x"), ("7", None, "web", "y")])
    edges = {tuple(r) for r in traces.service_edges(s).collect()}
    assert edges == {("web", "api", 2, "first"), ("api", "db", 1, "q")}
    assert {r["service"] for r in traces.trace_roots(s).collect()} == {"web", "job"}
    got = {r["service"]: (r["hops"], r["path"]) for r in traces.reachable_services(traces.service_edges(s), traces.trace_roots(s)).collect()}
    assert got == {"web": (0, ["web"]), "job": (0, ["job"]), "api": (1, ["web", "api"]), "db": (2, ["web", "api", "db"])}


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from_service string, to_service string")
    assert traces.reachable_services(edges, spark.createDataFrame([("a",)], "service string")).count() == 3


def test_traces_only_raise(spark):
    occ = spark.createDataFrame([("1", "api", False, "NONE"), ("2", "api", True, "OBSERVED"), ("3", "web", False, "NONE"), ("4", "db", None, None)], "occurrence_id string, system_id string, reachable boolean, via string")
    services = spark.createDataFrame([("web", 0, ["web"]), ("api", 1, ["web", "api"])], "service string, hops int, path array<string>")
    got = {r["occurrence_id"]: (r["reachable"], r["via"]) for r in traces.apply_trace_reachability(occ, services).collect()}
    assert got == {"1": (True, "TRACE"), "2": (True, "OBSERVED"), "3": (False, "NONE"), "4": (None, None)}


def test_reconcile(spark):
    f = found(spark, [finding(system="v"), finding("ASSERTED", "v", "MD5"), finding("HOST_AGENT", "v", "X25519"), finding(system="other")])
    a = {r["primitive"]: r["asset_id"] for r in evidence.assets(f).collect()}
    claims = spark.createDataFrame([("v", a["RSA"], "evaluating"), ("v", a["MD5"], "evaluating")], "system_id string, asset_id string, roadmap string")
    got = {r["asset_id"]: r["verdict"] for r in views.reconcile(claims, f, evidence.assets(f)).collect()}
    assert got == {a["RSA"]: "CORROBORATED", a["MD5"]: "UNVERIFIED", a["X25519"]: "UNDISCLOSED"}


FILES = [("app/server.ts", None, False, "http", False), ("app/lib/index.ts", None, False, None, False), ("app/keys.ts", None, False, None, False), ("app/dead.ts", None, False, None, False), ("tests/x.test.ts", None, True, "http", False), ("pkg/src/index.ts", "pkg", False, None, True), ("py/a.py", None, False, "main", False), ("py/sub/b.py", None, False, None, False)]
IMPORTS = [("app/server.ts", "./lib", 0), ("app/server.ts", "@org/pkg", 1), ("app/lib/index.ts", "../keys.js", 0), ("tests/x.test.ts", "../app/dead", 0), ("py/a.py", ".sub.b", 0)]


def graph(spark):
    return spark.createDataFrame(FILES, "file string, package string, is_test boolean, entry_kind string, published boolean"), spark.createDataFrame(IMPORTS, "file string, spec string, ordinal int")


def test_import_resolution(spark):
    files, imports = graph(spark)
    assert {tuple(r)[:2] for r in reach.resolve_local(imports, files).collect()} == {("app/server.ts", "app/lib/index.ts"), ("app/lib/index.ts", "app/keys.ts"), ("tests/x.test.ts", "app/dead.ts"), ("py/a.py", "py/sub/b.py")}
    packages = spark.createDataFrame([("@org/pkg", "pkg")], "name string, entry_dir string")
    assert [tuple(r)[:2] for r in reach.resolve_packages(imports, packages, files).collect()] == [("app/server.ts", "pkg/src/index.ts")]


def test_static_reachability(spark):
    files, imports = graph(spark)
    walked = reach.walk(reach.resolve_local(imports, files), reach.entry_points(files))
    assert {r["file"]: r["hops"] for r in walked.collect()} == {"app/server.ts": 0, "app/lib/index.ts": 1, "app/keys.ts": 2, "py/a.py": 0, "py/sub/b.py": 1}
    rows = spark.createDataFrame([("live", "SOURCE_AST", "app/keys.ts"), ("dead", "SOURCE_AST", "app/dead.ts"), ("surface", "SOURCE_AST", "pkg/src/index.ts"), ("none", "DEPENDENCY", None), ("wire", "NETWORK_ACTIVE", None), ("conf", "SOURCE_CONFIG", "etc/nginx.conf"), ("sample", "SOURCE_CONFIG", "examples/nginx.conf")], "occurrence_id string, modality string, file string")
    got = {r["occurrence_id"]: (r["reachable"], r["via"]) for r in reach.verdicts(rows, walked, files).collect()}
    assert got == {"live": (True, "ENTRY_POINT"), "dead": (False, "NONE"), "surface": (True, "LIBRARY_SURFACE"), "none": (None, None), "wire": (True, "OBSERVED"), "conf": (True, "DEPLOYED_CONFIG"), "sample": (False, "NONE")}
    assert {r["reachable"] for r in reach.verdicts(rows, walked, files, any_entry=False).collect()} == {None}
    paths = {r["file"]: r["path"] for r in reach.call_paths(walked, spark.createDataFrame([("app/keys.ts",)], "file string")).collect()}
    assert paths == {"app/keys.ts": ["app/server.ts", "app/lib/index.ts", "app/keys.ts"]}


def test_live_functions(spark):
    calls = spark.createDataFrame([("f", "main", "a"), ("f", "a", "b"), ("f", "dead", "c"), ("g", "main", "c")], "file string, caller string, callee string")
    exported = spark.createDataFrame([("f", "main")], "file string, name string")
    assert {tuple(r) for r in reach.live_functions(calls, exported).collect()} == {("f", "main"), ("f", "a"), ("f", "b")}


def test_store_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "o1"), ("s1", "o2")], "scan_id string, occurrence_id string")
    for _ in range(2):
        store.put(str(tmp_path), "occurrences", rows)
    store.put(str(tmp_path), "occurrences", spark.createDataFrame([("s2", "o3")], "scan_id string, occurrence_id string"))
    assert store.get(spark, str(tmp_path), "occurrences").count() == 3 and store.get(spark, str(tmp_path), "occurrences", "s1").count() == 2


def test_undeclared_assets_fail(spark):
    occ, known = spark.createDataFrame([("o", "a")], "occurrence_id string, asset_id string"), spark.createDataFrame([("b",)], "asset_id string")
    with pytest.raises(Exception, match="asset not declared"):
        store.require_references(occ, known).collect()


def test_runs_and_samples(spark):
    rows = spark.createDataFrame([(k, "x" if k in (0, 1, 5) else None) for k in range(8)], "k int, v string")
    assert [r["run"] for r in order.runs(rows, ["k"], ["v"], []).orderBy("k").collect()] == [1, 1, 2, 2, 2, 3, 4, 4]
    assert [r["k"] for r in order.systematic_sample(rows, ["k"], 4, 1).orderBy("k").collect()] == [1, 3, 5, 7]


def test_empty_findings(spark):
    f = evidence.identified(spark.createDataFrame([], SCHEMA))
    occ, known = evidence.occurrences(f), evidence.assets(f)
    for df in (occ, known, views.divergences(occ, known), export.components(occ, known), ranking.ranked(occ, known, mosca.EO_14412, 2026.66), changes.diff(occ, occ, known)):
        assert df.count() == 0
    assert views.coverage(occ).count() == 10 and not any(r["examined"] for r in views.coverage(occ).collect())


def test_reachable_services_through_cycles_equals_brute_force(spark):
    rng = random.Random(4)
    names = [f"svc-{k:02d}" for k in range(24)]
    pairs = sorted({(rng.choice(names[:20]), rng.choice(names[:20])) for _ in range(45)} | {("svc-00", "svc-15"), ("svc-15", "svc-03"), ("svc-03", "svc-00")})
    want, level = {"svc-00": (0, ["svc-00"])}, ["svc-00"]
    while level:
        found = {}
        for a, b in pairs:
            if a in level and b not in want:
                found[b] = min(found.get(b, ["~"]), [*want[a][1], b])
        want |= {b: (len(path) - 1, path) for b, path in found.items()}
        level = list(found)
    got = traces.reachable_services(spark.createDataFrame(pairs, "from_service string, to_service string"), spark.createDataFrame([("svc-00",)], "service string"))
    assert {r["service"]: (r["hops"], r["path"]) for r in got.collect()} == want
    assert len(want) > 10


@pytest.mark.parametrize("narrow", [0, 10_000])
def test_breadth_first_against_brute_force(spark, narrow):
    rng = random.Random(narrow)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(9)) for _ in range(90)] + [(100 + k, 101 + k, 0) for k in range(12)] + [(112, 100, 1)]
    roots = [1, 2, 100]
    level, want = {k: 0 for k in roots}, {k: None for k in roots}
    now, hop = set(roots), 0
    while now:
        hop += 1
        best = {}
        for a, b, e in edges:
            if a in now and b not in level:
                best[b] = min(best.get(b, e), e)
        level.update(dict.fromkeys(best, hop))
        want.update(best)
        now = set(best)
    table = spark.createDataFrame(edges, "from_key long, to_key long, edge int")
    start = spark.createDataFrame([(k, None) for k in [*roots, 1]], "key long, label int")
    got = graphs.breadth_first(table, start, lambda _, e: e, narrow).collect()
    assert {r["key"]: (r["hops"], r["label"]) for r in got} == {k: (level[k], want[k]) for k in level} and len(got) == len(level)


def test_search_without_roots_or_edges(spark):
    none = spark.createDataFrame([], "from_key long, to_key long, edge int")
    assert graphs.breadth_first(none, spark.createDataFrame([], "key long, label int"), lambda _, e: e).count() == 0
    assert [tuple(r) for r in graphs.breadth_first(none, spark.createDataFrame([(5, 1)], "key long, label int"), lambda _, e: e).collect()] == [(5, 0, 1)]


def test_edges_of_a_search_stay_where_they_are(spark):
    kept = bucketed(spark.range(1000).select(F.col("id").alias("from_key"), (F.col("id") + 1).alias("to_key"), F.lit(0).alias("edge")), "edges", "from_key")
    wide = spark.range(0, 1000, 3).select(F.col("id").alias("key"), F.lit(0).alias("label"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hop = graphs._hop(wide, kept, lambda label, _: label)
        hop.collect()
        plan = hop._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one exchange deals the frontier to the buckets, one brings what it found together by vertex
    assert "Bucketed: true" in plan and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 2


def test_paths_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graphs, "cut_lineage", lambda df, name: (rounds.append(name), cut_lineage(df, name))[1])
    parents = spark.range(1001).select(F.col("id").alias("key"), F.when(F.col("id") > 0, F.col("id") - 1).alias("pred"))
    got = {r["key"]: r["path"] for r in graphs.paths(parents, spark.createDataFrame([(1000,), (0,), (7,), (5000,)], "key long")).collect()}
    assert got == {1000: list(range(1001)), 0: [0], 7: list(range(8))} and rounds.count("jumps") <= 12


def test_redacted_paths(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["b"]), (3, []), (4, None), (5, ["a", "b", "c"])], "k int, path array<string>")
    out = traces.redact_paths(rows, spark.createDataFrame([("b",), ("z",)], "service string"))
    assert {r["k"]: (r["path"], r["hops_out_of_scope"]) for r in out.collect()} == {1: (["a", "c"], 1), 2: ([], 1), 3: ([], 0), 4: (None, None), 5: (["a", "c"], 1)}


@pytest.mark.parametrize("by", [[], ["p"]])
def test_order_against_brute_force(spark, by):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, "a", "b"]) if k % 40 else "only%d" % k, k // 9 if k < 200 else rng.randrange(3)) for k in range(400)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k long, p string, v long").repartition(3)
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1] if by else None, []).append(r)
    places = {r[0]: (i, len(g)) for g in groups.values() for i, r in enumerate(g, 1)}
    assert {r["k"]: (r["place"], r["total"]) for r in order.numbered(table, ["k"], by).collect()} == places
    want = {}
    for g in groups.values():
        run = 0
        for before, r in zip([None, *g], g):  # noqa: B905
            run += before is None or before[2] != r[2]
            want[r[0]] = run
    assert {r["k"]: r["run"] for r in order.runs(table, ["k"], ["v"], by).collect()} == want
    got = {r["k"] for r in order.systematic_sample(table, ["k"], 7, 2, by).collect()}
    assert got == {r[0] for g in groups.values() for i, r in enumerate(g[2:]) if i % max(1, len(g) // 7) == 0 and i // max(1, len(g) // 7) < 7}


def test_order_is_not_one_task(spark):
    dealt = order._dealt(spark.range(10_000).select("id", F.lit(1).alias("p")), ["id"], ["p"])
    sizes = [r["count"] for r in dealt.groupBy("_task").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * 10_000 / len(sizes)
    assert order.numbered(spark.range(0), ["id"]).count() == order.runs(spark.range(0), ["id"], ["id"], []).count() == 0


@pytest.mark.parametrize("n", [0, 1, 700])
def test_hash_tree_is_of_the_set(spark, n):
    leaves = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(n)]
    level = {d: d for d in leaves}
    for digits in export.TREE_LEVELS:
        groups = {}
        for name in sorted(level):
            groups.setdefault(name[:digits], []).append(level[name])
        level = {name: hashlib.sha256("".join(ds).encode()).hexdigest() for name, ds in groups.items()}
    want = level.get("", hashlib.sha256(b"").hexdigest())
    for parts in (1, 5):
        table = spark.createDataFrame([(d,) for d in random.Random(parts).sample(leaves, n)], "digest string").repartition(parts)
        assert tuple(export.hash_tree(table).first()) == (want, n)


def test_written_document_is_whole_and_the_same_again(spark, tmp_path):
    f = found(spark, some())
    rows = [export.write_document(evidence.occurrences(x), evidence.assets(x), str(tmp_path / str(k)), "p@1", "t").first() for k, x in enumerate((f, f.repartition(7)))]
    assert rows[0] == rows[1] and rows[0]["serial_number"].startswith("urn:uuid:") and rows[0]["n"] > 1 and export.whole(spark, str(tmp_path / "0"))
    at = next((tmp_path / "0" / "components").glob("*.txt"))
    at.write_text(at.read_text().replace("crypto:", "crypt0:", 1))
    (tmp_path / "0" / "components" / f".{at.name}.crc").unlink(missing_ok=True)
    assert not export.whole(spark, str(tmp_path / "0"))


def test_addressed_and_redacted_nodes(spark):
    nodes = [("r", "", "INFERENCE", "top"), ("r", "0", "INFERENCE", "group web-1"), ("r", "0.0", "EVIDENCE", "SOURCE web-10"), ("r", "1", "INFERENCE", "bare"), ("r", "2", "INFERENCE", "deep"), ("r", "2.0", "INFERENCE", "x"), ("r", "2.0.0", "ASSUMPTION", "guess web-1"), ("q", "", "INFERENCE", "alone")]
    table = spark.createDataFrame([(*n, 0, 1.0, 1.0) for n in nodes], "root_id string, path string, kind string, label string, depth int, value double, weight double")
    out = evidence.addressed(table)
    got = {(r["root_id"], r["address"]): (r["tainted"], r["is_evidence"]) for r in out.collect()}
    assert got == {("r", "f"): (True, False), ("r", "f.0"): (False, False), ("r", "f.0.0"): (False, True), ("r", "f.1"): (False, True), ("r", "f.2"): (True, False), ("r", "f.2.0"): (True, False), ("r", "f.2.0.0"): (True, True), ("q", "f"): (False, True)}
    hidden = spark.createDataFrame([("web-1",), ("web-10",)], "name string")
    assert {r["label"] for r in evidence.redacted_nodes(out, hidden).collect()} >= {"group (out of scope)", "SOURCE (out of scope)", "guess (out of scope)"}
    assert sorted(r["label"] for r in evidence.redacted_nodes(out, hidden.limit(0)).collect()) == sorted(n[3] for n in nodes)
