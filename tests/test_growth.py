"""What large tables need of a plan: one pass over the input, dealt over the cores, and nothing that one task gathers."""

import pandas as pd
from pyspark.sql import functions as F

from estatelens import queries, source_queries
from estatelens.operators import evidence, ledger
from estatelens.plans import commands
from estatelens.sources import binaries, calls, rules

PROGRAM = source_queries._PROGRAMS[0][1]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_handed_on_in_large_frames():
    files = pd.DataFrame({"path": [f"d{k}/x.so" for k in range(500)], "content": [PROGRAM] * 500})
    frames = list(binaries._observe(iter([files])))
    assert len(frames) == 1 and frames[0]["path"].nunique() == 500


def test_made_files_are_dealt_over_the_cores(spark, tmp_path):
    spark.range(1000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    assert source_queries.files(spark, str(tmp_path), source_queries._PROGRAMS).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fingerprints_read_what_was_found_once(spark):
    files = spark.createDataFrame([("x.so", bytearray(PROGRAM)), ("y", bytearray(PROGRAM))], "path string, content binary")
    named = binaries.fingerprints(binaries.observed(files))
    assert plan(named).count("MapInPandas") == 1
    assert {tuple(r) for r in named.collect()} == {("x.so", "OpenSSL", "1.0.2k-fips"), ("y", "OpenSSL", "1.0.2k-fips")}


def test_all_strings_of_a_file_are_searched(spark):
    plain = b"".join(b"word%06d\0" % k for k in range(20_001)) + b"".join(b"md5 %06d\0" % k for k in range(401))
    body = plain + b"OpenSSL 3.0.2\0NSS  3.90\0OpenSSL 3.0.2\0\0" + "wolfSSL 5.6.3".encode("utf-16-le")
    found = binaries.observed(spark.createDataFrame([("y.bin", bytearray(body))], "path string, content binary"))
    assert {tuple(r) for r in binaries.fingerprints(found).collect()} == {("y.bin", "OpenSSL", "3.0.2"), ("y.bin", "NSS", "3.90"), ("y.bin", "wolfSSL", "5.6.3")}
    assert sorted(r["value"] for r in found.collect()) == sorted([f"md5 {k:06d}" for k in range(401)] + ["OpenSSL 3.0.2", "NSS  3.90", "wolfSSL 5.6.3"])


def test_strings_beyond_memory_are_told_once(monkeypatch):
    monkeypatch.setattr(binaries, "_HELD", 3)
    words = [f"md5 {k % 700}" for k in range(2000)]
    assert list(binaries.once(words[:3] * 2)) == words[:3]
    assert sorted(binaries.once(words)) == sorted(set(words))


def test_one_file_is_handed_on_in_several_frames(monkeypatch):
    body = b"".join(b"md5 %06d\0" % k for k in range(1000))
    for name, bound in (("_ROWS", 100), ("_CHARS", 1000)):
        with monkeypatch.context() as m:
            m.setattr(binaries, name, bound)
            frames = list(binaries._observe(iter([pd.DataFrame({"path": ["y"], "content": [body]})])))
        assert max(map(len, frames)) == 100 and pd.concat(frames)["value"].nunique() == 1000


def test_binary_findings_parse_each_file_once(spark):
    needle = dict(binaries.needles())
    body = b"\0" * 64 + needle["sha1-h-le"] + b"\0" + needle["sha1-h"] + b"\0" + needle["sha1-h"] + b"\0" + needle["aes-sbox"]
    files = spark.createDataFrame([("x.so", bytearray(PROGRAM)), ("y.bin", bytearray(body))], "path string, content binary")
    found = binaries.binary_findings(files, "s")
    assert plan(found).count("MapInPandas") == 1 and "Exchange" not in plan(found)
    assert sorted((r["locator"], r["primitive"], r["raw"]) for r in found.collect()) == [
        ("x.so", "AES", "EVP_aes_128_cbc"), ("x.so", "RSA", "RSA_sign"), ("y.bin", "AES", "aes-sbox 1 hit(s)"), ("y.bin", "SHA1", "sha1-h 3 hit(s)")
    ]


def test_rules_are_broadcast_and_calls_are_not_shuffled_to_meet_them(spark):
    rows = spark.createDataFrame([("js", "x.seal", ["a"], {"bits": "128"}, "@acme/vault/node", True), ("js", "x.seal", ["a"], {}, "other", True)], "language string, callee string, args array<string>, kwargs map<string,string>, module string, gated boolean")
    found = rules.with_rules(rows, rules.rule_table(spark, source_queries._OWN_RULES))
    assert plan(found).count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan(found)
    assert [(r["module"], r["primitive"]) for r in found.collect()] == [("@acme/vault/node", "AES")]


def test_sources_are_read_and_handed_on_as_arrow(spark):
    rows = [("a.ts", "import * as c from 'crypto';\nc.f('x', a + 1, { k: 'v' });\n"), ("b.py", "def ("), ("c.go", None), ("d.txt", "f()")]
    found = calls.calls(spark.createDataFrame(rows, "path string, text string"))
    assert "MapInArrow" in plan(found) and "MapInPandas" not in plan(found)
    assert sorted((r["path"], r["line"], r["callee"], r["args"], r["kwargs"], r["module"], r["problem"]) for r in found.collect()) == [
        ("a.ts", 2, "c.f", ["x", None, None], {"k": "v"}, "crypto", None), ("b.py", None, None, None, None, None, "does not parse")
    ]


def test_names_of_modules_are_read_only_where_they_are_asked_for(spark, monkeypatch):
    monkeypatch.setattr(calls, "exports_of", None)
    files = spark.createDataFrame([("a.ts", "export function f() { g(); }")], "path string, text string")
    assert [r["callee"] for r in calls.calls(files).collect()] == ["f", "g"]


def test_imports_are_searched_once_for_modules_and_new_names(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.searches = pattern, 0

        def finditer(self, text):
            self.searches += 1
            return self.pattern.finditer(text)

    counted = Counted(calls._IMPORTS["js"])
    monkeypatch.setitem(calls._IMPORTS, "js", counted)
    assert [x[2:6:3] for x in calls.resolved_calls("import { createHash as h } from 'crypto'; h('md5');", "js")] == [("createHash", "crypto")]
    assert counted.searches == 1


def test_made_files_of_a_task_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_queries, "FILES", 10, raising=False)
    spark.range(1000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    assert source_queries.files(spark, str(tmp_path), source_queries._NOTED).rdd.getNumPartitions() >= 100


def test_python_sources_are_parsed_once(monkeypatch):
    seen = []
    monkeypatch.setattr(calls, "python_calls", lambda text: seen.append(text) or binaries.python_calls(text))
    found, imports = calls.resolved("import hashlib as hl\nhl.md5(b'')\n", "python")
    assert len(seen) == 1 and [x[2] for x in found] == ["hashlib.md5"] and imports == [("hl", "hashlib")]


def test_ingests_write_parts_of_occurrences_that_were_made_once(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id as l_orderkey", "id % 200 as l_partkey", "id % 10 as l_suppkey", "cast(id % 7 as int) as l_linenumber", "'R' as l_returnflag", "'F' as l_linestatus", "date'2020-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    plans, ingest = [], ledger.ingest
    monkeypatch.setattr(ledger, "ingest", lambda s, root, scan, tables: plans.extend(map(plan, (tables["occurrences"], tables["assets"]))) or ingest(s, root, scan, tables))
    queries.QUERIES["b4_after_ingests"](spark, str(tmp_path)).collect()
    assert len(plans) == 8 and not any("lineitem.parquet" in p for p in plans)


def _findings(spark):
    rows = [(f"s{k % 2}", "RSA", "{}", "DIGITAL_SIGNATURE", "SELF", ("SOURCE_AST", "DEPENDENCY")[k % 2], f"f{k}:1", "r", None if k % 5 else "guess") for k in range(40)]
    return evidence.identified(spark.createDataFrame([*rows, (None, *rows[0][1:])], "system_id string, primitive string, parameters string, purpose string, control_class string, modality string, locator string, raw string, assumption string"))


def _hashed_for_each_finding(df) -> bool:
    """Whether ids are hashed in the pass that reads locators."""
    return any("sha2" in line and "locator" in line for line in plan(df).splitlines())


def test_cited_rows_are_not_hashed_one_by_one(spark):
    found = _findings(spark)
    cited = evidence.cited(found)
    assert not _hashed_for_each_finding(cited)
    best = found.groupBy("occurrence_id").count()
    assert {r["occurrence_id"] for r in cited.collect()} == {r["occurrence_id"] for r in best.collect()}


def test_addressed_makes_its_nodes_once(spark):
    nodes = evidence.addressed(evidence.factor_nodes(_findings(spark)))
    assert "Window" not in plan(nodes) and nodes.filter("tainted and address = 'f'").count() >= 1


def test_one_occurrence_is_found_without_hashing_each_finding(spark):
    found = _findings(spark)
    for one in (r["occurrence_id"] for r in found.select("occurrence_id").distinct().collect()):
        part = evidence.of_occurrence(found, one)
        assert part.count() == found.filter(F.col("occurrence_id") == one).count() > 0


def test_a_tree_is_parsed_once_for_all_detectors(spark):
    tree = spark.createDataFrame([("a.ts", 40, bytearray(b"import * as c from 'crypto';\nc.createHash('md5');\n")), ("b.py", 5, bytearray(b"def ("))], "path string, length long, content binary")
    found, skipped = commands.collect(tree, "s", with_binaries=False)
    assert plan(found).count("MapInPandas") == 1 and "MapInPandas" not in plan(skipped)  # the one is for certificates
    assert found.count() == 1 and skipped.count() == 1
