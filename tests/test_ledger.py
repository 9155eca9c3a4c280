"""Ingests that happen whole or not at all."""

import pytest

from estatelens.operators import intake, ledger


def rows(spark, scan, ids):
    return spark.createDataFrame([(scan, i, f"a{i % 3}") for i in ids], "scan_id string, occurrence_id int, asset_id string")


def state(spark, root):
    read = lambda t: sorted(map(tuple, ledger.read(spark, root, t).collect()))
    return read("occurrences"), read("assets"), read("systems")


def put(spark, root, scan, ids, owner):
    table = rows(spark, scan, ids)
    systems = spark.createDataFrame([("shop", owner)], "system_name string, owner string")
    return ledger.ingest(spark, root, scan, {"occurrences": table, "assets": table.select("asset_id"), "systems": systems})


def test_ingests_replace_scans_and_keep_shared_rows(spark, tmp_path):
    root = str(tmp_path)
    assert ledger.version(spark, root) == 0 and ledger.read(spark, root, "assets") is None
    put(spark, root, "s1", [1, 2], "ann")
    before = state(spark, root)
    put(spark, root, "s1", [1, 2], "ann")
    assert state(spark, root) == before
    put(spark, root, "s2", [3, 4], "bob")
    put(spark, root, "s1", [5], "cid")
    occurrences, assets, systems = state(spark, root)
    assert [o[:2] for o in occurrences] == [("s1", 5), ("s2", 3), ("s2", 4)] and assets == [("a0",), ("a1",), ("a2",)] and systems == [("shop", "cid")]
    assert ledger.read(spark, root, "occurrences", "s2").count() == 2 and ledger.read(spark, root, "occurrences", number=1).count() == 2


@pytest.mark.parametrize("at", [0, 1, 2])
def test_a_kill_between_the_writes_changes_nothing(spark, tmp_path, monkeypatch, at):
    root = str(tmp_path)
    put(spark, root, "s1", [1, 2], "ann")
    before, seen = state(spark, root), []

    def dies(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if at == 2:
            m.setattr(ledger, "_commit", dies)
        else:
            named = ledger.uuid.uuid4

            def name():
                seen.append(1)
                return named() if len(seen) <= at else dies()

            m.setattr(ledger.uuid, "uuid4", name)
        with pytest.raises(RuntimeError):
            put(spark, root, "s1", [7], "eve")
    assert state(spark, root) == before
    put(spark, root, "s1", [7], "eve")
    assert [o[1] for o in state(spark, root)[0]] == [7]


def test_of_two_ingests_at_once_none_is_lost(spark, tmp_path, monkeypatch):
    root, commit, other = str(tmp_path), ledger._commit, []

    def first_another(*args):
        if not other:
            other.append(1)
            monkeypatch.setattr(ledger, "_commit", commit)
            put(spark, root, "s2", [9], "bob")
        return commit(*args)

    put(spark, root, "s0", [0], "ann")
    monkeypatch.setattr(ledger, "_commit", first_another)
    put(spark, root, "s1", [1], "eve")
    assert [o[:2] for o in state(spark, root)[0]] == [("s0", 0), ("s1", 1), ("s2", 9)]


def test_intake_lists_every_fault(spark, tmp_path):
    traces = ['{"spans": [{"spanId": "1", "service": "a"}]}', '{"resourceSpans": []}', '{"other": 1}', '{"spans": [{"spanId": "", "service": "a"}]}', "{", None, "[]", '{"spans": 5}']
    rows = spark.createDataFrame(list(enumerate(traces)), "k int, payload string")
    good, bad = intake.parted(intake.checked(rows, intake.TRACE, intake.trace_rules()), str(tmp_path / "t"))
    assert {r["k"] for r in good.collect()} == {0, 1}
    faults = {r["k"]: r["errors"] for r in bad.collect()}
    assert faults[2] == ["kind_unknown"] and faults[3] == ["span_without_id"] and faults[4] == faults[5] == faults[7] == ["unparseable"] and len(faults) == 6
    packs = spark.createDataFrame([('{"packId": "p", "crqcYear": 2035}',), ('{"packId": " ", "crqcYear": 1, "migrationYearsByControl": {"SELF": -1}}',)], "payload string")
    got = {r["p"]["packId"]: r["errors"] for r in intake.checked(packs, intake.PACK, intake.pack_rules()).collect()}
    assert got == {"p": [], " ": ["id_missing", "year_out_of_range", "migration_years_negative"]}
    none = intake.checked(rows.limit(0), intake.SCAN, intake.scan_rules(["p"]))
    good, bad = intake.parted(none, str(tmp_path / "none"))
    assert good.count() == bad.count() == 0
