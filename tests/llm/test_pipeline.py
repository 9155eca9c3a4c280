"""The pipeline's stages, each against brute force on what its predecessor kept."""

from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from estatelens.llm import secret_scan
from tests.llm.conftest import edge_rows, make
from tests.llm.test_operators import brute_print, roots


def test_stages(spark, tmp_path):
    docs = make(spark, edge_rows())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, str(tmp_path))
        out = str(tmp_path / name)
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = (before, docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == before[0].__fields__
    text = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    before, after = seen["quality_rules"]
    assert not text(after) - text(before) and all(len((r["text"] or "").split()) >= 20 for r in after) and len(after) > 20
    before, after = seen["exact_dedup"]
    assert Counter("".join(r["text"].split()) for r in after) == Counter({"".join(r["text"].split()) for r in before})
    before, after = seen["simhash_near_dedup"]
    prints = [brute_print(r["text"]) for r in before]
    top = roots(len(before), [(a, b) for a in range(len(before)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert len(after) == len(set(top)) and not text(after) - text(before)
    before, after = seen["secret_scan"]
    model = secret_scan.default_model(public_tokenizers.path("byte_bpe_50k.json"))
    assert text(after) == Counter((r["doc_id"], secret_scan.redacted(r["text"], r["source"], model)) for r in before)
    before, after = seen["best_fit_packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    bins = defaultdict(int)
    for r in after:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 2048


def test_run_equals_the_stages(spark, tmp_path):
    make(spark, edge_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
