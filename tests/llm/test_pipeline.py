"""The pipeline at the smallest scale, stage by stage."""

from collections import defaultdict

import corpus_pipeline
from brookcal.llm import mixing, queries, token_files
from tests.llm.test_matching import brute_components, brute_contamination, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, tmp_path):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "token_files":
            assert docs.columns == documents.columns
    rows = {k: v.collect() for k, v in kept.items()}
    # near duplicates: exactly the smallest id of each group of what the first stage left
    before = sorted(rows["toxicity"], key=lambda r: r["doc_id"])
    label = brute_components([brute_fingerprint(r["text"]) for r in before], 4)
    assert sorted(r["doc_id"] for r in rows["near_duplicates"]) == sorted({before[i]["doc_id"] for i in label.values()})
    # contamination: clean documents stay as they are, none of the others keeps a window
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").collect()]
    after = {r["doc_id"]: r["text"] for r in rows["decontamination"]}
    for r in rows["near_duplicates"]:
        n, hits, _ = brute_contamination(r["text"], items)
        if not hits:
            assert after[r["doc_id"]] == r["text"]
        elif 2 * hits <= n:
            assert after[r["doc_id"]] != r["text"]
        else:
            assert r["doc_id"] not in after
    # mix and files: every copy is written
    assert sorted(r["doc_id"] for r in rows["mixing"]) == [r["doc_id"] for r in sorted(rows["token_files"], key=lambda r: r["start"])]
    assert {r["doc_id"] for r in rows["mixing"]} <= after.keys()


def test_run_returns_the_index(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_token_files_keep_the_training_order(spark, documents, tmp_path, monkeypatch):
    """Read in order, the files give the documents as the curriculum places them."""
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    corpus_pipeline.mix_sources(spark, documents, SF).write.parquet(f"{tmp_path}/mixed")
    docs = spark.read.parquet(f"{tmp_path}/mixed")
    assert len(docs.inputFiles()) > 1
    index = sorted(corpus_pipeline.write_tokens(spark, docs, SF).collect(), key=lambda r: r["start"])
    times = defaultdict(list)
    for r in mixing.plan_mix(documents).collect():
        times[r["doc_id"]] += r["positions"]
    left = {d: iter(sorted(x)) for d, x in times.items()}
    rows = token_files.read_in_order(spark, f"{tmp_path}/tokens").collect()
    assert [r["position"] for r in rows] == list(range(sum(map(len, times.values()))))
    reached = [next(left[r["doc_id"]]) for r in rows]
    assert reached == sorted(reached)
    assert sorted(tuple(r)[1:] for r in rows) == sorted(map(tuple, index))
    assert [r["doc_id"] for r in rows] != [r["doc_id"] for r in index]
