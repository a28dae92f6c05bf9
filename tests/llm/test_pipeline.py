"""The pipeline's stages, each on what the one before kept, against what each must do."""

import corpus_pipeline as P
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    home, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (name, f) in enumerate(P.STAGES):
        before = docs
        f(spark, docs, SF).write.parquet(f"{home}/{i}")
        docs = spark.read.parquet(f"{home}/{i}")
        out.append((name, before, docs))
    return out


def test_stages(spark, stages):
    from test_operators import brute_classes

    assert [n for n, _, _ in stages] == ["quality classifier", "minhash near-dedup", "substring dedup", "benchmark decontamination", "mixing sources"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    known = [(d, q) for d, q in labels.items()]
    assert sum((d in kept) == (q == 1) for d, q in known) >= 0.9 * len(known)
    _, before, after = stages[1]
    classes = brute_classes([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in classes})
    _, before, after = stages[2]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    _, before, after = stages[4]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()} and {"copy", "shuffle_key"} < set(after.columns)


def test_run_is_the_stages(spark, stages):
    run = P.run(spark, SF)
    assert sorted((r.doc_id, r.copy, r.text) for r in run.collect()) == sorted((r.doc_id, r.copy, r.text) for r in stages[-1][2].collect())
