import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from satzwerk.llm import quality
from satzwerk.llm.shared import saved
from tests.llm.test_minhash import brute as near
from tests.llm.test_suffixes import brute as repeats


def test_each_stage_works_on_what_the_last_one_kept(spark, docs, tmp_path):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(100, 1)], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    left = docs
    bands = quality.Bands()
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in left.collect()]
        left = saved(stage(spark, left, str(tmp_path)), name)
        after = left.collect()
        if name == "quality_rules":
            assert len(after) == sum(quality.measure(r[1], bands)[quality.KEPT] for r in before) > 20
        if name == "minhash_neardup":
            assert {r.doc_id for r in after} == {r[0] for r in near(before, 5, 80) if r[3]}
        if name == "suffix_dedup":
            sizes = {r[0]: r[1] - r[2] for r in repeats(before)}
            assert all(sizes[r.doc_id] - 8 <= len(r.text.encode()) <= sizes[r.doc_id] for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        if name != "byte_bpe":
            assert left.columns == docs.columns
    assert all(len(r.ids) == 4 * r.n_tokens for r in after)


def test_whole_run(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    assert corpus_pipeline.run(spark, folder).count() > 50
