"""The pipeline against plain versions of its stages, and planted cases."""

import hashlib

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import plain_components, plain_cut, plain_hits, plain_quality, prose  # noqa: E402


def test_pipeline_matches_brute_force(spark, tmp_path):
    passage, bench = prose(70, 70), prose(71, 40)
    base = prose(72, 200)
    texts = [base, base, base.replace("alpha", "ALPHA"), " ".join(w if i % 70 else "edited" for i, w in enumerate(base.split())), prose(73, 60) + "\n" + passage, prose(74, 60) + "\n" + passage, prose(75, 50) + " " + bench + " " + prose(76, 50), "too short", None, "spam " * 60, prose(77, 90)]
    spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = {i: t for i, t in enumerate(texts) if not plain_quality(t)[5]}
    ids = sorted(kept)
    parts = plain_components([kept[i] for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if parts[k][2]}
    kept = dict(zip(sorted(kept), plain_cut([kept[i] for i in sorted(kept)]), strict=True))
    kept = {i: t for i, t in kept.items() if t.strip() and not plain_hits(t, [(1, bench)])[4]}
    assert {i: r.decoded_sha256 for i, r in found.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items()}
    assert set(kept) == {0, 4, 5, 10}


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, prose(i, 80), "en", "s", 1, "extra") for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long, ROW string")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "decontamination", "tokens"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 3 and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
