from __future__ import annotations

import corpus_pipeline as cp
from tracefold.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER), "test-stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] < counts[0]
    out = cp.STAGES[-1][1](spark, docs, FOLDER)
    assert out.where("copies * size > 2 * size OR copies < 1").count() == 0
    assert cp.run(spark, FOLDER).count() == out.count()


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, FOLDER), "test-empty")
        assert docs.count() == 0


def test_stages_of_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties and repeated rows, and extra columns called like those that stages make."""
    long = " ".join(f"word{i % 977} part{i}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (4, long), (5, long + " end"), (None, "no key here at all"), (6, "line one of two\nline two of two"), (6, "line one of two\nline two of two")]
    extra = {"n_removed": 7, "size": 8, "h": 9, "_k": 10, "component": 11}
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in extra)
    docs = spark.createDataFrame([(k, t, None, "s" if k and k % 2 else None, None if k == 2 else len(t or ""), *extra.values()) for k, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i", None), (None, "x"), ("j", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, kept = [], docs
    for name, stage in cp.STAGES[:-1]:
        kept = stored(stage(spark, kept, str(tmp_path)), "test-odd")
        assert kept.columns == docs.columns, name
        assert kept.where("n_removed <> 7 OR size <> 8 OR component <> 11").count() == 0, name
        seen.append(kept.count())
    assert seen[:2] == [9, 9] and seen[2] == 6 and seen[3] == 6  # 1, 2, 3, 4, 6 and the row without a key
    out = cp.STAGES[-1][1](spark, kept, str(tmp_path))
    assert len(set(out.columns)) == len(out.columns) and out.where("copies * size > 2 * size").count() == 0
