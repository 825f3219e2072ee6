from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frostline.llm import mixing, packing, quality
from frostline.llm.tokens import WordTokenizer

from .test_dedup import norm
from .test_near_dedup import brute
from .test_pack_shard_mix import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = before, docs.collect()

    before, after = seen["quality classifier"]
    net = quality.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if net.score(r.text.encode()) >= 0.3}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good - {r.doc_id for r in after}) <= 0.02 * len(good)

    before, after = seen["exact dedup"]
    best = {}
    for r in before:
        key = norm(r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert {r.doc_id for r in after} == {i for _, i in best.values()}

    before, after = seen["SimHash near-dedup"]
    before.sort(key=lambda r: r.doc_id)
    label = brute([r.text for r in before])
    assert {r.doc_id for r in after} == {before[k].doc_id for k in set(label)}

    before, after = seen["mixing sources to target weights"]
    copies = {r.doc_id: r.copies for r in mixing.mix_sizes(spark.createDataFrame(before)).collect()}
    assert Counter(r.doc_id for r in after) == {k: v for k, v in copies.items() if v}

    before, after = seen["best-fit packing"]
    check_packing(after, [(r.doc_id, r.text) for r in before], WordTokenizer(packing.default_tokenizer()))
    assert Counter(map(str, (tuple(sorted(r.asDict().items())) for r in after))).total() == corpus_pipeline.run(spark, SF).count()


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, None, None)]])
def test_stages_on_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.collect()
        docs = out if out.columns == docs.columns else docs


def test_stages_keep_columns_of_any_name(spark):
    names = ["_file", "_row", "_score", "_copies", "_n", "_size", "_doc", "_id", "_text"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    limits = [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
    assert limits == [spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")]


def test_many_rows_that_go_are_not_broadcast(spark, tmp_path):
    spark.range(50).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(str(tmp_path / "docs"))
    keyed = corpus_pipeline.row_key(spark.read.parquet(str(tmp_path / "docs")))
    found = keyed.selectExpr("_file", "_row", "_doc.doc_id % 3 > 0 AS kept")
    few, many = (corpus_pipeline._kept(keyed, found, most) for most in (1 << 20, 0))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() == 33
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (few, many)]
    assert "Broadcast" in plans[0] and "Broadcast" not in plans[1]
