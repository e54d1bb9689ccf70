import os

import pytest

DATA = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, id int, text_kept string"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")
def test_pipeline_keeps_what_its_stages_keep(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        docs = out.cache()
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > kept[0] // 2
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")
def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    say = lambda k: " ".join(f"word{k}{c}" for c in "abcdefghijklmnop")
    rows = [(5, say(1)), (5, say(1)), (6, say(2)), (5, say(3)), (7, say(2)), (None, say(4)), (None, say(4)), (None, f"{say(5)} {item}"), (8, f"{say(6)} {item}"), (9, None), (10, ""), (11, "w " * 20_000), (None, None)]
    frame = spark.createDataFrame([(i, t, None, None, None, "k", 1, "x") for i, t in rows], KIND)
    of = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    text = lambda *which: sorted((str(rows[i][0]), rows[i][1] or "") for i in which)
    assert of(p.near_dedup(spark, frame, DATA)) == text(0, 2, 3, 5, 7, 8, 9, 10, 11, 12)
    assert of(p.decontamination(spark, frame, DATA)) == text(0, 1, 2, 3, 4, 5, 6, 9, 10, 11, 12)
    spoken = frame.withColumn("lang", frame.source).fillna({"lang": "xx"})
    assert of(p.language_id(spark, spoken, DATA)) == text(0, 1, 2, 3, 4, 5, 6, 7, 8, 11)
    assert of(p.line_dedup(spark, frame, DATA)) == sorted(text(0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12))
    assert p.encoding(spark, frame, DATA).count() == len(rows)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, frame.where("false"), DATA)
        assert out.columns == p.COLUMNS and out.count() == 0
