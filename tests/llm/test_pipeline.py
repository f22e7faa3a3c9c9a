import corpus_pipeline
from llm import plain
from viewtide.llm import decontaminate, minhash, quality, secret_scan

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").distinct().collect())


def test_stages_by_the_operators(spark):
    """Each stage against its operator's decisions on what the stage before kept."""
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "near dedup", "decontamination", "secret scan", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    steps, columns = dict(corpus_pipeline.STAGES), docs.columns
    one = steps["quality rules"](spark, docs, SF).cache()
    assert one.columns == columns and ids(one) == ids(quality.quality(docs).where("kept"))
    two = steps["near dedup"](spark, one, SF).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert two.columns == columns and ids(two) == sorted(set(plain.components(rows, 5).values()))
    three = steps["decontamination"](spark, two, SF).cache()
    gone = ids(decontaminate.leaks(two, bench))
    assert three.columns == columns and ids(three) == sorted(set(ids(two)) - set(gone))
    four = steps["secret scan"](spark, three, SF).cache()
    assert four.columns == columns and ids(four) == ids(three)
    assert not any(plain.secret_spans(r.text) for r in four.collect())
    assert secret_scan.secrets(three).where("n_assign + n_access + n_hex > 0").count() == four.join(
        three.withColumnRenamed("text", "before"), "doc_id").where("text <> before").count()
    five = steps["packing"](spark, four, SF)
    assert ids(five) == ids(four)


def test_run_and_edges(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    rows = [(None, None), (None, ""), (1, None), (1, None), (2, "")]
    docs = plain.documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() == {"quality rules": 0, "near dedup": 4}.get(name, 5)


def test_different_texts_of_one_id_stay(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (3, a + " more"), (5, c), (5, c + " more"), (7, c + " than"), (8, "d e f"), (8, None), (8, ""), (None, a)]
    out = minhash.distinct_documents(plain.documents(spark, rows))
    left = sorted((str(r.doc_id), r.text or "") for r in out.collect())
    of_c = [x for x in left if x[1][:2] == "c0"]
    assert len(of_c) == 1 and of_c[0][0] == "5"
    assert [x for x in left if x not in of_c] == [("3", a + " more"), ("5", b), ("8", ""), ("8", "d e f"), ("None", a)]


def test_minhash_default_is_five_words():
    assert (minhash.SHINGLE, minhash.PERCENT) == (5, 80)
