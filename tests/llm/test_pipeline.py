"""The pipeline's stages on rows with known copies, toxic words and benchmark passages; and registration."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(1)
    vocabulary = [f"v{i}" for i in range(3000)]
    prose = lambda k: " ".join(r.choices(vocabulary, k=k))
    item = prose(14)
    clean = [(i, "\n".join(prose(30) for _ in range(4))) for i in range(300)]
    toxic = [(1000 + i, f"{prose(40)} vile foul {prose(10)}") for i in range(60)]
    copies = [(2000, clean[5][1]), (2001, clean[6][1] + " v1")]
    leaked = [(3000, f"{prose(20)} {item} {prose(20)}")]
    odd = [(4000, None), (4001, ""), (None, prose(40))]
    rows = [(i, t, None, "s", len(t or "")) for i, t in [*clean, *toxic, *copies, *leaked, *odd]]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 1000)) for i in [*range(200), *range(1000, 1050)]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({x.doc_id for x in docs.collect()})
    everyone = {x[0] for x in rows}
    assert everyone - kept[0] == {i for i, _ in toxic}
    assert kept[0] - kept[1] == {2000, 2001}
    assert kept[2] == kept[1]
    assert kept[2] - kept[3] == {3000}
    assert kept[4] == kept[3] == {i for i, _ in clean} | {4000, 4001, None}
    assert docs.where("not round_trip").count() == 0


def test_near_dedup_stage_keeps_one_of_each_group(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (2, base + " x"), (3, "y " + base), (4, "another text"), (5, None)]
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    assert {x.doc_id for x in stage(spark, df, str(tmp_path)).collect()} == {1, 4, 5}


def test_near_dedup_stage_on_rows_that_repeat(spark, tmp_path):
    """An id's copies of one text leave one row, other texts and rows without words stay, batches without words don't matter."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (1, base), (2, base), (3, None), (3, None), (4, ""), (4, ""), (5, "a b c d"), (5, "e f g h"), (None, base), (None, base), (6, " ")]
    df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    got = sorted(((x.doc_id, x.text) for x in stage(spark, df, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, base), (3, None), (3, None), (4, ""), (4, ""), (5, "a b c d"), (5, "e f g h"), (None, base), (None, base), (6, " ")], key=str)
    for only in ([(1, None), (2, ""), (3, " ")], [("7", None)][:0]):
        df = spark.createDataFrame([(i, t, None, "s", 0) for i, t in only], "doc_id long, text string, lang string, source string, n_chars long")
        assert stage(spark, df, str(tmp_path)).count() == len(only)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_run_bounds_batches_and_puts_the_setting_back(spark, tmp_path, monkeypatch):
    setting, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(setting)

    def stage(spark, docs, sf_dir):
        seen.append(int(spark.conf.get(setting)))
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 1
    assert len(seen) == 2 and max(seen) <= 2000
    assert spark.conf.get(setting) == before
