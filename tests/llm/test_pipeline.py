"""The pipeline's stages on a small table, and its registration."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_hold_their_contract(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeiounrst") for _ in range(5))
    leak = " ".join(word() for _ in range(20))
    rows = []
    for i in range(240):
        words = [word() for _ in range(60)]
        if i % 6 == 0:
            words[5] = words[30] = "zorkhead"
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(300, rows[1][1], "en", "s", 0), (301, "clean " + leak, "en", "s", 0), (302, "say password=abcdef123456 now", "en", "s", 0), (303, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert not any(i % 6 == 0 for i in seen["toxicity"] if i < 240) and 303 in seen["toxicity"]
    assert 300 not in seen["jaccard"] and 1 in seen["jaccard"]
    assert leak not in seen["decontamination"][301].text and seen["decontamination"][1].text == rows[1][1]
    assert "abcdef123456" not in seen["secrets"][302].text
    assert seen["bpe"].keys() == seen["secrets"].keys() and all(len(r.ids) == r.n_tokens for r in seen["bpe"].values())


def test_stages_take_empty_tables_repeats_nulls_and_other_columns(spark, tmp_path):
    """Each stage keeps the columns, also those named like the operators' own; repeated rows stay one document."""
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("aeiounrst") for _ in range(5)) for _ in range(n))
    text = words(30)
    rows = [(7, text), (7, text), (3, text + " end"), (None, "x"), (None, None), (5, ""), (9, words(40))]
    schema = "doc_id long, text string, chunk long, key string, rid long, n_words int, ids array<int>, n_chars int"
    rows = [(i, t, 1, "k", 2, 3, [4], 0) for i, t in rows]
    spark.createDataFrame([(9, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for part in (rows, []):
        docs = spark.createDataFrame(part, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
            if name == "jaccard":
                assert got == sorted((i or 0, t or "") for i, t, *_ in part if i != 7)
            else:
                assert got == sorted((i or 0, t or "") for i, t, *_ in part)
        assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == len(part)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
