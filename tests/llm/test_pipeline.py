"""The pipeline's stages on a small corpus, each against what brute force leaves of its input."""

import pytest

import corpus_pipeline
from platewise.llm import decontaminate


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random

    rng = random.Random(2)
    stems = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(stems, k=n))
    item, text = prose(30), prose(100)
    docs = {1: text, 2: text, 3: text.replace(text.split()[50], "zzz", 1), 4: prose(120), 5: prose(60) + " " + item + " " + prose(60), 6: " ".join(w + "***" for w in prose(100).split()), 7: "short", 8: None, 9: prose(90) + " a@b.cd " + prose(20)}
    good = {20 + k: prose(300) for k in range(60)}
    docs |= good
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, set(good)


def test_stages(spark, corpus):
    folder, good = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert left == [{1, 2, 3, 4, 5, 9} | good, {1, 4, 5, 9} | good, {1, 4, 9} | good, {1, 4, 9} | good]
    assert "[EMAIL]" in docs.where("doc_id = 9").first().text


def test_run_packs_what_is_left(spark, corpus):
    folder, good = corpus
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == {1, 4, 9} | good
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "personal data", "packing"]
    assert decontaminate.PERCENT == 20


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, score string, _row string"


@pytest.mark.parametrize("empty", [False, True])
def test_stages_bear_odd_rows(spark, corpus, empty):
    folder, _ = corpus
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "the same text"), (3, "the same text"), (4, long), (5, long), (None, long + " more"), (6, "\n \t")]
    docs = spark.createDataFrame([] if empty else [(i, t, "en", None, None, "x", "y", "z", "w") for i, t in rows], ODD_SCHEMA)
    left = [0, 5, 8, 8] if not empty else [0] * 4
    for (_, stage), n in zip(corpus_pipeline.STAGES[1:-1], left[1:]):
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns and (found.count() == n or not empty and stage is corpus_pipeline.near_dedup_stage)
    kept = corpus_pipeline.near_dedup_stage(spark, docs, folder).collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == ([] if empty else [1, 2, 3, 4, 6])
    good = corpus_pipeline.quality_rules(spark, docs, folder)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} <= {4, 5, None}
    pieces = corpus_pipeline.packed(spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == (set() if empty else {i for i, _ in rows})


def test_entry_lists_operators():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in known) for n in range(1, 11)) and "pipeline" in known
    assert set(__spark_entry__.oracle_sql()) <= set(known)
