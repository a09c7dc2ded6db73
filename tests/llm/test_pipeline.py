"""The pipeline's stages on a small table, each against plain Python on what it was given."""

import random
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline

from cinelake.llm import mixing, toxicity
from tests.llm.test_texts import classes, dropped_lines, rows, shingle_sets


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    corpus.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 7 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "line_dedup", "jaccard_join", "mixing", "byte_bpe"]
    first = stage["toxicity"](spark, docs, folder).cache()
    rejected = {x["doc_id"] for x in toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))).where("predicted = 1").collect()}
    assert {x["doc_id"] for x in first.collect()} == {x["doc_id"] for x in docs.collect()} - rejected
    second = stage["line_dedup"](spark, first, folder).cache()
    assert Counter((i, text) for i, _, _, text in dropped_lines(rows(first)).elements()) == Counter(rows(second))
    third = stage["jaccard_join"](spark, second, folder).cache()
    assert {x["doc_id"] for x in third.collect()} == {i for i, (_, root) in classes(shingle_sets(rows(second))).items() if i == root}
    fourth = stage["mixing"](spark, third, folder).cache()
    times = {x["doc_id"]: x["taken"] // x["size"] for x in mixing.mix(third).where("size > 0").collect()}
    assert Counter(x["doc_id"] for x in fourth.collect()) == Counter({k: n for k, n in times.items() if n})
    last = stage["byte_bpe"](spark, fourth, folder)
    assert Counter(rows(last)) == Counter(rows(fourth))
    for df in (first, second, third, fourth):
        assert df.columns == docs.columns


def test_near_copies_of_null_and_repeated_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(6)]
    docs = [
        (1, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (None, texts[1] + " end"), (5, texts[3]), (5, texts[0] + " end"), (5, texts[4]), (9, texts[4]), (7, texts[5]), (7, texts[5]),
        (None, None), (None, ""), (8, ""),
    ]
    found = Counter(rows(corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "")))
    assert found.pop((None, texts[1]), 0) + found.pop((None, texts[1] + " end"), 0) == 1
    assert found == Counter([(1, texts[0]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (7, texts[5]), (None, None), (None, ""), (8, "")])


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).where("n_tokens > 0").count() > 0


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_stages_on_odd_tables(spark, request, tmp_path, table):
    """Nulls, empty and long texts, ties, repeated rows and clashing names: every stage keeps what it should."""
    docs = request.getfixturevalue(table)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    first = stage["toxicity"](spark, docs, str(tmp_path)).cache()
    assert Counter(map(tuple, first.collect())) == Counter(map(tuple, docs.collect()))
    second = stage["line_dedup"](spark, first, str(tmp_path)).cache()
    assert Counter(rows(second)) == Counter((i, text) for i, _, _, text in dropped_lines(rows(first)).elements())
    third = stage["jaccard_join"](spark, second, str(tmp_path)).cache()
    plain = sorted(rows(second), key=lambda x: 2**63 if x[0] is None else x[0])
    linked = classes(shingle_sets(enumerate(text for _, text in plain)))
    assert Counter(i for i, _ in rows(third)) == Counter(plain[k][0] for k, (_, root) in linked.items() if k == root)
    fourth = stage["mixing"](spark, third, str(tmp_path)).cache()
    assert fourth.count() == sum(x["taken"] // x["size"] for x in mixing.mix(third).where("size > 0").collect())
    assert all(df.columns == docs.columns for df in (first, second, third, fourth)) and (fourth.count() > 3 or table == "empty")
    assert Counter(rows(stage["byte_bpe"](spark, fourth, str(tmp_path)))) == Counter((i, text or "") for i, text in rows(fourth))
