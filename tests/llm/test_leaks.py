"""What decontamination removes: rows by their own text, short items, odd ids; the pipeline on odd tables."""

import random

import pytest

import corpus_pipeline as C
from rankboard.llm import decontamination

from .odd import empty, odd, words


def test_rows_are_judged_by_their_own_text(spark):
    rng = random.Random(21)
    item, clean = words(rng, 30), words(rng, 60)
    docs = [(None, "a " + item), (None, clean), (1, item + " b"), (1, clean), (1, clean), (2, None), (3, "")]
    d = spark.createDataFrame([(*r, "x", 7) for r in docs], "doc_id long, text string, longest string, item_id int")
    b = spark.createDataFrame([(0, item), (None, None)], "item_id long, text string")
    got = decontamination.decontaminate(d, b)
    assert got.columns == d.columns
    want = sorted(((i, t) for i, t in docs if not t or item not in t), key=str)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == want


def test_short_items_spare_clean_documents(spark):
    rng = random.Random(22)
    docs = [(0, "the " + words(rng, 40)), (1, "The"), (2, "the end"), (3, "see the end"), (4, "yes, no: maybe, so " + words(rng, 4)),
            (5, "yes no maybe so " + words(rng, 5))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(0, "the"), (1, "Yes no, maybe so")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.decontaminate(d, b).collect()} == {0, 3, 5}


@pytest.mark.parametrize("make", [odd, empty])
def test_pipeline_on_odd_tables(spark, scratch, make):
    make(spark).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    got = C.run(spark, scratch).collect()
    kept = {r.doc_id for r in got}
    if make is empty:
        assert not got
    else:   # one of the copies, the near copy gone, texts without a letter gone
        assert {0, 2, 4, 5, 22, 24, 25} <= kept and not kept & {12, 13, 17, 18, 19, 20, 21, 23}
