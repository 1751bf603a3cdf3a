"""The pipeline's stages, and what the entry registers."""

import random

import __spark_entry__ as E
import corpus_pipeline as C

from .odd import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _tables(spark, scratch):
    rng = random.Random(12)
    bench = [words(rng, 40) for _ in range(3)]
    line = words(rng, 20)
    body = words(rng, 80)
    near = body.split()
    near[40] = "edited"
    texts = [line + "\n" + words(rng, 50), line + "\n" + words(rng, 40), body, " ".join(near), line,
             words(rng, 30) + " " + bench[1] + " " + words(rng, 30), "12 34 ...", None, words(rng, 3000), "short one"]
    docs = [(i, t, "en" if i % 2 else "fr", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    return texts


def test_stages(spark, scratch):
    texts = _tables(spark, scratch)
    docs, kept = spark.read.parquet(f"{scratch}/documents.parquet"), []
    for name, stage in C.STAGES:
        docs = C.cut(stage(spark, docs, scratch), f"test_{name}")
        if name != "packing":
            assert docs.columns == COLUMNS
            kept.append({r.doc_id: r.text for r in docs.collect()})
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    told, lines, near, clean = kept
    assert set(told) == set(range(10)) - {6, 7}
    assert lines[0] == texts[0] and lines[1] == texts[1].split("\n")[1]
    assert 4 not in lines and 3 not in lines     # the line again; a line that resembles an earlier one
    assert set(near) == set(lines)
    assert set(clean) == set(near) - {5}
    assert {r.doc_id for r in docs.collect()} == set(clean)
    assert sorted(map(tuple, C.run(spark, scratch).drop("sequence_id", "offset").collect())) == sorted(
        map(tuple, docs.drop("sequence_id", "offset").collect()))


def test_line_stage_joins_the_text_once(spark, scratch):
    """What the lines' join shuffles holds each text once; a column of the document's own with an odd name stays."""
    texts = _tables(spark, scratch)
    docs = spark.read.parquet(f"{scratch}/documents.parquet").selectExpr("*", "doc_id AS _text")
    out = C.line_stage(spark, docs, scratch)
    plan = out._jdf.queryExecution().optimizedPlan()
    while not plan.nodeName().startswith("Join"):
        plan = plan.children().head()
    side = plan.children().head().output()
    strings = [side.apply(i).name() for i in range(side.size()) if side.apply(i).dataType().simpleString() == "string"]
    assert sorted(strings) == ["lang", "source", "text"]
    got = {r.doc_id: r for r in out.collect()}
    assert all(r._text == r.doc_id for r in got.values())
    assert got[7].text is None and got[7].n_chars is None and 4 not in got and got[2].n_chars == len(texts[2])


def test_near_stage_keeps_one_of_each_class(spark, scratch):
    rng = random.Random(3)
    body = words(rng, 100).split()
    docs = [(i, " ".join([*body[:i], f"e{i}", *body[i + 1:]])) for i in range(6)] + [(9, words(rng, 50)), (10, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in C.near_stage(spark, df, scratch).collect()} == {0, 9, 10}


def test_registered_queries():
    names = set(E.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and C.ORACLE_SQL is None
