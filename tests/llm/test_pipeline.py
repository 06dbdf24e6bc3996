"""The pipeline's stages on planted cases, and the registered corpus queries against their SQL."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from scorespark.llm import oracle, queries
from scorespark.session import stage


def plant(spark, folder):
    rng = random.Random(11)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    shared = text(70)
    rows = [(i, text(80), "en", f"s{i % 4}") for i in range(200)]
    base = rows[5][1].split()
    rows.append((300, rows[7][1], "en", "s0"))  # an exact copy
    rows.append((301, " ".join([*base[:40], "edit", *base[41:]]), "en", "s0"))  # a near copy
    rows += [(310 + i, f"{text(40)} {shared} {text(40)}", "en", "s1") for i in range(3)]  # a shared passage
    rows += [(400 + i, f"{text(20)} grumblefool {text(20)}", "en", "s2") for i in range(60)]  # toxic
    rows += [(500, None, None, None), (501, "", "en", "s0"), (None, text(9), "en", "s0")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i >= 400)) for i in [*range(0, 200, 2), *range(400, 445)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, shared


def test_stages_catch_what_is_planted(spark, tmp_path):
    rows, shared = plant(spark, str(tmp_path))
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(apply(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == before
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    everything = {r[0] for r in rows}
    assert ids["toxicity"] == everything - set(range(400, 460))
    assert ids["near_duplicates"] == ids["toxicity"] - {300, 301}
    assert ids["repeated_passages"] == ids["mixing"] == ids["tokens"] == ids["near_duplicates"]
    left = {r.doc_id: r for r in seen["repeated_passages"].collect()}
    assert shared in left[310].text and shared not in left[311].text and shared not in left[312].text
    assert left[0].text == rows[0][1] and all(r.n_chars == len(r.text) for r in left.values())
    assert seen["tokens"].count() == seen["mixing"].count() >= len(ids["mixing"])


def test_stages_take_empty_tables(spark, tmp_path):
    plant(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        docs = apply(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_an_id_on_several_texts_loses_only_the_copies(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    first, unique, other, near = text(60), text(60), text(60), text(60)
    edited = " ".join([*near.split()[:30], "edit", *near.split()[31:]])
    rows = [(1, first), (7, first), (7, unique), (7, other), (7, other.upper()), (7, near), (7, edited), (7, None), (7, ""), (7, ""),
            (8, unique), (9, text(60)), (None, first), (None, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert (7, first) not in out and (8, unique) not in out and (7, unique) in out
    assert sum(t in (other, other.upper()) for _, t in out) == sum(t in (near, edited) for _, t in out) == 1
    assert {(1, first), (7, None), (7, ""), rows[11]} <= set(out) and out.count((None, first)) == 2
    assert len(out) == 9


def test_cut_characters_go_and_a_texts_own_marks_stay(spark):
    rng = random.Random(13)
    passage = " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))
    # é and è, and 😀 and 😁, share first bytes; ć and ĉ and others share last ones: spans begin and end inside characters
    first, second = f"a\ufffd é{passage}\u0107 x", f"b\ufffd c\u0129{passage}\u0109\ufffd y"
    faces = "😀" + passage[::-1] + "😀", "ab😁" + passage[::-1] + "😁z\ufffd"
    rows = list(enumerate([first, second, *faces]))
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    left = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, docs, "").collect()}
    assert [left[i].text for i in range(4)] == [first, "b\ufffd c\ufffd y", faces[0], "ab😁z\ufffd"]
    assert all(r.n_chars == len(r.text) for r in left.values())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    assert len(got)
    if name not in oracle.ORACLE:
        return  # held against brute force or a library in test_corpus.py
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM read_parquet('{sf}/{file}')")
    want = con.execute(oracle.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None)
                                  .itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
