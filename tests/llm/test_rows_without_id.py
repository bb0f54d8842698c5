"""Rows with a null id are documents of their own, after all others, in every operator that links or removes."""

import random

import pytest
from pyspark.sql import functions as F

from lodespark.llm import line_dedup, near_dedup, suffix_dedup, vector_links

NONE, SOME = [None, None, None], [None, 7, None]


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghiklmnoprstuw") for _ in range(r.randint(3, 9))) for _ in range(n))


def docs(spark, ids, texts):
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("ids", [NONE, SOME, [5, 7, None]])
def test_repeats_are_removed_from_rows_without_an_id(spark, ids):
    shared = passage(1, 80)
    texts = [passage(2, 20) + "|" + shared, shared + passage(3, 9), passage(4, 30) + "%" + shared]
    got = suffix_dedup.remove_repeats(docs(spark, ids, texts)).collect()
    assert sorted((r.doc_id, r.n_bytes) for r in got if r.doc_id is not None) == sorted((i, len(t)) for i, t in zip(ids, texts, strict=True) if i is not None)
    assert sorted(r.n_bytes for r in got) == sorted(map(len, texts)) and all(r.n_removed == len(shared) for r in got)
    lone = suffix_dedup.remove_repeats(docs(spark, NONE, [passage(k, 90) for k in (5, 6, 7)])).collect()
    assert len(lone) == 3 and not any(r.n_removed for r in lone)


@pytest.mark.parametrize(("ids", "component"), [(NONE, None), (SOME, 7), ([9, 7, None], 7)])
def test_near_copies_without_an_id_link(spark, ids, component):
    base = passage(8, 200)
    got = near_dedup.near_duplicates(docs(spark, [*ids, None], [base, base + " one more", "a " + base, passage(9, 200)])).collect()
    assert sorted((r.component_id is None, r.kept) for r in got) == sorted([(component is None, k) for k in (True, False, False)] + [(True, True)])
    assert [r.doc_id for r in got if r.kept and r.doc_id is not None] == ([7] if component else [])


@pytest.mark.parametrize(("ids", "component"), [(NONE, None), (SOME, 7)])
def test_vectors_without_an_id_link(spark, ids, component):
    rows = list(zip([*ids, None], [[1.0, 0.0], [1.0, 0.01], [1.0, 0.0], [0.0, 1.0]], [1, 1, 1, 1], strict=True))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    got = vector_links.link_vectors(df).collect()
    assert sorted(r.n_links for r in got) == [0, 2, 2, 2] and sum(r.kept for r in got) == 2
    assert {r.component_id for r in got if r.n_links} == {component}


@pytest.mark.parametrize("ids", [NONE, SOME])
def test_lines_of_rows_without_an_id(spark, ids):
    line = passage(10, 12)
    got = line_dedup.dedup_lines(docs(spark, ids, [line, line + "s", passage(11, 12) + "\n" + line])).collect()
    assert sum(r.n_removed for r in got) == 2 and sum(r.n_lines for r in got) == 4
    assert ids == NONE or [r.n_removed for r in got if r.doc_id == 7] == [0]


def test_ids_of_text_and_rows_without(spark):
    base = passage(12, 60)
    df = spark.createDataFrame([("b", base), ("a", base), (None, base), (None, "")], "doc_id string, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("None", "None", True), ("None", "a", False), ("a", "a", True), ("b", "a", False)]
    assert suffix_dedup.remove_repeats(df).where(F.col("n_removed") > 0).count() == 3
