"""Nulls in any column, repeated rows and empty tables have a defined result."""

import pytest
from pyspark.sql import functions as F

from skein.llm import p6_unsafe as p6
from skein.llm.p1_forms import look_classes, same_look, with_form
from skein.llm.p2_near import near_copies, near_groups
from skein.llm.p3_types import typed
from skein.llm.p4_copies import copies
from skein.llm.p5_overlap import overlaps
from skein.llm.p7_tokens import token_ids, token_joins
from skein.llm.p8_mix import mix
from skein.llm.p9_sentences import units

TEXT = "an owl sat on the old stone wall by the quiet river at dusk"
ROWS = [
    ("prompts", 1, TEXT, True), ("prompts", 2, TEXT.replace("dusk", "dawn"), None), ("prompts", 2, TEXT.replace("dusk", "dawn"), None), ("prompts", 3, TEXT.upper(), False),
    ("prompts", None, TEXT, True), (None, 5, TEXT, False), ("prompts", 6, None, None), (None, None, None, None), ("prompts", 7, "", True),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "tab string, id bigint, text string, held boolean").withColumn("k_hi", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("n", F.lit(None).cast("int"))


def test_pairs_name_rows_with_ids_only(rows):
    assert {(r.id_a, r.id_b) for r in near_copies(rows).collect()} == {(1, 2), (2, 3)}
    assert {(r.id_a, r.id_b) for r in copies(rows).collect()} == {(1, 3)}
    assert {(r.id_a, r.id_b) for r in overlaps(rows).collect()} == {(1, 2), (1, 3)}
    assert same_look(rows).count() == 0
    assert {(r.id, r.group_id, r.links) for r in near_groups(rows).collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 1)}
    assert {r.id: r.rows for r in look_classes(rows).collect()} == {1: 1, 2: 2, 3: 1}


def test_rows_are_kept_where_each_has_its_result(spark, rows):
    assert with_form(rows).count() == len(ROWS)
    common = spark.createDataFrame([(None, None), ("en", "the")], "lang string, word string")
    got = typed(rows, common)
    assert got.count() == len(ROWS) and got.where("type is null").count() == 3
    labels = spark.createDataFrame([(None, 1, 1, None), ("prompts", None, None, "a"), ("prompts", 1, 1, "a"), ("prompts", 3, 0, None)], "tab string, row_id bigint, unsafe int, rater string")
    flags = spark.createDataFrame([(None, None, None), ("fool", None, None)], "term string, category string, weight int")
    assert p6.scored(rows, labels, flags).count() == len(ROWS)


def test_documents_with_nulls(spark):
    docs = spark.createDataFrame([(1, "One. Two.", "a"), (None, "Three here.", None), (3, None, "a"), (None, None, None), (3, "", "b")], "doc_id bigint, text string, source string")
    assert token_ids(docs).count() == token_joins(docs).count() == 5
    assert sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in units(docs).collect()) == [(0, 0, 11), (1, 0, 4), (1, 5, 9)]
    weights = spark.createDataFrame([("a", None, 1), ("b", 0.5, None), (None, 0.5, 1), ("a", 0.5, 2)], "source string, target_share double, max_repeats int")
    uses, shares = mix(docs, weights)
    assert {r.doc_id for r in uses.collect()} == {1, 3} and [r.source for r in shares.collect()] == ["a"]
