import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein.llm.forms import FormConflict, Transducer, build_mapping, visible_form
from skein.llm.keys import copy_key, word_set, word_text
from skein.llm import p1_forms
from skein.llm.p1_forms import look_classes, same_look, with_form


@pytest.mark.parametrize(
    ("stored", "seen"),
    [
        ("ｆａｒｍｅｒ　Ｇ", "farmer G"), ("ｶﾞ", "ガ"), ("é", "é"), ("е́", "é"), ("ﬂat ﬁsh", "flat fish"), ("a​b­", "ab"), (" a ​\t b\n", "a b"),
        ("👩‍🎨", "👩‍🎨"), ("👩🎨", "👩🎨"), ("²", "²"), ("A a", "A a"), ("﻿‍ ", ""), ("ﺑ", "ب"), ("한", "한"), ("K", "K"), ("", ""), (None, None),
    ],
)
def test_visible_form(stored, seen):
    assert visible_form(stored) == seen


@given(st.text(max_size=60))
def test_form_is_stable_and_composed(text):
    form = visible_form(text)
    assert visible_form(form) == form
    assert form == " ".join(form.split())
    assert unicodedata.is_normalized("NFC", form) or any(unicodedata.combining(c) for c in form)


def test_mapping_has_no_conflict():
    image, blanks, hidden, _ = build_mapping()
    assert not (set(image) & (blanks | hidden))
    assert all(not set(to) & set(image) for to in image.values())


def test_conflicting_look_alikes_are_refused(monkeypatch):
    monkeypatch.setattr("skein.llm.forms.LOOK_ALIKES", "а a а b")
    with pytest.raises(FormConflict):
        Transducer()


def test_long_text():
    assert visible_form("Ｘ́ " * 200_000) == ("X́ " * 200_000).strip()


def test_copy_keys():
    labelled = ["subject: an owl | seed: 7", "Seed: 7\nSubject: An Owl", "seed=7; subject=an owl", '{"seed": "7", "subject": "an owl"}']
    assert len({copy_key(x) for x in labelled}) == 1
    assert copy_key("an owl --ar 16:9 --seed 7") == copy_key("An  owl! --seed 7 --ar 16:9")
    assert copy_key("b a") != copy_key("a b")
    assert copy_key("МАЯК") == copy_key("маяк")
    assert copy_key("!!") == "" and copy_key(None) is None


def test_word_sets():
    assert word_set("The owl, the OWL") == {"the", "owl"}
    assert word_set("山中 owl") == {"山", "中", "owl"}
    assert word_text("को-बदल_2") == "को बदल 2"
    assert word_set(None) == set()


def test_same_look(make):
    rows = make([(1, "owl"), (2, "ｏｗｌ"), (3, "owl"), (4, "оwl"), (5, None), (6, " "), (7, "​"), (8, "Owl")])
    got = {(r.id_a, r.id_b) for r in same_look(rows).collect()}
    assert got == {(1, 2), (2, 3), (1, 4), (3, 4), (2, 4)}


def test_same_look_of_no_rows(make):
    assert same_look(make([])).count() == 0


def test_hot_form(make, monkeypatch):
    import skein.llm.records as records

    monkeypatch.setattr(records.salt_join, "__defaults__", (5, 4))
    got = same_look(make([(i, "owl") for i in range(40)] + [(100, "ｏｗｌ")]))
    assert sorted((r.id_a, r.id_b) for r in got.collect()) == [(i, 100) for i in range(40)]


def test_forms_of_rows(make):
    assert {r.id: r.form for r in with_form(make([(1, None), (2, "")])).collect()} == {1: None, 2: ""}


def test_variants_of_a_form_meet_in_blocks(make, monkeypatch):
    monkeypatch.setattr(p1_forms._variant_pairs, "__defaults__", (2,))
    stored = ["owl", "ｏｗｌ", "оwl", "owl\u200b", " owl", "o\u00adwl", "owl"]
    got = sorted((r.id_a, r.id_b) for r in same_look(make(list(enumerate(stored)))).collect())
    assert got == [(a, b) for a in range(7) for b in range(a + 1, 7) if stored[a] != stored[b]]


def test_classes_of_one_look(make):
    got = {r.id: (r.class_id, r.rows, r.variants) for r in look_classes(make([(4, "owl"), (2, "ｏｗｌ"), (3, "owl"), (5, "fox"), (6, None), (7, " ")])).collect()}
    assert got == {4: (2, 3, 2), 2: (2, 3, 2), 3: (2, 3, 2), 5: (5, 1, 1)}
    assert look_classes(make([])).count() == 0


def test_clusters_are_built_ahead():
    t = Transducer()
    assert t.clusters["e\u0301"] == t.clusters["е\u0301"] == "é" and visible_form("µ") == visible_form("μ")
    assert all(t.apply(to) == to for to in t.clusters.values())
