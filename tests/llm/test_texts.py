import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import p6_unsafe as p6
from skein.llm.p3_types import FUNCTIONS, STATS, TYPES, learn, statistics, typed, votes
from skein.llm.p7_tokens import concatenate, encoding, join, token_ids, token_joins
from skein.llm.p8_mix import Plan, mix, parts_of, pfair
from skein.llm.p9_sentences import learn as learn_sentences
from skein.llm.p9_sentences import sentences, units

PROSE = "The owl stands near a lamp, and the fox walks over the bridge in the rain."
TEXTS = {
    "list": "- red lamp\n- blue kite\n- old coin\n- tin box",
    "table": "name | size | loss\nowl | 12 | 0.5\nfox | 7 | 0.25\nhare | 9 | 0.125",
    "junk": "@#%^ <<>> ~~!! ]]{{ ++== ||&& $$%% ^^**",
    "prose": PROSE,
}


def test_types(make, spark):
    rows = [(i, f"{PROSE} No. {i}") for i in range(60)] + [(100 + i, TEXTS[t]) for i, t in enumerate(TYPES)] + [(200, None), (201, " "), (202, "lamp fox " * 50_000)]
    common = spark.createDataFrame([("en", "the"), ("en", "a"), ("en", None)], "lang string, word string")
    got = {r.id: r for r in typed(make(rows), common).collect()}
    assert [got[100 + i].type for i in range(4)] == list(TYPES)
    assert got[200].type is None and got[201].type is None and got[5].type == "prose"
    assert abs(sum(got[5][f"p_{t}"] for t in TYPES) - 1) < 1e-9
    assert typed(make([]), common).count() == 0


def test_expectation_maximisation_finds_rates():
    rnd = np.random.default_rng(1)
    truth = rnd.choice(4, 20_000, p=[0.85, 0.05, 0.05, 0.05])
    own = np.array([TYPES.index(t) for t, _ in FUNCTIONS])
    fired = rnd.random((len(truth), len(FUNCTIONS))) < np.where(own[None] == truth[:, None], 0.7, 0.02)
    patterns, counts = np.unique((fired << np.arange(len(FUNCTIONS))).sum(axis=1), return_counts=True)
    model = learn(patterns, counts.astype(float))
    told = dict(zip(patterns, model.posterior(patterns).argmax(axis=1)))
    assert np.mean([told[p] == t for p, t in zip((fired << np.arange(len(FUNCTIONS))).sum(axis=1), truth)]) > 0.9


def test_statistics_of_nothing():
    assert set(statistics(None, set())) == {0.0} and votes(statistics("", set())) >= 0


@given(st.lists(st.integers(-12, 12).map(lambda x: x / 4), max_size=25))
def test_segments_hold_the_best_sum(scores):
    found = p6.segments(scores)
    best = max((sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=0.0)
    assert max((s for *_, s in found), default=0.0) == pytest.approx(max(best, 0.0), abs=1e-9)
    assert all(s == pytest.approx(sum(scores[a:b]), abs=1e-9) and s > 0 for a, b, s in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_disguises():
    assert p6.tokens("1d10t sooooo p.a.t.h.e.t.i.c r o t t e n") == ["idiot", "so", "pathetic", "roten"]
    assert p6.tokens(None) == [] and p6.tokens(" ") == []


def test_unsafe_texts_are_found(make, spark):
    rnd = random.Random(2)
    base = "lamp kite coin river stone fox owl heron moss fern crane amber".split()
    bad = ["you are a rotten fool", "what a rotten stupid fool you are", "stupid fool go away you pest"]
    rows, labels = [], []
    for i in range(400):
        text = " ".join(rnd.choice(base) + rnd.choice(["", str(rnd.randint(0, 9))]) for _ in range(12))
        if i % 5 == 0:
            text += "; " + rnd.choice(bad)
        rows.append((i, text))
        if i < 300:
            labels.append(("prompts", i, int(i % 5 == 0) if rnd.random() > 0.03 else None))
    rows += [(900, None), (901, ""), (902, "lamp " * 30_000), (903, "lamp kite; y0u r.o.t.t.e.n f00l, s*upid pest")]
    lab = spark.createDataFrame(labels, "tab string, row_id bigint, unsafe int")
    flags = spark.createDataFrame([("fool", 2), (None, 1)], "term string, weight int")
    got = {r.id: r for r in p6.scored(make(rows), lab, flags).collect()}
    held = range(300, 400)
    assert np.mean([got[i].unsafe == (i % 5 == 0) for i in held]) > 0.95
    assert got[903].unsafe and not got[902].unsafe and got[900].score == 0 == got[901].score


def test_no_labels(make, spark):
    lab = spark.createDataFrame([], "tab string, row_id bigint, unsafe int")
    flags = spark.createDataFrame([("fool", 3)], "term string, weight int")
    assert p6.scored(make([(1, "an owl")]), lab, flags).count() == 1


PIECES = ["a", "b", "'", "s", " ", "\n", "1", "é", "中", "😀", "-", "'re", "  ", "<|endoftext|>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.integers(1, 9))
def test_joined_parts_equal_the_whole(parts, k):
    enc, text = encoding(), "".join(parts)
    pieces = [enc.encode_ordinary(text[i : i + k]) for i in range(0, len(text), k)]
    assert concatenate(enc, pieces) == enc.encode_ordinary(text)
    mid = len(text) // 2
    assert join(enc, enc.encode_ordinary(text[:mid]), enc.encode_ordinary(text[mid:]), 2, 1) == enc.encode_ordinary(text)


def test_token_ids(spark):
    long = "un split" * 100 + "x" * 500 + " <|endoftext|>"
    docs = spark.createDataFrame([(1, "An owl", 0), (2, None, 0), (3, "", 0), (4, long, 0), (4, long, 0)], "doc_id bigint, text string, ids int")
    got = [(r.doc_id, list(r.ids)) for r in token_ids(docs, piece=64).collect()]
    enc = encoding()
    assert sorted(got) == sorted([(1, enc.encode_ordinary("An owl")), (2, []), (3, []), (4, enc.encode_ordinary(long)), (4, enc.encode_ordinary(long))])
    assert 50256 not in got[0][1] and token_ids(docs.limit(0)).count() == 0


def test_ids_equal_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ["An owl's  nest\n\n 12", "山中 <|endoftext|> é​", " \t x"]:
        assert t.encode(text, add_special_tokens=False).ids == encoding().encode_ordinary(text)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=6))
def test_schedule_stays_within_a_block(sizes):
    from fractions import Fraction

    whole = sum(sizes)
    order = pfair([Fraction(x, whole) for x in sizes], whole)
    for i, x in enumerate(sizes):
        assert order.count(i) == x
        for at in range(whole + 1):
            assert abs(order[:at].count(i) - at * x / whole) < 1


def test_plan_respects_caps():
    plan = Plan([("a", 0.5, 1), ("b", 0.5, 2)], {"a": 900, "b": 100}, 1000, 10)
    assert plan.want == {"a": 500, "b": 200} and plan.slots == 70


def test_mix(spark):
    docs = spark.createDataFrame([(i, "an owl by the lamp " * (1 + i % 3), "a" if i % 4 else "b") for i in range(80)] + [(900, None, "a"), (901, "", "b"), (902, "x", None)], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    uses, shares = mix(docs, weights, block=20)
    u = {r.doc_id: r for r in uses.collect()}
    s = {r.source: r for r in shares.collect()}
    assert 902 not in u and all(r.uses <= {"a": 1, "b": 3}[r.source] and len(r.slots) == r.uses for r in u.values())
    assert s["none"].tokens == 0
    for name in "ab":
        assert s[name].tokens == sum(r.n_tokens * r.uses for r in u.values() if r.source == name)
        assert abs(s[name].tokens - s[name].target_tokens) <= 20
    assert mix(docs.limit(0), weights)[0].count() == 0


def cut(text):
    return [text[a:b] for a, b in sentences(text, frozenset(["安静", "高い"]))]


@pytest.mark.parametrize(
    ("text", "units_"),
    [
        ("Dr. Owl met 3.5 foxes. They ran!", ["Dr. Owl met 3.5 foxes.", "They ran!"]),
        ('He asked "why now?" and left. "It works. It does." Done.', ['He asked "why now?" and left.', '"It works. It does."', "Done."]),
        ("# Head\n\n- one\n- two. three\n\nA line\nbroken here.", ["# Head", "- one", "- two. three", "A line\nbroken here."]),
        ("河流。「山中。」安静的河……安静的山", ["河流。", "「山中。」", "安静的河……", "安静的山"]),
        ("ว่าวสี ภาพที่ 12 สอง", ["ว่าวสี", "ภาพที่ 12 สอง"]),
        ("Es ist so... und weiter. Z. B. Anna.", ["Es ist so... und weiter.", "Z. B. Anna."]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["| a | b |", "|---|---|", "| 1 | 2 |"]),
        ("[10:02:03] step 1 ok\n[10:02:04] step 2. Done", ["[10:02:03] step 1 ok", "[10:02:04] step 2. Done"]),
        (None, []), ("", []), (" \n ​", []),
    ],
)
def test_sentences(text, units_):
    assert cut(text) == units_


@given(st.text(alphabet="aB .!?\n\"(«»中。|-1", max_size=80))
def test_units_cover_all_that_is_visible(text):
    got = sentences(text)
    assert all(a < b and text[a:b].strip() == text[a:b] for a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    inside = {i for a, b in got for i in range(a, b)}
    assert all(i in inside for i, c in enumerate(text) if not c.isspace())


def test_units_of_rows(spark):
    docs = spark.createDataFrame([(1, "One. Two.", 5), (2, None, 5), (3, "x. Y " * 20_000, 5)], "doc_id bigint, text string, start_pos int")
    got = units(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got} == {1, 3} and {r.doc_id: r["count"] for r in got}[1] == 2
    assert units(docs.limit(0)).count() == 0


def test_long_texts_are_joined(spark):
    long = "ein un split" * 400 + "x" * 5_000 + " <|endoftext|>" + "山川é \n\n" * 900
    docs = spark.createDataFrame([(1, "An owl"), (2, None), (3, ""), (4, long)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_tokens, r.joins) for r in token_joins(docs).collect()}
    assert got[4][0] == len(encoding().encode_ordinary(long)) and got[4][1] >= len(long) // 1_000 and got[1][1] == got[2][1] == got[3][0] == 0


@pytest.mark.parametrize(
    "inside",
    ['"One runs on. Two stops. Three sits."', "(One runs on. Two stops. Three sits.)", "„Eins läuft. Zwei steht. Drei sitzt.“", "« Un court. Deux reste. Trois dort. »", "“One runs. Two stops! Three sits?”"],
)
def test_quotations_do_not_cut_their_sentence(inside):
    assert cut(f"He wrote {inside} and left. Then it ended.") == [f"He wrote {inside} and left.", "Then it ended."]


def test_marks_without_partner_hold_nothing_together():
    assert cut('A 5" pipe is long. It leaks. He said "no.') == ['A 5" pipe is long.', "It leaks.", 'He said "no.']


def test_sentences_far_apart(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(900))
    assert len(cut(text)) == 900 and len(cut(text.replace(".", ","))) == 1


def test_lengths_and_words_are_learned(spark):
    docs = spark.createDataFrame([(i, f"Xyzw. also met it, see xyzw. here {i}.\n\nThe owl ran over the hill.\n\n安静的河流很长。") for i in range(40)], "doc_id bigint, text string")
    got = learn_sentences(docs)
    assert "xyzw" in got.abbreviations and "安静" in got.openings and got.lengths[0][0] == pytest.approx(math.log(27), abs=0.3)


def test_a_text_with_a_short_list_is_prose(make, spark):
    rows = [(i, f"{PROSE} No. {i}") for i in range(60)] + [(100, PROSE * 4 + "\n- red lamp\n- blue kite")] + [(200 + i, TEXTS["list"] + f"\n- cup {i}") for i in range(5)]
    common = spark.createDataFrame([("en", "the"), ("zh", "的")], "lang string, word string")
    got = {r.id: r.type for r in typed(make(rows), common).collect()}
    assert got[100] == "prose" and got[200] == "list"
    assert dict(zip(STATS, statistics("我的河的山", {"的"})))["common_share"] == pytest.approx(0.4)


def test_passages_are_given(make, spark):
    rows = [(i, f"lamp kite coin {i} river stone" + ("; you are a rotten fool" if i % 4 == 0 else "")) for i in range(200)] + [(900, None)]
    lab = spark.createDataFrame([("prompts", i, int(i % 4 == 0)) for i in range(150)], "tab string, row_id bigint, unsafe int")
    flags = spark.createDataFrame([("fool", 2)], "term string, weight int")
    got = p6.passages(make(rows), lab, flags).collect()
    scores = {r.id: r for r in p6.scored(make(rows), lab, flags).collect()}
    assert {r.id for r in got} == {i for i, r in scores.items() if r.unsafe} and all(0 <= r.first < r.last and "fol" in r.passage for r in got)  # repeated letters are read as one
    assert p6.passages(make([]), lab, flags).count() == 0


def test_wide_tables_have_cells():
    stats = dict(zip(STATS, statistics("ｎａｍｅ，ｓｉｚｅ，ｌｏｓｓ\nｏｗｌ，１２，７\nｆｏｘ，８，９\nｈａｒｅ，５，３", set())))
    assert stats["cell_share"] == 1.0 and stats["n_cells"] == 3 and stats["number_share"] > 0.4
    tabs = dict(zip(STATS, statistics("é\tb\nc\t d\ne\tf", set())))
    assert tabs["n_cells"] == 2


@given(st.lists(st.integers(1, 900), min_size=1, max_size=5))
def test_a_long_mix_repeats_its_schedule(sizes):
    whole = sum(sizes)
    plan = Plan([(str(i), x / whole, 1) for i, x in enumerate(sizes)], {str(i): x for i, x in enumerate(sizes)}, whole, 1, most=40)
    slots = {s: [plan.slot(s, k) for k in range(plan.want[s])] for s in plan.names if plan.want[s]}
    taken = [x for s in slots.values() for x in s]
    assert len(set(taken)) == len(taken) and all(s == sorted(s) for s in slots.values())
    assert all(plan.slot_of[s] for s in slots)
    if plan.slots > 40 and min(sizes) * 40 >= whole:
        for s, at in slots.items():
            share = len(plan.slot_of[s]) / 40
            assert abs(share - plan.want[s] / sum(plan.want.values())) < 1 / 40
            assert all(abs(k - share * x) < 1 for k, x in enumerate(at))


def test_parts_are_whole():
    from fractions import Fraction

    assert parts_of([Fraction(1, 3)] * 3, 10) == [4, 3, 3] and parts_of([Fraction(1, 1000), Fraction(999, 1000)], 10) == [1, 9] and parts_of([Fraction(0), Fraction(1)], 4) == [0, 4]


@pytest.mark.parametrize("times", [1, 100])
def test_a_mix_of_any_size_keeps_its_weights(times):
    sizes = {"a": 1_001 * times, "b": 607 * times, "c": 7 * times}
    whole = sum(sizes.values())
    plan = Plan([(s, x / whole, 1) for s, x in sizes.items()], sizes, whole, 1)
    assert plan.slots == whole
    for s, x in sizes.items():
        assert all(abs(k - plan.slot(s, k) * x / whole) < 1 for k in [*range(0, x, 101), x - 1])


@settings(deadline=None)
@given(st.lists(st.integers(1, 200), min_size=1, max_size=5), st.integers(1, 60))
def test_each_block_has_a_slot_of_its_own(sizes, block):
    whole = sum(sizes)
    given_ = [(str(i), x / whole, 1) for i, x in enumerate(sizes)], {str(i): x for i, x in enumerate(sizes)}, whole, block
    plan = Plan(*given_)
    slots = {s: [plan.slot(s, k) for k in range(-(-w // block))] for s, w in plan.want.items()}
    assert sorted(x for of in slots.values() for x in of) == list(range(plan.slots)) and all(of == sorted(of) for of in slots.values())
    for s, of in slots.items():
        assert all(abs(k - x * plan.want[s] / sum(plan.want.values())) < 1 for k, x in enumerate(of) if x <= sum(plan.want.values()) // block)
    spans = Plan(*given_, span=1)
    assert slots == {s: [spans.slot(s, k) for k in range(len(of))] for s, of in slots.items()}


def test_a_mix_loses_no_use_and_its_order_needs_no_number_of_buckets(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "an owl by the lamp " * (1 + i % 3), "a") for i in range(300)] + [(900, "an owl", "b"), (901, "", "b"), (902, None, "a")], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 3)], "source string, target_share double, max_repeats int")
    once = {r.doc_id: r for r in mix(docs, weights, block=50)[0].collect()}
    assert once[900].uses == 3 and all(len(r.slots) == r.uses and r.slots == sorted(r.slots) for r in once.values())
    monkeypatch.setattr("skein.llm.p8_mix.LEAST_BUCKETS", 7)
    assert once == {r.doc_id: r for r in mix(docs, weights, block=50)[0].collect()}


def test_types_do_not_change_when_the_corpus_grows(make, spark):
    rows = [(i, f"{PROSE} No. {i}") for i in range(40)] + [(100 + i, TEXTS[t]) for i, t in enumerate(TYPES)] + [(200, "lamp owl fox, fern"), (201, "id: 7\nname: owl\nkind: bird")]
    common = spark.createDataFrame([("en", "the")], "lang string, word string")
    once = {r.id: r.type for r in typed(make(rows), common).collect()}
    often = {r.id: r.type for r in typed(make([(i + 1000 * k, t) for k in range(10) for i, t in rows]), common).collect()}
    assert all(often[i + 1000 * k] == once[i] for i in once for k in range(10))
