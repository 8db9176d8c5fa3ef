import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skein.llm import near, p4_copies, p5_overlap
from skein.llm.keys import copy_key, word_set
from skein.llm.p2_near import near_copies, near_groups
from skein.llm.p4_copies import CountingTrie, copies, copy_classes, p4_counts
from skein.llm.p5_overlap import overlaps
from skein.session import Written

WORDS = "owl fox hare stoat crane heron moss fern river lamp stone brass linen quartz amber 山 川 café".split()


def texts(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            w = rnd.choice(out)[1].split()
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            rnd.random() < 0.3 and rnd.shuffle(w)
        else:
            w = [rnd.choice(WORDS) + rnd.choice(["", "", str(rnd.randint(0, 40))]) for _ in range(rnd.randint(1, 14))]
        out.append((i, (" " if rnd.random() < 0.8 else ", ").join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, "!!"), (n + 3, "word " * 3000), (n + 4, "word " * 3000 + "x")]


def brute(rows, crossing=None):
    key = {i: copy_key(t) for i, t in rows if copy_key(t)}
    sets = {i: word_set(t) for i, t in rows if i in key}
    out = set()
    for a, b in itertools.combinations(sorted(key), 2):
        if crossing is not None and (a in crossing) == (b in crossing):
            continue
        same = key[a] == key[b]
        close = 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])
        if (close and not same) if crossing is None else (close or same):
            out.add((a, b))
    return out


@given(st.lists(st.binary(max_size=6), max_size=60))
def test_trie_counts_as_a_dictionary(found):
    trie = CountingTrie()
    for i, k in enumerate(found):
        trie.add(k, i, 1)
    got = {k: (i, n) for k, i, n in trie.terminals()}
    assert got == {k: (found.index(k), n) for k, n in Counter(found).items()}


@pytest.mark.parametrize("bucket", [64, 1 << 24])
def test_copies(make, bucket):
    rows = texts(150, 1)
    got = {(r.id_a, r.id_b) for r in copies(make(rows), bucket).collect()}
    groups = {}
    for i, t in rows:
        if copy_key(t):
            groups.setdefault(copy_key(t), []).append(i)
    assert got == {(g[0], x) for g in groups.values() for x in g[1:]}


def test_hot_copies_are_counted(make):
    rows = make([(i, "An owl" if i % 3 else "an OWL!") for i in range(300)] + [(900, "fox")])
    members, classes = copy_classes(rows, Written(rows.sparkSession, "test"), 16)
    assert [(r.id, r.n) for r in classes.collect()] == [(0, 300)]
    assert members.count() == 301


def test_every_text_remains_once_with_its_number(spark, monkeypatch, make):
    rows = make([(0, "An owl"), (1, "an OWL!"), (2, "fox"), (3, None), (4, "!!")])
    monkeypatch.setattr("skein.llm.p4_copies.texts", lambda *_: rows)
    assert {(r.id, r.n) for r in p4_counts(spark, "").collect()} == {(0, 2), (2, 1)}


def test_no_copies(make):
    assert copies(make([])).count() == 0


@pytest.mark.parametrize(("hot", "target"), [(near.HOT, near.TARGET), (8, 2), (8, 10_000)])
def test_near_pairs_equal_brute_force(make, monkeypatch, hot, target):
    monkeypatch.setattr(near, "TARGET", target)
    rows = texts(160, 2)
    assert {(r.id_a, r.id_b) for r in near_copies(make(rows), hot=hot).collect()} == brute(rows)


def test_near_pairs_of_long_texts(make, monkeypatch):
    monkeypatch.setattr(near, "LONG", 6)
    rows = texts(120, 3)
    assert {(r.id_a, r.id_b) for r in near_copies(make(rows)).collect()} == brute(rows)


def met(sets, target, monkeypatch):
    """Pairs that share a value, which the smaller one has in its short prefix."""
    monkeypatch.setattr(near, "TARGET", target)  # workers import the module anew, so this has no effect on a whole query
    number = {w: i for i, w in enumerate(sorted(set().union(*sets)))}
    codes = np.zeros(1 << near.SKETCH_BITS, np.uint8)
    for w, n in Counter(itertools.chain(*sets)).items():
        codes[number[w]] = round(math.log2(n) * near.STEPS)
    offsets = np.cumsum([0, *map(len, sets)])
    words = np.array([number[w] for s in sets for w in sorted(s)], np.int32)
    posts = {}
    for r, k, short in zip(*near.coordinates(np.zeros(len(sets), np.int64), words, offsets, near.Sketch(codes, len(sets)), 7, 10)):
        posts.setdefault(k, {}).setdefault(r, []).append(short)
    out = set()
    for at in posts.values():
        for a, b in itertools.combinations(sorted(at), 2):
            x, y = len(sets[a]), len(sets[b])
            if any(at[a]) and x <= y or any(at[b]) and y <= x:
                out.add((a, b))
    return out


def similar(sets):
    return {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 10 * len(sets[a] & sets[b]) >= 7 * len(sets[a] | sets[b])}


def test_short_sets_of_common_words_share_a_value(monkeypatch):
    sets = [set("abc"), set("abcx"), *({"abc"[i % 3], f"r{i}", f"s{i}"} for i in range(90)), *({"x", f"t{i}", f"u{i}"} for i in range(50))]
    assert similar(sets) == {(0, 1)} <= met(sets, 1, monkeypatch)


@pytest.mark.parametrize("target", [1, 8, 1_000])
def test_similar_sets_share_a_value(monkeypatch, target):
    rnd = random.Random(target)
    sets = [set(rnd.sample("abcdefghijklm", rnd.randint(1, 9))) for _ in range(500)]
    assert similar(sets) <= met(sets, target, monkeypatch)


def test_near_pairs_of_no_rows(make):
    assert near_copies(make([])).count() == 0


@pytest.mark.parametrize("hot", [near.HOT, 8])
def test_overlaps_equal_brute_force(make, hot):
    rows = texts(160, 4)
    held = {i for i, _ in rows if i % 5 == 0}
    got = overlaps(make(rows, held=held), hot=hot).collect()
    assert {(r.id_a, r.id_b) for r in got} == brute(rows, held)
    assert all(0 < r.overlap_a <= 1 and 0 < r.overlap_b <= 1 and (r.id_a in held) == r.held_a for r in got)


@pytest.mark.parametrize("hot", [near.HOT, 8])
def test_overlaps_of_many_small_buckets(make, monkeypatch, hot):
    """Postings that are passed on often, and buckets that take out hot values several times, give the same pairs."""
    for name, n in (("TOGETHER", 64), ("ROOM", 50), ("PER_BUCKET", 10)):
        monkeypatch.setattr(near, name, n)
    rows = texts(160, 4)
    held = {i for i, _ in rows if i % 5 == 0}
    assert {(r.id_a, r.id_b) for r in overlaps(make(rows, held=held), hot=hot).collect()} == brute(rows, held)


def test_postings_of_a_task_are_one_row_a_bucket(make):
    classes = p5_overlap.classes_of(p5_overlap.shape(make(texts(160, 4)).coalesce(1)).coalesce(1)).coalesce(1).cache()

    def all_words(b):
        words, offsets = near.column_of_arrays(b, "words")
        rec = np.repeat(np.arange(b.num_rows), np.diff(offsets))
        return rec, near.mix(words.view(np.uint32), np.zeros(1)).view(np.int64), rec

    got = near.postings(classes, [all_words], ["t", "id", "words"], 4).collect()
    n = sum(len(r.words) // 4 for r in classes.collect())
    assert len(got) <= 4 < n == sum(len(r.key) // 8 for r in got)
    values = [set(np.frombuffer(r.key, np.int64) >> near.IN_KEY) for r in got]
    assert sum(map(len, values)) == len(set().union(*values))


@given(st.lists(st.tuples(st.lists(st.integers(-(2**31), 2**31 - 1), max_size=5)), max_size=6))
def test_packed_columns_and_their_order(lists):
    arrays = [np.array(x, np.int32) for (x,) in lists]
    flat, offsets = np.concatenate([np.zeros(0, np.int32), *arrays]), np.cumsum([0, *map(len, arrays)])
    got, at = near.unpacked(near.packed(flat, offsets).slice(len(arrays) // 2), np.int32)
    assert (got == flat[offsets[len(arrays) // 2] :]).all() and (at == offsets[len(arrays) // 2 :] - offsets[len(arrays) // 2]).all()
    kept = near.packed(p5_overlap.ordered(flat.view(np.uint32)), offsets).to_pylist()
    assert (p5_overlap.in_order(near.unpacked(near.packed(p5_overlap.ordered(flat.view(np.uint32)), offsets), np.uint32)[0]) == flat).all()
    assert sorted(range(len(arrays)), key=lambda i: kept[i]) == sorted(range(len(arrays)), key=lambda i: arrays[i].tolist())


def test_ids_of_two_tabs_do_not_meet(make):
    rows = make([(1, "an owl by a lamp")]).unionByName(make([(1, "an owl by a lamp")], "train")).unionByName(make([(2, "an owl, by a lamp")], "train"))
    assert [(r.tab, r.id_a, r.id_b) for r in copies(rows).collect()] == [("train", 1, 2)]


@pytest.mark.parametrize("most", [near.MOST_IDS, 0])
def test_groups_are_components(make, monkeypatch, most):
    monkeypatch.setattr(near, "MOST_IDS", most)
    rows = texts(140, 5)
    links = brute(rows)
    key = {i: copy_key(t) for i, t in rows if copy_key(t)}
    root = {i: i for i in key}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in [*links, *((a, b) for a, b in itertools.combinations(sorted(key), 2) if key[a] == key[b])]:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = near_groups(make(rows)).collect()
    assert {r.id: r.group_id for r in got} == {i: find(i) for i in key}
    assert {r.id: r.class_id for r in got} == {i: min(j for j in key if key[j] == key[i]) for i in key}
    of = {r.id: r.class_id for r in got}
    classes = {tuple(sorted((of[a], of[b]))) for a, b in links}
    assert all(r.links == sum(r.class_id in c for c in classes) for r in got)


def test_groups_of_no_rows(make):
    assert near_groups(make([])).count() == 0


def test_bit_table_holds_its_values(spark):
    keys_ = [1, -1, 2**62, -(2**63), 12345]
    table = near.BitTable.of(spark.createDataFrame([(k,) for k in keys_], "key bigint"), 5)
    assert table.has(np.array(keys_, np.int64).view(np.uint64)).all() and near.BitTable.bits_for(10**12) == near.BitTable.MOST_BITS


@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 3))
def test_chunks_depend_on_their_words_alone(seqs, window):
    seq, offsets = np.array([w for s in seqs for w in s], np.int32), np.cumsum([0, *map(len, seqs)])
    rec, digest, size = p5_overlap.chunks(seq, offsets, window)
    assert [size[rec == i].sum() for i in range(len(seqs))] == [len(s) for s in seqs]
    for i, s in enumerate(seqs):
        alone = p5_overlap.chunks(np.array(s, np.int32), np.array([0, len(s)]), window)
        assert (alone[1] == digest[rec == i]).all() and (alone[2] == size[rec == i]).all()


def test_most_overlaps_come_by_chunks(make):
    rnd = random.Random(9)
    base = [" ".join(rnd.choice(WORDS) + str(rnd.randint(0, 400)) for _ in range(24)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t.replace(t.split()[5], "edited").replace(t.split()[15], "")) for i, t in enumerate(base)]
    got = overlaps(make(rows, held=set(range(100, 160)))).collect()
    assert {(r.id_a, r.id_b) for r in got} >= {(i, 100 + i) for i in range(60)}
    assert sum(r.path == "chunks" for r in got) >= 59 and all(r.overlap_a > 0.4 for r in got if r.path == "chunks")


def test_prefix_tables_that_are_joined(make, monkeypatch):
    monkeypatch.setattr(p4_copies, "MOST_BROADCAST", 0)
    rows = texts(120, 6)
    assert copies(make(rows), 64).count() == copies(make(rows)).count()


def test_overlaps_of_no_rows_and_of_one_side(make):
    assert overlaps(make([])).count() == 0
    assert overlaps(make(texts(20, 7))).count() == 0


@pytest.mark.parametrize("most", [near.BitTable.MOST_BITS, 16])
def test_bit_tables_of_groups(spark, monkeypatch, most):
    monkeypatch.setattr(near.BitTable, "MOST_BITS", most)
    rows = spark.createDataFrame([(k * 0x9E3779B97F4A7 - 2**61, k % 2 == 0) for k in range(300)], "key bigint, even boolean")
    got = near.bit_tables(rows, {(True,): 150, (False,): 150}, ["even"])
    keys_ = np.array([k * 0x9E3779B97F4A7 - 2**61 for k in range(300)], np.int64).view(np.uint64)
    assert got[True,].has(keys_[::2]).all() and got[False,].has(keys_[1::2]).all() and not got[True,].has(keys_[1::2]).all()
