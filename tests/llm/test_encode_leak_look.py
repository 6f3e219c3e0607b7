import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import encode as E
from millrace.llm import leakage as K
from millrace.llm import lookalike as L

needs_vocabulary = pytest.mark.skipif(not os.path.exists(E.DEFAULT_VOCABULARY), reason="no vocabulary files")


@needs_vocabulary
@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t'st,.é​　ß中🙂"), max_size=80), st.integers(1, 9))
def test_tree_equals_whole(text, leaf):
    encode = E.encoder(E.read_ranks()).encode_ordinary
    assert E.tree_encode(encode, text, leaf) == encode(text)


@needs_vocabulary
def test_corpus_round_trip(spark):
    texts = ["", None, "  ", "Hello, world", "x" * 9000, "word " * 5000, "<|endoftext|>", "\x00�", "ein Text\r\n mehr"]
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in enumerate(texts)] + [(3, "Hello, world", 1, "")], "doc_id long, text string, ids int, __text string")
    got = E.encode_corpus(df)
    rows = got.collect()
    assert len(rows) == len(texts) + 1 and all(r.ids == [] for r in rows if r.doc_id in (0, 1))
    encode = E.encoder(E.read_ranks()).encode_ordinary
    assert all(r.ids == encode(texts[r.doc_id] or "") for r in rows)
    assert {r.text for r in E.decode_corpus(got).collect()} == {t or "" for t in texts}
    assert E.encode_corpus(df.limit(0)).count() == 0


def items(n, words, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(words))) for i in range(n)]


def within(item, doc):
    """Brute force: some run of item words within the limits of some run of document words, by edit distance."""
    n, m = len(item), len(doc)
    for i in range(n):
        for j in range(m):
            row = list(range(m - j + 1))
            for a in range(1, n - i + 1):
                new = [a]
                for b in range(1, m - j + 1):
                    new.append(min(row[b] + 1, new[b - 1] + 1, row[b - 1] + (item[i + a - 1] != doc[j + b - 1])))
                row = new
                e = min(row)
                if a >= 15 and e <= 1 or a >= 30 and e <= a // 7:
                    return True
    return False


@pytest.mark.parametrize("seed", range(12))
def test_verification_equals_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.randrange(1, 60) for _ in range(34)]
    a = rng.randrange(0, 10)
    part = item[a : a + rng.choice([13, 14, 15, 16, 31, 34])]
    for _ in range(rng.choice([0, 1, 1, 2, 4])):
        p = rng.randrange(len(part))
        part[p : p + rng.choice([0, 1])] = rng.choice([[], [99], [98]])
    doc = [rng.randrange(60, 90) for _ in range(4)] + part + [rng.randrange(60, 90) for _ in range(3)]
    assert K.holds(np.array(item), np.array(doc)) == within(item, doc)


def test_edits_spread_over_a_passage_longer_than_the_least():
    item = np.arange(1, 36)
    doc = item.copy()
    doc[[5, 11, 17, 23, 29]] = 0
    assert within(list(item), list(doc)) and K.holds(item, doc)
    text = [f"w{i}" for i in range(35)]
    index = K.Index([(0, " ".join(text))])
    assert list(K._possible(index, np.where(np.isin(index.items[0], doc), index.items[0], 0), np.array([0]))) == [0]


@pytest.mark.parametrize("seed", range(12))
def test_prefilter_loses_no_long_passage(seed):
    rng = random.Random(seed)
    n = rng.randrange(30, 43)
    item = list(range(1, n + 1))
    doc = item.copy()
    step = rng.randrange(5, 9)
    for p in range(rng.randrange(step), n, step):
        doc[p] = 0
    got = K.holds(np.array(item), np.array(doc))
    assert got == within(item, doc)
    index = K.Index([(0, " ".join(f"w{i}" for i in item))])
    assert not got or len(K._possible(index, np.array(doc), np.array([0])))


def test_leaks(spark):
    its = items(30, 80)
    word = lambda i, a, b: its[i][1].split()[a:b]
    filler = " ".join(f"f{i}" for i in range(300))
    changed = word(2, 5, 40)
    for p in (6, 14, 22, 30):
        changed[p] = "other"
    docs = {
        1: f"{filler} {its[0][1]} {filler}",
        2: f"{filler}\n{' '.join(word(1, 10, 25)).upper().replace(' ', chr(10))}, {filler}",
        3: " ".join(word(1, 10, 17) + ["x"] + word(1, 18, 26)),
        4: " ".join(word(1, 10, 22)),
        5: " ".join(changed),
        6: " ".join(word(3, 0, 13)) + " " + filler + " " + " ".join(word(3, 13, 26)),
        7: "ｗ" + its[4][1][1:].replace("w", "w​"),
        8: "", 9: None, 10: "w1 " * 50_000,
        11: its[5][1] + " " + its[6][1],
    }
    df = spark.createDataFrame([(k, t, 0, "c") for k, t in docs.items()] + [(1, docs[1], 0, "c")], "doc_id long, text string, item_id int, __text string")
    bench = spark.createDataFrame([*its, (40, None), (41, ""), (42, "too short to leak"), its[0]], "item_id long, text string")
    want = {(1, 0), (2, 1), (3, 1), (5, 2), (7, 4), (11, 5), (11, 6)}
    assert sorted(tuple(r) for r in K.leaks(df, bench).collect()) == sorted(want)
    assert sorted(tuple(r) for r in K.leaks(df, bench, block_words=500).collect()) == sorted(want)
    assert K.leaks(df.limit(0), bench).count() == 0 and K.leaks(df, bench.limit(0)).count() == 0


def test_lsh_recall():
    its = items(200, 80, seed=5)
    index = K.Index(its)
    rng = random.Random(6)
    docs, want = [], set()
    for k in range(300):
        i = rng.randrange(200)
        w = its[i][1].split()
        a = rng.randrange(0, 60)
        part = w[a : a + 16]
        part[rng.randrange(16)] = "changed"
        docs.append((k, " ".join(["pre"] * 20 + part + ["post"] * 20)))
        if K.holds(index.items[i], np.array([index.vocabulary.get(x, 0) for x in K.words(docs[-1][1])])):
            want.add((k, i))
    got = set(K.scan(index, docs))
    assert got <= want | got and len(want) > 50 and len(got & want) >= 0.98 * len(want)


def test_stretches_find_what_whole_texts_hold():
    """Passages anywhere in long documents and long items, by verification of bounded stretches only."""
    its = items(6, 2500, seed=9)
    index = K.Index(its)
    rng = random.Random(10)
    docs, want = [], set()
    for k in range(120):
        i = rng.randrange(6)
        w = its[i][1].split()
        n = rng.choice([14, 15, 18, 40, 70, 300])
        a = rng.randrange(0, 2500 - n)
        part = w[a : a + n]
        for p in range(rng.randrange(7, 12), n, rng.randrange(8, 14)):
            part[p] = "changed"
        text = " ".join([f"f{rng.randrange(9000)}" for _ in range(rng.randrange(2000))] + part + ["post"] * rng.randrange(900))
        docs.append((k, text))
        if K.holds(np.array([index.vocabulary[x] for x in w[max(0, a - 40) : a + n + 40]]), np.array([index.vocabulary.get(x, 0) for x in part])):
            want.add((k, i))
    docs.append((500, its[0][1] + " " + its[1][1]))
    got = set(K.scan(index, docs))
    assert {(500, 0), (500, 1)} <= got and len(want) > 60
    assert len(want & got) >= 0.98 * len(want) and not {p for p in got if p[0] < 500} - want


PAIRS = [("café", "café"), ("ＡＢＣ １", "ABC 1"), ("a​b", "ab"), ("a b", "a b"), ("pаy", "pay"), ("ﬁsh", "fish"), ("ṩ", "ṩ"), ("5 ℃", "5 °C"), ("a\r\nb ", "a\nb"), ("ﻻ", "لا"), ("أ", "أ"), ("so­ft", "soft"), ("Å", "Å")]
UNLIKE = [("m²", "m2"), ("A", "a"), ("cale", "calé"), ("c-d", "c d"), ("l", "1"), ("\U0001f469‍\U0001f373", "\U0001f469\U0001f373"), ("م‌م", "مم"), ("٢", "2")]


def test_folding():
    for a, b in PAIRS:
        assert L.fold_text(a) == L.fold_text(b), (a, b)
    for a, b in UNLIKE:
        assert L.fold_text(a) != L.fold_text(b), (a, b)


def test_spark_form_equals_model(spark):
    rng = random.Random(1)
    pool = "aeo \n\r\t.ẹ́́ ​‌‍Ａаοﬁ℃أﻻ\U0001f469\U0001f373️­م²"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(400)] + [None, "", " ", "plain", "é" * 3000, "á" * 3000]
    df = spark.createDataFrame([(i, t, 0, "c") for i, t in enumerate(texts)], "doc_id long, text string, pos int, cp string")
    got = {r.doc_id: r.form for r in L.canonical(df).collect()}
    assert got == {i: None if t is None else L.fold_text(t) for i, t in enumerate(texts)}


def test_pairs(spark):
    rows = [(i, t) for i, t in enumerate(x for p in PAIRS for x in p)] + [(100 + i, t) for i, t in enumerate(x for p in UNLIKE for x in p)]
    rows += [(200, "same"), (201, "same"), (202, "sa​me"), (203, None), (204, ""), (205, "​"), (206, " "), (202, "sa​me")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, form int")
    got = {(r[0], r[1]) for r in L.same_look_pairs(df).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(PAIRS))} | {(200, 202), (201, 202)}
    assert L.same_look_pairs(df.limit(0)).count() == 0
    links = Counter(x for p in got for x in p)
    classes = {r.doc_id: (r.class_id, r.links) for r in L.same_look_classes(df).collect()}
    assert classes == {i: (200 if i >= 200 else i - i % 2, n) for i, n in links.items()}
    assert L.same_look_classes(df.limit(0)).count() == 0
