"""Spelling variants against plain Python: near pairs at every depth of halving, roots, odd rows."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.oracle import assert_same
from tracefold.llm import spelling

FOLDER = "/root/testdata/sf0.001"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(counts, times=10):
    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in beside.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= times * counts[w]}
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(beside[w]), form.get(w), counts[form[w]] if w in form else None, root)
    return out


def answers(spark, counts, **args):
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(rows, **args).collect()}


def test_matches_sql(spark):
    assert_same(spelling.QUERIES["op12_spelling"](spark, FOLDER), spelling.SQL["op12_spelling"], FOLDER)


@pytest.mark.parametrize("group", [4096, 20, 1])
def test_against_brute_force(spark, group):
    """Common starts and ends, runs of one letter, edits at both ends; groups are halved until they are small, down to one letter."""
    rng, base = random.Random(7), ["aaaaaaa", "conspre", "abcabcabc", "éèéèéèé", "walkingly"]
    found = set(base)
    while len(found) < 400:
        w = list(rng.choice(sorted(found)))
        p, letter = rng.randrange(len(w) + 1), rng.choice("abcé")
        w[p : p + rng.randrange(2)] = [letter] * rng.randrange(2) if len(w) > 7 else [letter]
        if len(w) >= 7:
            found.add("".join(w[:14]))
    found.add("q" * 300)
    found.add("q" * 150 + "r" + "q" * 150)
    counts = {w: rng.choice([1, 2, 3, 30, 400, 5000]) for w in sorted(found) if len(w) >= 7}
    assert answers(spark, counts, group=group) == brute(counts)


def test_each_pair_once():
    """All pairs of a tile with several groups, over a stretch in the middle."""
    words = ["xxabcyy", "xxabdyy", "xxbcyyy", "xxabccyy", "xxacyyy", "zzabcyy", "zzabdyy", "zzabyyy", "xxaabcyy"]
    words, group = sorted(w for w in words if w[0] == "x") + sorted(w for w in words if w[0] == "z"), [0] * 6 + [1] * 3
    letters = np.zeros((9, 8), dtype=np.uint8)
    for i, w in enumerate(words):
        letters[i, : len(w)] = np.frombuffer(w.encode("latin-1"), dtype=np.uint8)
    got = spelling.near_pairs(letters, np.array([len(w) for w in words]), np.array(group), 7, 2, 5)
    first = lambda a, b: next(i for i in range(9) if a[i : i + 1] != b[i : i + 1])
    want = {frozenset((a, b)) for a in words for b in words if near(a, b) and a[0] == b[0] and 2 <= first(a, b) < 5 and min(len(a), len(b)) == 7}
    assert sorted(map(sorted, (frozenset((words[i], words[j])) for i, j in zip(*got, strict=True)))) == sorted(map(sorted, want)) and len(want) > 4


def test_words(spark):
    texts = ["Conspire conspire CONSPIRE\nété Çàéèêëœabcdefg x", None, "", "conspire-conspirÉ " * 40, "a" * 5000]
    rows = [(i, t, "w", "k", 3) for i, t in enumerate(texts)] + [(None, "conspire conspire", "w", "k", 3), (3, texts[3], "w", "k", 3)]
    got = {r.word: r.n for r in spelling.words(spark.createDataFrame(rows, "doc_id long, text string, word string, k string, n int"), least=1).collect()}
    want = Counter()
    for key, text, *_ in rows:
        low = "".join(c.lower() if c < "a" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
                want[word] += len(word) >= 7
            run = ""
    assert got == {w: n for w, n in want.items() if n}
    assert spelling.variants(spelling.words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
