"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tastemap.llm import spelling_variants as sv


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(counts, ratio=5):
    out, form = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if is_near(w, v)]
        best = min(near, key=lambda v: (-counts[v], v)) if near else None
        form[w] = best if best is not None and counts[best] >= ratio * n else None
        out[w] = [form[w], None, n, len(near), counts[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def found(rows):
    got = [(r.word, (r.form, r.root, r.n, r.n_near, r.form_n)) for r in rows]
    assert len(got) == len(dict(got))
    return dict(got)


def edits(draw, word, alphabet):
    i = draw.randrange(len(word) + 1)
    kind = draw.randrange(3)
    if kind == 0 and i < len(word) > 1:
        return word[:i] + word[i + 1:]
    if kind == 1 and i < len(word):
        return word[:i] + draw.choice(alphabet) + word[i + 1:]
    return word[:i] + draw.choice(alphabet) + word[i:]


@pytest.mark.parametrize("alphabet, symbols, long", [("ab", 2, 6), ("abcdeéÿ", 4, 64), ("abcdefgh🙂", 3, 9)])
def test_against_all_pairs(spark, alphabet, symbols, long):
    draw = random.Random(len(alphabet))
    words = {"".join(draw.choice(alphabet) for _ in range(draw.randint(1, 14))) for _ in range(60)}
    words |= {edits(draw, w, alphabet) for w in sorted(words) for _ in range(4)}
    words |= {edits(draw, w, alphabet) for w in sorted(words)}
    words.discard("")
    counts = {w: draw.choice([5, 6, 25, 30, 150, 1000, 5000, 30000]) for w in sorted(words)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(sv.group_variants(df, symbols=symbols, long=long).collect()) == plain(counts)


def test_long_words_and_a_long_chain(spark):
    chain = ["x" * 10 + "y" * k + "z" * (12 - k) for k in range(12)]  # each is one replacement from the next
    counts = {w: 5 ** k for k, w in enumerate(chain, 1)}
    base = "".join(random.Random(1).choice("abcdef") for _ in range(300))
    for i, w in enumerate([base, base[:150] + base[151:], "q" + base, base[:299] + "q", base[:40], base[:64], base[:65],
                           base[:64] + "q", base[:66], "q" + base[1:65], "q" * 5000, "q" * 5001, "q" * 5003]):
        counts[w] = 7 * (i + 1) ** 3
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(sv.group_variants(df).collect())
    assert got == plain(counts)
    assert got[chain[0]][1] == chain[-1]


def test_keys_are_the_reduced_neighbourhood():
    def spelt(reduced):
        return int(sv.mix(np.array([sum(int(s) * pow(sv._BASE, i, 1 << 64) for i, s in enumerate(reduced)) % (1 << 64)],
                                   np.uint64))[0])

    for word in ("a", "abc", "éabcab"):
        reduced = tuple(int(s) for s in sv._reduced([word], 3)[0])
        near = {reduced} | {reduced[:i] + reduced[i + 1:] for i in range(len(reduced))}
        near |= {reduced[:i] + (s,) + reduced[i + 1:] for i in range(len(reduced)) for s in (1, 2, 3)}
        near |= {reduced[:i] + (s,) + reduced[i:] for i in range(len(reduced) + 1) for s in (1, 2, 3)}
        assert set(sv.neighbour_keys([word], 3)[0].tolist()) == {spelt(r) for r in near}
        assert int(sv.own_keys([word], 3)[0]) == spelt(reduced)


def test_only_true_neighbours_leave_the_join(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}word{d}", 9) for a in "abcd" for b in "efgh" for c in "ijkl" for d in "mnop"],
                                  "word string, n long")
    pairs = sv.near_words(words, symbols=2)
    assert pairs.count() == 256 * 12
    assert "levenshtein" in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_nulls_repeats_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("abcdef", 3, 1, 2), ("abcdef", 4, 1, 2), ("abcdeg", 40, 0, 0), (None, 9, 0, 0), ("", 9, 0, 0),
                                ("zzzzzz", None, 0, 0)], "word string, n int, key int, other int")
    assert found(sv.group_variants(df).collect()) == plain({"abcdef": 7, "abcdeg": 40})
    assert sv.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_planted_words(spark):
    draw = random.Random(5)
    docs = [(i, " ".join("".join(draw.choice("abÀéÿÜZ×÷") for _ in range(draw.randint(1, 12))) + draw.choice(["", ".", "1", "ł"])
                         for _ in range(200))) for i in range(40)]
    docs += [(None, "nothing here"), (5, None), (6, ""), (7, "A" * 50_000 + "!")]
    want = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                want[run] += 1
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert Counter(r.word for r in sv.planted_words(df).collect()) == want
