"""Near-duplicate groups against all pairs."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np

from pyspark.sql import Row

from tastemap.llm.components import connected_components
from tastemap.llm.near_dedup import _groups, drop_near_copies, near_groups, op9_near_dedup

SF = "/root/testdata/sf0.01"


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i:i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def by_all_pairs(docs):
    """``{doc_id: (n_shingles, component_id)}`` of ``(doc_id, text)`` pairs with distinct ids."""
    sets = {d: shingles(t) for d, t in docs}
    postings, parent = {}, {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, s in sets.items():
        common = {}
        for item in s:
            for other in postings.setdefault(item, []):
                common[other] = common.get(other, 0) + 1
            postings[item].append(d)
        for other, shared in common.items():
            if 100 * shared >= 80 * (len(s) + len(sets[other]) - shared):
                a, b = root(d), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def check(rows, docs):
    want = by_all_pairs(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(op9_near_dedup(spark, SF).collect(), docs)


def variants(seed, bases=12, copies=25, words=(3, 150)):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(bases):
        base = [draw.choice(vocabulary) for _ in range(draw.randint(*words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(text) // 8))):
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
            docs.append(" ".join(text))
    draw.shuffle(docs)
    return [(1000 - i, t) for i, t in enumerate(docs)]


def test_borderline_variants(spark):
    for seed in (1, 2):
        docs = variants(seed)
        check(near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_large_clumps_are_dealt_in_blocks_and_by_regions(spark):
    docs = variants(4, bases=2, copies=200, words=(40, 80))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (16, 3):  # up to 13 blocks, and more blocks than orders
        check(near_groups(rows, block=block).collect(), docs)


def test_pairs_in_a_large_family_of_boilerplate(spark):
    """Two thousand texts that share most of a label with all others, and a link only with one."""
    base = [f"b{i}" for i in range(41)]
    docs = [(2 * i + j, " ".join([*base, f"p{i}", *(f"d{i}.{j}.{k}" for k in range(5))]))
            for i in range(1000) for j in range(2)]
    want = by_all_pairs(docs)
    assert len({root for _, root in want.values()}) == 1000
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for sizes in ({"block": 16}, {"block": 16, "region": 100}):  # more blocks than orders; regions in blocks too
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(rows, **sizes).collect()}
        assert got == want


def test_regions_and_clumps_of_any_size_keep_every_pair(spark):
    """All pairs that share a prefix in an order meet in a group, by regions as well."""
    active = spark.createDataFrame([(7, i, 0) for i in range(300)] + [(8 + i // 2, i, 0) for i in range(300, 2000)]
                                   + [(5000, 299, 0), (5000, 300, 0)], "region long, sid long, head long")
    clumps = spark.createDataFrame([(i, 0) for i in range(1, 2000)], "node long, root long")
    groups = {}
    for r in _groups(active, clumps, 4).collect():
        groups.setdefault((r.part, r.sub), set()).add(r.sid)
    met = {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    assert met >= set(itertools.combinations(range(300), 2)) | {(i, i + 1) for i in range(300, 2000, 2)} | {(299, 300)}
    assert len(met) < 100_000  # by regions


def test_many_copies_and_chains(spark):
    base = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(base)) for i in range(400)]  # one large group of copies
    docs += [(1000 + i, " ".join(base[:i % 50] + [f"x{i}"] + base[i % 50 + 1:])) for i in range(600)]
    docs += [(2000 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 60))) for i in range(40)]  # a chain
    check(near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_edges_of_the_input(spark):
    rows = [Row(doc_id=5, text=None, n=1, sid="x"), Row(doc_id=4, text="", n=1, sid="x"),
            Row(doc_id=3, text=" \n\t", n=1, sid="x"), Row(doc_id=7, text="One", n=1, sid="x"),
            Row(doc_id=6, text="oNE ", n=1, sid="x"), Row(doc_id=9, text="one two", n=1, sid="x"),
            Row(doc_id=None, text="one two", n=1, sid="x"), Row(doc_id=9, text="one two", n=1, sid="x"),
            Row(doc_id=11, text="a " * 200000, n=1, sid="x"), Row(doc_id=12, text="É é É", n=1, sid="x")]
    docs = spark.createDataFrame(rows)
    got = sorted(((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_groups(docs).collect()))
    assert got == [(-1, 1, 9, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True),
                   (7, 1, 6, False), (9, 1, 9, False), (9, 1, 9, True), (11, 1, 11, True), (12, 2, 12, True)]
    kept = drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 9, 11, 12]
    assert near_groups(docs.filter("false")).count() == 0


def test_components(spark):
    draw = random.Random(3)
    path = list(range(300))
    draw.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect())
    want = {x: 0 for x in range(1, 300)} | {1000 + i: 1000 for i in range(1, 200)} | {5001: 5000}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_depth_varies_by_region_and_six_bytes_always_meet():
    from tastemap.llm import near_dedup as nd

    draw = random.Random(2)
    crowd = 0x11223344_0000_0000  # many rows share four bytes, so their regions go deeper
    labels = [crowd + draw.randrange(40) * (1 << 24) + draw.randrange(1 << 16) * (1 << 8) for _ in range(600)]
    labels += [0x55667700_0000_0000 + draw.randrange(1 << 40) for _ in range(9)]  # few rows share three
    labels += [draw.randrange(1 << 62) for _ in range(300)]
    tree = np.repeat([0, 1], len(labels))
    label = np.concatenate([np.sort(np.array(labels, np.int64))] * 2)
    region = nd.adapted_regions(tree, label, 3)
    groups = {}
    for k, r in enumerate(region.tolist()):
        groups.setdefault(r, []).append(k)

    def depth(ks):
        first, last = (int(label[k]).to_bytes(8, "big") for k in (ks[0], ks[-1]))
        return next((d for d in range(8) if first[d] != last[d]), 8)

    shared = {depth(ks) for ks in groups.values() if len(ks) > 1}
    assert min(shared) <= 3 and max(shared) >= 6
    six = {}
    for k in range(len(label)):
        six.setdefault((tree[k], int(label[k]) >> 16), set()).add(int(region[k]))
    assert all(len(rs) == 1 for rs in six.values())
    assert all(len(ks) <= nd.SMALL or depth(ks) >= 6 for ks in groups.values())
    assert nd._shallowest(1000) < nd._shallowest(10**9) <= nd.MIN_DEPTH
