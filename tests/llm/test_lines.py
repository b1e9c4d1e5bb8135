"""Line links and classes against all pairs of lines."""

from __future__ import annotations

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from tastemap.llm.line_dedup import (MIN_CHARS, drop_repeated_lines, line_dedup, line_links, line_table, op7_line_dedup,
                                     within_distance, without_common_ends)

SF = "/root/testdata/sf0.001"
BLANK = " "


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def edited(draw, text, most, letters="abcdé "):
    out = list(text)
    for _ in range(draw.randint(0, most)):
        k, i = draw.randint(0, 2), draw.randint(0, len(out))
        if k == 0:
            out.insert(i, draw.choice(letters))
        elif out and k == 1:
            out.pop(min(i, len(out) - 1))
        elif out:
            out[min(i, len(out) - 1)] = draw.choice(letters)
    return "".join(out)


def linked(a, b, threshold):
    if a == b or min(len(a), len(b)) < MIN_CHARS or abs(len(a) - len(b)) > threshold:
        return False
    cuts = [len(a) * i // (threshold + 1) for i in range(threshold + 2)]
    if not any(a[x:y] in b for x, y in zip(cuts, cuts[1:], strict=False)):  # edits cannot touch every part
        return False
    return distance(a, b) <= threshold


def by_all_pairs(docs, threshold=2):
    """``{doc_id: counts}`` of ``(doc_id, text)`` rows with ascending ids."""
    lines = {}
    for d, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            if line.strip(BLANK):
                lines.setdefault(line, []).append((d, pos))
    names = sorted(lines, key=len)
    parent, links = {x: x for x in names}, dict.fromkeys(names, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if len(b) - len(a) > threshold:
                break
            if linked(a, b, threshold):
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    heads, sizes = {}, {}
    for x in names:
        heads[root(x)] = min(heads.get(root(x), lines[x][0]), lines[x][0])
        sizes[root(x)] = sizes.get(root(x), 0) + len(lines[x])
    out = {d: [0, 0, 0, 0, 0] for d, _ in docs}
    for x in names:
        for place in lines[x]:
            row = out[place[0]]
            row[0] += 1
            row[1] += len(lines[x]) > 1 or links[x] > 0
            row[2] += links[x] > 0
            row[3] += links[x]
            row[4] += place != heads[root(x)]
    return out


def check(rows, docs, threshold=2):
    want = by_all_pairs(docs, threshold)
    assert {r.doc_id: [r.n_lines, r.n_shared, r.n_linked, r.n_links, r.n_dropped] for r in rows} == want
    return want


def test_banded_distance(spark):
    draw = random.Random(5)
    pairs = [(a, edited(draw, a, 4)) for a in ("".join(draw.choice("abé ") for _ in range(draw.randint(0, 16)))
                                               for _ in range(600))]
    pairs += [("", ""), ("", "ab"), ("abc", ""), ("😀b", "b😀")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for t in (1, 2, 3):
        same = df.select("a", "b", within_distance(F.col("a"), F.col("b"), t).alias("near"))
        ends = without_common_ends(df.withColumns({"x": F.col("a"), "y": F.col("b")}), "x", "y")
        cut = ends.select("a", "b", within_distance(F.col("x"), F.col("y"), t).alias("near"))
        for r in same.union(cut).collect():
            assert r.near == (distance(r.a, r.b) <= t), r


def family(seed, bases=25, copies=8, most=4):
    draw = random.Random(seed)
    out = []
    for _ in range(bases):
        base = "".join(draw.choice("abcdé ") for _ in range(draw.randint(10, 40)))
        out += [edited(draw, base, most) for _ in range(copies)]
    draw.shuffle(out)
    return [x for x in out if x.strip(BLANK)]


def test_links_are_all_found(spark):
    for threshold in (1, 2):
        lines = sorted(set(family(threshold)) | set(family(7, bases=1, copies=150)))  # and one large family
        df = spark.createDataFrame(list(enumerate(lines)), "_tm_row long, t string")
        name = {r.id: r.t for r in df.select("t", F.xxhash64("t").alias("id")).collect()}
        links = line_links(df, "t", line_table(df, "t", threshold=threshold), threshold=threshold)
        got = {tuple(sorted((name[r.a], name[r.b]))) for r in links.collect()}
        assert got == {(a, b) for i, a in enumerate(lines) for b in lines[i + 1:] if linked(a, b, threshold)}
        assert got


def test_documents_of_varied_lines(spark):
    lines = family(9, bases=30, copies=10)
    draw = random.Random(2)
    docs = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 6)))) for i in range(80)]
    docs += [(100 + i, "the very same line of everyone\n\n   \n") for i in range(60)]
    want = check(line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert sum(w[4] for w in want.values()) > 60


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    check(op7_line_dedup(spark, SF).collect(), docs)


def test_edges_of_the_input(spark):
    rows = [Row(doc_id=2, text=None, line="x", id=1), Row(doc_id=3, text="", line="x", id=1),
            Row(doc_id=None, text="a line of some length\nshort", line="x", id=1),
            Row(doc_id=5, text="short\na line of some lengths\n" + "y" * 100000, line="x", id=1),
            Row(doc_id=5, text="short\na line of some lengths\n" + "y" * 100000, line="x", id=1)]
    docs = spark.createDataFrame(rows)
    got = sorted((r.doc_id or -1, r.n_lines, r.n_shared, r.n_linked, r.n_links, r.n_dropped)
                 for r in line_dedup(docs).collect())
    assert got == [(-1, 2, 2, 1, 1, 2), (2, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0), (5, 3, 3, 1, 1, 0), (5, 3, 3, 1, 1, 3)]
    cleaned = drop_repeated_lines(docs)
    assert cleaned.columns == docs.columns
    texts = sorted(r.text for r in cleaned.collect() if r.text is not None)
    assert texts == ["", "", "", "short\na line of some lengths\n" + "y" * 100000]
    assert line_dedup(docs.filter("false")).count() == 0


def test_short_lines_are_linked_too(spark):
    draw = random.Random(4)
    lines = sorted({"".join(draw.choice("abcdé ") for _ in range(draw.randint(1, 18))).strip() for _ in range(300)} - {""})
    lines = sorted(set(lines) | {edited(draw, x, 2).strip() for x in lines} - {""})
    docs = [(i, x) for i, x in enumerate(lines)] + [(len(lines), None), (len(lines) + 1, "ab\nab\n \nxyz")]
    for threshold in (1, 2):
        near = {(a, b) for i, a in enumerate(lines) for b in lines[i + 1:]
                if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold}
        df = spark.createDataFrame(list(enumerate(lines)), "_tm_row long, t string")
        name = {r.id: r.t for r in df.select("t", F.xxhash64("t").alias("id")).collect()}
        links = line_links(df, "t", line_table(df, "t", threshold=threshold), threshold=threshold)
        assert {tuple(sorted((name[r.a], name[r.b]))) for r in links.collect()} == near
        assert any(len(a) < 16 <= len(b) or len(b) < 16 <= len(a) for a, b in near)
    got = {r.doc_id: (r.n_lines, r.n_shared, r.n_linked, r.n_links, r.n_dropped) for r in line_dedup(
        spark.createDataFrame([(1, "teh\nquite another"), (2, "the\nsomething else"), (3, "a longer line")],
                              "doc_id long, text string")).collect()}
    assert got == {1: (2, 1, 1, 1, 0), 2: (2, 1, 1, 1, 1), 3: (1, 0, 0, 0, 0)}
    check(line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
