import random
from itertools import combinations

import pytest
from cases import awkward_documents, edited, prose

from helioscape.llm import jaccard_join


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).add(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: find(i) for i in sets}


def check(df, rows):
    members, links = jaccard_join.similar_sets(df, "doc_id", "text")
    found = [tuple(r) for r in members.select("id", "n", "component").collect()]
    expected = brute(rows)
    assert sorted(found) == sorted((i, len(shingles(t)), expected[i]) for i, t in rows)
    for a, b in links.collect():
        assert a < b and expected[a] == expected[b]


def test_awkward_rows(spark):
    df = awkward_documents(spark)
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_near_copies_chains_and_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 2_000)  # many blocks
    draw = random.Random(5)
    rows = []
    for g in range(4):
        base = prose(900 + g, 80)
        rows += [(len(rows) + k, edited(base, 31 * g + k, draw.randrange(8))) for k in range(25)]
    chain = prose(77, 100)
    for k in range(10):  # neighbours are similar, ends are not
        rows.append((1000 + k, chain))
        chain = edited(chain, k, 2)
    passage = prose(78, 70)
    rows += [(2000 + k, passage + " " + prose(3000 + k, 10 + k % 12)) for k in range(60)]
    rows += [(4000 + k, prose(78, 70)) for k in range(20)]
    draw.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_at_the_threshold(spark):
    words = [f"a{i}" for i in range(60)]
    rows = []
    for k, extra in enumerate(range(0, 40)):  # sizes on both sides of 75 percent
        rows.append((k, " ".join(words + [f"b{k}_{j}" for j in range(extra)])))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f"), (4, "A b c d e f"), (None, None), (5, None)]])
def test_empty_and_rows_without_ids(spark, rows):
    members, _ = jaccard_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = sorted(((r.id, r.n, r.component) for r in members.collect()), key=repr)
    assert found == (sorted([(None, 2, 4), (4, 2, 4), (None, 0, None), (5, 0, 5)], key=repr) if rows else [])
