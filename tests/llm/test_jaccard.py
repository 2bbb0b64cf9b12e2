import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from lexmill.llm import jaccard
from lexmill.llm.graph import components


def plain_sets(rows: list[tuple]) -> dict:
    out = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    return out


def plain_components(rows: list[tuple]) -> dict:
    sets, parent = plain_sets(rows), {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_sets_against_plain_python():
    import pyarrow as pa

    from lexmill.llm.common import flat

    texts = ["A b c D e f", "a B c d E F", "one two", None, "", "x " * 40, "é É a b c d"]
    keys, of = jaccard.shingles(*flat(pa.array(texts)), 5)
    sets = plain_sets(list(enumerate(texts)))
    size, own = jaccard.class_keys(keys, of, len(texts))
    assert size.tolist() == [len(sets[i]) for i in range(len(texts))]
    assert own[0] == own[1] and len(set(own.tolist())) == 5  # the two empty ones are alike


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n, high, sets in ((1, 48, 1), (1000, 48, 3), (5, 47, 5), (200_000, 20, 100_000)):
        s = rng.integers(0, 1 << high, n).astype(np.uint64)
        k = rng.integers(0, 1 << 63, sets).astype(np.uint64)[rng.integers(0, sets, n)]
        x = rng.integers(0, 2 if n == 5 else 1, n).astype(np.uint8)
        assert Counter(zip(*(v.tolist() for v in jaccard.read_block(jaccard.write_block(s, k, x))), strict=True)) == Counter(zip(s.tolist(), k.tolist(), x.tolist(), strict=True))


def test_near_copies_against_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows: list[tuple] = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows += [(len(rows) + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 12)))) for i in range(25)]
    rows += [(len(rows) + i, t) for i, t in enumerate([None, "", "  ", "short text", "SHORT  text"])]
    got = jaccard.jaccard_classes(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components(rows)


def test_all_links_of_a_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows: list[tuple] = []
    for i in range(40):
        copy = list(base)
        for _ in range(i % 3):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(20)}"
        rows.append((i, " ".join(copy)))
    rows += [(40, "alone " * 3), (41, None)]
    sets = plain_sets(rows)
    classes = {frozenset(x) for x in sets.values() if x}
    near = [(x, y) for x, y in combinations(classes, 2) if x & y and 100 * len(x & y) >= 75 * len(x | y)]
    degree = Counter(z for pair in near for z in pair)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_links(df).collect()
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in got} == {k: (len(x), degree[frozenset(x)]) for k, x in sets.items()}
    assert len(got) == len(rows) and len({r.class_id for r in got} - {None}) == len(classes)
    links = jaccard.class_links(df).collect()
    assert len(links) == len({(r.a, r.b) for r in links}) == len(near) > len(classes)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (None, None)]
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(1, 3, 1), (1, 3, 1), (5, 3, 1), (None, 3, 1), (None, 0, None)], key=str)
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id string, text string")).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    edges = [(a, b) for a, b in edges if a != b]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for start in sorted(near):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = start
                todo += near[x]
    for most in (1000, 10):  # in one task, and in rounds
        got = components(spark.createDataFrame(edges, "a long, b long"), most).collect()
        assert {r.node: r.label for r in got} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
