import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from cartaspark.llm import jaccard as J
from cartaspark.llm.components import connected_components
from cartaspark.llm.shared import Scratch


def shingles(text):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_force(rows, threshold=80):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= threshold * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(docs, rows, **options):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs, **options).collect()}
    assert got == brute_force(rows, options.get("threshold", 80))


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    boilerplate = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 150, 300]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 15))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own) + (" " + boilerplate if rng.random() < 0.3 else ""))
    for k in range(40):  # a large group of near copies in a row: each differs a little more
        own = rows[0].split() + [f"x{i}" for i in range(60)]
        for j in range(k // 2):
            own[-1 - j] = f"y{j}"
        rows.append(" ".join(own))
    rows += ["", None, " \n", "one", "One", "one two", "a b c d e"] * 2
    rows += [" ".join(f"v{i}" for i in range(20000)), " ".join(f"v{i}" for i in range(20500))]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i * 3 + 1, rows[k]) for i, k in enumerate(order)]


def test_components_equal_brute_force(make_docs):
    rows = corpus()
    check(make_docs(rows), rows)


def test_small_blocks_give_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 3)
    rows = corpus(6)
    check(make_docs(rows), rows)


def test_other_threshold(make_docs):
    rows = corpus(7)
    check(make_docs(rows), rows, threshold=60)


def test_parts_of_hot_shingles_give_the_same(make_docs, monkeypatch):
    monkeypatch.setattr(J, "HOT_ROWS", 3)
    monkeypatch.setattr(J, "HOT_TIMES", 0)
    rows = corpus(8)
    check(make_docs(rows), rows)


def test_empty_and_null_ids(make_docs):
    assert J.near_duplicates(make_docs([])).collect() == []
    near = " ".join(f"w{i}" for i in range(40))
    docs = make_docs([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, near), (None, near + " x"), (None, near + " y"), (9, "z " + near), (None, "p q r s t u v"), (None, "p q r s t u v"), (None, None), (None, "")])
    got = sorted((r[0] or 0, r[1], r[2] or 0) for r in J.near_duplicates(docs).collect())
    assert got == sorted([(0, 2, 1), (1, 2, 1), (2, 2, 1), (0, 36, 9), (0, 37, 9), (0, 37, 9), (9, 37, 9), (0, 3, 0), (0, 3, 0), (0, 0, 0), (0, 0, 0)])
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in J.keep_one_each(docs).collect())
    assert kept == [(0, ""), (0, ""), (0, "p q r s t u v"), (0, "p q r s t u v"), (1, "a b c d e f"), (9, "z " + near)]
    assert J.keep_one_each(docs).columns == docs.columns


def test_ids_of_the_whole_range(make_docs):
    big, a, b = 2**63 - 1, "a b c d e f g", "h i j k l m n"
    docs = make_docs([(big, a), (-5, a), (3 << 61, b), ((3 << 61) + 1, b), (None, b), (None, "q r s t u v w"), (-(2**63), "")])
    got = sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3]) for r in J.near_duplicates(docs).collect() if r[2] is not None)
    low = 3 << 61
    assert got == sorted([(False, big, 3, -5, -5), (False, -5, 3, -5, -5), (False, low, 3, low, low), (False, low + 1, 3, low, low), (True, 0, 3, low, low), (False, -(2**63), 0, -(2**63), -(2**63))])
    assert J.near_duplicates(docs).count() == 7
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in J.keep_one_each(docs).collect())
    assert kept == sorted([(-5, a), (low, b), (0, "q r s t u v w"), (-(2**63), "")])


def test_rows_with_equal_ids_are_one_node(make_docs):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    docs = make_docs([(5, a), (5, b), (1, a), (7, b), (8, c), (8, c), (9, "")])
    got = sorted((r[0], r[1], r[2]) for r in J.near_duplicates(docs).collect())
    assert got == [(1, 3, 1), (5, 3, 1), (5, 3, 1), (7, 3, 1), (8, 3, 8), (8, 3, 8), (9, 0, 9)]


def test_bit_counts_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80), dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([b, a[: rng.integers(0, len(a) + 1)]]))
        x, y = J.bitmap(a), J.bitmap(b)
        width = 8 * min(len(x), len(y))
        p, q = (J.fold(int.from_bytes(v, "little"), 8 * len(v), width) for v in (x, y))
        common = len(np.intersect1d(a, b))
        assert J.overlap(a, b) == common
        assert min(len(a) - (p & ~q).bit_count(), len(b) - (q & ~p).bit_count()) >= common


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(50)], [(1, i) for i in range(2, 40)] + [(100, i) for i in range(101, 130)] + [(39, 129)]])
def test_connected_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r[0]: r[1] for r in connected_components(df, Scratch(spark, "t"), "c").collect()}
    root = {}
    for a, b in edges:
        for n in (a, b):
            root.setdefault(n, n)
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_whole_query_on_the_small_tables(spark):
    from cartaspark.llm.queries import op2_ngram_jaccard

    sf = "/root/testdata/sf0.001"
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op2_ngram_jaccard(spark, sf).select("doc_id", F.col("n_shingles"), "component_id").collect()}
    assert got == brute_force(rows)


def tasks_of(spark, run):
    """What `run` returns, and the number of Spark's tasks meanwhile."""
    context = spark.sparkContext
    context.setJobGroup("counted", "counted")
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("counted") for s in status.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)


def test_a_small_graph_needs_no_exchange(spark):
    """Its tasks do not grow with the number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
        found, tasks = tasks_of(spark, lambda: connected_components(edges, Scratch(spark, "t"), "c").where("node <> component").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r[0]: r[1] for r in found} == {i: 0 for i in range(1, 51)}
    assert tasks < 61 * 2


def test_graphs_larger_than_a_chunk(spark, monkeypatch):
    from cartaspark.llm import components

    monkeypatch.setattr(components, "CHUNK", 4)
    rng = random.Random(3)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(7, i) for i in range(200, 260)] + [(i, i + 1) for i in range(300, 330)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    root = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {n: got.get(n, n) for n in root} == root


@pytest.mark.parametrize("few", [0, 1 << 40])
def test_all_rounds_of_stars_or_none_give_the_same(make_docs, monkeypatch, few):
    monkeypatch.setattr(J, "FEW", few)
    rows = corpus(9)
    check(make_docs(rows), rows)
