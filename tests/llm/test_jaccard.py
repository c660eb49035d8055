import random
import re

from ebbtide.llm import jaccard
from ebbtide.llm.components import components
from ebbtide.llm.queries import QUERIES
from tests.llm.fixtures import ODD, empty_docs, odd_docs


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def plain(rows, k, percent):
    """Brute force: all pairs."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j in range(i):
            b, y = sets[j]
            if x and y and a is not None and b is not None and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if d is not None else None) for i, (d, s) in enumerate(sets)), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(QUERIES["op9_jaccard_join"](spark, sf_dir)) == plain(rows, 4, 85)


def test_odd_rows(spark):
    assert got(jaccard.jaccard_components(odd_docs(spark), 4, 85)) == plain([(d, t) for d, t, _, _ in ODD], 4, 85)
    assert jaccard.jaccard_components(empty_docs(spark), 4, 85).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(odd_docs(spark)).collect()) == sorted(str(d) for d, *_ in ODD if d != 7)
    clash = odd_docs(spark).selectExpr("*", "1 gone", "2 row_id", "3 row_body", "4 sieve_mask", "5 n", "6 digest", "7 `a.b`")
    assert jaccard.keep_one(clash).columns == clash.columns and jaccard.keep_one(clash).count() == len([d for d, *_ in ODD if d != 7])


def test_rows_of_one_id_are_judged_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " more"), (2, "another text that is clean and stays here"), (None, long), (None, "no id and nothing like it"), (None, "no id and nothing like it"), (3, None), (4, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([rows[0], *rows[2:3], *rows[4:]], key=str)


def test_a_large_group_whose_members_miss_their_least_one(spark, monkeypatch):
    """Most pairs of the group are no links, and no member links to all; blocks are small, so that a cell has many."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(120)], []
    for d in range(2000):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        rows.append((d, " ".join(w)))
    rows[0] = (0, " ".join(base[:60] + [f"y{i}" for i in range(14)] + base[60:]))
    assert got(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 85)) == plain(rows, 4, 85)


def test_a_forest_pair_that_is_no_link_hides_none(spark, monkeypatch):
    """With bitmaps of few bits most pairs pass that don't link, and the second round must find the links they stood for."""
    monkeypatch.setattr(jaccard, "_bitmap", lambda s: bytes(8))
    test_chains_bridges_and_shared_passages(spark, monkeypatch)


def test_chains_bridges_and_shared_passages(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    rows = []
    for g in range(25):
        base = rng.choices(words, k=rng.choice([6, 12, 40, 90, 200]))
        for _ in range(rng.choice([1, 2, 8, 20])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.5:
                base = w  # chains: each a little off the one before
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(rng.choices(words, k=20)) + " " + passage) for i in range(60)]
    rows += [(len(rows) + i, rows[3][1]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width, percent in ((4, 85), (5, 80), (1, 50)):
        assert got(jaccard.jaccard_components(docs, width, percent)) == plain(rows, width, percent), (width, percent)
    kept = sorted(r.doc_id for r in jaccard.keep_one(docs).collect())
    assert kept == sorted({c for *_, c in plain(rows, 5, 80)})


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_take_few_tasks(spark):
    """The driver handles each task's result: rounds of steps over a few edges took most of the pipeline's tasks on check_h."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(90, 100)], "a long, b long").repartition(4)
    context = spark.sparkContext
    context.setJobGroup("few-edges", "components")
    try:
        found = components(edges).collect()
    finally:
        context._jsc.clearJobGroup()
    assert {r.node: r.root for r in found} == {i: 0 for i in range(41)} | {i: 90 for i in range(90, 101)}
    tracker = context.statusTracker()
    stages = {k for j in tracker.getJobIdsForGroup("few-edges") for k in tracker.getJobInfo(j).stageIds}
    assert sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s) < 60


def test_components_of_many_and_few_edges_agree(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(190)] + [(i + 1, i) for i in range(1000, 1060)] + [(5000, i) for i in range(2000, 2100)] + [(-5, -9), (-9, -5), (9, 9), (None, 1), (7, None)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    want = sorted((i, find(i)) for i in root)
    for small in (0, len(edges)):
        found = components(spark.createDataFrame(edges, "a long, b long").repartition(5), small=small).collect()
        assert sorted((r.node, r.root) for r in found) == want, small
