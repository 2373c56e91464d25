"""Graph search, bisector clusters and target resampling against brute force, and on odd tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from duecall.llm import bisector_clusters, graph_search, target_resample
from duecall.llm.queries import ORACLES, QUERIES
from duecall.llm.slot_table import Spans, intern

SF_DIR = "/root/testdata/sf0.01"
VECTORS = "vec_id BIGINT, embedding ARRAY<FLOAT>, score STRING, `a.b` INT"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    """Vectors beside columns that bear the names of results."""
    return spark.createDataFrame([(i, v, "mine", 1) for i, v in rows], VECTORS)


def some_vectors(n, dims=8, seed=1):
    return np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32).astype(float).tolist()


ODD = [None, [], [0.0] * 8, [1.0] * 7 + [None], [NAN] + [1.0] * 7, [INF] + [1.0] * 7, [1.0, 2.0]]


# --- graph search ----------------------------------------------------------------------------------


def nearest(rows, queries, k):
    """All k nearest rows of every query, equal rows once."""
    def takes_part(key, v):
        return key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    rows = {(i, tuple(v)) for i, v in rows if takes_part(i, v)}
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in queries if takes_part(i, v)}):
        own = [(math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v)]
        out += [(q, rank, i, d) for rank, (d, i) in enumerate(sorted(own)[:k], 1)]
    return out


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert all(math.isclose(g[3], w[3], rel_tol=1e-12, abs_tol=1e-12) for g, w in zip(got, sorted(want)))


@pytest.mark.parametrize("shard_rows", [500, 100, 20])
def test_small_shards_equal_brute_force(spark, shard_rows):
    rows = list(enumerate(some_vectors(300)))
    df = frame(spark, rows)
    asked = [r for r in rows if r[0] % 10 == 0]
    # beams hold a shard of 100 or 20; a graph of 300 nodes is searched on a long beam
    index = graph_search.build_index(df, shard_rows=shard_rows)
    got = graph_search.search_index(index, df.where("vec_id % 10 = 0"), beam=200)
    same(found(got), nearest(rows, asked, 10))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")
def test_recall_on_driver_vectors(spark):
    df = spark.read.parquet(f"{SF_DIR}/../sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    hits = total = 0
    got = defaultdict(set)
    for r in graph_search.nearest_neighbours(df, df.where("vec_id % 20 = 0"), shard_rows=1500).collect():
        got[r.query_id].add(r.vec_id)
    for q in ids[ids % 20 == 0]:
        far = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        far[ids == q] = np.inf
        want = set(ids[np.lexsort([ids, far])[:10]].tolist())
        hits, total = hits + len(want & got[int(q)]), total + 10
    assert hits >= 0.95 * total


def test_every_node_is_found_and_edges_are_few():
    x = np.array(some_vectors(700, 4, seed=3))
    x[:300] = x[0] + np.arange(300)[:, None] * 1e-3  # a thin string of near copies
    graph = graph_search.build(x, degree=12, beam=24)
    assert graph.edges.shape == (700, 12) and graph.edges.max() < 700
    assert all(len(set(e[e >= 0])) == (e >= 0).sum() and k not in e for k, e in enumerate(graph.edges))
    best, near = graph.search(x, 48)
    assert (near[:, 0] == 0).mean() > 0.97
    reached, front = set(), set(graph.entries.tolist())
    while front:
        reached |= front
        front = {int(j) for i in front for j in graph.edges[i] if j >= 0} - reached
    assert len(reached) == 700


def test_pruning_keeps_diverse_neighbours():
    x = np.array([[0.0, 0], [1, 0], [1.1, 0], [2, 0], [0, 3], [0, 3.2]])
    kept = graph_search.prune(x, np.array([0]), np.array([[5, 4, 3, 2, 1, 0, -1, 1]]), 4, 1.2)
    # 2 and 3 lie behind 1, and 5 behind 4
    assert kept.tolist() == [[1, 4, -1, -1]]
    wide = graph_search.prune(x, np.array([0]), np.array([[1, 3, 4]]), 2, 10.0)
    assert wide.tolist() == [[1, 3]]


def test_hot_vector_and_ties(spark):
    """A third of all rows are one vector: the smallest ids win, whoever asks."""
    hot = [0.5] * 8
    rows = [(i, hot if i % 3 == 0 else v) for i, v in enumerate(some_vectors(900, seed=5))]
    df = frame(spark, rows).repartition(7)
    got = found(graph_search.nearest_neighbours(df, df.where("vec_id IN (0, 1, 300)"), shard_rows=300))
    asked = [rows[0], rows[1], rows[300]]
    want = nearest(rows, asked, 10)
    assert [g for g in got if g[0] != 1] == sorted(w for w in want if w[0] != 1)
    assert [w[2] for w in want if w[0] == 0] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 30]
    assert len({g[2] for g in got if g[0] == 1} & {w[2] for w in want if w[0] == 1}) >= 9



def test_recall_beside_a_crowd_of_near_copies(spark):
    """Vectors all over a sphere, a third of them close around one point."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 64))
    x[::3] = x[0] + rng.normal(size=(1000, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype(np.float32).astype(float)
    df = frame(spark, list(enumerate(x.tolist())))
    got = defaultdict(set)
    for r in graph_search.nearest_neighbours(df, df.where("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 20):
        far = ((x - x[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(got[q] & set(np.argsort(far, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 1500


def test_graph_search_edges(spark):
    vectors = some_vectors(6)
    rows = [(i if i else None, v) for i, v in enumerate(ODD)] + [(100 + i, v) for i, v in enumerate(vectors)]
    rows += [(100, vectors[0]), (100, vectors[1]), (None, vectors[2]), (200, [3.0, 4.0]), (201, [-0.0, 1.0])]
    df = frame(spark, rows)
    got = graph_search.nearest_neighbours(df, df)
    same(found(got), nearest(rows, rows, 10))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    empty = df.limit(0)
    assert graph_search.nearest_neighbours(empty, df).count() == 0
    assert graph_search.nearest_neighbours(df, empty).count() == 0
    huge = frame(spark, [(1, [3e38] * 8), (2, [-3e38] * 8), (3, [1.0] * 8)])
    assert found(graph_search.nearest_neighbours(huge, huge.where("vec_id = 3")))[0][:3] in {(3, 1, 1), (3, 1, 2)}


# --- bisector clusters -----------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale=256, seed="2"):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted((name(i), v) for i, v in kept)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest_of = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest_of(v)[1]].append(v)
        centroids = [
            [sum(x) // len(groups[j]) for x in zip(*groups[j])] if groups[j] else c
            for j, c in enumerate(centroids)
        ]
    placed = [(i, *reversed(nearest_of(v))) for i, v in kept]
    per = Counter()
    for _, j, d in placed:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, per[j], sum(per.values()), sha[j]) for i, j, d in placed]


def by_text(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("k, rounds", [(40, 5), (3, 1), (1, 2)])
def test_clusters_equal_plain_rounds(spark, k, rounds):
    rows = list(enumerate(some_vectors(400, seed=8)))
    # coarse values: ties between centroids, equal centroids, floors of negative numbers
    rows = [(i, [round(x) / 256 for x in v] if i % 2 else [round(x * 2) / 2 for x in v]) for i, v in rows]
    got = bisector_clusters.cluster_vectors(frame(spark, rows).repartition(5), k=k, rounds=rounds, dims=8)
    assert by_text(got.collect()) == by_text(plain_clusters(rows, k, rounds, 8))


def test_zero_favours_the_smaller_number():
    bisectors = bisector_clusters.Bisectors(np.array([[4, 0], [0, 0], [0, 0], [-4, 0]]))
    best, distance = bisectors.nearest(np.array([[2, 0], [0, 7], [-2, 0], [5, 0]]))
    assert best.tolist() == [0, 1, 1, 0] and distance.tolist() == [4, 49, 4, 1]
    rng = np.random.default_rng(0)
    c, x = rng.integers(-3, 4, (12, 3)), rng.integers(-4, 5, (2000, 3))
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    best, distance = bisector_clusters.Bisectors(c).nearest(x)
    assert (best == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_cluster_edges(spark):
    rows = [(i if i else None, v) for i, v in enumerate(ODD)]
    rows += [(7, some_vectors(1)[0]), (7, some_vectors(1)[0]), (None, some_vectors(2)[1]), (8, [-1e-9] * 8)]
    df = frame(spark, rows)
    got = bisector_clusters.cluster_vectors(df, dims=8)
    assert by_text(got.collect()) == by_text(plain_clusters(rows, 40, 5, 8))
    assert got.schema == bisector_clusters.cluster_vectors(df.limit(0), dims=8).schema
    assert bisector_clusters.cluster_vectors(df.limit(0), dims=8).count() == 0
    with pytest.raises(Exception, match="2\\^26"):
        bisector_clusters.cluster_vectors(frame(spark, [(1, [1e9] * 8)]), dims=8).count()


# --- target resampling -----------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_slots_are_shared_by_equal_spans_only():
    rng = random.Random(1)
    sizes = [0, 1, 2, 3, 4, 5, 7, 8, 9, 12, 15, 16, 31, 32, 33, 40, 63, 64, 100, 1000]
    spans = [bytes(rng.choices(b"abc\0", k=rng.choice(sizes))) for _ in range(1500)] * 2
    size = np.array([len(s) for s in spans])
    end = np.cumsum(size)
    table = Spans(np.frombuffer(b"".join(spans), np.uint8), end - size, end)
    keys = table.keys()
    assert [xxhash.xxh64_intdigest(s) for s in spans] == keys.tolist()
    # all keys, four keys, one key: bytes alone tell the spans apart
    for given in (None, keys & np.uint64(3), np.zeros(len(spans), np.uint64)):
        slot, opened_by = intern(table, given)
        slots = defaultdict(set)
        for s, at in zip(spans, slot.tolist()):
            slots[s].add(at)
        assert all(len(v) == 1 for v in slots.values())
        assert len(set.union(*slots.values())) == len(slots) == (opened_by >= 0).sum()
        assert all(spans[opened_by[min(at)]] == s for s, at in slots.items())


def plain_resample(rows, target, longest, buckets, least_words, percent, seed):
    def features(text):
        w = WORD.findall((text or "").translate(LOWER))
        return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [(i, *features(t)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in docs for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text)[1])
    whole = (sum(s.values()) + buckets) / (sum(t.values()) + buckets)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * whole / (s[b] + 1))) for b in s}
    out = []
    for i, n_words, fs in docs:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, score, None, n_words])
    drawn = [r for r in out if r[5] >= least_words]
    drawn.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[2], -r[1]))
    for rank, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


ODD_TEXTS = [None, "", " \n", "A a A a", "x" * 100_000, "été 日本 Ünï_x9", "the The THE", "\0a\x7fb"]


@pytest.mark.parametrize("longest, percent", [(1, 10), (3, 60), (2, 100)])
def test_resampling_equals_plain_counting(spark, longest, percent):
    rng = random.Random(longest)
    texts = [" ".join(rng.choices(["Red", "green,blue", "x1", "é", "-", "z" * 40], k=rng.randrange(60))) for _ in range(300)]
    rows = list(enumerate(texts + ODD_TEXTS)) + [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[5])]
    target = ["red red x1", None, "", texts[7]]
    schema = "doc_id BIGINT, text STRING, rank STRING, eligible STRING, key INT"
    df = spark.createDataFrame([(i, t, "mine", "mine", 1) for i, t in rows], schema).repartition(6)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text STRING, weight INT")
    got = target_resample.resample(df, wanted, longest=longest, buckets=97, percent=percent, least_words=5)
    want = plain_resample(rows, target, longest, 97, 5, percent, "2024")
    assert by_text(got.collect()) == by_text(want)


def test_resampling_edges(spark):
    schema = "doc_id BIGINT, text STRING"
    empty = spark.createDataFrame([], schema)
    few = spark.createDataFrame([(1, "a b"), (2, None)], schema)
    none = target_resample.resample(empty, few)
    assert none.count() == 0 and none.schema == target_resample.resample(few, empty).schema
    want = plain_resample([(1, "a b"), (2, None)], [], 1, 10_000, 20, 10, "2024")
    assert by_text(target_resample.resample(few, empty).collect()) == by_text(want)
    # one score for all rows: ranks follow the keys
    text = " ".join(["w"] * 30)
    level = spark.createDataFrame([(9, text)] * 50, schema)
    assert sorted(r["rank"] for r in target_resample.resample(level, few).collect() if r["rank"]) == [1, 2, 3, 4, 5]


# --- SQL -------------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    got = QUERIES[name](spark, SF_DIR)
    assert sorted(got.columns) == sorted(columns)
    assert by_text(got.select(*columns).collect()) == by_text(result.fetchall())


def test_op11_asks_for_every_hundredth_vector(spark):
    got = QUERIES["op11_graph_search"](spark, SF_DIR)
    assert [(c, t) for c, t in got.dtypes] == [
        ("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double"),
    ]
    ids = [r.vec_id for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").where(F.col("vec_id") % 100 == 0).collect()]
    counted = {r.query_id: r["count"] for r in got.groupBy("query_id").count().collect()}
    assert counted == {i: 10 for i in ids}
