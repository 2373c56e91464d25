"""Nearest neighbours by beam search in robust-pruned directed graphs, one graph per shard.

**Index.** Vectors are dealt to shards by a hash of their components, about ``shard_rows`` to a
shard, so equal vectors meet and are one node with the ids of its smallest ``k + 1`` rows. A shard's
graph grows by insertion: a greedy search over the nodes so far proposes neighbours, pruning keeps
the nearest one and drops every candidate that is ``alpha`` times nearer to a kept one than to the
node, and so on, at most ``degree`` of them; kept neighbours get an edge back, and those with too
many edges are pruned the same way. Nodes that cannot be reached from the first entry become entries
too, so every node can be found. One row per shard holds ids, vectors and edges.

**Search.** Queries go to the shards in blocks of at most ``block`` distinct vectors, the only rows
that come to the driver. A task answers a block over all shards it reads, beam search by beam
search, and keeps the ``k`` best per query; the final ranking sees ``k`` rows per query and task.
Distances to whatever a beam ends with are computed again in double precision on the original
vectors. A shard of no more nodes than the beam holds is searched whole, and so is a shard whose
beam ends with too few rows for a query.

Scale: queries times shards are searched, as a stated share of all rows asks every shard; a larger
``shard_rows`` makes that fewer searches and needs more memory in a task (about a kilobyte a row).

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
with a null key. Vectors are compared with those of the same length only. Equal rows (key and
vector) count once; rows with the query's own key are no candidates. Of equally near rows the
smaller key comes first; a query with fewer candidates than ``k`` gets all that are found. An empty
table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duecall.llm.shared import saved

K = 10
SHARD_ROWS = 8192
DEGREE = 48
BEAM = 96
ALPHA = 1.2
BLOCK = 16_384
MOST_PARTS = 100_000
_WIDTH = 4  # nodes whose edges are followed in one step
_BATCH = 256  # searches that advance together
_GAPS = 8_000_000  # distances between candidates that are held at once


def _apart(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the vectors ``a`` (n, d) to the nodes ``b`` (n, m) of ``x``."""
    gap = x[b] - a[:, None, :]
    return np.einsum("nmd,nmd->nm", gap, gap)


def _once(nodes: np.ndarray) -> np.ndarray:
    """Every row sorted, with -1 instead of what it holds a second time."""
    nodes = np.sort(nodes, axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    return nodes


@dataclass
class Graph:
    """Vectors, edges (-1: none) and entry nodes of a shard."""

    x: np.ndarray
    edges: np.ndarray
    entries: np.ndarray

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes met on the way from the entries, and their distances.

        Rows hold -1 and infinity where fewer nodes were met.
        """
        n, nodes = len(queries), len(self.x)
        every = np.arange(n)
        seen = np.zeros((n, nodes + 1), bool)
        seen[:, -1] = True  # stands for no node
        best = np.broadcast_to(self.entries, (n, len(self.entries))).copy()
        seen[:, self.entries] = True
        near = _apart(self.x, queries, best)
        passed = np.zeros(best.shape, bool)
        while True:
            waiting = np.where(passed, np.inf, near)
            width = min(_WIDTH, waiting.shape[1])
            chosen = np.argpartition(waiting, width - 1, axis=1)[:, :width]
            fresh = np.isfinite(np.take_along_axis(waiting, chosen, 1))
            going = np.flatnonzero(fresh.any(axis=1))
            if not len(going):
                break
            np.put_along_axis(passed, chosen, True, 1)
            at = np.where(fresh[going], np.take_along_axis(best, chosen, 1)[going], -1)
            met = np.where(at[:, :, None] >= 0, self.edges[at], -1).reshape(len(going), -1)
            met = _once(met)
            met[seen[going[:, None], met]] = -1
            seen[going[:, None], met] = True
            far = np.full((n, met.shape[1]), np.inf)
            new = np.full((n, met.shape[1]), -1, best.dtype)
            row, column = np.nonzero(met >= 0)
            gap = self.x[met[row, column]] - queries[going[row]]
            far[going[row], column] = np.einsum("nd,nd->n", gap, gap)
            new[going] = met
            best, near = np.hstack([best, new]), np.hstack([near, far])
            passed = np.hstack([passed, new < 0])
            if best.shape[1] > beam:
                left = np.argpartition(near, beam - 1, axis=1)[:, :beam]
                best, near, passed = (np.take_along_axis(v, left, 1) for v in (best, near, passed))
        order = np.argsort(near, axis=1, kind="stable")
        best, near = best[every[:, None], order], near[every[:, None], order]
        return np.where(np.isfinite(near), best, -1), near


def prune(
    x: np.ndarray, of: np.ndarray, found: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """At most ``degree`` diverse neighbours of the nodes ``of`` among the candidates ``found``."""
    found = _once(np.where(found == of[:, None], -1, found))
    near = np.where(found >= 0, _apart(x, x[of], found), np.inf)
    order = np.argsort(near, axis=1, kind="stable")
    found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
    used = max(int((found >= 0).sum(axis=1).max(initial=0)), 1)
    step = max(1, _GAPS // used**2)
    if len(of) > step:
        parts = range(0, len(of), step)
        return np.concatenate(
            [prune(x, of[k : k + step], found[k : k + step, :used], degree, alpha) for k in parts]
        )
    found, near = found[:, :used], near[:, :used]
    # as seen from the node, so that vectors that lie close together can be told apart
    points = x[found] - x[of][:, None, :]
    square = np.einsum("nmd,nmd->nm", points, points)
    between = square[:, :, None] + square[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    alive = found >= 0
    kept = np.full((len(of), degree), -1, np.int32)
    row = np.arange(len(of))
    for k in range(degree):
        first = alive.argmax(axis=1)
        some = alive[row, first]
        if not some.any():
            break
        kept[some, k] = found[row, first][some]
        alive &= alpha * alpha * between[row, first] > near
        alive[row, first] = False
    return kept


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Graph:
    """Graph over the distinct vectors ``x``, inserted in their order after the most central one."""
    n = len(x)
    middle = x - x.mean(axis=0)
    first = int(np.einsum("nd,nd->n", middle, middle).argmin())
    order = np.concatenate([[first], np.delete(np.arange(n), first)])
    graph = Graph(x, np.full((n, degree), -1, np.int32), np.array([first]))
    done = 1
    while done < n:
        # the first insertions few at a time, as they cannot see each other
        of = order[done : done + min(max(done, 8), _BATCH)]
        found, _ = graph.search(x[of], beam)
        if done <= 4 * degree:
            found = np.hstack([found, np.broadcast_to(of, (len(of), len(of)))])
        kept = prune(x, of, found, degree, alpha)
        graph.edges[of] = kept
        _link_back(graph, of, kept, alpha)
        done += len(of)
    graph.entries = np.concatenate([[first], _unreached(graph, first)])
    return graph


def _link_back(graph: Graph, of: np.ndarray, kept: np.ndarray, alpha: float) -> None:
    """Edges from the kept neighbours back to the nodes ``of``."""
    degree = graph.edges.shape[1]
    row, _ = np.nonzero(kept >= 0)
    to, back = kept[kept >= 0].astype(np.int64), of[row]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    start = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    count = np.diff(np.append(start, len(to)))
    # nodes with about as many new edges are pruned together
    for least in (1 << k for k in range(int(count.max(initial=0)).bit_length())):
        group = np.flatnonzero((count >= least) & (count < 2 * least))
        step = max(1, 8192 // (least + degree))
        for lo in range(0, len(group), step):
            some = group[lo : lo + step]
            most = int(count[some].max())
            place = start[some][:, None] + np.arange(most)
            new = np.where(
                np.arange(most) < count[some][:, None], back[np.minimum(place, len(back) - 1)], -1
            )
            node = to[start[some]]
            found = _once(np.hstack([graph.edges[node], new]).astype(np.int64))
            full = (found >= 0).sum(axis=1) > degree
            loose = np.sort(found[~full], axis=1)[:, ::-1][:, :degree]
            graph.edges[node[~full]] = loose
            if full.any():
                graph.edges[node[full]] = prune(graph.x, node[full], found[full], degree, alpha)


def _unreached(graph: Graph, first: int) -> np.ndarray:
    """Nodes to enter by besides ``first``, so that every node can be reached."""
    reached = np.zeros(len(graph.x), bool)
    extra: list[int] = []
    front = np.array([first])
    while True:
        while len(front):
            reached[front] = True
            after = graph.edges[front].reshape(-1)
            after = np.unique(after[after >= 0])
            front = after[~reached[after]]
        missing = np.flatnonzero(~reached)
        if not len(missing):
            return np.array(extra, np.int64)
        extra.append(int(missing[0]))
        front = missing[:1]


# --- shards --------------------------------------------------------------------------------------

_INDEX = "shard bigint, dims int, ids binary, node binary, vectors binary, edges binary, entries binary"


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def _smallest(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of vectors: row number, number of its vector, and place among its ids.

    A row that repeats the one before it, key and vector, has a place past ``k``.
    """
    order = np.lexsort([ids, *x.T[::-1]])
    x, ids = x[order], ids[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]).any(axis=1)))
    again = np.concatenate(([False], (ids[1:] == ids[:-1]) & ~new[1:]))
    node = np.cumsum(new) - 1
    count = np.cumsum(~again) - 1
    place = count - count[np.searchsorted(node, node)]
    return order, node, np.where(again, k + 1, place)


def _thin(k: int):
    """Leaves at most ``k + 1`` rows of a vector that is frequent in the rows of a task.

    Rows of a vector that a batch holds more often than that wait for the end of the task.
    """

    def cut(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows to keep, and which of those belong to frequent vectors."""
        rows, frequent = [], []
        size, ids = batch["dims"].to_numpy(), batch["key"].to_numpy()
        vectors = batch["vector"].combine_chunks()
        for dims in np.unique(size):
            own = np.flatnonzero(size == dims)
            order, node, place = _smallest(_matrix(vectors.take(pa.array(own)), dims), ids[own], k)
            keep = place <= k
            rows.append(own[order[keep]])
            frequent.append((np.bincount(node)[node] > k + 1)[keep])
        return np.concatenate(rows), np.concatenate(frequent)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rows, frequent = cut(table)
            yield from table.take(pa.array(rows[~frequent])).to_batches()
            if frequent.any():
                more = table.take(pa.array(rows[frequent]))
                waiting = more if waiting is None else pa.concat_tables([waiting, more])
                waiting = waiting.take(pa.array(cut(waiting)[0]))
        if waiting is not None:
            yield from waiting.combine_chunks().to_batches()

    return thin


def _shard_builder(k: int, degree: int, beam: int, alpha: float):
    def shard_graph(key: tuple, table: pa.Table) -> pa.Table:
        dims, shard = key[0].as_py(), key[1].as_py()
        x, ids = _matrix(table["vector"].combine_chunks(), dims), table["key"].to_numpy()
        order, node, place = _smallest(x, ids, k)
        x = x[order][np.concatenate(([True], node[1:] != node[:-1]))]
        ids, node = ids[order][place <= k], node[place <= k]
        # vectors next to each other in this order are alike; insertion wants them mixed
        mixed = np.random.default_rng(0).permutation(len(x))
        named = np.empty(len(x), np.int64)
        named[mixed] = np.arange(len(x))
        x, node = x[mixed], named[node]
        order = np.argsort(node, kind="stable")
        ids, node = ids[order], node[order]
        graph = build(x, degree, beam, alpha)
        parts = (ids, node, x, graph.edges, graph.entries)
        return pa.table(
            [[shard], pa.array([dims], pa.int32()), *([p.tobytes()] for p in parts)],
            names=[c.split()[0] for c in _INDEX.split(", ")],
        )

    return shard_graph


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and ``vector`` of the rows that take part."""
    finite = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    return df.select(
        F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{vector}`").alias("vector")
    ).where(F.col("key").isNotNull() & finite & F.exists("vector", lambda v: v != 0))


def build_index(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    shard_rows: int = SHARD_ROWS,
    degree: int = DEGREE,
    beam: int = BEAM,
    alpha: float = ALPHA,
) -> DataFrame:
    """One row per shard; serves searches for up to ``k`` neighbours."""
    rows = _clean(df, key, vector)
    shards = max(1, -(-rows.count() // shard_rows))
    # as numbers with 0.0 added, so that -0.0 goes where 0.0 goes
    hashed = F.xxhash64(F.transform("vector", lambda v: v.cast("double") + F.lit(0.0)))
    dealt = rows.select(
        "key", "vector", F.size("vector").alias("dims"), F.pmod(hashed, F.lit(shards)).alias("shard")
    )
    same = Window.partitionBy("dims", "shard", "vector").orderBy("key")
    few = (
        dealt.mapInArrow(_thin(k), dealt.schema)
        # one shuffle serves the window and the shards
        .repartition(min(shards, MOST_PARTS), "dims", "shard")
        .withColumn("place", F.dense_rank().over(same))
        .where(F.col("place") <= k + 1)
        .drop("place")
    )
    built = few.groupBy("dims", "shard").applyInArrow(
        _shard_builder(k, degree, beam, alpha), _INDEX
    )
    return saved(built, "graphs")


@dataclass
class Shard:
    """One index row, read back."""

    graph: Graph
    ids: np.ndarray
    start: np.ndarray  # of the rows of each node in ``ids``

    @staticmethod
    def of(batch: pa.RecordBatch, row: int) -> Shard:
        def numbers(name: str, kind) -> np.ndarray:
            return np.frombuffer(batch.column(name)[row].as_py(), kind)

        dims = batch.column("dims")[row].as_py()
        x = numbers("vectors", np.float64).reshape(-1, dims)
        node = numbers("node", np.int64)
        edges = numbers("edges", np.int32).reshape(len(x), -1)
        start = np.searchsorted(node, np.arange(len(x) + 1))
        graph = Graph(x, edges, numbers("entries", np.int64))
        return Shard(graph, numbers("ids", np.int64), start)

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, beam: int):
        """Query number, id and distance of the ``k`` nearest rows of every query."""
        n, nodes = len(queries), len(self.graph.x)
        if nodes <= beam:
            return self._best(queries, own, np.broadcast_to(np.arange(nodes), (n, nodes)), k)
        found, _ = self.graph.search(queries, beam)
        at, ids, far = self._best(queries, own, found, k)
        # a beam that cannot name k rows, though the shard may have them: look at all nodes
        short = np.flatnonzero(np.bincount(at, minlength=n) < k)
        if not len(short):
            return at, ids, far
        enough = ~np.isin(at, short)
        parts = [(at[enough], ids[enough], far[enough])]
        for q in short:
            every = np.arange(nodes)[None, :]
            row, more, gap = self._best(queries[[q]], own[[q]], every, k)
            parts.append((row + q, more, gap))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _best(self, queries: np.ndarray, own: np.ndarray, found: np.ndarray, k: int):
        query, column = np.nonzero(found >= 0)
        node = found[query, column]
        gap = self.graph.x[node] - queries[query]
        far = np.sqrt(np.einsum("nd,nd->n", gap, gap))
        count = self.start[node + 1] - self.start[node]
        at = np.repeat(self.start[node], count)
        at += np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        query, far, ids = np.repeat(query, count), np.repeat(far, count), self.ids[at]
        other = ids != own[query]
        return first_k(query[other], ids[other], far[other], k)


def first_k(query: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int):
    """The ``k`` nearest rows of every query, ties to smaller ids."""
    order = np.lexsort([ids, far, query])
    query, ids, far = query[order], ids[order], far[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], far[keep]


def _search_block(index: DataFrame, queries: list, k: int, beam: int) -> DataFrame:
    """The ``k`` nearest rows of every query of a block, per task that reads the index."""
    by_dims: dict[int, list] = {}
    for key, vector in queries:
        by_dims.setdefault(len(vector), []).append((key, vector))
    block = {
        dims: (np.array([q[0] for q in own], np.int64), np.array([q[1] for q in own], np.float64))
        for dims, own in by_dims.items()
    }
    sent = index.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch.column("dims")[row].as_py()
                if dims not in sent.value:
                    continue
                keys, vectors = sent.value[dims]
                shard = Shard.of(batch, row)
                found = [held[dims]] if dims in held else []
                for lo in range(0, len(keys), _BATCH):
                    some = slice(lo, lo + _BATCH)
                    at, ids, far = shard.nearest(vectors[some], keys[some], k, beam)
                    found.append((at + lo, ids, far))
                held[dims] = first_k(*(np.concatenate(p) for p in zip(*found, strict=True)), k)
        for dims, (at, ids, far) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(sent.value[dims][0][at]), pa.array(np.full(len(at), dims, np.int32)),
                 pa.array(at), pa.array(ids), pa.array(far)],
                names=["query_id", "dims", "place", "vec_id", "score"],
            )

    return index.mapInArrow(
        search, "query_id bigint, dims int, place bigint, vec_id bigint, score double"
    )


def search_index(
    index: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    beam: int = 2 * BEAM,
    block: int = BLOCK,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``k`` nearest rows of every query."""
    doubles = F.transform("vector", lambda v: v.cast("double")).alias("vector")
    asked = saved(_clean(queries, key, vector).select("key", doubles).distinct(), "queries")
    blocks = max(1, -(-2 * asked.count() // block))  # half full on average
    part = F.pmod(F.xxhash64("key", "vector"), F.lit(blocks))
    found = None
    for number in range(blocks):
        rows = asked.where(part == number).collect()
        for lo in range(0, len(rows), block):
            some = saved(_search_block(index, rows[lo : lo + block], k, beam), "found")
            some = some.withColumn("block", F.lit(f"{number} {lo}"))
            found = some if found is None else found.union(some)
    if found is None:
        found = _search_block(index, [], k, beam).withColumn("block", F.lit(""))
    best = Window.partitionBy("block", "dims", "place").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(
    df: DataFrame,
    queries: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The ``k`` rows of ``df`` nearest to every row of ``queries``."""
    index = build_index(df, key, vector, k, shard_rows)
    return search_index(index, queries, key, vector, k)
