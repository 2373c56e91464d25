"""Near-duplicate texts by BagMinHash signatures of their weighted word shingles.

**Signature.** A text is a bag of five-word shingles with counts. For every shingle, Poisson
processes run over its weight axis, cut into dyadic levels (0, 1], (1, 2], (2, 4], ...: a level of
width w gives points at rate w, each with a place on the axis, and a point counts if its place lies
below the shingle's count. Every point falls to one of the signature's components, which keeps the
earliest. Two signatures then agree in a component with a probability equal to the weighted Jaccard
similarity. Points of a process come in order of time and stop once they are later than every
component of the text, so a text costs about (shingles + components * log components) points.

**Links.** 24 bands of five components; texts alike to 0.8 share no band with probability 7e-5 at
the threshold, less above it. All 120 components are kept as 16-bit numbers. A pair is compared, on
whole bags and exactly, only if at least ``LEAST_AGREE`` of them agree (at a similarity of 0.8 that
fails with probability 3e-5); so of texts that merely share a passage none are moved.

First every text of a bucket meets a leader, the one that shares most places with others; links join
texts to components. A bucket whose texts then lie in one component is settled. The others go to a
task each, signatures only, to find the texts that agree enough with one of another component; a
pair belongs to the first bucket it shares. Those texts, once per bucket, meet in a task that
compares their bags and gives the links that join components, so a group of n texts gives at most
n - 1 links, however many pairs were compared. An unsettled bucket of more than ``CROWDED`` texts goes
to several tasks: its texts are dealt into blocks, and every two blocks meet in one of them, so each of
its pairs is compared, in bounded memory.

Texts and signatures are moved only for nodes that share a bucket, and at the end for rows that may
have to go: a filter of hashed keys goes ahead of these joins, so what is written grows with the copies.

Exact copies (equal word sequences) are one node from the start. Hot buckets and hot nodes only
meet in joins whose other side is one row per key and a fresh exchange, which the runtime can
split. Nothing but counts comes to the driver.

Cases: a null text counts as empty; texts without a word are copies of each other. Texts of fewer
than five words have one shingle. The class id is the smallest key of the class (null if all keys
are null); of rows with the class's smallest key, one with the smallest row number is kept. Keys
may be null or repeat. Nodes are 64-bit hashes of word sequences. Other columns stay as they are.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.llm.shared import likely, saved, without
from duecall.llm.text import flat, mix, runs, shingles, slices, span_hashes, uniform, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
# 0.65 of the components
LEAST_AGREE = 78
CROWDED = 20_000


def bags(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
    """Distinct shingles, their counts and rows, ordered by row; and each row's node."""
    start, end, row = words(data, offsets)
    hashes = span_hashes(data, start, end)
    node = np.full(len(offsets) - 1, 0x51ED270B, np.uint64)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, node.view(np.int64)
    first, count = runs(row)
    place = (np.arange(len(row)) - np.repeat(first, count)).astype(np.uint64)
    spread = mix(hashes + place * np.uint64(0xD6E8FEB86659FD93))
    node[row[first]] = mix(np.add.reduceat(spread, first) + count.astype(np.uint64))
    shingle, owner = shingles(hashes, row, size)
    order = np.argsort(shingle, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    shingle, owner = shingle[order], owner[order]
    change = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(np.concatenate(([True], change)))
    return shingle[at], np.diff(np.append(at, len(shingle))), owner[at], node.view(np.int64)


def signatures(shingle: np.ndarray, weight: np.ndarray, row: np.ndarray, n: int, size: int) -> np.ndarray:
    """Earliest point of every component, one row per text; rows without shingles stay infinite."""
    best = np.full((n, size), np.inf)
    # one process per shingle and dyadic level below its weight
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1
    lane = np.repeat(np.arange(len(shingle)), levels)
    level = np.arange(len(lane)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    width = np.where(level == 0, 1.0, low)
    seed = mix(shingle[lane] + level.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    reach = weight[lane] - low
    owner = row[lane]
    time = np.zeros(len(lane))
    point = 0
    while len(time):
        point += 1
        draw = mix(seed + np.uint64(point * 0x165667B19E3779F9 % (1 << 64)))
        time = time - np.log(uniform(draw)) / width
        inside = uniform(draw ^ np.uint64(0xE7037ED1A0B428DB)) * width < reach
        component = (mix(draw ^ np.uint64(0x8EBC6AF09C88C6E3)) % np.uint64(size)).astype(np.int64)
        place = owner * size + component
        np.minimum.at(best.reshape(-1), place[inside], time[inside])
        late = best.max(axis=1)
        go = time < late[owner]
        seed, width, reach, owner, time = (x[go] for x in (seed, width, reach, owner, time))
    return best


def band_keys(best: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band; keys of different bands differ."""
    bits = best.view(np.uint64).reshape(len(best), bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9FB21C651E98DF25)
    key = np.broadcast_to(key, bits.shape[:2])
    for k in range(rows):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + bits[:, :, k])
    return key.view(np.int64)


def short_signs(best: np.ndarray) -> np.ndarray:
    """16 bits of every component."""
    return (mix(best.view(np.uint64)) >> np.uint64(48)).astype("<u2")


@F.arrow_udf(T.IntegerType())
def agreement(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Components in which two signatures agree."""
    for a, b in pairs:
        if not len(a):
            yield pa.array([], pa.int32())
            continue
        left, right = (np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(len(x), -1) for x in (a, b))
        yield pa.array((left == right).sum(axis=1).astype(np.int32))


_SKETCH = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("sign", T.BinaryType()),
    ]
)


@F.arrow_udf(_SKETCH)
def _sketch(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        nodes, sizes, keys, signs = [], [], [], []
        for lo, hi in slices(column):
            shingle, weight, row, node = bags(*flat(column.slice(lo, hi - lo)))
            best = signatures(shingle, weight, row, hi - lo, BANDS * ROWS)
            nodes.append(node)
            sizes.append(np.bincount(row, weight, hi - lo).astype(np.int64))
            keys.append(band_keys(best).reshape(-1))
            signs += [row.tobytes() for row in short_signs(best)]
        n = len(column)
        bands = pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1) * BANDS, pa.int32()),
            pa.array(np.concatenate(keys) if keys else [], pa.int64()),
        )
        parts = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (nodes, sizes)]
        signs = pa.array(signs, pa.binary())
        yield pa.StructArray.from_arrays([*parts, bands, signs], ["node", "size", "bands", "sign"])


@F.arrow_udf(T.DoubleType())
def weighted_jaccard(left: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Exact weighted Jaccard similarity of the shingle bags of two texts."""
    for a, b in left:
        out = np.zeros(len(a))
        at = 0
        # slices that suit both columns
        edges = sorted({hi for x in (a, b) for _, hi in slices(x)})
        for hi in edges:
            out[at:hi] = _similarity(a.slice(at, hi - at), b.slice(at, hi - at))
            at = hi
        yield pa.array(out)


def _similarity(a: pa.Array, b: pa.Array) -> np.ndarray:
    n = len(a)
    keys, counts, rows = [], [], []
    for column in (a, b):
        shingle, weight, row, _ = bags(*flat(column))
        keys.append(mix(shingle + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        counts.append(weight)
        rows.append(row)
    _, i, j = np.intersect1d(*keys, assume_unique=True, return_indices=True)
    both = np.bincount(rows[0][i], np.minimum(counts[0][i], counts[1][j]), n)
    total = sum(np.bincount(r, c, n) for r, c in zip(rows, counts, strict=True))
    return np.where(total > 0, both / np.maximum(total - both, 1), 1.0)


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp`` (the smallest node it is linked with) of all nodes in ``edges`` (``a``,
    ``b``), by alternating stars: neighbours move to the smallest node of a neighbourhood."""
    stars = saved(edges.select("a", "b").where("a <> b").distinct(), "edges")
    mark = None
    while True:
        seen = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = saved(
            both.join(least, "a")
            .where("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct(),
            "large",
        )
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = saved(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = (
            down.join(least, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
        )
        stars = saved(small.distinct(), "stars")
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(roots)


def _compare(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``a``, ``b`` and whether they are linked."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    met = pairs.join(left, "a").join(right, "b")
    linked = weighted_jaccard("left", "right") >= least
    return saved(met.select("a", "b", linked.alias("linked")), "compared")


def _fits(least: float) -> Column:
    """A link needs sizes within the threshold of each other."""
    return F.expr(f"least(size, other) >= {least} * greatest(size, other)")


def _close_pairs(table: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a tile, across components, that agree and belong to its bucket; all pairs of
    a row come together. In a tile of two blocks each pair has a row of either."""
    size, comp, block = (table[c].to_numpy() for c in ("size", "comp", "block"))
    n = len(size)
    key, two = table["key"][0].as_py(), block.min() != block.max()
    sign = np.frombuffer(b"".join(table["sign"].to_pylist()), "<u2").reshape(n, -1)
    bands = pc.list_flatten(table["bands"].combine_chunks()).to_numpy().reshape(n, -1)
    step = max(1, 1_000_000 // n)
    for lo in range(0, n, step):
        some = slice(lo, lo + step)
        other = comp[some, None] != comp[None, :]
        other &= np.minimum(size[some, None], size) >= least * np.maximum(size[some, None], size)
        other &= np.arange(n) > np.arange(n)[some, None]
        if two:
            other &= block[some, None] != block[None, :]
        left, right = [], []
        i, j = np.nonzero(other)
        for at in range(0, len(i), 50_000):
            x, y = i[at : at + 50_000] + lo, j[at : at + 50_000]
            close = (sign[x] == sign[y]).sum(axis=1) >= LEAST_AGREE
            x, y = x[close], y[close]
            shared = (bands[x] == bands[y]).argmax(axis=1)
            own = bands[x, shared] == key
            left.append(x[own])
            right.append(y[own])
        if left:
            yield np.concatenate(left), np.concatenate(right)


def _met(least: float):
    def find(table: pa.Table) -> pa.Table:
        met = np.zeros(table.num_rows, bool)
        for x, y in _close_pairs(table, least):
            met[x] = met[y] = True
        return table.select(["tile", "node"]).filter(pa.array(met))

    return find


def _joining(least: float):
    """Links of a tile's texts that join components."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, comp = table["node"].to_numpy(), table["comp"].to_numpy()
        shingle, weight, row, _ = bags(*flat(table["text"].combine_chunks()))
        kinds, shingle = np.unique(shingle, return_inverse=True)
        edge = np.searchsorted(row, np.arange(len(node) + 1))
        total = np.bincount(row, weight, len(node))
        names, group = np.unique(comp, return_inverse=True)
        left, right = [], []
        for x, y in _close_pairs(table, least):
            mine = np.zeros(len(kinds))
            start, count = runs(x)
            for at, n in zip(start.tolist(), count.tolist(), strict=True):
                i, others = int(x[at]), y[at : at + n]
                others = others[group[others] != group[i]]
                if not len(others):
                    continue
                own = slice(edge[i], edge[i + 1])
                mine[shingle[own]] = weight[own]
                size = edge[others + 1] - edge[others]
                place = np.repeat(edge[others] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                of = np.repeat(np.arange(len(others)), size)
                both = np.bincount(of, np.minimum(mine[shingle[place]], weight[place]), len(others))
                mine[shingle[own]] = 0
                union = total[i] + total[others] - both
                for j in others[both >= least * union].tolist():
                    if group[j] != group[i]:
                        left.append(node[i])
                        right.append(node[j])
                        group[group == group[j]] = group[i]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return join


def _tiled(rest: DataFrame, most: int) -> DataFrame:
    """``rest`` (``key``, ``node``, ``size``) with the task each row goes to: ``tile`` and ``block``.

    A bucket of more than ``most`` texts is dealt into blocks of about half as many, and a tile holds
    two blocks, or one for the pairs within it; so every pair of a bucket meets in exactly one tile.
    """
    counted = rest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = saved(rest.join(counted, "key"), "parts")
    whole = sized.where(F.col("n") <= most).drop("n")
    whole = whole.select("*", F.col("key").alias("tile"), F.lit(0).cast("bigint").alias("block"))
    blocks = F.expr(f"bigint(ceil(2 * n / {most}))")
    dealt = sized.where(F.col("n") > most).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return whole.union(met.select(*rest.columns, tile.alias("tile"), "block"))


def _links(sketched: DataFrame, least: float, most_texts: int = CROWDED) -> DataFrame:
    """Components of nodes that are linked to another; ``sketched`` has ``row``, ``node``, ``size``,
    ``bands``, ``sign`` and ``text``."""
    nodes = saved(
        sketched.groupBy("node").agg(
            F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("size", "bands", "sign")]
        ),
        "nodes",
    )
    keyed = nodes.select("node", "size", F.explode("bands").alias("key"))
    shared = saved(
        keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"),
        "buckets",
    )
    crowded = saved(likely(keyed, shared, "key").join(shared, "key"), "crowded")
    # a text that shares many places with others is likely what they are copies of
    places = saved(crowded.groupBy("node").agg(F.sum("n").alias("rank")), "ranks")
    ranked = crowded.drop("n").join(places, "node")
    ranked = saved(ranked, "ranked")
    first_of = ranked.groupBy("key").agg(F.max_by("node", F.struct("rank", "node")).alias("leader"))
    members = saved(ranked.drop("rank").join(saved(first_of, "leaders"), "key"), "members")

    # from here on only nodes that share a bucket
    named = saved(members.select("node").distinct(), "named")
    nodes = saved(likely(nodes, named, "node").join(named, "node", "left_semi"), "met_nodes")
    signs = nodes.select("node", "sign")
    wanted = nodes.select("node", "row")
    whole = likely(sketched.select("row", "text"), wanted, "row")
    texts = saved(whole.join(wanted, "row").select("node", "text"), "texts")

    def close(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose signatures agree; a leader is met as often as it leads."""
        left, right = (signs.select(F.col("node").alias(n), F.col("sign").alias(f"sign_{n}")) for n in "ab")
        met = pairs.join(left, "a").join(right, "b").withColumn("same", agreement("sign_a", "sign_b"))
        return met.where(F.col("same") >= LEAST_AGREE).select("a", "b")

    sizes = nodes.select(F.col("node").alias("leader"), F.col("size").alias("other"))
    first = members.where("node <> leader").join(sizes, "leader").where(_fits(least))
    pairs = first.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    compared = _compare(saved(close(pairs.distinct()), "pairs"), texts, least)
    comps = saved(components(compared.where("linked").select("a", "b")), "components")

    def unsettled(rows: DataFrame, of: str) -> DataFrame:
        """Rows of the buckets or tiles whose texts lie in several components."""
        placed = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        placed = saved(placed, "placed")
        spread = placed.groupBy(of).agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        mixed = saved(spread.where("low <> high").select(of), "mixed")
        return placed.join(mixed, of)

    tiles = _tiled(unsettled(members.select("key", "node", "size"), "key").drop("comp"), most_texts)
    facts = nodes.select("node", "sign", "bands")
    spread = saved(unsettled(tiles, "tile").join(facts, "node"), "spread")
    spread = spread.select("tile", "key", "block", "node", "size", "comp", "sign", "bands")
    met = spread.groupBy("tile").applyInArrow(_met(least), "tile bigint, node bigint")
    met = saved(met, "met")
    whole = likely(spread, met, "tile", "node").join(met, ["tile", "node"]).join(texts, "node")
    joining = whole.groupBy("tile").applyInArrow(_joining(least), "a bigint, b bigint")
    links = compared.where("linked").select("a", "b").union(saved(joining, "joining"))
    return saved(components(links), "components")


def _classes(sketched: DataFrame, key: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their root, and per root its smallest key, size and the row to keep."""
    comps = _links(sketched, least)
    rooted = saved(
        sketched.select("row", F.col(f"`{key}`").alias("key"), "node")
        .join(comps, "node", "left")
        .select("row", "key", F.coalesce("comp", "node").alias("root")),
        "rooted",
    )
    # the smallest key, and the first row that has it; nulls last
    lowest = saved(
        rooted.groupBy("root").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")),
        "classes",
    )
    kept = (
        rooted.join(lowest.select("root", "class_id"), "root")
        .where("key <=> class_id")
        .groupBy("root")
        .agg(F.min("row").alias("row"))
    )
    return rooted, saved(lowest.join(kept, "root"), "kept")


def _sketched(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    held = F.struct(*[F.col(f"`{c}`") for c in columns])
    base = docs.select(held.alias("held"), F.col(f"`{text}`").alias("text"))
    found = base.withColumn("s", _sketch("text")).withColumn("row", F.monotonically_increasing_id())
    return saved(found.select("row", "held", "text", "s.node", "s.size", "s.bands", "s.sign"), "sketched")


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY
) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``class_id``, ``class_size`` and ``kept``."""
    sketched = _sketched(docs, text, [key])
    rooted, classes = _classes(sketched.withColumn(key, F.col(f"held.`{key}`")), key, least)
    classes = classes.withColumnRenamed("row", "first")
    return rooted.join(classes, "root").select(
        F.col("key").alias(key), "class_id", "class_size", (F.col("row") == F.col("first")).alias("kept")
    )


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILARITY
) -> DataFrame:
    """The rows of ``docs`` that are kept: one of each class, with all columns."""
    columns = [c for c in docs.columns if c != text]
    sketched = _sketched(docs, text, columns)
    rooted, classes = _classes(sketched.withColumn(key, F.col(f"held.`{key}`")), key, least)
    first = classes.select("root", F.col("row").alias("first"))
    gone = saved(rooted.join(first, "root").where("row <> first").select("row"), "gone")
    chosen = without(sketched.select("row", "held", "text"), gone, "row")
    return chosen.select(
        *[
            F.col("text").alias(c) if c == text else F.col(f"held.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
