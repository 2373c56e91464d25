"""Sampled segmentations with SentencePiece pieces: Gumbel top-k without replacement.

Every text has a lattice: an edge for each piece at each place, with the piece's log probability.
A segmentation's probability is the product over its edges, divided by the sum over all
segmentations. Sampling without replacement is a best-first search over sets of segmentations that
share a prefix: each set has a perturbed score, a Gumbel value located at the log of the set's
mass, and the scores of the parts of a set are drawn so that the best of them is the set's own. The
set with the best score is taken, a segmentation is drawn from it, and the rest of the set, split
by where it leaves that segmentation, goes back with smaller scores. The ``k`` segmentations that
come out first are distinct and a draw without replacement; the score of the best remaining set is
the threshold, from which follows each one's inclusion probability.

No piece crosses the start of a word, so the lattice falls apart into units, and equal units of a
slice of texts share one; what follows a place depends on the rest of its unit only, so equal rests
share their edges. Backward sums run over all units at once, by distance from the unit's end, and
drawing advances all places of a slice together. Random numbers are hashes of the row's
key, the place in the text and the number of the draw, so they do not depend on tasks or batches.

Piece probabilities: a model's scores, if it is a unigram model (``exponent`` multiplies them). The
scores of a merge model are ranks; piece r then gets the Zipf weight (r + 2.7) ** -``exponent``.
Characters without a piece fall back to byte pieces, each as likely as the rarest piece.

Cases: a null text counts as empty; an empty text has one segmentation, without pieces. A text with
fewer than ``k`` segmentations has all of them, with inclusion probability 1. Rows with equal keys
and texts get equal samples. Unused and user-defined pieces take no part. A literal ``▁`` reads
back as a blank, and a normalising model gives back the normalised text.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecall.llm.text import distinct, mix, runs, slices, span_hashes, uniform

SAMPLES = 3
SLICE = 1 << 19  # bytes of text searched together
EXPONENT = 1.0
_MARK = "▁".encode()
_NEVER = -1e8  # scores of pieces that merging cannot make


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    if not len(size) or not size.sum():
        return np.zeros(0, np.int64)
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1])


class Trie:
    """Pieces as a trie of bytes, packed: a byte leads from a node to the place ``base[node] + byte``,
    if that place's ``parent`` is the node. Nodes are places, the root is 0; ``base`` is 0 for a leaf.

    A table of all nodes and bytes would be a hundred times as large and mostly empty.
    """

    def __init__(self, texts: list[str]):
        steps: list[dict[int, int]] = [{}]
        spelled = [-1]
        for k, text in enumerate(texts):
            node = 0
            for byte in text.encode():
                if byte not in steps[node]:
                    steps[node][byte] = len(steps)
                    steps.append({})
                    spelled.append(-1)
                node = steps[node][byte]
            spelled[node] = k
        spelled[0] = -1
        taken = bytearray(256)
        taken[0] = 1
        place, base = [0] * len(steps), [0] * len(steps)
        # nodes with many children first, those with one fill what is left between them
        front, many = 1, True
        for node in sorted(range(len(steps)), key=lambda n: -len(steps[n])):
            below = sorted(steps[node])
            if not below:
                break
            if many and len(below) == 1:
                front, many = 1, False
            tried, at = 0, max(front, below[0] + 1) - 1
            while True:
                at = taken.find(0, at + 1)
                if at < 0 or at + 256 > len(taken):
                    taken.extend(bytes(len(taken)))
                    at = taken.find(0, max(front, below[0] + 1)) if at < 0 else at
                if not any(taken[at - below[0] + byte] for byte in below):
                    break
                tried += 1
            if tried > 50:
                front = at
            base[node] = at - below[0]
            for byte in below:
                taken[base[node] + byte] = 1
                place[steps[node][byte]] = base[node] + byte
            front = max(taken.find(0, front), front)
        size = max(base) + 256
        self.base, self.parent, self.piece = np.zeros(size, np.int64), *np.full((2, size), -1)
        self.base[place], self.piece[place] = base, spelled
        for node, below in enumerate(steps):
            for child in below.values():
                self.parent[place[child]] = place[node]


class Lattice:
    """Edges of units, grouped by what is left of the unit where they start: places with the same rest
    up to the end share their edges."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, pieces: "Pieces"):
        first = np.cumsum(size) - size  # where each unit starts in `text`
        self.text = data[ranges(start, size)]
        heads = np.flatnonzero((self.text & 0xC0) != 0x80)
        stop = np.repeat(first + size, size)[heads]
        after = np.minimum(np.append(heads[1:], len(self.text)), stop)
        _, one, number = distinct(span_hashes(self.text, heads, stop))
        # groups of edges, one per distinct rest, in the order in which backward sums need them
        left = (stop - heads)[one]
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        group_at = np.zeros(len(self.text) + 1, np.int64)
        group_at[heads] = rank.take(number)
        self.first = group_at[first]  # the group of each unit's start
        one, left = one[order], left[order]
        heads, stop, after = heads[one], stop[one], after[one]
        ends, single, used = self._edges(heads, stop, after, pieces.trie)
        bare = np.flatnonzero(~single)
        used[bare] += 1
        count = used
        place = np.cumsum(count) - count
        end = np.empty(int(count.sum()), np.int64)
        piece = np.full(len(end), -1)
        for source, nth, to, which in ends:
            at = place.take(source) + nth
            end[at], piece[at] = to, which
        lone = (place + count - 1)[bare]
        end[lone] = after[bare]
        self.group = group = np.repeat(np.arange(len(heads)), count)
        self.heads, self.left, self.edge, self.count = heads, left, place, count
        self.ahead = left.take(group)  # what is left where an edge starts
        chance = pieces.chance.take(piece)
        fallback = pieces.byte_log * (after[bare] - heads[bare])
        chance[lone] = np.exp(fallback)
        closes = end == stop.take(group)
        # what closes a unit goes to a group of its own
        onward = np.where(closes, len(heads), group_at.take(end))
        mass, share, beta = np.ones(len(heads) + 1), np.empty(len(end)), None
        block, sizes = runs(left)
        easy = int(np.searchsorted(left, pieces.plain, "right"))
        for a, n in zip(block.tolist(), sizes.tolist(), strict=True):
            lo, hi = place[a], place[a + n - 1] + count[a + n - 1]
            at = place[a : a + n] - lo
            if a < easy:
                w = share[lo:hi] = chance[lo:hi] * mass.take(onward[lo:hi])
                mass[a : a + n] = np.add.reduceat(w, at)
                continue
            # a sum over many bytes is too small for a number: its log is kept
            if beta is None:
                beta = np.log(mass)
                weight = pieces.log[piece]
                weight[lone] = fallback
            w = weight[lo:hi] + beta[onward[lo:hi]]
            top = np.maximum.reduceat(w, at)
            total = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, count[a : a + n])), at))
            beta[a : a + n] = total
            share[lo:hi] = np.exp(w - np.repeat(total, count[a : a + n]))
        known = int(count[:easy].sum())
        share[:known] /= mass.take(group[:known])
        # likely edges first, so that a draw looks at few of them
        order = np.argsort(2.0 * group - share)
        self.end, self.piece, self.share = end.take(order), piece.take(order), share.take(order)
        # the group an edge leads to, below 0 if it closes its unit
        onward[closes] = -1
        self.onward = onward.take(order)
        sums = np.concatenate(([0.0], np.cumsum(self.share)))
        self.upto = sums[1:] - sums.take(place).take(group)
        self.upto[place + count - 1] = 2.0  # the last edge takes what rounding leaves

    def _edges(self, heads: np.ndarray, stop: np.ndarray, after: np.ndarray, trie: Trie):
        """Per length the pieces found (number of the head, how many it had before, end, piece);
        whether a head has a piece of one character, and how many pieces it has."""
        source, cur, node = np.arange(len(heads)), heads, np.zeros(len(heads), np.int64)
        single, used, found = np.zeros(len(heads), bool), np.zeros(len(heads), np.int64), []
        base = trie.base[node]
        while len(source):
            to = base + self.text[cur]
            on = np.flatnonzero(trie.parent[to] == node)
            source, cur, node = source[on], cur[on] + 1, to[on]
            piece = trie.piece[node]
            hit = np.flatnonzero(piece >= 0)
            of, end = source[hit], cur[hit]
            nth = used[of]
            found.append((of, nth, end, piece[hit]))
            used[of] = nth + 1
            # no character has more than four bytes
            if len(found) <= 4:
                single[of[end == after[of]]] = True
            base = trie.base[node]
            more = np.flatnonzero((base > 0) & (cur < stop[source]))
            source, cur, node, base = source[more], cur[more], node[more], base[more]
        return found, single, used

    def draw(self, group: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each group, with its probability."""
        at = self.edge.take(group)
        on = np.flatnonzero(self.upto.take(at) <= u)
        while len(on):
            at[on] += 1
            on = on[self.upto[at[on]] <= u[on]]
        return at


class Pieces:
    """Pieces, their ids and log probabilities, from a serialized SentencePiece model."""

    def __init__(self, proto: bytes, exponent: float = EXPONENT):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.vocab_size()
        plain = [
            i
            for i in range(n)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
            and not model.is_unused(i)
            # single characters always take part, in a merge model too
            and (model.get_score(i) > _NEVER or len(model.id_to_piece(i)) == 1)
        ]
        text = [model.id_to_piece(i) for i in plain]
        if any("▁" in t[1:] for t in text):
            raise ValueError("a piece goes on past the start of a word")
        score = np.array([model.get_score(i) for i in plain])
        if np.array_equal(score, np.round(score)):
            weight = -exponent * np.log(np.argsort(np.argsort(-score)) + 2.7)
            self.log = weight - np.log(np.exp(weight).sum())
        else:
            self.log = exponent * score
        self.chance = np.exp(self.log)
        self.byte_log = float(self.log.min())
        # bytes whose probability is still a number, however unlikely
        self.plain = int(600 / max(-self.byte_log, 1e-9))
        self.ids = np.array(plain, np.int32)
        self.trie = Trie(text)
        self.bytes = np.zeros(256, np.int32)
        spelled = [b""] * n
        for i, t in zip(plain, text, strict=True):
            spelled[i] = t.replace("▁", " ").encode()
        for i in range(n):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
                spelled[i] = bytes([int(model.id_to_piece(i)[3:5], 16)])
        self.spelled = pa.array(spelled, pa.large_binary())
        inside = {b for t in text if len(t) > 1 for b in t.encode()}
        self.lone = np.array([b < 128 and b not in inside for b in range(256)])

    def units(self, data: np.ndarray, offsets: np.ndarray):
        """Start, size and row of the units: a word mark or a sign that only stands alone starts
        one, and so does what follows such a sign."""
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, none
        lone = self.lone[data]
        begins = lone.copy()
        begins[:-2] |= (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
        begins[1:] |= lone[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        start = np.flatnonzero(begins)
        return (
            start,
            np.diff(np.append(start, len(data))),
            np.searchsorted(offsets, start, "right") - 1,
        )

    def spell(self, edges: np.ndarray, at: np.ndarray, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of edges, and where those of the edges from ``at`` on begin (a fallback has one per byte)."""
        piece = lattice.piece.take(edges)
        ids = self.ids.take(piece)
        bare = np.flatnonzero(piece < 0)
        if not len(bare):
            return ids, at
        begin = lattice.heads[lattice.group[edges[bare]]]
        more = lattice.end[edges[bare]] - begin - 1
        ids[bare] = self.bytes[lattice.text[begin]]
        behind = np.repeat(bare, more)
        ids = np.insert(ids, behind + 1, self.bytes[lattice.text[ranges(begin + 1, more)]])
        return ids, at + np.searchsorted(behind, at)

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """Texts of the id lists ``ids[edges[i]:edges[i + 1]]``."""
        _, offsets, data = self.spelled.take(pa.array(ids)).buffers()
        raw = memoryview(data or b"")
        at = np.frombuffer(offsets, np.int64)[edges] if len(ids) else edges
        texts = [
            str(raw[a:b], "utf-8", "replace")
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
        ]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def _seeds(seed: np.ndarray, draw: int, use: int) -> np.ndarray:
    """Of a draw, per row."""
    return mix(seed + np.uint64((2 * draw + use + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))


def _spread(place: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)


def _random(seeds: np.ndarray, place: np.ndarray) -> np.ndarray:
    return uniform(seeds + _spread(place))


class _Search:
    """The search for one slice of texts."""

    def __init__(self, pieces: Pieces, data: np.ndarray, offsets: np.ndarray, seed: np.ndarray):
        self.pieces, self.seed = pieces, seed
        self.n = len(offsets) - 1
        start, size, self.row = pieces.units(data, offsets)
        hashes = span_hashes(data, start, start + size)
        _, first, self.unit = distinct(hashes)
        self.lattice = Lattice(data, start[first], size[first], pieces)
        # where each unit ends in the row's text
        self.stop = start + size - offsets[self.row]
        self.paths: list[dict] = []

    def place(self, edges: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
        """Where edges of occurrences start in the row's text."""
        return self.stop.take(occurrence) - self.lattice.ahead.take(edges)

    def walk(self, occurrence: np.ndarray, at: np.ndarray, draw: int):
        """Edges from group ``at`` (below 0: none) to the end of each occurrence, and how many each has."""
        lattice, steps = self.lattice, []
        counts = np.zeros(len(occurrence), np.int64)
        # a place is what is left there off the end; the end's part of a seed stays the same on the way
        seed = _seeds(self.seed, draw, 0)[self.row[occurrence]] + _spread(self.stop[occurrence])
        off = _spread(lattice.left)
        lane = np.flatnonzero(at >= 0)
        at, seed = at[lane], seed[lane]
        while len(lane):
            edge = lattice.draw(at, uniform(seed - off.take(at)))
            steps.append((lane, edge))
            counts[lane] = len(steps)
            at = lattice.onward.take(edge)
            go = np.flatnonzero(at >= 0)
            lane, at, seed = lane.take(go), at.take(go), seed.take(go)
        first = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for k, (lane, edge) in enumerate(steps):
            out[first.take(lane) + k] = edge
        return out, counts

    def start(self) -> None:
        occurrence = np.arange(len(self.unit))
        edges, counts = self.walk(occurrence, self.lattice.first[self.unit], 0)
        u = uniform(mix(self.seed ^ np.uint64(0x2D358DCCAA6C78A5)))
        none = np.zeros(0, np.int64)
        self.add(
            edges,
            np.repeat(occurrence, counts),
            -np.log(-np.log(u)),
            np.full(self.n, -1),
            (none, none),
            np.ones(self.n, bool),
        )

    def remaining(self, group: np.ndarray, barred: tuple[np.ndarray, np.ndarray]):
        """All edges of the groups, the number of the group each is listed for, where the groups'
        lists start, and the shares; of ``barred`` (number, edge) the share is 0."""
        lattice, (of, edge) = self.lattice, barred
        count = lattice.count[group]
        start = np.cumsum(count) - count
        edges = ranges(lattice.edge[group], count)
        share = lattice.share[edges].copy()
        share[start[of] + edge - lattice.edge[group[of]]] = 0
        return edges, np.repeat(np.arange(len(group)), count), start, share

    def add(self, edges, occurrence, score, branch, barred, rows: np.ndarray) -> None:
        """A path per row, with the scores of the sets that leave it at each of its steps.

        ``branch`` is the step at which a row's path left another (-1: none), ``barred`` the rows
        and edges that were taken there before, in the order of rows.
        """
        number = len(self.paths)
        row = self.row[occurrence]
        edge_at = np.searchsorted(row, np.arange(self.n + 1))
        lattice = self.lattice
        share = lattice.share.take(edges)
        with np.errstate(divide="ignore"):
            before = np.concatenate(([0.0], np.cumsum(np.log(share))))
        rest = 1 - share
        left = np.flatnonzero(branch >= 0)
        if len(left):
            at = edge_at[left] + branch[left]
            barred = (np.concatenate([barred[0], left]), np.concatenate([barred[1], edges[at]]))
            order = np.argsort(barred[0], kind="stable")
            barred = (barred[0][order], barred[1][order])
            group = lattice.group[edges[at]]
            _, _, first, shares = self.remaining(group, (np.searchsorted(left, barred[0]), barred[1]))
            rest[ranges(edge_at[left], branch[left])] = 0
            rest[at] = np.add.reduceat(shares, first)
        # a step without a rest has no set that leaves the path there
        live = np.flatnonzero(rest > 0)
        size = np.diff(np.searchsorted(live, edge_at))
        where = before.take(live) - np.repeat(before[edge_at[:-1]], size) + np.log(rest.take(live))
        place = self.place(edges.take(live), occurrence.take(live))
        wait = -np.log(_random(np.repeat(_seeds(self.seed, number, 1), size), place))
        g = np.full(len(edges), -np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            g[live] = where - np.log(np.exp(where - np.repeat(score, size)) + wait)
        self.paths.append(
            {
                "edges": edges, "occurrence": occurrence, "at": edge_at, "score": score, "leave": g,
                "log": before[edge_at[1:]] - before[edge_at[:-1]], "branch": branch,
                "barred": barred, "rows": rows,
            }
        )

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Best remaining score of each row, and the path it leaves."""
        top = np.full((len(self.paths), self.n), -np.inf)
        for k, path in enumerate(self.paths):
            full = np.flatnonzero(np.diff(path["at"]))
            if len(full):
                top[k, full] = np.maximum.reduceat(path["leave"], path["at"][full])
        which = np.argmax(top, axis=0)
        return top[which, np.arange(self.n)], which

    def next(self) -> None:
        score, which = self.best()
        lattice, number = self.lattice, len(self.paths)
        rows = np.flatnonzero(score > -np.inf)
        if not len(rows):
            return
        m = len(rows)
        step, old, occurrence = (np.zeros(m, np.int64) for _ in range(3))
        heads, occ_heads, of, gone = [], [], [], []
        for k in np.unique(which[rows]).tolist():
            path = self.paths[k]
            mine = np.flatnonzero(which[rows] == k)
            own, size = rows[mine], np.diff(path["at"])
            # the first step of each row that has its best score
            reached = np.flatnonzero(path["leave"] == np.repeat(np.where(which == k, score, np.nan), size))
            row = np.searchsorted(path["at"], reached, "right") - 1
            at = reached[np.searchsorted(row, own)]
            path["leave"][at] = -np.inf
            lo = path["at"][own]
            step[mine], old[mine], occurrence[mine] = at - lo, path["edges"][at], path["occurrence"][at]
            head = ranges(lo, at - lo)
            heads.append(path["edges"][head])
            occ_heads.append(path["occurrence"][head])
            again = path["branch"][own] == at - lo
            of.append(mine[~again])
            gone.append(old[mine[~again]])
            # left where the path itself had left another: all that were taken there
            place = np.full(self.n, -1)
            place[own[again]] = mine[again]
            there = place[path["barred"][0]] >= 0
            of.append(place[path["barred"][0][there]])
            gone.append(path["barred"][1][there])
        of, gone = np.concatenate(of), np.concatenate(gone)
        order = np.argsort(of, kind="stable")
        of, gone = of[order], gone[order]
        edges, owner, first, share = self.remaining(lattice.group[old], (of, gone))
        u = _random(_seeds(self.seed[rows], number, 0), self.place(old, occurrence))
        upto = np.cumsum(share)
        before = upto[first] - share[first]
        total = np.add.reduceat(share, first)
        # the first edge that passes the drawn mass; one without a share never does
        passed = (upto - before[owner] > (u * total)[owner]) & (share > 0)
        last = np.maximum.reduceat(np.where(share > 0, np.arange(len(share)), -1), first)
        chosen = np.minimum(
            np.minimum.reduceat(np.where(passed, np.arange(len(share)), len(share)), first), last
        )
        new = edges[chosen]
        until = np.searchsorted(self.row, rows, "right")
        lane = ranges(occurrence, until - occurrence)
        begin = lattice.first[self.unit[lane]]
        head_of = np.cumsum(until - occurrence) - (until - occurrence)
        begin[head_of] = lattice.onward[new]
        tail, counts = self.walk(lane, begin, number)
        edges = np.concatenate([*heads, new, tail])
        occurrence = np.concatenate([*occ_heads, occurrence, np.repeat(lane, counts)])
        branch = np.full(self.n, -1)
        branch[rows] = step
        barred = (rows[of], gone)
        # heads come before the tails of their row, and within both the order is right
        order = np.argsort(self.row[occurrence], kind="stable")
        taken = np.zeros(self.n, bool)
        taken[rows] = True
        self.add(edges[order], occurrence[order], score, branch, barred, taken)


def sample_slice(pieces: Pieces, texts: list, seed: np.ndarray, k: int):
    """Per row a list of (ids, log probability, perturbed score, log inclusion probability)."""
    normal = pieces.model.normalize([t or "" for t in texts]) if texts else []
    raw = [t.encode() for t in normal]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in raw]))).astype(np.int64)
    out: list[list] = [[] for _ in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return [[(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for _ in texts]
    search = _Search(pieces, data, offsets, seed)
    search.start()
    while len(search.paths) < k:
        size = len(search.paths)
        search.next()
        if len(search.paths) == size:
            break
    least, _ = search.best()
    for path in search.paths:
        apart = path["log"] - least
        with np.errstate(over="ignore", divide="ignore"):
            chance = np.where(apart < -30, apart, np.log(-np.expm1(-np.exp(np.minimum(apart, 700)))))
        chance[np.isneginf(least)] = 0.0
        ids, at = pieces.spell(path["edges"], path["at"], search.lattice)
        for r in np.flatnonzero(path["rows"]).tolist():
            out[r].append(
                (ids[at[r] : at[r + 1]], float(path["log"][r]), float(path["score"][r]), float(chance[r]))
            )
    return out


_loaded: dict[tuple[int, float], Pieces] = {}


def _pieces(proto: bytes, exponent: float) -> Pieces:
    """Built once per Python worker."""
    import zlib

    key = (zlib.crc32(proto), exponent)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(proto, exponent)
    return _loaded[key]


SAMPLES_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("log_prob", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("log_inclusion", T.DoubleType()),
            T.StructField("intact", T.BooleanType()),
        ]
    )
)


def sample_segmentations(
    docs: DataFrame,
    model_proto: bytes,
    k: int = SAMPLES,
    text: str = "text",
    key: str = "doc_id",
    exponent: float = EXPONENT,
    seed: int = 0,
    into: str = "samples",
    keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) with ``into``: up to ``k`` distinct
    segmentations, best perturbed score first, each with its ids, log probability, perturbed score,
    log inclusion probability and whether its ids read back as the text. Results leave a task slice by slice."""
    held = docs.sparkSession.sparkContext.broadcast(model_proto)  # one model, a fixed input
    kept = [c for c in (docs.columns if keep is None else keep) if c != into]
    # numbered names: a task's input columns are found by name, which a dot in one would break
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    schema = T.StructType([*fields, T.StructField("samples", SAMPLES_TYPE)])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(held.value, exponent)
        for batch in batches:
            for lo, hi in slices(batch.column(0), SLICE):
                part = batch.slice(lo, hi - lo)
                seeds = part.column(1).to_numpy().astype(np.uint64)
                texts = part.column(0).to_pylist()
                found = sample_slice(pieces, texts, seeds, k)
                lists = _lists(pieces, texts, found)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], lists], schema.names)

    hashed = F.xxhash64(F.lit(seed), F.col(f"`{key}`"))
    carried = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)]
    rows = docs.select(F.col(f"`{text}`").alias("text"), hashed.alias("seed"), *carried)
    return rows.mapInArrow(sample, schema).toDF(*kept, into)


def _lists(pieces: Pieces, texts: list, found: list[list[tuple]]) -> pa.ListArray:
    """The samples of each row, and whether each reads back as its text, in which a word mark counts
    as a blank."""
    rows = [x for row in found for x in row]
    count = np.array([len(row) for row in found], np.int64)
    ids = np.concatenate([np.zeros(0, np.int32), *(x[0] for x in rows)])
    ends = np.concatenate(([0], np.cumsum([len(x[0]) for x in rows]))).astype(np.int64)
    wanted = [t for text, n in zip(texts, count.tolist()) for t in n * [(text or "").replace("▁", " ")]]
    intact = [a == b for a, b in zip(pieces.decode(ids, ends), wanted, strict=True)]
    parts = [pa.array([x[c] for x in rows], pa.float64()) for c in (1, 2, 3)]
    item = pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
            *parts,
            pa.array(intact, pa.bool_()),
        ],
        ["ids", "log_prob", "score", "log_inclusion", "intact"],
    )
    edges = np.concatenate(([0], np.cumsum(count)))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), item)


def decoder(model_proto: bytes, spark):
    """Column function that gives the text of a column of id lists; null gives the empty text."""
    held = spark.sparkContext.broadcast(model_proto)

    @F.arrow_udf("string")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(held.value, EXPONENT)
        for column in columns:
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            edges = np.concatenate(([0], np.cumsum(size)))
            ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.array(pieces.decode(ids, edges), pa.string())

    return decode
