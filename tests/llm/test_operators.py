"""Every training-data operator against brute force, and on nulls, empties, ties and repeats."""

import collections
import itertools
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duecall.llm import (
    context_mixing,
    decontaminate,
    importance,
    language_id,
    near_dedup,
    quality_rules,
    segmentation,
    token_counts,
    token_store,
    toxicity,
)
from duecall.llm.queries import model_proto, tokenizer_path
from duecall.llm.shared import likely, without
from duecall.llm.text import flat, fold_of, shingles, slices, span_hashes, words

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "a", "a", "x" * 3000, "été 日本 😀 b", "the the the the", "A\0b ▁ c"]
SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
# an input column named like a result of each operator, and one with a dot
CLASH = ["score", "n_words", "kept", "samples", "leaks", "lang_pred", "row", "node", "a.b"]
# names that helper columns bore once
HELPERS = ["__t", "__w", "__l", "__s", "__p", "__n", "__found", "__leaks_0", "___row", "part", "prefix"]


def frame(spark, texts, lang="en"):
    rows = [(i if i else None, t, lang if i % 3 else None, "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    df = frame(spark, ODD).union(frame(spark, ODD[:4]))
    for name in CLASH:
        df = df.withColumn(name, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 9)], "doc_id BIGINT, quality INT, toxic INT")


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(SF_DIR):
        pytest.skip("driver tables are absent")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def texts_of(documents):
    return [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]


# --- helpers -------------------------------------------------------------------------------------


def test_words_and_shingles():
    texts = ["", "a b", None, " one two three four five six ", "x"]
    data, offsets = flat(pa.array(texts))
    start, end, row = words(data, offsets)
    got = [(int(r), bytes(data[s:e]).decode()) for s, e, r in zip(start, end, row)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    hashes, owner = shingles(span_hashes(data, start, end), row, 5)
    assert owner.tolist() == [1, 3, 3, 4] and len(set(hashes.tolist())) == 4
    again, _ = shingles(span_hashes(*[x for x in (data, start, end)])[2:8], row[2:8], 5)
    assert again.tolist() == hashes[1:3].tolist()


def test_slices_cover_all_rows():
    column = pa.array([None, "", "x" * 50, "y" * 500, "", "z"])
    got = list(slices(column, 100))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(6)) and len(got) > 1


# --- segmentation --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    return segmentation.Pieces(model_proto())


def all_segmentations(pieces, text):
    logs = {pieces.model.id_to_piece(int(i)): l for i, l in zip(pieces.ids, pieces.log)}

    def cut(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in logs:
                for tail, l in cut(rest[n:]):
                    yield (rest[:n], *tail), l + logs[rest[:n]]

    found = list(cut(text))
    total = np.logaddexp.reduce([l for _, l in found])
    return {s: math.exp(l - total) for s, l in found}


def test_samples_are_drawn_without_replacement(pieces):
    chance = all_segmentations(pieces, "▁the▁en")
    n, k = 4000, 3
    seeds = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    first, second, weight = collections.Counter(), collections.Counter(), 0.0
    for row in segmentation.sample_slice(pieces, ["the en"] * n, seeds, k):
        seen = [tuple(pieces.model.id_to_piece(s[0].tolist())) for s in row]
        assert len(set(seen)) == k and [s[2] for s in row] == sorted((s[2] for s in row), reverse=True)
        for s, (_, log, _, inclusion) in zip(seen, row):
            assert math.isclose(chance[s], math.exp(log), rel_tol=1e-6)
            weight += chance[s] / math.exp(inclusion) / n
        first[seen[0]] += 1
        second[seen[1]] += 1
    assert abs(weight - 1) < 0.01  # the inclusion scores give unbiased sums
    for s, p in chance.items():
        assert abs(first[s] / n - p) < 0.02
        q = sum(chance[a] * p / (1 - chance[a]) for a in chance if a != s)
        assert abs(second[s] / n - q) < 0.02


def test_packed_trie_takes_the_steps_of_its_pieces(pieces):
    texts = ["▁ab", "a", "ab", "abc", "b", "bcd", "é", "日本", "abc"]
    trie = segmentation.Trie(texts)
    found = {}

    def walk(node, spelled):
        found[spelled] = int(trie.piece[node])
        for byte in range(256):
            to = trie.base[node] + byte
            if trie.parent[to] == node:
                walk(to, spelled + bytes([byte]))

    walk(0, b"")
    prefixes = {t.encode()[:n] for t in texts for n in range(len(t.encode()) + 1)}
    number = {t.encode(): k for k, t in enumerate(texts)}
    assert found == {p: number.get(p, -1) for p in prefixes}
    # every worker of a task holds one
    assert sum(x.nbytes for x in vars(pieces.trie).values()) < 4 << 20


def test_sums_of_numbers_and_of_logs_agree(pieces):
    data = np.frombuffer("▁the▁interesting日本▁😀▁en".encode(), np.uint8)
    start, size, _ = pieces.units(data, np.array([0, len(data)]))
    plain = segmentation.Lattice(data, start, size, pieces)
    assert pieces.plain > 20
    kept, pieces.plain = pieces.plain, 3
    try:
        mixed = segmentation.Lattice(data, start, size, pieces)
    finally:
        pieces.plain = kept
    assert np.allclose(plain.share, mixed.share, rtol=1e-9, atol=0)
    assert np.array_equal(plain.end, mixed.end) and np.array_equal(plain.piece, mixed.piece)


def test_equal_rests_of_units_share_their_edges(pieces):
    units = ["▁singing", "▁ringing", "▁sing", "▁king", "(", "ing", "▁café", "▁fé"]
    size = np.array([len(u.encode()) for u in units])
    data = np.frombuffer("".join(units).encode(), np.uint8)
    lattice = segmentation.Lattice(data, np.cumsum(size) - size, size, pieces)
    # one group of edges per distinct rest, not one per place
    assert len(lattice.count) == len({u[i:] for u in units for i in range(len(u))}) < sum(map(len, units))
    for unit, group in zip(units, lattice.first):
        want = collections.Counter()
        for pieces_of, p in all_segmentations(pieces, unit).items():
            want[pieces_of[0]] += p
        edges = np.arange(lattice.edge[group], lattice.edge[group] + lattice.count[group])
        names = pieces.model.id_to_piece(pieces.ids[lattice.piece[edges]].tolist())
        assert dict(zip(names, lattice.share[edges])) == pytest.approx(want)


def test_characters_without_a_piece_between_others(pieces):
    texts = ["a😀😀b", "😀", "\x01😀 \x01\x01 日😀the"]
    for text, row in zip(texts, segmentation.sample_slice(pieces, texts, np.arange(3).astype(np.uint64), 3)):
        assert [pieces.decode(ids, np.array([0, len(ids)])) for ids, *_ in row] == [[text]] * len(row)
        assert all(pieces.model.decode(ids.tolist()) == text for ids, *_ in row)


def test_few_segmentations_come_out_whole(pieces):
    (row,) = segmentation.sample_slice(pieces, ["a"], np.array([5], np.uint64), 4)
    assert len(row) == len(all_segmentations(pieces, "▁a")) == 2
    assert all(s[3] == 0 for s in row) and math.isclose(sum(math.exp(s[1]) for s in row), 1)


def test_segmentation_edges(spark, odd, empty):
    rows = segmentation.sample_segmentations(odd, model_proto(), keep=["doc_id", "a.b"]).collect()
    assert len(rows) == odd.count() and all(s.intact for r in rows for s in r.samples)
    assert segmentation.sample_segmentations(empty, model_proto()).count() == 0
    decode = segmentation.decoder(model_proto(), spark)
    back = segmentation.sample_segmentations(odd, model_proto(), k=1).select(
        "text", decode(F.col("samples")[0]["ids"]).alias("t")
    )
    assert all(r.t == (r.text or "").replace("▁", " ") for r in back.collect())


# --- token store ---------------------------------------------------------------------------------


def test_codes_give_every_token():
    for ids in ([], [1], [255, 256, 65535, 65536, 2**32 - 1, 0] * 300):
        levels = token_store.pack(np.array(ids, np.uint32))
        assert token_store.unpack(levels).tolist() == ids
        assert [token_store.token_at(levels, k) for k in range(len(ids))] == ids


def test_store_equals_library(spark, documents, tmp_path):
    from tokenizers import Tokenizer

    text = open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read()
    library = Tokenizer.from_str(text)
    rng = random.Random(2)
    parts = ["a", "'s", "'", "'ll", " ", "  ", "\n", "é", "12", "½", "!", "日", "😀", "　", "<|endoftext|>", "<|endof", "text|>", "\0"]
    mixed = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)]
    mixed += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "x <|endoftext|"]
    ids, size = token_store.Encoder(text).encode(*flat(pa.array(mixed)))
    cuts = np.split(ids, np.cumsum(size)[:-1])
    assert all(library.encode(t, add_special_tokens=False).ids == c.tolist() for t, c in zip(mixed, cuts))

    token_store.write_store(documents, str(tmp_path / "s"), text, 2, shard_tokens=30_000)
    shards = token_store.read_store(spark, str(tmp_path / "s"))
    got = {r.doc_id: r for r in token_store.documents_of(shards).collect()}
    start, every = 0, []
    for doc_id, t in sorted(texts_of(documents)):
        want = library.encode(t, add_special_tokens=False).ids + [2]
        row = got[doc_id]
        assert (row.start, row.n_tokens) == (start, len(want))
        assert row.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
        every += want
    asked = [rng.randrange(start) for _ in range(50)] + [0, start - 1]
    places = spark.createDataFrame([(p,) for p in [*asked, *asked, start, -1, None]], "position BIGINT")
    found = token_store.tokens_at(shards, places).collect()
    assert sorted(r.position for r in found) == sorted(set(asked))
    assert all(every[r.position] == r.token for r in found)


def test_store_edges(spark, odd, empty, tmp_path):
    text = open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8").read()
    for name, df in (("odd", odd), ("empty", empty)):
        token_store.write_store(df, str(tmp_path / name), text, 2)
        rows = token_store.documents_of(token_store.read_store(spark, str(tmp_path / name)), True).collect()
        assert len(rows) == df.count() and all(r.ids[-1] == 2 for r in rows)
        assert [r.start for r in sorted(rows, key=lambda r: r.start)] == list(
            itertools.accumulate([0, *(r.n_tokens for r in sorted(rows, key=lambda r: r.start))][:-1])
        )[: len(rows)]


# --- near-duplicates -----------------------------------------------------------------------------


def bag(text):
    w = WORD.findall(text or "")
    n = min(5, len(w))
    return collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter()


def jaccard(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def classes(texts):
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if find(a) != find(b) and jaccard(bags[a], bags[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


def test_signatures_estimate_weighted_jaccard():
    rng, pairs = random.Random(3), []
    for k in range(400):
        base = [rng.choice("ab") + str(k) for _ in range(80)]
        other = [w if rng.random() > 0.03 else "c" for w in base]
        pairs.append((" ".join(base), " ".join(other)))
    shingle, weight, row, _ = near_dedup.bags(*flat(pa.array([t for p in pairs for t in p])))
    assert weight.max() > 4
    best = near_dedup.signatures(shingle, weight, row, 800, 120)
    got = (best[0::2] == best[1::2]).mean(axis=1)
    want = np.array([jaccard(bag(a), bag(b)) for a, b in pairs])
    assert abs((got - want).mean()) < 0.008
    assert np.sqrt(((got - want) ** 2).mean()) < 1.3 * np.sqrt((want * (1 - want) / 120).mean())
    exact = near_dedup._similarity(*(pa.array([p[k] for p in pairs]) for k in (0, 1)))
    assert np.allclose(exact, want)


def test_classes_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    passage = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([60, 150]))
        if rng.random() < 0.6:
            base = base + passage  # shared by many, alike to about a half
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += texts[:5] + ["", None, " ", "one two", "one  two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    rows = sorted(near_dedup.near_duplicates(df).collect(), key=lambda r: r.doc_id)
    want = classes(texts)
    assert [r.class_id for r in rows] == want
    assert [r.kept for r in rows] == [w == k for k, w in enumerate(want)]
    size = collections.Counter(want)
    assert all(r.class_size == size[r.class_id] for r in rows)
    kept = near_dedup.drop_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))



def test_texts_that_share_half_are_not_compared(spark, monkeypatch):
    """300 texts alike to a half, some of them copied: no text moves but for the copies."""
    rng = random.Random(9)
    word = lambda n: ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
    passage = word(60)
    texts = [" ".join(passage + word(40)) for _ in range(300)]
    texts += [t + " end" for t in texts[:20]]
    compared = []
    plain = near_dedup._compare
    monkeypatch.setattr(near_dedup, "_compare", lambda pairs, *a: compared.append(pairs.count()) or plain(pairs, *a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: i if i < 300 else i - 300 for i in range(320)}
    assert sum(compared) < 100


@pytest.mark.parametrize("most", [3, 20, 20_000])
def test_split_buckets_lose_no_link(spark, most):
    """Chains and groups of texts alike to 0.85 and more, in buckets cut at any size."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(400)]
    texts = []
    for _ in range(12):
        t = rng.choices(vocabulary, k=150)
        for _ in range(rng.choice([1, 2, 12])):
            texts.append(" ".join(t))
            t = list(t)
            t[rng.randrange(150)] = rng.choice(vocabulary)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    sketched = near_dedup._sketched(df, "text", ["doc_id"])
    comps = {r.node: r.comp for r in near_dedup._links(sketched, 0.8, most).collect()}
    ids = {r.held.doc_id: comps.get(r.node, r.node) for r in sketched.select("held", "node").collect()}
    want = classes(texts)
    groups = collections.defaultdict(set)
    for i, root in ids.items():
        groups[root].add(want[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want))


def test_crowded_bucket_compares_all_its_pairs(spark):
    """Texts that share one bucket and no other band: its links are found, however it is dealt."""
    rng = random.Random(12)
    texts = []
    for _ in range(15):
        base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(120)]
        texts += [" ".join(base), " ".join([*base, "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    sketched = near_dedup._sketched(df, "text", ["doc_id"])
    alone = F.transform(F.sequence(F.lit(1), F.lit(near_dedup.BANDS - 1)), lambda k: F.xxhash64("node", k))
    sketched = near_dedup.saved(sketched.withColumn("bands", F.concat(F.array(F.lit(7).cast("bigint")), alone)), "one")
    ids = {r.node: r.held.doc_id for r in sketched.select("held", "node").collect()}
    for most in (4, 20, 1000):
        groups = collections.defaultdict(set)
        for r in near_dedup._links(sketched, 0.8, most).collect():
            groups[r.comp].add(ids[r.node])
        assert sorted(map(sorted, groups.values())) == [[k, k + 1] for k in range(0, 30, 2)]


def test_pipeline_drops_every_copy_of_a_crowded_bucket(spark, monkeypatch):
    """Texts that share one bucket and no other band, in a bucket far over the bound: one of each pair stays."""
    import corpus_pipeline

    rng = random.Random(12)
    texts = []
    for _ in range(15):
        base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(120)]
        texts += [" ".join(base), " ".join([*base, "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    links, sketch = near_dedup._links, near_dedup._sketched
    alone = F.transform(F.sequence(F.lit(1), F.lit(near_dedup.BANDS - 1)), lambda k: F.xxhash64("node", k))
    bands = F.concat(F.array(F.lit(7).cast("bigint")), alone)
    monkeypatch.setattr(near_dedup, "_sketched", lambda *a: near_dedup.saved(sketch(*a).withColumn("bands", bands), "one"))
    monkeypatch.setattr(near_dedup, "_links", lambda sketched, least: links(sketched, least, 4))
    kept = corpus_pipeline.apply_near_dedup(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 30, 2))


@pytest.fixture
def no_broadcast(spark):
    """Tables count as too large to be sent to all tasks unasked."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_filters_ahead_of_joins_lose_no_row(spark, no_broadcast):
    df = spark.range(20_000).selectExpr("nullif(id, 5) as `a.b`", "id as __word", "string(id % 7) as c")
    for keys in (df.where("__word % 10 = 3 or __word = 5"), df.limit(0)):
        want = sorted(r["__word"] for r in keys.collect())
        for on in (["a.b"], ["a.b", "c"]):
            got = likely(df, keys, *on)
            ids = {r["__word"] for r in got.collect()}
            assert got.columns == df.columns and ids >= set(want) and len(ids) < 1.2 * len(want) + 1
        rest = without(df.withColumnRenamed("a.b", "k"), keys.select(F.col("`a.b`").alias("k")), "k")
        assert rest.columns == ["k", "__word", "c"]
        # a null is not among any keys
        assert sorted(r["__word"] for r in rest.collect()) == sorted({*range(20_000)} - set(want) | {5})


def test_texts_without_copies_stay_where_they_are(spark, monkeypatch, no_broadcast):
    """Of 300 texts only the ten that have a copy, and their copies, go into a join with their texts."""
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts[:10]])), "doc_id BIGINT, text STRING")
    moved = []

    plain = type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, *a, **k: (
        moved.append(self.count()) if "text" in self.columns and "__mask" not in self.columns else None
    ) or plain(self, other, *a, **k))
    kept = near_dedup.drop_near_duplicates(df).collect()
    assert sorted(r.doc_id for r in kept) == list(range(300))
    assert moved and max(moved) < 60


def test_components_of_a_chain(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame(chain, "a BIGINT, b BIGINT")
    got = {r.node: r.comp for r in near_dedup.components(df).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_near_dedup_edges(odd, empty):
    kept = near_dedup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    distinct = {tuple(WORD.findall(t or "")) for t in ODD}
    assert kept.count() == len(distinct)
    assert near_dedup.near_duplicates(odd).count() == odd.count()
    assert near_dedup.drop_near_duplicates(empty).count() == 0


# --- language model ------------------------------------------------------------------------------


def test_scores_against_plain_counting(documents):
    held = fold_of(F.col("doc_id"), 7) == 2
    got = {r.doc_id: r for r in context_mixing.score_texts(documents, held, slot_bits=18).collect()}
    rows = [(i, [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]) for i, t in texts_of(documents)]
    count = collections.Counter()
    for i, w in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    total, distinct = sum(count.values()), len(count)
    for i, w in rows:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), total)
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert sum(r.bits_per_byte for r in got.values()) / len(got) < 4


def test_word_scores_equal_plain_mixing(spark):
    """Probabilities of words from plain counts of their contexts, and of all next bytes together."""
    known = {b"the": 900, b"then": 20, b"them": 3, b"a": 50, b"": 70, b"\xc3\xa9t": 2, b"theme": 1}
    df = spark.createDataFrame([(bytearray(w), n) for w, n in known.items()], "word BINARY, seen BIGINT")
    _, counts = context_mixing.block_counts(df)
    held = context_mixing._Counts([[bytes(x) for x in r.packed] for r in counts.collect()], 55)
    weights = context_mixing._first_weights() + np.random.default_rng(1).normal(0, 0.1, (context_mixing.GATES * 8, 4))

    def contexts(w, i):
        return [(k, w[at:i]) for k, at in enumerate((max(i - 1, 0), max(i - 2, 0), max(i - 3, 0), 0))]

    table = collections.defaultdict(collections.Counter)
    for w, n in known.items():
        for i, byte in enumerate(w + b" "):
            for c in contexts(w + b" ", i):
                table[c][byte] += n

    def byte_log(w, i, byte):
        log = 0.0
        for bit in range(8):
            low, width = byte >> (8 - bit) << (8 - bit), 1 << (8 - bit)
            x, level = [], []
            for c in contexts(w, i):
                total = sum(n for b, n in table[c].items() if low <= b < low + width)
                one = sum(n for b, n in table[c].items() if low + width // 2 <= b < low + width)
                x.append(min(max(math.log((one + 0.02) / (total - one + 0.02)), -12), 12))
                level.append(sum(total >= n for n in (1, 3, 10, 100)))
            mixed = sum(a * b for a, b in zip(weights[(level[3] * 5 + level[2]) * 8 + bit], x))
            mixed = min(max(mixed, -20), 20)
            log -= math.log1p(math.exp(-mixed if byte >> (7 - bit) & 1 else mixed))
        return log

    asked = sorted(known)
    logs, _ = context_mixing.word_logs(pa.array(asked, pa.binary()), held, weights)
    for w, got in zip(asked, logs):
        each = [byte_log(w + b" ", i, byte) for i, byte in enumerate(w + b" ")]
        assert np.allclose(got, [sum(each[:2]), sum(each[:4]), sum(each)], rtol=1e-4, atol=1e-4)
    for w, i in ((b"the ", 3), (b"", 0), (b"them", 4)):
        assert math.isclose(sum(math.exp(byte_log(w, i, byte)) for byte in range(256)), 1, rel_tol=1e-9)


@pytest.mark.parametrize("top", [5, 1 << 33, 1 << 55])
def test_seen_before_counts_keys_of_any_size(top):
    rng = random.Random(top)
    row = np.sort(np.array([rng.randrange(9) for _ in range(700)]))
    some = [rng.randrange(top) for _ in range(6)]
    key = np.array([rng.choice(some) for _ in row])
    times = collections.Counter()
    for r, k, got in zip(row.tolist(), key.tolist(), context_mixing._seen_before(key, row), strict=True):
        assert got == times[r, k]
        times[r, k] += 1


def test_adapted_scores_equal_plain_refinement():
    """Texts scored word by word, each step by how often the text took it, in several strengths."""
    rng = np.random.default_rng(2)
    spelled = [b"the ", b"then ", b"them ", b"a ", b" ", b"theme ", b"at "]
    steps = rng.uniform(0.05, 0.9, (len(spelled), 3))
    heads = np.array([[int.from_bytes(w[:n].ljust(n, b"\0"), "little") for w in spelled] for n in context_mixing.HEADS])
    # equal beginnings have equal chances
    for k, n in enumerate(context_mixing.HEADS):
        for i, w in enumerate(spelled):
            for j in range(i):
                if w[:n] == spelled[j][:n]:
                    steps[i, k] = steps[j, k]
    logs = np.cumsum(np.log(steps), axis=1)
    texts = [rng.integers(0, len(spelled), n) for n in (1, 2, 40, 300)]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = context_mixing._adapted(np.concatenate(texts), at, [*heads, np.arange(len(spelled))], logs)
    for text, log in zip(texts, got):
        experts = [sum(logs[w, -1] for w in text)]
        for strength in context_mixing.STRENGTHS:
            seen, followers = collections.Counter(), collections.defaultdict(collections.Counter)
            more = context_mixing.PAIR_STRENGTHS if strength in context_mixing.PAIRED else ()
            totals, before = [0.0] * (1 + len(more)), None
            for w in text.tolist():
                path = [(0, 0), *((k + 1, int(heads[k, w])) for k in range(2)), (3, w)]
                chance = 1.0
                for k in range(3):
                    chance *= (seen[path[k + 1]] + strength * steps[w, k]) / (seen[path[k]] + strength)
                seen.update(path)
                totals[0] += math.log(chance)
                known = followers[before]
                for k, m in enumerate(more, 1):
                    totals[k] += math.log((known[w] + m * chance) / (known.total() + m))
                known[w] += 1
                before = w
            experts += totals
        top = max(experts)
        assert math.isclose(log, top + math.log(sum(math.exp(e - top) for e in experts) / len(experts)), rel_tol=1e-9)


def test_every_context_keeps_its_own_counts(spark):
    rng = random.Random(11)
    known = {"".join(rng.choices("0123456789abcdef", k=10)).encode(): rng.randint(1, 3) for _ in range(80_000)}
    known |= {b"": 7, b"the": 900, b"then": 20, b"\xc3\xa9t": 2}
    df = spark.createDataFrame([(bytearray(w), n) for w, n in known.items()], "word BINARY, seen BIGINT")
    words_of, counts = context_mixing.block_counts(df)
    assert {bytes(r.word): r.seen for r in words_of.collect()} == known
    table = collections.defaultdict(lambda: np.zeros(256, np.int64))
    for w, n in known.items():
        w += b" "
        for i, byte in enumerate(w):
            for k, at in enumerate((max(i - 1, 0), max(i - 2, 0), max(i - 3, 0), 0)):
                table[k, w[at:i]][byte] += n
    held = context_mixing._Counts([[bytes(x) for x in r.packed] for r in counts.collect()], 55)
    assert len(held.key) == sum((rows > 0).sum() for rows in table.values())
    # more (context, bit node) pairs than a table of 2^22 slots can tell apart
    assert sum(len(np.unique(held.key >> (8 - bits))) for bits in range(8)) > 1 << 22
    for w in rng.sample(sorted(known), 300) + [b"", b"then", b"\xc3\xa9t"]:
        coded = context_mixing._Coded(pa.array([w], pa.binary()))
        for k, key in enumerate(coded.keys(55)):
            for i, byte in enumerate(w + b" "):
                row = np.searchsorted(held.key, key[i])
                mine = table[k, (w + b" ")[max(i - k - 1, 0) if k < 3 else 0 : i]]
                for bits in range(9):
                    low = byte >> (8 - bits) << (8 - bits)
                    assert held.sums[bits][row] == mine[low : low + (1 << (8 - bits))].sum()



def test_order_of_words_counts(spark):
    """Texts with turns of phrase score higher than the same words in any order."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(60):
        phrases = [rng.choices(vocabulary, k=5) for _ in range(6)]
        rows.append((i, " ".join(w for _ in range(30) for w in rng.choice(phrases))))
    mixed = [(1000 + i, " ".join(rng.sample(w := t.split(), len(w)))) for i, t in rows]
    df = spark.createDataFrame(rows + mixed, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r for r in context_mixing.score_texts(df, F.col("doc_id") % 1000 >= 20).collect()}
    held = range(20, 60)
    assert all(got[i].score > got[1000 + i].score + 20 for i in held)
    assert all(math.isclose(got[i].base_score, got[1000 + i].base_score) for i in held)


def test_context_mixing_edges(odd, empty):
    held = fold_of(F.col("doc_id"), 7) == 2
    rows = context_mixing.score_texts(odd, held, slot_bits=14).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert context_mixing.score_texts(empty, held, slot_bits=14).count() == 0
    none = context_mixing.score_texts(odd, F.lit(True), slot_bits=14).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in none)


# --- importance ----------------------------------------------------------------------------------


def test_kth_largest_is_exact(spark):
    rng = random.Random(5)
    values = [round(rng.expovariate(1) ** 9, 3) for _ in range(30_000)] + [1.0] * 15_000
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    order = sorted(values, reverse=True)
    for k in (1, 17, 20_000, len(values)):
        assert importance.kth_largest(df, "v", k) == order[k - 1]
    assert importance.kth_largest(df.limit(0), "v", 3) is None


def test_importance_weights(spark):
    good = [f"fine prose {i % 7} here " * 30 for i in range(60)]
    bad = [f"junk ### spam {i % 5} " * 30 for i in range(40)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(0, 100, 2)], "doc_id BIGINT, quality INT")
    rows = importance.resample(df, labels).collect()
    assert len(rows) == 100 and sum(r.selected for r in rows) == 60
    mean = [np.mean([r.log_weight for r in rows if (r.doc_id < 60) == side]) for side in (True, False)]
    assert mean[0] > 0 > mean[1]
    assert sum(r.selected for r in rows if r.doc_id < 60) >= 55



def test_weights_equal_plain_counting(spark):
    """Log weights, keys with noise and the draw from plain n-gram counts of all labelled texts."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["Red", "green", "blue", "x1", "é", "a-b"], k=rng.randrange(1, 30)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (202, rows[1][1])]
    labels_ = [(i, i % 3 % 2) for i in range(120)] + [(3, 1), (None, 1), (5, None), (999, 1)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    marks = spark.createDataFrame(labels_, "doc_id BIGINT, quality INT")

    def grams(text):
        w = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w]
        return w + list(zip(w, w[1:]))

    best = {}
    for i, q in labels_:
        if i is not None and q is not None:
            best[i] = max(best.get(i, 0), q)
    raw = collections.Counter(g for _, t in rows for g in grams(t))
    target = collections.Counter(g for i, t in rows if best.get(i) == 1 for g in grams(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    # so many buckets that no two of these n-grams share one
    got = importance.resample(df, marks, buckets=1 << 22).collect()
    want = {}
    for i, t in rows:
        weight = sum(math.log((target[g] + 1000 * raw[g] / n_raw) / (n_target + 1000) / (raw[g] / n_raw)) for g in grams(t))
        want.setdefault(i, []).append(round(weight, 6))
    found = collections.defaultdict(list)
    for r in got:
        found[r.doc_id].append(round(r.log_weight, 6))
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in want.items()}
    share = sum(best.values()) / len(best)
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    least = keys[round(share * len(rows)) - 1]
    assert all(r.selected == (r.gumbel_key >= least) for r in got)


def test_kth_largest_of_values_that_no_bin_tells_apart(spark, monkeypatch):
    monkeypatch.setattr(importance, "_LAST_BIN", 10)
    values = [1.0 + k * 2**-52 for k in range(6)] * 40 + [2.0]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    for k in (1, 2, 41, 42, 200, 241, 500):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[min(k, len(values)) - 1]


def test_importance_edges(odd, empty, labels):
    for target in (labels, labels.limit(0)):
        assert importance.resample(odd, target).count() == odd.count()
    assert importance.resample(empty, labels).count() == 0


# --- toxicity ------------------------------------------------------------------------------------


def test_factors_learn_a_pair(spark):
    rng, rows = random.Random(6), []
    for i in range(3000):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = rng.choices([f"w{k}" for k in range(40)], k=8) + ["insult"] * insult + ["group"] * group
        rows.append((i, " ".join(w), int(insult and group)))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    model = toxicity.fit(df.where("doc_id % 5 <> 0"), df.select("doc_id", "toxic"), epochs=25)
    held = toxicity.score(df.where("doc_id % 5 = 0"), model).collect()
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.97



def test_all_labelled_rows_are_learned_from(spark):
    """Shards of about 500 rows: terms that single shards hardly know are learned from all of them."""
    rng, rows = random.Random(8), []
    for i in range(6000):
        rare, insult, group = rng.randrange(30), rng.random() < 0.4, rng.random() < 0.4
        w = rng.choices([f"w{k}" for k in range(40)], k=8) + [f"bad{rare}x"] * (i % 4 == 0) + [f"good{rare}x"] * (i % 4 == 1)
        rows.append((i, " ".join(w + ["insult"] * insult + ["group"] * group), int(i % 4 == 0 or (insult and group))))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    train, held = df.where("doc_id % 5 <> 0"), df.where("doc_id % 5 = 0")
    models = [toxicity.fit(train, df.select("doc_id", "toxic"), bound=500) for _ in range(2)]
    for k in range(30):
        term, _ = toxicity.hashed_terms(*flat(pa.array([f"bad{k}x"])))
        assert models[0].linear[models[0].find(term)[0]].sum() > 0
    got = toxicity.score(held, models[0]).collect()
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.95
    assert [r.score for r in got] == [r.score for r in toxicity.score(held, models[1]).collect()]


def test_texts_are_not_moved_to_their_labels(spark, monkeypatch, no_broadcast):
    """Labels go to the shards of term lists; rows without one hardly go there."""
    rows = [(i, f"word{i % 50} text{i % 3}", i % 2) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    plans, lists = [], []
    plain = toxicity.saved
    monkeypatch.setattr(toxicity, "saved", lambda d, label: plans.append((label, d._jdf.queryExecution().toString())) or plain(d, label))
    pick = toxicity.likely
    monkeypatch.setattr(toxicity, "likely", lambda *a: lists.append(pick(*a)) or lists[-1])
    model = toxicity.fit(df.drop("toxic"), df.where("doc_id % 10 < 3").drop("text"))
    assert "SortMergeJoin" not in dict(plans)["shards"]
    assert 600 <= lists[0].count() < 700
    assert model.bias < 0.1


def crossed(rng, marks, most):
    """Texts of noise and of named words, each there or not."""
    words_ = [f"w{i}" for i in range(300)]
    for _ in range(most):
        there = [m for m in marks if rng.random() < 0.35]
        text = rng.choices(words_, k=12) + there
        rng.shuffle(text)
        yield " ".join(text), set(there)


@pytest.mark.parametrize("case", ["company", "crossed"])
def test_terms_that_matter_only_in_company(spark, case):
    """A group mention with the average toxic share, and pairs that no sum of weights can tell."""
    rng = random.Random(3)
    rows, probes = [], []
    if case == "company":
        marks = ["groupling", "insulting", "marker"]
        bad = lambda m: {"groupling", "insulting"} <= m or ("marker" in m and "groupling" not in m)
    else:
        marks = ["aardvark", "bumble", "citrus", "dolphin"]
        bad = lambda m: len(m) == 4 or m in ({"aardvark", "bumble"}, {"citrus", "dolphin"})
    for i, (text, there) in enumerate(crossed(rng, marks, 6000)):
        rows.append((i, text, int(bad(there))))
    if case == "company":
        shares = [sum(r[2] for r in part) / len(part) for part in (rows, [r for r in rows if "groupling" in r[1]])]
        assert abs(shares[0] - shares[1]) < 0.03
    for i, (text, there) in enumerate(crossed(rng, marks, 1500)):
        if len(there) == 2 and "marker" not in there:
            probes.append((i, text, int(bad(there))))
    schema = "doc_id BIGINT, text STRING, toxic INT"
    train = spark.createDataFrame(rows, schema)
    model = toxicity.fit(train.drop("toxic"), train.drop("text"))
    got = toxicity.score(spark.createDataFrame(probes, schema), model).collect()
    caught = [r.predicted for r in got if r.toxic]
    spared = [1 - r.predicted for r in got if not r.toxic]
    assert sum(caught) >= 0.95 * len(caught) > 50
    assert sum(spared) >= 0.95 * len(spared)


def test_pairs_of_rare_terms_are_learned(spark):
    """Four marks, each in 4 % of the rows, always with another; only the pair tells the label."""
    rng = random.Random(3)
    marks = ["aardvark", "bumble", "citrus", "dolphin"]
    noise = [f"w{i}" for i in range(300)]

    def texts(most, share):
        for i in range(most):
            there = rng.sample(marks, 2) if rng.random() < share else []
            text = rng.choices(noise, k=12) + there
            rng.shuffle(text)
            yield i, " ".join(text), int(set(there) in ({"aardvark", "bumble"}, {"citrus", "dolphin"}))

    schema = "doc_id BIGINT, text STRING, toxic INT"
    rows = list(texts(6000, 0.08))
    assert all(sum(m in r[1] for r in rows) < 0.05 * len(rows) for m in marks)
    train = spark.createDataFrame(rows, schema)
    model = toxicity.fit(train.drop("toxic"), train.drop("text"))
    probes = spark.createDataFrame(list(texts(600, 1.0)), schema)
    got = toxicity.score(probes, model).collect()
    caught = [r.predicted for r in got if r.toxic]
    spared = [1 - r.predicted for r in got if not r.toxic]
    assert sum(caught) >= 0.95 * len(caught) > 150
    assert sum(spared) >= 0.95 * len(spared)


def test_terms_of_few_rows_are_fitted(spark):
    """Marks of four toxic rows each, in one shard and in eleven."""
    rng = random.Random(4)
    rows = []
    for i in range(2400):
        mark = [f"{'klmnpqrstv'[i // 4 % 10]}zq"] if i < 40 else []
        rows.append((i, " ".join(rng.choices([f"w{k}" for k in range(40)], k=8) + mark), int(i < 40 or i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, toxic INT")
    for bound in (20_000, 450):
        model = toxicity.fit(df.drop("toxic"), df.drop("text"), bound=bound)
        for k in "klmnpqrstv":
            term, _ = toxicity.hashed_terms(*flat(pa.array([f"{k}zq"])))
            at, known = model.find(term)
            assert known.all() and (model.linear[at] > 0).all()


def test_margins_equal_plain_pair_sums():
    rng = np.random.default_rng(5)
    model = toxicity.Model(np.arange(9), -0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    bags_ = [[], [4], [0, 3], [1, 2, 5, 8], list(range(9))]
    at = np.array([t for b in bags_ for t in b])
    row = np.array([k for k, b in enumerate(bags_) for _ in b])
    want = [
        -0.3 + sum(model.linear[t] for t in b)
        + sum(model.factors[s] @ model.factors[t] for s, t in itertools.combinations(b, 2))
        for b in bags_
    ]
    assert np.allclose(model.margins(at, row, len(bags_)), want)


def test_toxicity_edges(odd, empty, labels):
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).count() == 0


# --- quality rules -------------------------------------------------------------------------------


def plain_numbers(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def test_numbers_equal_plain_counting(spark, documents):
    texts = [t for _, t in texts_of(documents)] + ODD + ["a\na\n\na b", "x y z x y z q x y", "# * $%&|<> "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    rows = quality_rules.measure(df).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in quality_rules.NUMBERS) for r in rows] == [plain_numbers(t) for t in texts]


def test_rules_are_learned_and_applied(spark):
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(90)) for _ in range(400)]
    bad = [k % 4 == 0 for k in range(400)]
    texts = [t.replace(" ", " | ") if b else t for t, b in zip(texts, bad)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    labels = df.select("doc_id", F.expr("int(doc_id % 4 <> 0)").alias("quality"))
    rules = quality_rules.learn_rules(df, labels)
    assert rules and all(r.kept == (not bad[r.doc_id]) for r in quality_rules.judge(df, rules).collect())
    assert quality_rules.learn_rules(df, labels.where("quality = 1")) == []


def test_quality_edges(odd, empty, labels):
    rules = quality_rules.learn_rules(odd, labels)
    judged = quality_rules.judge(odd, rules)
    assert judged.count() == odd.count() and judged.where("kept and base_failed").count() == 0
    assert quality_rules.judge(empty, quality_rules.learn_rules(empty, labels)).count() == 0


# --- decontamination -----------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(300)]
    items = [rng.choices(vocabulary, k=n) for n in (3, 5, 12, 20, 20, 57)] + [[]]
    texts = []
    for _ in range(40):
        t = rng.choices(vocabulary, k=120)
        item = list(rng.choice(items))
        if item and rng.random() < 0.5:
            item[rng.choice([0, -1, len(item) // 2])] = "changed"
        at = rng.randrange(100)
        texts.append(" ".join(t[:at] + item + t[at:]).title())
    # texts that are shorter than an item: without its last words, or one from the middle
    for item in items:
        n = len(item)
        texts += [" ".join(x) for x in (item, item[:-1], item[: n // 2] + item[n // 2 + 1 :], item[: int(0.8 * n)], item[3:], item[: n // 2])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id BIGINT, text STRING")

    def bags(w, n):
        k = min(5, n)
        return collections.Counter(tuple(w[i : i + k]) for i in range(n - k + 1))

    want = set()
    for d, t in enumerate(texts):
        w = t.lower().split()
        for i, item in enumerate(items):
            n = len(item)
            if min(5, n) <= len(w) < n:
                best = jaccard(collections.Counter(tuple(w[s : s + min(5, n)]) for s in range(len(w) - min(5, n) + 1)), bags(item, n))
            else:
                best = max((jaccard(bags(w[s : s + n], n), bags(item, n)) for s in range(len(w) - n + 1)), default=0)
            if n and best >= 0.8:
                want.add((d, i, round(best, 9)))
    for block in (10**6, 60):
        found = decontaminate.with_leaks(df, bench, block_chars=block).select("doc_id", F.inline("leaks"))
        assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in found.collect()} == want
    assert len(want) > 15


def test_decontamination_edges(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (None, "the the the the"), (3, ""), (4, "a"), (4, "a")], "item_id BIGINT, text STRING")
    rows = decontaminate.with_leaks(odd, bench).collect()
    assert len(rows) == odd.count()
    assert all((len(r.leaks) == 2) == (r.text in ("a",)) for r in rows if r.text not in ("A\0b ▁ c", "the the the the"))
    assert decontaminate.with_leaks(empty, bench).count() == 0
    assert all(r.leaks == [] for r in decontaminate.with_leaks(odd, bench.limit(0)).collect())


# --- token counts --------------------------------------------------------------------------------


def test_lengths_equal_greedy_matching(spark, documents):
    pieces = token_counts.pieces_of(tokenizer_path("piece_bpe_32k.model"))
    known, longest = set(pieces), max(map(len, pieces))

    def greedy(word):
        word, n = "▁" + word, 0
        while word:
            size = next((k for k in range(min(longest, len(word)), 0, -1) if word[:k] in known), 0)
            if not size:
                return 0
            word, n = word[size:], n + 1
        return n

    texts = [t for _, t in texts_of(documents)][:60] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    for row in token_counts.count_tokens(df, pieces).collect():
        n = [greedy(w) for w in WORD.findall(row.text or "")]
        assert (row.n_words, row.n_pieces, row.n_unknown) == (len(n), sum(max(x, 1) for x in n), n.count(0))


def test_links_of_nested_pieces(odd, empty):
    tool = token_counts.Automaton(["▁ab", "▁abcd", "▁abcdef", "c", "cde", "x"])
    data, offsets = flat(pa.array(["abcdex", "abcdefx", "abcz", "ab", "abccdex"]))
    assert tool.lengths(data, offsets[:-1], offsets[1:]).tolist() == [0, 2, 0, 1, 4]
    assert token_counts.count_tokens(odd, []).where("n_unknown <> n_words").count() == 0
    assert token_counts.count_tokens(empty, ["▁a"]).count() == 0


# --- language ------------------------------------------------------------------------------------


def test_predictions_equal_plain_profiles(spark, documents):
    profiles = language_id.learn_profiles(documents, size=50)
    rows = documents.select("doc_id", "text", "lang").collect()

    def ranked(texts, size):
        count = collections.Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                w = "_" + w + "_"
                count.update(w[1:-1])
                count.update(w[i : i + 2] for i in range(len(w) - 1))
                count.update(w[i : i + 3] for i in range(len(w) - 2))
        code = lambda g: int("".join(f"{1 if c == '_' else ord(c):04x}" for c in g), 16)
        return {g: k for k, g in enumerate(sorted(count, key=lambda g: (-count[g], code(g)))[:size])}

    want = {lang: ranked([r.text for r in rows if r.lang == lang], 50) for lang in {r.lang for r in rows}}
    got = collections.defaultdict(dict)
    for r in profiles.collect():
        got[r.lang][language_id.gram_text(r.gram)] = r["rank"]
    assert got == want
    found = language_id.identify(documents, profiles, size=50).collect()
    for r in found[:40]:
        own = ranked([r.text], 50)
        far = {lang: sum(abs(k - p[g]) if g in p else 50 for g, k in own.items()) for lang, p in want.items()}
        best = min(sorted(far), key=far.get)
        assert r.lang_pred == best and math.isclose(r.score, 1 - far[best] / (50 * len(own)))


def test_language_held_out_accuracy(documents):
    held = fold_of(F.col("doc_id"), 3) == 1
    profiles = language_id.learn_profiles(documents.where(~held))
    found = language_id.identify(documents.where(held).where("n_chars > 100"), profiles)
    assert found.agg(F.avg(F.expr("double(lang = lang_pred)"))).first()[0] > 0.95


def test_language_edges(odd, empty):
    profiles = language_id.learn_profiles(odd)
    rows = language_id.identify(odd, profiles).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in rows)
    none = language_id.identify(odd, language_id.learn_profiles(empty)).collect()
    assert all((r.lang_pred, r.score) == ("und", 0) for r in none)
    assert language_id.identify(empty, profiles).count() == 0


def test_callers_columns_come_back(spark, empty, labels):
    df = frame(spark, ODD)
    for name in HELPERS:
        df = df.withColumn(name, F.concat(F.lit(f"{name} "), F.coalesce("text", F.lit("-"))))
    bench = spark.createDataFrame([(1, "the the the the"), (2, "a")], "item_id BIGINT, text STRING")
    pieces = token_counts.pieces_of(tokenizer_path("piece_bpe_32k.model"))
    results = [
        quality_rules.judge(df, quality_rules.learn_rules(df, labels)),
        token_counts.count_tokens(df, pieces),
        language_id.identify(df, language_id.learn_profiles(df)),
        decontaminate.with_leaks(df, bench),
        decontaminate.with_leaks(df, bench, block_chars=3),
        decontaminate.with_leaks(df, empty.select(F.col("doc_id").alias("item_id"), "text")),
    ]
    want = sorted(map(tuple, df.collect()), key=repr)
    for result in results:
        assert sorted(map(tuple, result.select(*df.columns).collect()), key=repr) == want


# --- the whole -----------------------------------------------------------------------------------


def test_pipeline_keeps_clean_documents(spark, documents):
    import corpus_pipeline

    docs, kept = documents, {}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()} if "text" in docs.columns else {}
        docs = corpus_pipeline.saved(stage(spark, docs, SF_DIR), name)
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != "segmentation":
            assert docs.columns == documents.columns
        if name == "quality_rules":
            clean = [i for i, t in before.items() if i in labels and labels[i].quality == 1]
            clean = [i for i in clean if (n := plain_numbers(before[i]))[0] >= 50 and 2 * n[4] <= n[0]]
            assert sum(i in set(kept[name]) for i in clean) >= 0.97 * len(clean)
        if name == "near_dedup":
            ids = sorted(before)
            assert sorted(kept[name]) == sorted({ids[k] for k in classes([before[i] for i in ids])})
    assert len(kept["segmentation"]) == len(set(kept["segmentation"])) > 100
    assert docs.where("not samples[0].intact").count() == 0

def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "samples"} <= set(out.columns)


def test_pipeline_stages_give_workers_small_batches(spark, empty):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    mine = spark.conf.get(key)
    for stage in (corpus_pipeline.apply_segmentation, corpus_pipeline.apply_near_dedup):
        spark.conf.unset(key)
        stage(spark, empty, SF_DIR)
        assert spark.conf.get(key) == mine == "4m"


def test_language_counts_are_merged_in_parts(spark, documents, monkeypatch):
    """Small slices and many merges change no profile."""
    import pyarrow as pa

    rows = documents.select("text", F.coalesce("lang", F.lit("xx")).alias("lang")).where("text is not null").limit(60)
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows.collect()])

    def counted():
        return sorted(repr(r) for b in language_id._count(iter([batch])) for r in b.to_pylist())

    want = counted()
    monkeypatch.setattr(language_id, "SLICE", 3000)
    monkeypatch.setattr(language_id, "HELD_GRAMS", 500)
    assert want == counted()


def test_ties(spark):
    """Equal windows: the first counts. Equal distances: the first language by name."""
    bench = spark.createDataFrame([(1, "one two three four five six"), (2, "one two three four five six")], "item_id BIGINT, text STRING")
    text = "x one two three four five six y one two three four five six"
    df = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    found = decontaminate.with_leaks(df, bench).select(F.inline("leaks")).collect()
    assert sorted((r.item_id, r.similarity, r.start_word) for r in found) == [(1, 1.0, 1), (2, 1.0, 1)]
    both = spark.createDataFrame([(1, "abc abd", "xx"), (2, "abc abd", "aa")], "doc_id BIGINT, text STRING, lang STRING")
    profiles = language_id.learn_profiles(both)
    assert {r.lang_pred for r in language_id.identify(both, profiles).collect()} == {"aa"}


def test_registered(spark):
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in contract.queries() and json.dumps(sorted(contract.oracle_sql()))
