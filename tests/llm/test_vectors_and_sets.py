"""SimHash, mixing, top-k, packing, neighbours and the pipeline: brute force, exact round trips and odd cases."""

import itertools
import math
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docloom.llm import ann, meeting, mixing, packing, queries, simhash, similar, topk
from docloom.llm.packing import Encoder

from .data import SCHEMA, empty, odd, odd_rows

DATA = "/root/testdata/sf0.01"
TOKENIZER = "word_bpe_49k.json"


# --- SimHash ---------------------------------------------------------------------------------------------------------


def brute_fingerprint(text, shingle):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps: list[int], distance: int) -> list[int]:
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= distance):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rows = queries.op5_simhash_near_dedup(spark, DATA).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows.sort(key=lambda r: r["doc_id"])
    for r in rows[::7]:
        assert r["fingerprint"] == f"{brute_fingerprint(text[r['doc_id']], 4):016x}"
    roots = brute_components([int(r["fingerprint"], 16) for r in rows], 4)
    assert [r["component_id"] for r in rows] == [rows[k]["doc_id"] for k in roots]


def near_copies(n, rng):
    """Fingerprints around a few centres, so that buckets are crowded, and some far ones."""
    out = []
    for _ in range(n):
        f = int((0x0123456789ABCDEF, 0xFEDCBA9876543210, 0)[rng.integers(3)])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            f ^= 1 << int(b)
        out.append(f)
    return sorted(set(out) | {int(x) for x in rng.integers(0, 2**63, 200)})


@pytest.mark.parametrize("chunk,finish", [(4096, 100_000), (16, 0), (4096, 20)])
def test_links_of_crowded_buckets(spark, monkeypatch, chunk, finish):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "FINISH", finish)
    monkeypatch.setattr(meeting, "CHUNKS", 1)
    fps = near_copies(400, np.random.default_rng(chunk))
    nodes = spark.createDataFrame([(bytearray(np.uint64(f).tobytes()),) for f in fps], "fp binary")
    edges = simhash.links(simhash.bucketed(nodes, simhash.key_masks(4, len(fps))), 4)
    found = {bytes(r["node"]): bytes(r["root"]) for r in simhash.components(edges).collect()}
    keys = [np.uint64(f).tobytes() for f in fps]
    mine = defaultdict(set)
    for k in keys:
        mine[found.get(k, k)].add(k)
    theirs = defaultdict(set)
    for k, r in zip(keys, brute_components(fps, 4)):
        theirs[r].add(k)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("chunk,chunks", [(4, 8), (4, 1), (20, 8)])
def test_exact_links_of_large_components(spark, monkeypatch, chunk, chunks):
    monkeypatch.setattr(similar, "CHUNK", chunk)
    monkeypatch.setattr(meeting, "CHUNKS", chunks)
    rng = np.random.default_rng(chunk)
    texts = []
    for k in range(4):  # chains and heaps of texts around 0.8, in one candidate component each
        base = [f"w{k}x{j}" for j in range(60)]
        for _ in range(25):
            own = list(base)
            for at in rng.choice(60, int(rng.integers(0, 3)), replace=False):
                own[at] = f"v{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["id"]: r["component"] for r in similar.similar_groups(df).collect()}
    assert [found[k] for k in range(len(texts))] == brute_groups(texts)


@pytest.mark.parametrize("kind", ["near copies", "two groups and strays", "strays"])
def test_large_groups_move_few_rows(spark, monkeypatch, kind):
    """Links of a large bucket are whole; near copies move a few times each, not once for each chunk of the group."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(meeting, "CHUNKS", 2)
    rng = np.random.default_rng(17)
    near = lambda centre, n: [centre ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 3), replace=False)) for _ in range(n)]
    strays = [int(x) << 41 | 0x5555555555 for x in rng.integers(0, 1 << 22, 40)]
    fps = {"near copies": near(0, 900), "two groups and strays": near(0, 500) + near(0x5555555555, 60) + strays[:12], "strays": strays}[kind]
    fps = sorted({f for f in fps if f < 1 << 63})
    rows = spark.createDataFrame([(0, 7, bytearray(np.uint64(f).tobytes())) for f in fps], "mask_no int, key bigint, fp binary")
    moved, plain = [], meeting.dealt

    def counted(rows, by, node, rest, parts, find):
        moved.append(rows.select(F.sum(F.size(parts))).collect()[0][0] or 0)
        return plain(rows, by, node, rest, parts, find)

    monkeypatch.setattr(meeting, "dealt", counted)
    edges = simhash.links(rows, 4)
    found = {bytes(r["node"]): bytes(r["root"]) for r in simhash.components(edges).collect()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for f, r in zip(fps, brute_components(fps, 4)):
        key = np.uint64(f).tobytes()
        mine[found.get(key, key)].add(key)
        theirs[r].add(key)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    n, chunks = len(fps), -(-len(fps) // 16)
    if kind != "strays":
        assert sum(moved) < n * chunks / 2, moved
    assert kind != "near copies" or moved[2] == 0 and sum(moved) < 3 * n, moved


def test_pivots_lose_no_pair():
    rng = np.random.default_rng(5)
    fps = np.array(near_copies(300, rng), np.uint64).reshape(-1, 1)
    table = np.stack([np.bitwise_count(fps ^ r).sum(1) for r in simhash.references(1)], 1).astype(np.int64)
    for i, j in itertools.combinations(range(len(fps)), 2):
        if np.bitwise_count(fps[i] ^ fps[j]).sum() <= 4:
            assert np.abs(table[i] - table[j]).max() <= 4


@pytest.mark.parametrize("nodes", [10, 10**6, 10**9])
def test_keys_are_lossless(nodes):
    masks = simhash.key_masks(4, nodes)
    rng = np.random.default_rng(nodes % 97)
    for _ in range(200):
        off = set(rng.choice(64, 4, replace=False).tolist())
        assert any(off.isdisjoint(m.tolist()) for m in masks)


def test_pivots_of_a_bucket_lose_no_pair():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, (8, 4), np.uint64)
    fps = base[rng.integers(0, 8, 300)].copy()
    for k in range(300):
        for bit in rng.integers(0, 256, rng.integers(0, 60)):
            fps[k, bit // 64] ^= np.uint64(1 << int(bit % 64))
    group = np.sort(rng.integers(0, 3, 300))
    table = simhash._own_pivots(fps, group)
    a, b = simhash._forest(fps, table, group, similar.DISTANCE)
    root = list(range(300))
    for i, j in itertools.combinations(range(300), 2):
        if group[i] == group[j] and np.bitwise_count(fps[i] ^ fps[j]).sum() <= similar.DISTANCE:
            assert np.abs(table[i] - table[j]).max() <= similar.DISTANCE
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    mine = list(range(300))
    for i, j in zip(a.tolist(), b.tolist()):
        old, new = max(mine[i], mine[j]), min(mine[i], mine[j])
        mine = [new if r == old else r for r in mine]
    assert mine == root and (np.abs(table[:, None] - table[None]).max(2) > similar.DISTANCE).any()


def test_keys_and_fingerprints_find_pairs_at_the_bound():
    """A pair at 0.8 shares a key whatever the number of nodes, and its fingerprints differ in DISTANCE bits or fewer."""
    rng = np.random.default_rng(12)
    met, near = [], []
    for _ in range(1500):
        shared = int(rng.choice([4, 8, 40, 400]))
        extra = shared // 4
        left = int(rng.integers(0, extra + 1))
        every = rng.integers(0, 1 << 64, shared + extra, np.uint64)
        a, b = np.sort(every[: shared + left]), np.sort(np.concatenate((every[:shared], every[shared + left :])))
        met.append(bool(set(similar.keys(a).tolist()) & set(similar.keys(b).tolist())))
        one, two = (np.frombuffer(similar.node_of(x)[: 8 * similar.WORDS], np.uint64) for x in (a, b))
        near.append(int(np.bitwise_count(one ^ two).sum()) <= similar.DISTANCE)
    assert np.mean(met) >= 0.998 and all(near)


def shingle_sets(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    return [{b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]


def brute_groups(texts):
    """The smallest position reachable over pairs whose shingle sets have a Jaccard similarity of 0.8 or more."""
    sets, root = shingle_sets(texts), list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
            old, new = max(root[i], root[j]), min(root[i], root[j])
            root = [new if r == old else r for r in root]
    return root


def test_pipeline_links_exactly_the_similar_texts(spark, monkeypatch):
    import corpus_pipeline as cp

    rng = np.random.default_rng(8)
    texts = []
    for k in range(120):  # similarities from 0.7 to 0.9, close to the bound on either side, and copies of copies
        base = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(8, 500)))]
        texts.append(" ".join(base))
        for _ in range(2):
            base = base + [f"v{x}" for x in rng.integers(0, 10**6, max(1, int(len(base) * rng.uniform(0.12, 0.4))))]
            texts.append(" ".join(base))
    texts += ["a b c d e f"] * 2 + ["", " ", "a b", "a b c"] + ["x " * 3000 + "tail one two", "x " * 3000 + "tail three four"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = [k for k, r in enumerate(brute_groups(texts)) if k == r]
    assert 150 < len(kept) < 320
    for chunk in (similar.CHUNK, 2):
        monkeypatch.setattr(similar, "CHUNK", chunk)
        found = {r["doc_id"] for r in cp.drop_near_duplicates(spark, df, DATA).collect()}
        assert found == set(kept)


def test_pipeline_decides_by_row(spark):
    import corpus_pipeline as cp

    one, two, three = (" ".join(f"{c}{k}" for k in range(30)) for c in "abc")
    rows = [(1, one), (1, two), (5, one), (5, three), (None, two), (None, two), (None, "own text of a row without id here"), (2, None), (3, ""), (None, None), (7, three), (8, two + " tail"), (9, one), (9, one), (10, "x y z"), (10, "x y z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("source", F.lit("s"))
    out = cp.drop_near_duplicates(spark, df, DATA)
    assert out.columns == df.columns
    left = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert left == Counter([(1, one), (1, two), (5, three), (None, "own text of a row without id here"), (2, None), (10, "x y z")])
    assert cp.drop_near_duplicates(spark, df.limit(0), DATA).count() == 0


def test_pipeline_groups_of_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    found = {r["id"]: r["component"] for r in similar.similar_groups(docs).collect()}
    assert len(found) == len(rows)
    assert [found[d] for d, _ in rows] == [rows[k][0] for k in brute_groups([t for _, t in rows])]


def test_simhash_odd_cases(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(odd_rows())
    by = defaultdict(list)
    for r in rows:
        by[r["id"]].append((bytes(r["fp"]), r["component"]))
    assert by[1] == by[2] == by[3] == [(bytes(8), 1)]
    assert by[5][0] == by[5][1] and by[8][0][1] == 7 and {c for _, c in by[None]} == {1, 7}
    assert simhash.near_duplicates(empty(spark)).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


def check_schedule(rows, weights, block_rows):
    """Every block is inside its window, one a slot, less than a block off the fluid ideal; blocks have the right rows."""
    blocks = {}
    for r in rows:
        blocks.setdefault((r["source"], r["mix_block"]), (r["mix_slot"], r["mix_release"], r["mix_deadline"]))
    assert sorted(b[0] for b in blocks.values()) == list(range(len(blocks)))
    assert all(rel <= slot < dead for slot, rel, dead in blocks.values())
    assert sorted(r["mix_position"] for r in rows) == list(range(len(rows)))
    n = Counter(s for s, _ in blocks)
    order = [s for _, s in sorted((slot, s) for (s, _), (slot, _, _) in blocks.items())]
    ideal, done = Counter(), Counter()
    for source in order:
        left = 1.0
        while left > 1e-12:  # one slot of the fluid: sources with blocks advance at their weights
            active = {s: weights[s] for s in n if ideal[s] < n[s] - 1e-9}
            if not active:
                break
            total = sum(active.values())
            step = min(left, *((n[s] - ideal[s]) * total / w for s, w in active.items()))
            for s, w in active.items():
                ideal[s] += step * w / total
            left -= step
        done[source] += 1
        assert all(abs(done[s] - ideal[s]) < 1 + 1e-6 for s in n)


@pytest.mark.parametrize("seed", range(4))
def test_mixture_is_less_than_a_block_off(spark, seed):
    rng = np.random.default_rng(seed)
    sources = [f"s{k}" for k in range(rng.integers(2, 9))]
    weights = {s: int(rng.integers(1, 30)) for s in sources}
    rows = [(i, sources[rng.integers(len(sources)) if i % 3 else 0]) for i in range(700)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, source string"), weights=weights, block_rows=8).collect()
    check_schedule(out, weights, 8)
    sizes = Counter((r["source"], r["mix_block"]) for r in out)
    assert all(v <= 8 for v in sizes.values()) and sum(v < 8 for v in sizes.values()) <= len(sources)


def edf(sizes, weights, block_rows):
    """(source, block): (slot, first row) by earliest deadline first over all blocks at once."""
    n = {s: -(-r // block_rows) for s, r in sizes.items()}
    gone = lambda s, j: sum(min(Fraction(weights[k] * j, weights[s]), n[k]) for k in n)
    todo = [(math.ceil(gone(s, j + 1)), s, j, math.floor(gone(s, j))) for s in n for j in range(n[s])]
    out, row = {}, 0
    for slot in range(len(todo)):
        pick = min(t for t in todo if t[3] <= slot)
        todo.remove(pick)
        _, s, j, _ = pick
        out[s, j] = (slot, row)
        row += min(block_rows, sizes[s] - j * block_rows)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_rounds_give_the_schedule_of_all_blocks(spark, seed):
    rng = np.random.default_rng(20 + seed)
    weights = {f"s{k}": int(rng.integers(1, 6)) for k in range(5)}
    sizes = {s: int(rng.integers(1, 160)) for s in weights}
    rows = [(k, s) for s, n in sizes.items() for k in range(n)]
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, source string"), weights=weights, block_rows=3).collect()
    expected = edf(sizes, weights, 3)
    assert sorted(r["mix_position"] for r in out) == list(range(len(rows)))
    for r in out:
        slot, row = expected[r["source"], r["mix_block"]]
        assert r["mix_slot"] == slot and row <= r["mix_position"] < row + 3


def test_plan_does_not_grow_with_rows(spark):
    def plan(rows):
        sources = spark.createDataFrame([(k, a, n * rows, n * rows * 16 - k) for k, (a, n) in enumerate(((100, 7), (60, 5), (30, 9)))], "s int, a bigint, n bigint, rows bigint")
        found = mixing.planned(sources).collect()
        assert sum((r["upto"] - r["first"]) * 1 for r in found if r["s"] == 0 and r["j"] == 0) == -(-7 * rows // 100)
        return len(found)

    assert plan(10**9) <= 6 * 190 and plan(1000) <= 6 * 190


def test_mixture_of_many_sources(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 600).cast("string").alias("source"))
    out = mixing.mixed(df, block_rows=2).collect()
    assert sorted(r["mix_position"] for r in out) == list(range(3000))
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in out)
    assert len({(r["source"], r["mix_block"]): r["mix_slot"] for r in out}) == len({r["mix_slot"] for r in out}) == 1800


def test_mixing_odd_cases(spark):
    docs = odd(spark)
    out = mixing.mixed(docs, block_rows=2)
    assert out.columns[: len(docs.columns)] == docs.columns and out.columns[-1] == "mix_position_"
    assert sorted(r["mix_position_"] for r in out.collect()) == list(range(len(odd_rows())))
    assert mixing.mixed(empty(spark)).count() == 0


# --- top-k -----------------------------------------------------------------------------------------------------------

ODD_VECTORS = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (100, [1.0, 2.0, 3.0]), (7, [3.0, 3.0]), (8, [3.0, 3.0]), (9, [-1.0, 0.0]), (10, [0.5, 0.5])]


def test_top_k_matches_brute_force(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.floor(np.array([r["embedding"] for r in rows], np.float64) * 256)
    found = defaultdict(list)
    for r in sorted(queries.op7_exact_topk(spark, DATA).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    for k in np.flatnonzero(ids % 50 == 0):
        s = x @ x[k]
        rest = np.flatnonzero(ids != ids[k])
        best = rest[np.lexsort((ids[rest], -s[rest]))[:5]]
        assert found[ids[k]] == [(ids[b], int(s[b])) for b in best]


@pytest.mark.parametrize("size", [3, 40])
def test_branch_and_bound_with_ties_and_large_values(size):
    rng = np.random.default_rng(size)
    c = rng.integers(-3, 4, (3000, size)) / 256 * (1 if size == 3 else 1e6)
    ids = rng.permutation(3000)
    q = c[:20]
    for own, row, (places, scores) in zip(ids[:20], q, topk.search(256, 5)(size, ids, c, b"", ids[:20], q)):
        s = (np.floor(c * 256) @ np.floor(row * 256)).astype(np.int64)
        rest = np.flatnonzero(ids != own)
        best = rest[np.lexsort((ids[rest], -s[rest]))[:5]]
        assert ids[places].tolist() == ids[best].tolist() and scores.tolist() == s[best].tolist()


def test_blocks_hold_bytes_not_rows(spark, monkeypatch):
    from docloom.llm import blocks

    rng = np.random.default_rng(9)
    x = rng.integers(-8, 8, (300, 500)) / 16
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(blocks, "BYTES", 1 << 17)  # 32 vectors
    monkeypatch.setattr(blocks, "QUERY_BYTES", 1 << 14)
    seen = [len(np.frombuffer(ids, np.int64)) for _, ids, _, _ in blocks._packed(iter(df.select("vec_id", "embedding").toArrow().to_batches()), None, blocks.MOST, 1 << 17)]
    assert max(seen) == 32 and sum(seen) == 300
    found = defaultdict(list)
    for r in sorted(topk.top_k(df).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    c = np.floor(x * 256).astype(int)
    for q in range(0, 300, 50):
        s = c @ c[q]
        rest = np.array([k for k in range(300) if k != q])
        assert found[q] == [(k, s[k]) for k in rest[np.lexsort((rest, -s[rest]))[:5]]]


def test_top_k_odd_cases(spark):
    df = spark.createDataFrame(ODD_VECTORS, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("x"))
    rows = topk.top_k(df, k=3).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert by[0] == [(1, 7, 3 * 768 * 256), (2, 8, 3 * 768 * 256), (3, 50, 5 * 256 * 256)]
    assert [v for _, v, _ in by[50]] == [7, 8, 0] and 100 not in by
    huge = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 1.0])], "vec_id bigint, embedding array<double>")
    assert topk.top_k(huge).collect()[0]["score"] == 2**63 - 1
    assert topk.top_k(df.limit(0)).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return Encoder(public_tokenizers.path(TOKENIZER))


@pytest.fixture(scope="module")
def tokenizer():
    """The file as it is, apart from the encoder."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER))


def check_packed(rows, wanted):
    """rows cover the ids of wanted (list of (doc_id, ids)) exactly, in sequences that are gapless and not too long."""
    expected = Counter()
    for d, ids in wanted:
        expected[d, zlib.crc32(np.asarray(ids, "<u4").tobytes())] += 1
    seqs, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    padding = total = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.SIZE
        total += at
        padding += 0 if at & (at - 1) == 0 else packing.SIZE - at
    return seqs, docs, padding / max(total, 1)


def test_packing_round_trip(spark, tokenizer):
    rows = queries.op8_order_preserving_packing(spark, DATA).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    wanted = {d: np.array([*ids_of(tokenizer, t), 2], "<u4") for d, t in docs.items()}
    _, pieces, padding = check_packed(rows, wanted.items())
    assert padding < 0.01 and pieces.keys() == wanted.keys()
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(wanted[d])
            assert r["ids_crc32"] == zlib.crc32(wanted[d][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(wanted[d])


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def check_encoder(encoder, tokenizer, texts):
    for _ in range(2):  # the second time words are remembered
        flat, counts = encoder.ids(pa.array([*texts, None]))
        assert counts[-1] == 0
        for t, ids in zip(texts, np.split(flat, counts.cumsum())):
            assert ids.tolist() == ids_of(tokenizer, t), t


def test_encoder_is_the_tokenizer(encoder, tokenizer):
    odd_texts = ["", "  ", "İstanbul ΑΣ. Σ!! <|endoftext|> x's don't áb́. é,", "a\x1cb c d", "½. ³, x². 漢字。 ok?|| ...!!! 12.5, 3:4; _a_. naïve", "ﬁ. ẞ? ß!", "it's, we'll. 'tis they'd! O'Neil's", "👍🏽 👨‍👩‍👧. z", "A" * 300]
    odd_texts += ["hello <|startoftext|> world", "<|ENDOFTEXT|>", "x<|StartOfText|>y.", "İ?", "Aİ?", "aİ.", "İ..", "ǰ. ẖ, ΐ! ΰ; և: ŉ?", "<|endoftext |>", "e\u0301. a\u0308? n\u0303", "Ⅳ. ª, º! µ? ß;"]
    check_encoder(encoder, tokenizer, odd_texts)
    encoder.clear()


LETTERS = st.sampled_from("abcxyzABCIİıiſßẞΑΣσςΐΰάéÉñŉǅǆЖжїЙ漢字ªºµ") | st.characters(min_codepoint=0x00C0, max_codepoint=0x05FF)
OTHERS = st.sampled_from([".", ",", "?", "!", "|", ";", ":", "'s", "'", " ", "  ", "\n", "\t", "1", "²", "\u0301", "\u0307", "\u0308", "\u0345", "<|startoftext|>", "<|endoftext|>", "<|", "|>", "<|EndOfText|>", "\u00a0", "\x1f", "\u200d", "👍🏽"])


@settings(max_examples=600, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(LETTERS | OTHERS, max_size=14).map("".join), min_size=1, max_size=6))
def test_encoder_is_the_tokenizer_on_any_text(encoder, tokenizer, texts):
    check_encoder(encoder, tokenizer, texts)


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    at = np.concatenate(([0], np.cumsum(rng.integers(1, 9, rng.integers(1, 30)))))
    cost = np.concatenate(([0], rng.choice([0, 3, 8], len(at) - 1)))
    cost[-1] = 0
    size, end = 16, int(at[-1])
    best = {0: 0}
    for j in range(1, len(at)):
        options = [best[i] + (0 if (n := int(at[j] - at[i])).bit_count() == 1 else size - n) for i in range(j) if at[j] - at[i] <= size]
        best[j] = min(options) + int(cost[j])
    total = min(best[i] + packing.tail_cost(end - int(at[i]), size) for i in range(len(at) - 1) if end - at[i] <= size)
    total = min(total, best[len(at) - 1])
    cuts = packing.best_cuts(at, cost, True, size)
    assert cuts[-1] == end and all(0 < b - a <= size for a, b in itertools.pairwise([0, *cuts]))
    price = dict(zip(at.tolist(), cost.tolist()))
    spent = sum(0 if (b - a).bit_count() == 1 else size - (b - a) for a, b in itertools.pairwise([0, *cuts])) + sum(price.get(c, packing.INSIDE) for c in cuts[:-1])
    assert spent <= total


def test_packing_odd_cases(spark, tokenizer):
    rows = packing.packed(odd(spark), TOKENIZER).collect()
    wanted = [(i, [*ids_of(tokenizer, t), 2]) for i, t, *_ in odd_rows()]
    _, pieces, _ = check_packed(rows, wanted)
    tokens = Counter()
    for d, ids in wanted:
        tokens[d] += len(ids)
    assert {d: sum(r["length"] for r in own) for d, own in pieces.items()} == dict(tokens)
    assert len(pieces[4]) > 10 and [r["length"] for r in pieces[2]] == [1]
    ordered = packing.packed(odd(spark), TOKENIZER, order_by=[-F.col("doc_id")]).collect()
    assert sum(r["length"] for r in ordered) == sum(tokens.values())
    assert packing.packed(empty(spark), TOKENIZER).count() == 0


# --- neighbours ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows_of_block", [65536, 150])
def test_neighbours_recall(spark, monkeypatch, rows_of_block):
    from docloom.llm import blocks

    monkeypatch.setattr(blocks, "MOST", rows_of_block)
    monkeypatch.setattr(blocks, "LEAST", min(blocks.LEAST, rows_of_block))
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    found = defaultdict(list)
    for r in sorted(queries.op9_anisotropic_ann(spark, sf).collect(), key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = []
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(np.square(x - x[k]).sum(1))
        rest = np.flatnonzero(ids != ids[k])
        best = rest[np.lexsort((ids[rest], d[rest]))[:10]]
        hit.append(len({v for v, _ in found[ids[k]]} & set(ids[best].tolist())) / 10)
        assert [s for _, s in found[ids[k]]] == sorted(s for _, s in found[ids[k]])
        assert all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-9 for v, s in found[ids[k]])
    assert np.mean(hit) >= 0.9


def test_codes_weigh_the_parallel_residual():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    off = {}
    for threshold in (0.0, ann.THRESHOLD):
        book = ann.Codebooks(x, threshold=threshold)
        held = np.concatenate([book.centres[m, c] for m, c in enumerate(book.encode(x))], 1)
        off[threshold] = np.square(((x - held) * unit).sum(1)).mean()
    assert off[ann.THRESHOLD] < 0.5 * off[0.0]
    q = rng.normal(size=(3, 64))
    codes = np.frombuffer(book.packed(x), np.uint8).reshape(-1, len(x))
    assert np.allclose(sum(t[c] for t, c in zip(book.tables(q)[0], codes)), held @ q[0], atol=1e-4)


@pytest.mark.parametrize("spread", [0.0, 1e-3, 1.0])
def test_search_of_crowded_groups_is_exact_without_deviations(spread):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(10, 32)), 600, 0)
    x = (x + spread * rng.normal(size=x.shape))[rng.permutation(len(x))]
    ids = rng.permutation(len(x))
    book = ann.Codebooks(x[:2000])
    found = list(ann.search({32: book}, 10, 128, None)(32, ids, x, book.packed(x), ids[:70], x[:70]))
    for q, (places, scores) in enumerate(found):
        exact = np.sqrt(np.square(x - x[q]).sum(1))
        order = np.lexsort((ids, exact))
        best = order[order != q][:10]
        assert ids[places].tolist() == ids[best].tolist() and np.array_equal(scores, exact[best])


def crowded(rng, dim, spread):
    x = np.repeat(rng.normal(size=(10, dim)), 600, 0)
    return (x + spread * rng.normal(size=x.shape))[rng.permutation(len(x))]


@pytest.mark.parametrize("kind,dim,most", [(0.0, 64, 0.11), (1e-3, 64, 0.11), (0.1, 64, 0.11), (1.0, 64, 0.06), ("table", 64, 0.1), ("plain", 64, 0.06), ("plain", 256, 0.06)])
def test_search_finds_neighbours_among_few(spark, monkeypatch, kind, dim, most):
    """Recall and the share of a block that is ranked: groups of 600 rows are ranked whole, a tenth of the rows."""
    rng, shares = np.random.default_rng(4), []
    if kind == "table":
        x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()], np.float64)
    else:
        x = rng.normal(size=(6000, dim)) if kind == "plain" else crowded(rng, dim, kind)
    opened = ann._open

    def counted(*args):
        found = opened(*args)
        shares.append(len(np.union1d(args[5], found)) / len(x))
        return found

    monkeypatch.setattr(ann, "_open", counted)
    ids, book, hit = rng.permutation(len(x)), ann.Codebooks(x[:2000]), []
    for q, (places, _) in enumerate(ann.search({dim: book}, 10, ann.RERANK)(dim, ids, x, book.packed(x), ids[:60], x[:60])):
        order = np.lexsort((ids, np.sqrt(np.square(x - x[q]).sum(1))))
        hit.append(len(set(order[order != q][:10].tolist()) & set(places.tolist())) / 10)
    assert np.mean(hit) >= 0.95 and np.mean(shares) <= most


def test_neighbours_odd_cases(spark):
    df = spark.createDataFrame([(i * 100 if i in (50,) else i, v) for i, v in ODD_VECTORS if True], "vec_id bigint, embedding array<double>").withColumn("rank", F.lit("x"))
    df = df.withColumn("vec_id", F.when(F.col("vec_id") == 5000, 200).otherwise(F.col("vec_id")))
    by = defaultdict(list)
    for r in sorted(ann.neighbours(df, k=3).collect(), key=lambda r: r["rank"]):
        by[r["query_id"]].append((r["vec_id"], r["score"]))
    assert by[0][:2] == [(200, 0.0), (200, 0.0)] and [v for v, _ in by[200]][0] == 0 and 100 not in by
    assert ann.neighbours(df.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path, encoder):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        assert name == "packing" or docs.columns == columns
    start = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {name: {r["doc_id"]: r for r in df.collect()} for name, df in kept.items()}
    toxic = {r["doc_id"] for r in queries.op1_ordinal_toxicity(spark, DATA).collect() if r["toxic"]}
    assert rows["toxicity"].keys() == start.keys() - toxic
    assert rows["line_dedup"].keys() == rows["toxicity"].keys()
    assert all(r["n_chars"] == len(r["text"]) for r in rows["line_dedup"].values())
    held = rows["simhash_near_dedup"]
    texts = defaultdict(set)
    for d, r in rows["line_dedup"].items():
        texts[r["text"]].add(d)
    for group in texts.values():  # of exact copies no two stay
        assert len(group & held.keys()) <= 1
    assert rows["mixing"].keys() == held.keys() and kept["mixing"].count() == len(held)
    order = [r["doc_id"] for r in kept["mixing"].orderBy("_metadata.file_name", "_metadata.row_index").collect()]
    placed = {r["doc_id"]: r["mix_position"] for r in mixing.mixed(kept["simhash_near_dedup"]).collect()}
    assert order == sorted(placed, key=placed.get)
    tokens = Counter()
    for r in kept["packing"].collect():
        tokens[r["doc_id"]] += r["length"]
    assert tokens.keys() == held.keys()
    some = sorted(held)[::20]
    assert [tokens[d] for d in some] == (encoder.ids(pa.array([rows["mixing"][d]["text"] for d in some]))[1] + 1).tolist()


def test_pipeline_reads_files_by_their_numbers(spark, tmp_path):
    import corpus_pipeline as cp

    names = ["part-00002-a.parquet", "part-99999-a.parquet", "part-100000-a.parquet", "part-1000000-a.parquet"]
    for k, name in enumerate(names):
        spark.range(2).selectExpr(f"cast({k} * 10 + id as bigint) AS doc_id", "'t' AS text").coalesce(1).write.parquet(f"{tmp_path}/{k}")
        (file,) = (tmp_path / str(k)).glob("part-*.parquet")
        (tmp_path / "all").mkdir(exist_ok=True)
        file.rename(tmp_path / "all" / name)
    docs = spark.read.parquet(f"{tmp_path}/all")
    assert [r["doc_id"] for r in docs.orderBy(*cp.file_order(docs)).collect()] == [0, 1, 10, 11, 20, 21, 30, 31]
    made = spark.createDataFrame([(1, "t")], "doc_id bigint, text string")
    assert made.select(*cp.file_order(made)).columns == ["doc_id"]


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([(7, 0, 1)], "doc_id bigint, toxic int, quality int")
    for name, docs in (("odd", odd(spark)), ("empty", empty(spark))):
        folder = f"{tmp_path}/{name}"
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out = cp.run(spark, folder)
        ids = [r["doc_id"] for r in out.filter("offset >= 0 AND start = 0").collect()]
        assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
        assert name == "odd" or not ids
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "packing"]
    assert SCHEMA
