"""Cross-tokenizer alignment, Merkle manifest and pivot-permutation index: brute force and odd cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from docloom.llm import alignment, merkle, pivots, queries

from .data import empty, odd, odd_rows

DATA = "/root/testdata/sf0.01"
A, B, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))


# --- alignment -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_tokens(plain, text):
    """[(id, bytes)] of both sides, by the libraries alone; empty if bytes differ."""
    if not text:
        return [], []
    a, b = plain
    of = {v: k for k, v in ((bytes([n]), c) for c, n in alignment.byte_of_character().items())}
    own = [(i, b"".join(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    other = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        other.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (own, other) if b"".join(x for _, x in own) == want == b"".join(x for _, x in other) else ([], [])


def plain_groups(own, other):
    ends = lambda tokens: np.cumsum([len(x) for _, x in tokens]).tolist()
    groups, g = [], ([], [])
    i = j = 0
    ea, eb = ends(own), ends(other)
    while i < len(own) or j < len(other):
        if j == len(other) or (i < len(own) and ea[i] <= eb[j]):
            g[0].append(own[i][0])
            i += 1
        else:
            g[1].append(other[j][0])
            j += 1
        if i and j and ea[i - 1] == eb[j - 1]:
            groups.append(g)
            g = ([], [])
    return groups


def brute_alignment(plain, rows):
    """Counters of expected rows for (doc_id, text)."""
    each = [(i, *plain_tokens(plain, t)) for i, t in rows]
    found = [(i, own, other, plain_groups(own, other)) for i, own, other in each]
    count = Counter()
    for *_, groups in found:
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for i, own, other, groups in found:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out[i, len(own), len(other), len(groups), len(links), hashlib.sha256(text.encode()).hexdigest() if groups else "", sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)] += 1
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum").collect())


def test_alignment_matches_brute_force(spark, plain):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows_of(queries.op12_token_alignment(spark, "/root/testdata/sf0.001")) == brute_alignment(plain, rows)


ODD_TEXTS = ["", None, " ", "  ", "a  b", " lead", "trail ", "x\n y", "tab\tx ", "▁x", "<|endoftext|> <s> </s> <0x41>", "é ﬁ ①", "漢字 かな", "👍🏽 x", "a b c  d", "᠎ x", "aaaa" * 900, "=" * 3000 + " é" * 50, "it's we'll\r\n\r\n  done", "\x00 \x1c x"]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_of_odd_texts(spark, plain, monkeypatch, small):
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)] + [(r[0], r[1][:5000] if r[1] else r[1]) for r in odd_rows()] + [(7, "same text"), (7, "same text"), (None, "same text")]
    if small:  # rows and runs of few events, a table that holds few pairs
        for name, value in (("BLOCK", 7), ("HELD", 20), ("CHARS", 50), ("TOGETHER", 3), ("DENSE", 3), ("COUNTED", 10)):
            monkeypatch.setattr(alignment, name, value)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_a", F.lit(1)).withColumn("pairs", F.lit("x")).repartition(3)
    found = alignment.aligned(df, A, B, ranks=RANKS, **({"table": 40} if small else {})).withColumnRenamed("id", "doc_id")
    assert rows_of(found) == brute_alignment(plain, rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.aligned(empty(spark), A, B).collect() == []


@pytest.fixture(scope="module")
def encoded():
    return alignment.Encoded(A, B, RANKS)


ALPHABET = st.sampled_from(list("ab'sl. \n\t-1é漢Ώ़👍▁  　<|>x0") + ["<|endoftext|>", "  ", " the", "<s>", "᠎", "ǅ", "ʰ"])


@given(texts=st.lists(st.lists(ALPHABET, max_size=25).map("".join), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_segments_keep_the_tokenizers_ids(encoded, texts):
    encoded._clear()
    a, b = encoded.sides
    sides, has = encoded(texts)
    starts = [np.cumsum(n) - n for _, n in sides]
    for k, t in enumerate(texts):
        x = a.own.encode_batch([" " + t], add_special_tokens=False)[0].ids if t else []
        y = b.own.encode(t)
        own, other = (b"".join(map(side.bytes.__getitem__, ids)) for side, ids in ((a, x), (b, y)))
        want = (" " + t).encode()
        if not t or own != want or other != want:
            assert not has[k] and not sides[0][1][k] and not sides[1][1][k]
            continue
        assert sides[0][0][starts[0][k] : starts[0][k] + sides[0][1][k]].tolist() == x
        assert sides[1][0][starts[1][k] : starts[1][k] + sides[1][1][k]].tolist() == y


def test_ranks_give_the_ids_of_the_tokenizer():
    side, rnd = alignment.ByteLevel(A, RANKS), random.Random(3)
    chars = [chr(c) for c in range(ord(alignment.SIMPLE))]
    texts = ["".join(rnd.choice(rnd.choice((chars, " \t\n'sld1a\xa0\x85\x1c²"))) for _ in range(30)) for _ in range(4000)]
    assert side(texts) == alignment.ByteLevel(A)(texts)


# --- manifest --------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes):
    """(root, [(siblings left, siblings right) by level] of each node)."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            steps[k].append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        nodes, at = [h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], steps


def brute_manifest(rows):
    """Counter of expected rows for (doc_id, source, lang, n_chars, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(part, r))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = brute_tree([leaf(r) for r in groups[s]])
    root, over = brute_tree([trees[s][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for r, steps in zip(groups[s], trees[s][1]):
            steps = steps + over[k]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc = leaf((*r[:4], r[4].replace("\n", "") if bad and r[4] is not None else r[4]))
            for before, after in steps:
                acc = h(before, acc, after)
            out[r[0], leaf(r), trees[s][0], root, h(*[x for step in steps for x in step]), acc, acc == root] += 1
    return out


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_of(df):
    own = ["doc_id", "source", "lang", "n_chars"]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    bare = merkle.leaf_of(*own, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return Counter(tuple(r) for r in merkle.manifest(df, "source", "doc_id", merkle.leaf_of(*own, "text"), F.when(even, bare)).withColumnRenamed("id", "doc_id").select(*MANIFEST).collect())


def test_manifest_matches_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert Counter(tuple(r) for r in queries.op13_merkle_manifest(spark, DATA).select(*MANIFEST).collect()) == brute_manifest(rows)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (82, 3, 1, 81, 27, 28, 9, 80, 4), (6562, 1, 5)])
def test_manifest_of_groups_of_all_sizes(spark, sizes):
    rows = [(k * 10_000 + i, None if k == 1 else f"s{k}", "en", None, f"a\nb {i}" if i % 3 else None) for k, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert manifest_of(df) == brute_manifest(rows)


def test_manifest_of_many_groups(spark):
    rows = [(i, f"é{i % 97}" if i % 5 else "", None, i, "") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert manifest_of(df) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_rows()]
    assert manifest_of(odd(spark).withColumn("key", F.lit(1)).withColumn("number", F.lit("x")).withColumn("digest", F.lit(0))) == brute_manifest(rows)
    assert manifest_of(empty(spark)) == Counter()


# --- pivots ----------------------------------------------------------------------------------------------------------


def brute_links(rows, bound=0.98):
    """[(vec_id, n_links, component_id, kept)] of (vec_id, vector, label), in their order."""
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = [[] for _ in range(n)]
    by = defaultdict(list)
    for k, (_, v, label) in enumerate(rows):
        if label is not None and ok(v):
            by[label, len(v)].append(k)
    for own in by.values():
        x = np.array([rows[k][1] for k in own], np.float64)
        norm = np.linalg.norm(x, axis=1)
        cosine = x @ x.T / norm[:, None] / norm
        for i, j in zip(*np.nonzero(cosine >= bound - 1e-13)):
            if i != j:
                links[own[i]].append(own[j])
    group = list(range(n))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(n):
        for j in links[i]:
            a, b = find(i), find(j)
            group[max(a, b)] = min(a, b)
    least = {}
    for k in range(n):
        i = rows[k][0]
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(rows[k][0], len(links[k]), least.get(find(k)), rows[k][0] == least.get(find(k))) for k in range(n)]


def found_links(df):
    return Counter(tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect())


def near_rows(rng, n, dim, centres, spread, labels=3):
    c = rng.normal(size=(centres, dim))
    x = c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread * np.linalg.norm(c[0]) / np.sqrt(dim)
    return [(k, v, int(rng.integers(labels))) for k, v in enumerate(x.tolist())]


def test_vectors_of_the_table_match_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert found_links(queries.op11_pivot_near_dedup(spark, DATA)) == Counter(brute_links(rows))


@pytest.mark.parametrize("spread,list_size,chunk", [(0.05, 512, 512), (0.13, 8, 512), (0.13, 512, 16), (0.2, 64, 64)])
def test_crowded_vectors_reach_the_recall(spark, monkeypatch, spread, list_size, chunk):
    monkeypatch.setattr(pivots, "LIST", list_size)
    monkeypatch.setattr(pivots, "CHUNK", chunk)
    monkeypatch.setattr(pivots, "MOST", 2 * chunk)
    monkeypatch.setattr(pivots, "TILE", 100)
    rows = near_rows(np.random.default_rng(chunk), 900, 32, 60, spread)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in pivots.near_duplicates(df).collect()}
    wanted = brute_links(rows)
    total = sum(w[1] for w in wanted)
    assert len(found) == len(rows) and all(found[w[0]]["n_links"] <= w[1] for w in wanted)
    assert sum(r["n_links"] for r in found.values()) >= 0.99 * total and total > 100
    assert sum(found[w[0]]["component_id"] == w[2] for w in wanted) >= 0.99 * len(rows)


def test_prefix_lists_hold_every_pair_of_candidates():
    rng = np.random.default_rng(5)
    ranks = np.argsort(rng.random((300, 24)), axis=1)[:, : pivots.NEAREST]
    for size in range(1, pivots.SHARED + 1):
        prefix = pivots.prefixes(ranks, pivots.SHARED, size)
        for i in range(0, 300, 3):
            for j in range(i + 1, 300, 7):
                if len(set(ranks[i]) & set(ranks[j])) >= pivots.SHARED:
                    assert len(set(prefix[i]) & set(prefix[j])) >= size


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [1.0, nan], 1), (10, [inf, 0.0], 1), (11, [2.0, 0.0], 1), (11, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (12, [1.0, 0.0, 0.0], 1), (13, [-1.0, 0.0], 1), (14, [1.0, 0.0, 1e-9], 1), (0, [5.0, 0.0], 2)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("component", F.lit("x")).withColumn("vector", F.lit(2))
    assert found_links(pivots.near_duplicates(df)) == Counter(brute_links(rows))
    assert pivots.near_duplicates(df.limit(0)).collect() == []


def test_many_exact_copies(spark):
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 else [float(k + 1), 1.0, -1.0], 0) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    assert found_links(pivots.near_duplicates(df)) == Counter(brute_links(rows))
