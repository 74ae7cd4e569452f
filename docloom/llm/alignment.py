"""Cross-tokenizer alignment: groups and links between the tokens of a byte-level BPE (A) and a piece model (B).

An event is a token's end: a byte offset in its document, a side and an id.

1. A task encodes its texts by both tokenizers and gives the events of either side, ``BLOCK`` to a row. A row holds ids
   and the offset it starts at; the ends follow from it, since an id fixes how many bytes a token has.
2. The rows of both sides are dealt out by document and sorted by offset within partitions.
3. A machine streams through them. Where both sides end at one offset it cuts a group and forgets what stands before; it
   holds the events after the last cut (and rows read ahead, ``HELD`` events at most), running totals of the document,
   and the document's distinct links.
4. Counts of linked id pairs are summed over documents. The ``TABLE`` pairs of the highest counts go to all tasks, which
   look the links of documents up in them; links of all other pairs are joined with their counts instead.

Texts are cut into segments before a blank that follows a character that is no white space. No token of either
vocabulary reaches across such a place, so a segment met before is not encoded again.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import lean_worker, scratch, staged

#: Events of a row, and events that the machine reads ahead.
BLOCK, HELD = 4096, 1 << 18
#: Characters encoded together; segments kept by a worker; the longest segment that is kept.
CHARS, SEGMENTS, LONGEST = 1 << 21, 1_000_000, 64
#: New segments that are encoded as one text.
TOGETHER = 512
#: Pairs that every task gets the counts of at most.
TABLE = 1 << 21
#: A group of more links than this is counted by its distinct ids.
DENSE = 4096
#: Distinct links that are counted together.
COUNTED = 1 << 22

#: Fixed value: the pattern of the ranks' vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters from here on are left to the tokenizer.json.
SIMPLE = "\u0250"

_CUT = re.compile(r"(?<=[^\s᠎])(?= )")
_WIDE = re.compile(r"[\s᠎] ")


def byte_of_character() -> dict[str, int]:
    """What a character of a byte-level vocabulary stands for: itself if its byte is visible, else 256 and up in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE from a tokenizer.json, and its vocabulary as ranks, which encodes simple texts faster.

    Ranks merge alike; the libraries' patterns part texts alike as long as all characters are below ``SIMPLE``.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                of_bytes = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=of_bytes, special_tokens={})
        of = byte_of_character()
        self.bytes = [b""] * self.own.get_vocab_size()
        for token, i in self.own.get_vocab().items():
            self.bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def __call__(self, texts: list[str]) -> list[list[int]]:
        simple = [bool(self.fast and (t.isascii() or max(t) < SIMPLE)) for t in texts]
        slow = iter(self.own.encode_batch([t for t, s in zip(texts, simple) if not s], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if s else next(slow).ids for t, s in zip(texts, simple)]


class Pieces:
    """A sentencepiece model. Texts start with a blank, which the model adds by itself."""

    #: A word before the text, so that blanks after it are the text's own.
    AHEAD = "a"

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.own.vocab_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i in range(n) for p in (self.own.id_to_piece(i),)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.skip = len(self.own.encode(self.AHEAD))

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [ids[self.skip :] for ids in self.own.encode([self.AHEAD + t for t in texts], num_threads=1)]


def segments(text: str) -> list[str]:
    """The text, which starts with a blank, cut before each blank that follows a character that is no white space."""
    if _WIDE.search(text):
        return _CUT.split(text)
    return [" " + s for s in text[1:].split(" ")]


def width_of(lengths: np.ndarray) -> type:
    """The type of a side's ids in rows."""
    return np.uint16 if len(lengths) <= 1 << 16 else np.uint32


class _Ragged:
    """Arrays of ids of different lengths in one."""

    def __init__(self) -> None:
        self.flat, self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after another, and how many each row has."""
        sizes = self.sizes[rows]
        shift = self.starts[rows] - (np.cumsum(sizes) - sizes)
        return self.flat[np.arange(int(sizes.sum())) + np.repeat(shift, sizes)], sizes


class Encoded:
    """Ids by both tokenizers, by segments."""

    def __init__(self, a: str, b: str, ranks: str | None = None):
        self.sides = (ByteLevel(a, ranks), Pieces(b))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = (_Ragged(), _Ragged())
        self.whole = np.zeros(0, bool)

    @staticmethod
    def _encoded(side: ByteLevel | Pieces, together: list[str], alone: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, each segment's count, and whether its bytes are kept.

        Those of together are encoded in runs: a segment ends where a token ends, if the run's bytes are kept.
        """
        flat, sizes, kept = [], [], []

        def one(ids: list[int], text: str) -> None:
            flat.append(np.array(ids, np.int64))
            sizes.append(np.array([len(ids)]))
            kept.append(np.array([b"".join(map(side.bytes.__getitem__, ids)) == text.encode()]))

        runs = [together[k : k + TOGETHER] for k in range(0, len(together), TOGETHER)]
        texts = ["".join(run) for run in runs]
        for run, text, ids in zip(runs, texts, side(texts)):
            found = np.array(ids, np.int64)
            ends, cuts = np.cumsum(side.lengths[found]), np.cumsum([len(s) if s.isascii() else len(s.encode()) for s in run])
            at = np.searchsorted(ends, cuts)
            if len(ends) and ends[-1] == cuts[-1] and np.array_equal(ends[at], cuts) and b"".join(map(side.bytes.__getitem__, ids)) == text.encode():
                flat.append(found)
                sizes.append(np.diff(at, prepend=-1))
                kept.append(np.ones(len(run), bool))
            else:  # the bytes of one of them are not kept
                for ids, s in zip(side(run), run):
                    one(ids, s)
        for ids, s in zip(side(alone), alone):
            one(ids, s)
        return np.concatenate(flat), np.concatenate(sizes), np.concatenate(kept)

    def __call__(self, texts: list[str | None]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each side all ids and the texts' counts; and which texts have tokens. Others have none of either."""
        if len(self.whole) > SEGMENTS:
            self._clear()
        parts = [segments(" " + t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.known) if parts else set()
        if new:
            odd = lambda s: len(s) > LONGEST or s[-1].isspace() or s[-1] == "\u180e"
            alone = list(filter(odd, new))
            together = list(new.difference(alone))
            first = len(self.whole)
            self.known.update(zip(itertools.chain(together, alone), itertools.count(first)))
            kept = np.ones(len(new), bool)
            for side, ids in zip(self.sides, self.ids):
                flat, sizes, own = self._encoded(side, together, alone)
                ids.add(flat, sizes)
                kept &= own
            self.whole = np.concatenate((self.whole, kept))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        rows = np.fromiter(map(self.known.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(counts.sum()))
        doc = np.repeat(np.arange(len(parts)), counts)
        lost = np.bincount(doc, ~self.whole[rows], len(parts)) > 0 if len(rows) else np.zeros(len(parts), bool)
        rows, doc = rows[~lost[doc]], doc[~lost[doc]]
        out = []
        for ids in self.ids:
            flat, sizes = ids.take(rows)
            out.append((flat, np.bincount(doc, sizes, len(parts)).astype(np.int64)))
        for s in new:
            if len(s) > LONGEST:
                del self.known[s]
        return out, (counts > 0) & ~lost


def _events_type(id_type: T.DataType) -> T.StructType:
    kinds = [("doc", T.BinaryType()), ("origin", T.IntegerType()), ("id", id_type), ("side", T.IntegerType()), ("offset", T.LongType()), ("ids", T.BinaryType())]
    return T.StructType([T.StructField(n, k) for n, k in kinds])


def events(docs: DataFrame, a: str, b: str, ranks: str | None = None) -> DataFrame:
    """(doc, origin, id, side, offset, ids) for docs (id, text): the events of both sides, ids of 16 bits (32 if there are more).

    doc is a digest of id and text and origin the partition; rows alike in both are told apart by nothing, and need not
    be. A text without tokens gives one row without ids.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean_worker()
        origin, encoded = TaskContext.get().partitionId(), Encoded(a, b, ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto] or "") <= CHARS):
                    size += len(texts[upto] or "")
                    upto += 1
                yield _rows(batch.column(0).slice(at, upto - at), texts[at:upto], encoded, origin)
                at = upto

    return docs.mapInArrow(each, _events_type(docs.schema["id"].dataType))


def _rows(ids: pa.Array, texts: list[str | None], encoded: Encoded, origin: int) -> pa.RecordBatch:
    sides, _ = encoded(texts)
    names = [xxhash.xxh3_128_digest(repr((i, t)).encode("utf-8", "surrogatepass")) for i, t in zip(ids.to_pylist(), texts)]
    row, side_of, offset, blobs = [], [], [], []
    for side, ((flat, counts), lengths) in enumerate(zip(sides, (s.lengths for s in encoded.sides))):
        ends = np.concatenate(([0], np.cumsum(lengths[flat])))
        upto = np.cumsum(counts)
        small = flat.astype(width_of(lengths))
        for k, (lo, hi) in enumerate(zip((upto - counts).tolist(), upto.tolist())):
            for start in range(lo, hi, BLOCK) if hi > lo else ([lo] if side == 0 else []):
                row.append(k)
                side_of.append(side)
                offset.append(int(ends[start] - ends[lo]))
                blobs.append(small[start : min(hi, start + BLOCK)].tobytes())
    columns = [pa.array([names[k] for k in row], pa.binary()), pa.array(np.full(len(row), origin, np.int32)), ids.take(pa.array(row, pa.int64())), pa.array(side_of, pa.int32()), pa.array(offset, pa.int64()), pa.array(blobs, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc", "origin", "id", "side", "offset", "ids"])


class _Document:
    """The totals of a document under way."""

    __slots__ = ("name", "origin", "id", "copies", "n", "groups", "links", "digest", "pairs", "counts")

    def __init__(self, name: bytes, origin: int, own) -> None:
        self.name, self.origin, self.id, self.copies, self.n, self.groups, self.links = name, origin, own, 1, [0, 0], 0, 0
        self.digest = None
        self.pairs, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> None:
        if not len(self.pairs):
            self.pairs, self.counts = pairs, counts
            return
        self.pairs, at = np.unique(np.concatenate((self.pairs, pairs)), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate((self.counts, counts)), len(self.pairs)).astype(np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), and so on for each."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Machine:
    """Cuts groups out of two streams of events, which come by document and offset."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray]):
        self.lengths, self.width = lengths, len(lengths[1])
        digits = [f"{k}".encode() for k in range(max(map(len, lengths)))]
        most = max(map(len, digits)) + 1
        self.text = np.zeros((3, len(digits), most), np.uint8)
        for end, mark in enumerate(b",|;"):
            for k, d in enumerate(digits):
                self.text[end, k, : len(d) + 1] = np.frombuffer(d + bytes([mark]), np.uint8)
        self.text = self.text.reshape(-1, most)
        self.docs: list[_Document] = []
        self.held: list[tuple[list[np.ndarray], list[np.ndarray]]] = []
        self.size = 0
        self.last: tuple | None = None

    def feed(self, name: bytes, origin: int, own, side: int, offset: int, ids: np.ndarray) -> Iterator[_Document]:
        """Takes the next row; gives documents that are finished."""
        now = (name, origin, offset, side)
        if not self.docs or self.docs[-1].name != name or self.docs[-1].origin != origin:
            if self.size > HELD or len(self.docs) > HELD // 64:
                yield from self.flush(True)
            self.docs.append(_Document(name, origin, own))
            self.held.append(([], []))
        elif now == self.last:  # a repeated row
            self.docs[-1].copies += offset == 0 and side == 0
            return
        elif self.size > 2 * HELD:
            yield from self.flush(False)
        self.last = now
        self.held[-1][side].append(ids)
        self.size += len(ids)

    def flush(self, over: bool) -> Iterator[_Document]:
        """Cuts what is held; the last document goes on unless it is over."""
        if self.docs:
            rest = self._cut([[np.concatenate(s) if s else np.zeros(0, np.uint32) for s in pair] for pair in self.held], over)
            going = self.docs[-1:] if not over else []
            done = self.docs if over else self.docs[:-1]
            self.docs, self.held = going, [([rest[0]], [rest[1]])] if going else []
            self.size = sum(map(len, rest)) if going else 0
            yield from done

    def _cut(self, held: list[list[np.ndarray]], over: bool) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.concatenate([h[s] for h in held]).astype(np.int64) for s in (0, 1)]
        ends = [np.cumsum(self.lengths[s][ids[s]]) for s in (0, 1)]
        none = (ids[0][:0], ids[1][:0])
        if not len(ids[0]) or not len(ids[1]):
            return none if over else (ids[0], ids[1])
        upto = np.cumsum([sum(map(len, h[0:1])) for h in held])  # events of A up to each document's end
        edges = np.where(upto > 0, ends[0][np.maximum(upto - 1, 0)], 0)
        if not over:
            # The last document's streams may stand at different offsets: only what both have reached is cut.
            edges[-1] = max(ends[0][-1], ends[1][-1])
        at = np.searchsorted(ends[1], ends[0])
        both = at < len(ends[1])
        both[both] = ends[1][at[both]] == ends[0][both]
        cut_a = np.flatnonzero(both)
        cut_b = at[cut_a]
        if not len(cut_a):
            return ids[0], ids[1]
        first = [np.concatenate(([0], c[:-1] + 1)) for c in (cut_a, cut_b)]
        sizes = [c + 1 - f for c, f in zip((cut_a, cut_b), first)]
        doc = np.searchsorted(edges, ends[0][cut_a])  # the document of each group
        self._digests(ids, first, sizes, doc)
        links = sizes[0] * sizes[1]
        groups, n_links = np.bincount(doc, minlength=len(held)), np.bincount(doc, links, len(held))
        n = [np.bincount(doc, s, len(held)) for s in sizes]
        for k, d in enumerate(self.docs):
            d.groups += int(groups[k])
            d.links += int(n_links[k])
            d.n[0] += int(n[0][k])
            d.n[1] += int(n[1][k])
        self._pairs(ids, first, sizes, doc, links)
        return ids[0][cut_a[-1] + 1 :], ids[1][cut_b[-1] + 1 :]

    def _digests(self, ids, first, sizes, doc) -> None:
        """Adds the groups' text to the documents' digests."""
        wide = sizes[0] + sizes[1]
        start = np.cumsum(wide) - wide
        order = np.zeros(int(wide.sum()), np.int64)
        n = len(self.text) // 3
        for s, (at, mark) in enumerate(((start, 1), (start + sizes[0], 2))):
            codes = ids[s][_spread(first[s], sizes[s])].copy()
            codes[np.cumsum(sizes[s]) - 1] += mark * n
            order[_spread(at, sizes[s])] = codes
        found = np.unique(doc)
        last_group = np.searchsorted(doc, found, side="right")
        token_end = (start + wide)[last_group - 1]
        lo = 0
        for k, hi in zip(found.tolist(), token_end.tolist()):
            flat = self.text[order[lo:hi]].reshape(-1)
            text = flat[flat != 0].tobytes()[:-1]
            d = self.docs[k]
            if d.digest is None:
                d.digest = hashlib.sha256(text)
            else:
                d.digest.update(b";" + text)
            lo = hi

    def _pairs(self, ids, first, sizes, doc, links) -> None:
        """Adds the distinct links of the groups to the documents, with how often each occurs."""
        dense = links > DENSE
        keys, marks, weights = [], [], []
        few = np.flatnonzero(~dense)
        for lo in range(0, len(few), HELD):
            own = few[lo : lo + HELD]
            n = links[own]
            inside = _spread(np.zeros(len(own), np.int64), n)
            wide = np.repeat(sizes[1][own], n)
            a = ids[0][np.repeat(first[0][own], n) + inside // wide]
            keys.append(a * self.width + ids[1][np.repeat(first[1][own], n) + inside % wide])
            marks.append(np.repeat(doc[own], n))
            weights.append(np.ones(len(inside), np.int64))
        for g in np.flatnonzero(dense).tolist():
            (u, m), (v, w) = (np.unique(ids[s][first[s][g] : first[s][g] + sizes[s][g]], return_counts=True) for s in (0, 1))
            keys.append((u[:, None] * self.width + v).reshape(-1))
            weights.append((m[:, None] * w).reshape(-1))
            marks.append(np.full(len(keys[-1]), doc[g]))
        if not keys:
            return
        key, mark, weight = np.concatenate(keys), np.concatenate(marks), np.concatenate(weights)
        whole = mark * (len(self.lengths[0]) * self.width) + key
        if len(few) == len(links):
            found, total = np.unique(whole, return_counts=True)
        else:
            found, at = np.unique(whole, return_inverse=True)
            total = np.bincount(at, weight, len(found)).astype(np.int64)
        mark = found // (len(self.lengths[0]) * self.width)
        bounds = np.searchsorted(mark, np.arange(len(self.docs) + 1))
        found -= mark * (len(self.lengths[0]) * self.width)
        for d, lo, hi in zip(self.docs, bounds[:-1].tolist(), bounds[1:].tolist()):
            if hi > lo:
                d.add(found[lo:hi], total[lo:hi])


def _aligned_type(id_type: T.DataType) -> T.StructType:
    long = T.LongType()
    kinds = [("doc", T.BinaryType()), ("origin", T.IntegerType()), ("id", id_type), ("copies", long), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("groups_sha256", T.StringType()), ("pairs", T.BinaryType()), ("times", T.BinaryType())]
    return T.StructType([T.StructField(n, k) for n, k in kinds])


def swept(found: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each distinct row of events' documents: totals, the digest of its groups, its distinct links.

    pairs: the links' a * (size of B) + b, ascending, as differences of 64 bits; times: how often each occurs.
    """
    schema = _aligned_type(found.schema["id"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        machine = Machine((ByteLevel(a).lengths, Pieces(b).lengths))
        kind = None

        def out(docs: list[_Document]) -> pa.RecordBatch:
            columns = [
                pa.array([d.name for d in docs], pa.binary()), pa.array([d.origin for d in docs], pa.int32()), pa.array([d.id for d in docs], kind), *[pa.array([f(d) for d in docs], pa.int64()) for f in (lambda d: d.copies, lambda d: d.n[0], lambda d: d.n[1], lambda d: d.groups, lambda d: d.links)],
                pa.array([d.digest.hexdigest() if d.digest else "" for d in docs]), pa.array([np.diff(d.pairs, prepend=0).tobytes() for d in docs], pa.binary()), pa.array([d.counts.astype(np.int32).tobytes() for d in docs], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

        for batch in batches:
            kind = batch.column(2).type
            held = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                held += machine.feed(*row[:5], np.frombuffer(row[5], width_of(machine.lengths[row[3]])))
                if len(held) >= 512:
                    yield out(held)
                    held = []
            if held:
                yield out(held)
        rest = list(machine.flush(True))
        if rest:
            yield out(rest)

    dealt = found.repartition("doc", "origin").sortWithinPartitions("doc", "origin", "offset", "side")
    return dealt.mapInArrow(each, schema)


def _links(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(row["pairs"], np.int64)), np.frombuffer(row["times"], np.int32).astype(np.int64)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): in how many documents a pair of ids is linked. Pairs are counted in tasks before they are shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        held, weights, size = [], [], 0

        def out() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate(held), return_inverse=True)
            n = np.bincount(at, np.concatenate(weights), len(pairs)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for copies, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(np.cumsum(np.frombuffer(blob, np.int64)))
                weights.append(np.full(len(held[-1]), copies))
                size += len(held[-1])
                if size >= COUNTED:
                    yield out()
                    held, weights, size = [], [], 0
        if size:
            yield out()

    return aligned.select("copies", "pairs").mapInArrow(each, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def best_pairs(counts: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): best is 1 where n is the highest of the pair's A id."""
    left = F.call_function("div", F.col("pair"), F.lit(width).cast("bigint"))
    most = counts.groupBy(left.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", left).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best"))


def _often(table: DataFrame, most: int) -> DataFrame:
    """The rows of the highest counts, whole classes of counts, most rows at most."""
    kind = F.floor(F.log2(F.col("n").cast("double")) * 4)
    kinds = sorted(((r["kind"], r["n"]) for r in table.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in kinds:
        total += n
        if total > most:
            break
        least = k
    return table.filter(kind >= least) if least is not None else table.limit(0)


def scored(aligned: DataFrame, table: DataFrame, most: int = TABLE) -> DataFrame:
    """aligned without pairs and times, with n_best and count_sum; a row for each copy."""
    totals = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    all_rows = table.count()
    often = table if all_rows <= most else _often(table, most)
    own = often.select("pair", "n", "best").toArrow().combine_chunks()
    columns = [c.to_numpy().astype(np.int64) for c in own.columns]
    order = np.argsort(columns[0])
    sent = aligned.sparkSession.sparkContext.broadcast([c[order].tobytes() for c in columns])
    del own, columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        pair, n, best = (np.frombuffer(v, np.int64) for v in sent.value)
        for batch in batches:
            sums, bests, others, other_times = [], [], [], []
            for pairs, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                keys, weight = _links({"pairs": pairs, "times": times})
                at = np.minimum(np.searchsorted(pair, keys), max(len(pair) - 1, 0))
                hit = pair[at] == keys if len(pair) else np.zeros(len(keys), bool)
                sums.append(int((n[at[hit]] * weight[hit]).sum()))
                bests.append(int((best[at[hit]] * weight[hit]).sum()))
                others.append(keys[~hit].tolist())
                other_times.append(weight[~hit].tolist())
            kept = [batch.column(c) for c in ("doc", "origin", "copies", *totals)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), pa.array(others, pa.list_(pa.int64())), pa.array(other_times, pa.list_(pa.int64()))], ["doc", "origin", "copies", *totals, "n_best", "count_sum", "others", "other_times"])

    kinds = {f.name: f for f in aligned.schema}
    long = T.LongType()
    schema = T.StructType([*(kinds[c] for c in ("doc", "origin", "copies", *totals)), T.StructField("n_best", long), T.StructField("count_sum", long), T.StructField("others", T.ArrayType(long)), T.StructField("other_times", T.ArrayType(long))])
    looked = aligned.mapInArrow(each, schema)
    if all_rows > most:
        looked = staged(looked)
        rest = looked.select("doc", "origin", F.explode(F.arrays_zip("others", "other_times")).alias("o")).select("doc", "origin", F.col("o.others").alias("pair"), F.col("o.other_times").alias("times"))
        rare = rest.join(table, "pair").groupBy("doc", "origin").agg(F.sum(F.col("best") * F.col("times")).alias("best_"), F.sum(F.col("n") * F.col("times")).alias("sum_"))
        looked = looked.join(rare, ["doc", "origin"], "left").withColumn("n_best", F.col("n_best") + F.coalesce("best_", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("sum_", F.lit(0)))
    each_copy: Column = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return looked.select(*totals, "n_best", "count_sum", each_copy.alias("copy")).drop("copy")


def aligned(df: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, table: int = TABLE) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) for every row of df.

    a: the path of a byte-level tokenizer.json; b: of a sentencepiece model that adds a blank; ranks: of the vocabulary of
    a as ranks, for speed. Both encode the text behind a blank, without special tokens. Texts that are null or empty, or whose bytes a tokenizer does not keep, have
    no tokens: zeros and ''. Repeated rows are documents one by one, so are rows without id. Other columns are not read.
    An empty table gives no rows. A group is cut wherever both sides end, whatever the text's length; table bounds the
    pairs whose counts every task gets, the counts of others are joined.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    with scratch(df.sparkSession) as keep:
        found = staged(swept(events(rows, a, b, ranks), a, b), "zstd")
        counts = staged(pair_counts(found))
        pairs = staged(best_pairs(counts, len(Pieces(b).lengths)))
        keep(found, pairs)
    return scored(found, pairs, table)
