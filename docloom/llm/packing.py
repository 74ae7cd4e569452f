"""Order-preserving packing of token streams into sequences of at most ``SIZE`` tokens.

Documents keep the order in which a partition holds them (or the order of ``order_by``, dealt out by range). Within a
partition their tokens form one stream, and the cuts of that stream are chosen by dynamic programming:

    f(c) = penalty(c) + min over c' in [c - SIZE, c) of f(c') + padding(c - c')

where padding is SIZE - length, or nothing for a length that is a power of two. A cut between documents costs nothing,
one after a sentence and one inside a sentence cost a few tokens. As padding is linear in the length, the minimum over
the window is a minimum of f(c') + c', which a monotone queue gives in constant time; exact powers of two are single
further transitions. The stream is cut shard by shard; the last, open sequence of a shard goes on in the next, so there
is one tail for each partition. No shuffle takes place and memory is bounded by a shard and the longest text.
"""

from __future__ import annotations

import gc
import itertools
import os
import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import lean_worker

SIZE = 4096
END_ID = 2
SHARD = 1 << 20
#: Costs of a cut, in tokens of padding.
SENTENCE, INSIDE = 8, 32
#: Cuts inside texts are considered at least so many tokens apart.
GRAIN = 32
#: Bytes of text encoded together.
TEXTS = 1 << 22
#: Stems whose ids are remembered at once, and places for hashes of those seen.
WORDS, SEEN = 400_000, 1 << 23

#: White space that str.split() takes and the tokenizer's pattern may not, or the other way round.
_ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"


#: Marks that may follow a word of letters and are then a token run of their own.
_MARKS = ".,;:!?|"


class Encoder(dict):
    """Ids of a text by the tokenizer file at path.

    The ids of what stands between blanks follow from it alone. So stems (words without case and the marks after them)
    are encoded many at a time and remembered as bytes, in a table of bounded size. Texts that hold one of the
    tokenizer's own marks (in any case) or odd white space are encoded as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(os.path.basename(path))
        self._own = Tokenizer.from_file(path)
        marks = [t.content for t in self._own.get_added_tokens_decoder().values()]
        self._whole = "|".join([_ODD, *(f"(?i:{re.escape(m)})" for m in marks if m)])
        self._seen = np.zeros(SEEN, bool)
        self.clear()
        # lower-case letters of Latin-1 need neither normalising nor the pattern
        self._bare = Tokenizer.from_file(path)
        self._bare.normalizer = normalizers.Sequence([])
        self._bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [k for t, k in self._own.get_vocab().items() if re.search(r"[.!?](</w>)?$", t)]
        self.ends_sentence = np.zeros(self._own.get_vocab_size() + 1, bool)
        self.ends_sentence[ends] = True
        self.ends_word = np.zeros(self._own.get_vocab_size() + 1, bool)
        self.ends_word[[k for t, k in self._own.get_vocab().items() if t.endswith("</w>")]] = True

    def _encoded(self, stems: list[str]) -> dict[str, bytes]:
        """The ids of stems, in two calls: those of letters alone end where a token ends a word, the others are counted."""
        of: dict[str, bytes] = {}
        for plain in (True, False):
            own = [w for w in stems if w.isalpha() == plain]
            if not own:
                continue
            if plain:
                text = " ".join(own)
                by = self._bare if text.isascii() or max(text) < "\u0100" else self._own
                ids = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.concatenate(([0], np.flatnonzero(self.ends_word[ids]) + 1))
                if len(cuts) != len(own) + 1:
                    plain = False
            if not plain:
                found = self._own.encode(own, is_pretokenized=True, add_special_tokens=False)
                ids = np.array(found.ids, np.uint32)
                cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(own) + 1))
            raw, cuts = ids.tobytes(), (4 * cuts).tolist()
            of.update(zip(own, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        return of

    def _parted(self, words: Iterable[str]) -> Iterator[tuple[str, str, str]]:
        """(word, stem, marks): a word is its stem and the punctuation after it.

        The pattern parts them after a letter that stays one letter in lower case: any of ASCII, and others if the
        normalised word is of letters (a capital I with a dot becomes an i and a mark that joins the punctuation).
        """
        for w in words:
            stem, marks = w, ""
            if w[-1] in _MARKS:
                stem = w.rstrip(_MARKS)
                if stem and stem[-1].isalpha() and (stem[-1].isascii() or (max(stem) < "\u0530" and unicodedata.normalize("NFC", stem).lower().isalpha())):
                    marks = w[len(stem) :]
                else:
                    stem = w
            if not stem.islower() and (stem.isascii() or max(stem) < "\u0100"):
                stem = stem.lower()
            yield w, stem, marks

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each of the distinct words, from the stems; new ones are encoded all at once.

        A stem is remembered when it comes a second time; a bitmap of hashes tells.
        """
        found = list(map(self.get, words))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        rest = list(self._parted(words[k] for k in gaps))
        new = {stem for _, stem, _ in rest if stem not in self} | {marks for _, _, marks in rest if marks and marks not in self}
        of = self._encoded(list(new))
        for k, (_, stem, marks) in zip(gaps, rest):
            ids = of[stem] if stem in of else self[stem]
            found[k] = ids + (of[marks] if marks in of else self[marks]) if marks else ids
        at = np.fromiter(map(hash, of), np.int64, len(of)) & (SEEN - 1)
        for stem in itertools.compress(of, self._seen[at]):
            self[stem] = of[stem]
        self._seen[at] = True
        if len(self) > WORDS:
            self.clear()
        return found

    def clear(self) -> None:
        super().clear()
        self._seen[:] = False
        self[""] = b""

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each text's ids; null is an empty text.

        Splitting and telling words apart is Arrow's; Python sees each distinct word once, ids are gathered by numpy.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self._whole)
        words = pc.ascii_split_whitespace(pc.if_else(odd, "", texts))
        cuts, told = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        own = self._words(told.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts, at = sizes.cumsum() - sizes, told.indices.to_numpy()
        each = sizes[at]
        ends = np.concatenate(([0], each.cumsum()))
        flat = np.frombuffer(b"".join(own), np.uint32)
        flat = flat[np.repeat(starts[at] - ends[:-1], each) + np.arange(ends[-1])]
        counts = ends[cuts[1:] - cuts[0]] - ends[cuts[:-1] - cuts[0]]
        if pc.any(odd).as_py():
            pieces = np.split(flat, counts.cumsum()[:-1])
            for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                pieces[k] = np.array(self._own.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            flat, counts = np.concatenate(pieces), np.array([len(x) for x in pieces])
        return flat, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def nodes(ids: np.ndarray, starts: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a cut may be, with their costs; starts are the first positions of the documents.

    Ends of documents all count; ends of sentences GRAIN or more apart; in between, a position every GRAIN tokens
    where none has come for 4 * GRAIN tokens.
    """
    n = len(ids)
    found = np.flatnonzero(ends_sentence[ids]) + 1
    slot = found // GRAIN
    found = found[np.concatenate((slot[1:] != slot[:-1], [True]))[: len(found)]]
    at = np.unique(np.concatenate((found, starts, [n])))
    wide = np.flatnonzero(np.diff(at) > 4 * GRAIN)
    inner = [np.arange(at[k] + GRAIN, at[k + 1], GRAIN) for k in wide]
    inner = np.concatenate(inner) if inner else np.zeros(0, np.int64)
    every = np.concatenate((at, inner))
    cost = np.concatenate((np.full(len(at), SENTENCE), np.full(len(inner), INSIDE)))
    cost[: len(at)][np.isin(at, starts) | (at == n)] = 0
    order = np.argsort(every, kind="stable")
    every, cost = every[order], cost[order]
    return (every, cost) if every[0] == 0 else (np.concatenate(([0], every)), np.concatenate(([0], cost)))


def tail_cost(length: int, size: int = SIZE) -> int:
    """Cost of the last sequence: padding, or cuts into powers of two that need none."""
    return min(size - length, (length.bit_count() - 1) * INSIDE)


def best_cuts(at: np.ndarray, cost: np.ndarray, last: bool, size: int = SIZE) -> list[int]:
    """The cuts (positions, without 0) of least cost; the open rest after the final cut is the caller's unless last.

    at: increasing from 0, no two neighbours over size apart.
    """
    pos, pen = at.tolist(), cost.tolist()
    n = len(pos)
    jumps: dict[int, list[int]] = {}
    power = 1
    while power < size:
        k = np.searchsorted(at, at - power)
        hit = np.flatnonzero((at >= power) & (at[np.minimum(k, n - 1)] == at - power))
        for j, i in zip(hit.tolist(), k[hit].tolist()):
            jumps.setdefault(j, []).append(i)
        power *= 2
    f, g, back = [0] * n, [0] * n, [0] * n
    queue: deque[int] = deque([0])
    for j in range(1, n):
        c = pos[j]
        while pos[queue[0]] < c - size:
            queue.popleft()
        i = queue[0]
        least = g[i] + size - c
        if j in jumps:
            for k in jumps[j]:
                if f[k] < least:
                    least, i = f[k], k
        f[j], back[j] = (v := least + pen[j]), i
        g[j] = v = v + c
        while queue and g[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    end = pos[-1]
    first = int(np.searchsorted(at, end - size))
    if last:
        j = min(range(first, n), key=lambda i: (f[i] + (tail_cost(end - pos[i], size) if pos[i] < end else 0), -i))
    else:
        j = min(range(first, n), key=lambda i: (f[i], -i))
    cuts = []
    while j:
        cuts.append(pos[j])
        j = back[j]
    cuts.reverse()
    if last and (rest := end - (cuts[-1] if cuts else 0)):
        if size - rest > (rest.bit_count() - 1) * INSIDE:
            for k in reversed(range(rest.bit_length())):
                if rest >> k & 1:
                    cuts.append((cuts[-1] if cuts else 0) + (1 << k))
        else:
            cuts.append(end)
    return cuts


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, order_by: list | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end token alone. Every row of docs is packed, repeated rows and null ids too, each as a
    document of its own; an empty table gives no rows. Other columns are not read. Sequence ids are unique, not dense:
    the partition's number in the high 32 bits, a counter in the low ones.
    order_by: columns whose ascending values give the documents' order (dealt out by range); else the order of the partitions' rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 32
        # what is open: (doc id, its ids from here on, tokens before them, tokens of the document)
        held: list[tuple[object, np.ndarray, int, int]] = []
        count = 0

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal held, count, number
            if not held:
                return None
            ids = np.concatenate([h[1] for h in held])
            lengths = np.array([len(h[1]) for h in held])
            starts = np.cumsum(lengths) - lengths
            at, cost = nodes(ids, starts, enc.ends_sentence)
            cuts = np.array(best_cuts(at, cost, last, size), np.int64)
            upto = int(cuts[-1]) if len(cuts) else 0
            begins = np.concatenate(([0], cuts[:-1])) if upto else np.zeros(0, np.int64)
            piece = np.union1d(begins, starts[starts < upto])
            doc = np.searchsorted(starts, piece, side="right") - 1
            seq = np.searchsorted(begins, piece, side="right") - 1
            ends = np.concatenate((piece[1:], [upto]))[: len(piece)]
            before = np.array([h[2] for h in held])
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(piece.tolist(), ends.tolist())]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[d][0] for d in doc.tolist()], id_type),
                    pa.array(piece - starts[doc] + before[doc], pa.int64()),
                    pa.array(ends - piece, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.array([h[3] for h in held])[doc], pa.int64()),
                    pa.array(seq + number, pa.int64()),
                    pa.array(piece - begins[seq], pa.int64()),
                ],
                _COLUMNS,
            )
            number += len(begins)
            if upto == len(ids):
                held = []
            else:
                d = int(np.searchsorted(starts, upto, side="right")) - 1
                done = upto - int(starts[d])
                held = [(held[d][0], held[d][1][done:], held[d][2] + done, held[d][3]), *held[d + 1 :]]
            count = sum(len(h[1]) for h in held)
            return out

        id_type = None
        for b in batches:
            id_type = b.schema.field(0).type
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).cumsum()
            k = 0
            while k < b.num_rows:
                upto = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + TEXTS)))
                flat, counts = enc.ids(b.column(1).slice(k, upto - k))
                ends = counts.cumsum()
                for doc, start, end in zip(b.column(0).slice(k, upto - k).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    held.append((doc, np.append(flat[start:end], np.uint32(end_id)), 0, end - start + 1))
                count += len(flat) + len(counts)
                if count >= SHARD and (out := flush(False)) is not None:
                    yield out
                k = upto
        if (out := flush(True)) is not None:
            yield out
    def undisturbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_worker()
        gc.disable()  # millions of words and no cycles
        try:
            yield from each(batches)
        finally:
            gc.enable()

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(f"order{k}") for k, c in enumerate(order_by or [])])
    if order_by:
        keys = [f"order{k}" for k in range(len(order_by))]
        narrow = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = T.StructType([T.StructField("doc_id", narrow.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in _COLUMNS[1:]]])
    return narrow.select("doc_id", "text").mapInArrow(undisturbed, schema)
