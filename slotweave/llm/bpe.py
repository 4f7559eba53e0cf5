"""Encoding of whole corpora with a public byte-level BPE vocabulary.

Texts are cut into words by character class, for a whole Arrow batch at once (array operations over the
batch's own bytes; the words are offsets into them, nothing is copied). Each distinct word of a batch is encoded
once: a *contiguous rank array* holds the word's part boundaries and the ranks of adjacent pairs; the least
rank is found by a scan, its boundary deleted and the two neighbouring ranks refreshed. Words longer than
``SHORT`` bytes keep the same ranks in a heap, so a huge word costs n log n. Ids are then gathered per document.

Scale: a map over documents without any shuffle; the vocabulary is read by each worker from its path. A worker keeps at
most ``CACHE`` words between batches and works through ``CHUNK`` bytes at a time, so memory does not grow with the data.
"""

from __future__ import annotations

import base64
import heapq
import struct
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SHORT = 64
NONE = np.int32(2**31 - 1)
CACHE = 300_000
CHUNK = 4_000_000
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The characters of Unicode's White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file in the installed collection of public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(i))[0]
        if major == "L":
            out[i] = LETTER
        elif major == "N":
            out[i] = NUMBER
    out[WHITE] = SPACE
    return out


def word_breaks(data: np.ndarray, doc_starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Start offsets of the words in UTF-8 ``data``; every offset in ``doc_starts`` begins a word.

    The split is that of the vocabulary's pattern: English contractions; letters, numbers or other signs with one
    space before them; white space, of which the last character stands alone or joins the word after it.
    """
    n = len(data)
    cls = table[data]  # right for ASCII; the others follow
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead].astype(np.int32)
        at = lambda k: data[np.minimum(lead + k, n - 1)].astype(np.int32) & 0x3F
        two, three = b < 0xE0, (b >= 0xE0) & (b < 0xF0)
        cp = np.where(two, (b & 0x1F) << 6 | at(1), np.where(three, (b & 0x0F) << 12 | at(1) << 6 | at(2), (b & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
        kind = table[np.minimum(cp, 0x10FFFF)]
        cls[lead] = kind
        for k, m in ((1, np.ones(len(b), bool)), (2, ~two), (3, ~two & ~three)):
            to = lead[m] + k
            ok = to < n
            cls[to[ok]] = kind[m][ok]
    brk = np.empty(n, bool)
    brk[0] = True
    np.not_equal(cls[1:], cls[:-1], out=brk[1:])
    doc = np.zeros(n, bool)
    doc[doc_starts] = True
    brk |= doc
    # the last white character before a word
    after = np.flatnonzero(brk[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~doc[1:]) + 1
    last = after - 1
    for _ in range(3):
        tail = (data[last] & 0xC0) == 0x80
        if not tail.any():
            break
        last = last - tail
    brk[last] = True
    brk[after[data[last] == 0x20]] = False
    # contractions: a lone apostrophe that begins a word
    q = np.flatnonzero((data == 0x27) & brk)
    q = q[q + 1 < n]
    q = q[brk[q + 1] & (cls[q + 1] == LETTER) & ~doc[q + 1]]
    if len(q):
        a, b = data[q + 1], data[np.minimum(q + 2, n - 1)]
        inner = (q + 2 < n) & ~doc[np.minimum(q + 2, n - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        both = inner & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for m, k in ((one, 2), (both, 3)):
            brk[q[m] + 1] = False
            end = q[m] + k
            brk[end[end < n]] = True
    return np.flatnonzero(brk)


class PairTable:
    """The rank of joining two neighbouring parts, looked up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``NONE`` where the pair does not join (also for -1, which stands behind a word's end)."""
        key = left.astype(np.int64) << 32 | right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (right >= 0) & (left >= 0), self.ranks[i], NONE)


def merge_short(words: list[bytes], table: PairTable) -> list[bytes]:
    """Packed ids of words of like length by contiguous rank arrays, one row a word.

    Each round scans every row for its least rank, joins that pair, closes the gap in the row and refreshes
    the ranks on both sides of the joint; rows without a rank left are done.
    """
    size = np.array([len(w) for w in words])
    width = int(size.max())
    grid = np.zeros((len(words), width), np.uint8)
    grid[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    parts = np.where(np.arange(width) < size[:, None], table.byte[grid], -1)
    ranks = table.rank(parts[:, :-1], parts[:, 1:]) if width > 1 else np.full((len(words), 1), NONE, np.int32)
    out: list[bytes] = [b""] * len(words)
    rows = np.arange(len(words))
    while len(rows):
        at = np.argmin(ranks, axis=1)
        low = ranks[np.arange(len(rows)), at]
        done = low == NONE
        if done.any():
            for k in np.flatnonzero(done):
                p = parts[k]
                out[rows[k]] = p[p >= 0].astype(np.int32).tobytes()
            keep = ~done
            rows, parts, ranks, at, low = rows[keep], parts[keep], ranks[keep], at[keep], low[keep]
            if not len(rows):
                break
        line = np.arange(len(rows))
        parts[line, at] = low
        move = np.arange(parts.shape[1] - 1)
        parts = np.column_stack([np.take_along_axis(parts, move + (move > at[:, None]), axis=1), np.full(len(rows), -1, parts.dtype)])
        move = np.arange(ranks.shape[1] - 1)
        ranks = np.column_stack([np.take_along_axis(ranks, move + (move >= at[:, None]), axis=1), np.full(len(rows), NONE, ranks.dtype)])
        last = parts.shape[1] - 2
        here = np.minimum(at, last)
        ranks[line, here] = table.rank(parts[line, here], parts[line, here + 1])
        has = at > 0
        ranks[line[has], at[has] - 1] = table.rank(parts[line[has], at[has] - 1], parts[line[has], at[has]])
    return out


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap: least rank first, then leftmost."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = [i + 1 for i in range(n)]
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop or end[i] != j:
            continue
        end[i], alive[j] = stop, False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (r := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """A vocabulary in rank order, with the ids of words met so far (at most ``CACHE``)."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pairs = PairTable(self.ranks)
        self.table = classes()
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words as packed 32-bit integers."""
        known, ranks = self.known, self.ranks
        out = [known.get(w) for w in words]
        new = [i for i, p in enumerate(out) if p is None]
        by_size: dict[int, list[int]] = {}
        for i in new:
            w = words[i]
            whole = ranks.get(w)
            if whole is not None:
                out[i] = struct.pack("i", whole)
            elif len(w) > SHORT:
                out[i] = np.asarray(merge_long(w, ranks), np.int32).tobytes()
            else:
                by_size.setdefault((len(w) + 3) // 4, []).append(i)
        for group in by_size.values():
            for at in range(0, len(group), 20_000):
                part = group[at : at + 20_000]
                for i, p in zip(part, merge_short([words[i] for i in part], self.pairs)):
                    out[i] = p
        if len(known) + len(new) > CACHE:
            known.clear()
        for i in new[:CACHE]:
            if len(words[i]) <= SHORT:
                known[words[i]] = out[i]
        return out

    def lengths_and_ids(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids per text (0 for null and empty), and all ids one after another."""
        texts = texts.cast(pa.large_string())
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = np.diff(off)
        if texts.null_count:
            size = np.where(texts.is_null().to_numpy(zero_copy_only=False), 0, size)
        if not size.any():
            return np.zeros(len(texts), np.int64), np.zeros(0, np.int32)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)
        filled = np.flatnonzero(size > 0)
        if (size == np.diff(off)).all():
            data, starts = raw[off[0] : off[-1]], (off[:-1] - off[0])[filled]
        else:
            data = np.concatenate([raw[off[i] : off[i] + size[i]] for i in filled])
            starts = np.concatenate([[0], np.cumsum(size[filled])[:-1]])
        begin = word_breaks(data, starts, self.table)
        bounds = np.append(begin, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        d = words.dictionary_encode()
        index = d.indices.to_numpy()
        packed = self.words(d.dictionary.to_pylist())
        each = np.fromiter((len(p) >> 2 for p in packed), np.int64, len(packed))
        per_word = each[index]
        out = np.zeros(len(texts), np.int64)
        out[filled] = np.add.reduceat(per_word, np.searchsorted(begin, starts))
        if not want_ids:
            return out, None
        flat = np.frombuffer(b"".join(packed), np.int32)
        from_ = np.concatenate([[0], np.cumsum(each)[:-1]])[index]
        place = np.repeat(from_ - np.concatenate([[0], np.cumsum(per_word)[:-1]]), per_word) + np.arange(int(per_word.sum()))
        return out, flat[place]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``CHUNK`` bytes of text each (one text at least)."""
    sizes = np.frombuffer(batch.column(column).cast(pa.large_string()).buffers()[1], np.int64)
    off = batch.column(column).cast(pa.large_string()).offset
    ends = sizes[off + 1 : off + batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else sizes[off]
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode(df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, ids array<int>``: the ids of every text, without special tokens, whole texts.

    Empty and null texts get the empty list. Strings that look like special tokens are ordinary text. Repeated
    rows come out as often as they go in; further columns are left out; an empty table gives no rows.
    """
    where = path or default_path()
    kind = df.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(where)
        for whole in batches:
            for b in slices(whole, text):
                n, ids = enc.lengths_and_ids(b.column(text))
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    return df.select(key, text).mapInArrow(work, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, *, keep: list[str], text: str = "text", path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of ids of each text (0 for empty and null)."""
    where = path or default_path()
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.load(where)
        for whole in batches:
            for b in slices(whole, text):
                n, _ = enc.lengths_and_ids(b.column(text), want_ids=False)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(n)], [*keep, name])

    return df.select(*keep, text).mapInArrow(work, schema)


