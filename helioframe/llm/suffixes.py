"""Suffix-array dedup: remove every byte of a LENGTH-byte string that also starts in an earlier document.

The work is a merge sort of suffixes that knows common prefixes. Each chunk of documents sorts its suffixes and sends
them, front-coded (length shared with the one before, and the rest), to ranges of the order; each range merges
its runs with a loser tree whose nodes keep the prefix they share with the last output, so that known prefixes are
never compared again. Equal neighbours are one string, and its least document keeps it.

Copies are collapsed before the sort, so that a corpus of many copies costs little more than one. Texts are cut where
their content says so, into segments that reach LENGTH - 1 bytes into the next one, so that each window lies in the
segment where it starts. Of equal segments, those of the least document stay; in later documents all windows of the
segment have an earlier holder, so their bytes go and the windows take no further part. The least holder of a window is
never in such a segment, so what remains decides all other windows as before.

Only suffixes that can have an equal in another document are sent. Every LENGTH-byte window selects the GRAM-byte
piece of least hash in it, its anchor; equal windows select the same one. Neighbouring windows with one anchor form a
block. A first exchange of anchor hashes tells each block whether its anchor occurs in several documents;
else none of its windows can. A block is sent as the suffix that starts at its anchor, followed by what stands before
the anchor. The order is by four bytes hashed from the anchor, then by the string: so all ranges are alike long, however
many there are, and no splitters are needed. In the merged order the blocks of an anchor are neighbours that share GRAM
bytes: equal ones are decided whole; where a few differ, by what they share on both sides of the anchor, and where many do, by a table of their windows. Anchors with very many
different blocks send single windows instead, which the order deals over many ranges. The hashes of anchors and blocks
only decide what is sent and where; equality of strings is decided on bytes, that of segments by BLAKE2 digests of 128 bits.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import ship, stage

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1  # anchors that a window chooses from
#: Text bytes of a chunk, entries of a hash bucket and of a range aimed at, bytes hashed at a time.
CHUNK, BUCKET, RANGE, PIECE = 8 << 20, 1 << 18, 100_000, 1 << 20
#: A text is cut at one place in SEGMENT, but not within SHORT bytes of a place just before.
SEGMENT, SHORT = 256, 64
_ENTRY = np.dtype([("high", "<u8"), ("low", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("size", "<i4")])
#: An anchor with more block kinds than MANY in one chunk, or CROWD entries in all, sends single windows.
MANY, CROWD = 8, 5000
#: So many different blocks of one anchor are compared with one another; more, by a table of their windows.
FEW = 4
#: A string begins with four bytes that say where it lies in the order, and one that says what it is.
_ANCHORED, _SINGLE, HEAD = b"\0", b"\1", 5
#: Bits of a block's hash that tell blocks of one anchor apart; those that still share a class are told apart by bytes.
BLOCK_BITS = 12
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_POWER = np.cumprod(np.full(PIECE + (1 << 17), 0xF58B6A3D1C9E4B27, np.uint64))
_INVERSE = np.cumprod(np.full(PIECE + (1 << 17), pow(0xF58B6A3D1C9E4B27, -1, 1 << 64), np.uint64))
_CHUNK = "chunk long, ids binary, ends binary, text binary"


def _chunks(size: int):
    """Documents to rows of about `size` bytes: ids, ends of the texts, and the texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, part, k = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def row():
            by = sorted(range(len(ids)), key=ids.__getitem__)  # so that places are in order of documents
            ids[:], texts[:] = [ids[i] for i in by], [texts[i] for i in by]
            ends, whole = np.cumsum([len(t) for t in texts]).astype("<i8"), b"".join(texts)
            cells = [pa.array([x], pa.binary()) for x in (np.array(ids, "<i8").tobytes(), ends.tobytes(), pack.compress(whole))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 24) + k]), *cells], names=["chunk", "ids", "ends", "text"])

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            for d, t in zip(keys, batch.column("text").cast(pa.binary())):
                ids.append(d)
                texts.append(t.as_py() or b"")
                held += len(texts[-1])
                if held >= size:
                    yield row()
                    ids, texts, held, k = [], [], 0, k + 1
        if ids:
            yield row()

    return run


def _cuts(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the segments of a chunk's texts that have windows."""
    found = [np.r_[0, ends[:-1]]]
    for at in range(0, len(text), PIECE):
        piece = np.zeros(min(len(text), at + PIECE + GRAM) - at + 8, np.uint8)
        piece[:-8] = text[at : at + PIECE + GRAM]
        eight = np.ndarray((len(piece) - 7,), "<u8", piece, 0, (1,))
        n = min(len(text), at + PIECE) - at - GRAM
        if n > 0:
            h = (eight[:n] * _M1 ^ eight[8 : 8 + n]) * _M2
            found.append(np.flatnonzero((h ^ (h >> np.uint64(32))) * _M3 >> np.uint64(32) < (1 << 32) // SEGMENT) + at)
    cut = np.concatenate(found[1:] or [np.empty(0, np.int64)])
    cut = np.unique(np.r_[found[0], cut[np.diff(cut, prepend=-SHORT) >= SHORT]])
    cut = cut[cut < len(text)]
    stop = np.minimum(np.r_[cut[1:], len(text)] + LENGTH - 1, ends[np.searchsorted(ends, cut, "right")] if len(cut) else 0)
    full = stop - cut >= LENGTH
    return cut[full], (stop - cut)[full]


def _segments(buckets: int):
    """Each chunk's segments by buckets of their digests: those of the least document of the chunk that has them; and the
    (place, length) of the later documents', which go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, ends, blob in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "ends", "text"))):
                text, ends = zstandard.ZstdDecompressor().decompress(blob) if blob else b"", np.frombuffer(ends, "<i8")
                at, size = _cuts(np.frombuffer(text, np.uint8), ends)
                if not len(at):
                    continue
                e = np.empty(len(at), _ENTRY)
                digests = b"".join([hashlib.blake2b(text[a:z], digest_size=16).digest() for a, z in zip(at.tolist(), (at + size).tolist())])
                e["high"], e["low"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
                e["at"], e["size"], e["doc"] = at, size, np.frombuffer(ids, "<i8")[np.searchsorted(ends, at, "right")]
                e, later = _later(e)
                own = np.stack([e["at"][later], e["size"][later]], 1).astype("<i4").tobytes()
                e = e[~later]
                of = ((e["high"] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(e)]
                rows = [(int(of[a]), chunk, e[a:z].tobytes(), b"" if a else own) for a, z in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "chunk", "data", "own"])

    return run


def _later(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments by digest, and which of them a smaller document has."""
    e = e[np.lexsort((e["doc"], e["low"], e["high"]))]
    new = np.r_[True, (e["high"][1:] != e["high"][:-1]) | (e["low"][1:] != e["low"][:-1])]
    return e, e["doc"] > e["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]


def _copies(table: pa.Table) -> pa.Table:
    """For one bucket: each chunk's (place, length) of segments that a smaller document has, and its own ones handed on."""
    blobs, own = table.column("data").to_pylist(), table.column("own").to_pylist()
    chunk = np.repeat(np.arange(len(blobs)), [len(x) // _ENTRY.itemsize for x in blobs])
    e = np.frombuffer(b"".join(blobs), _ENTRY)
    del blobs
    order = np.lexsort((e["doc"], e["low"], e["high"]))
    e, chunk = e[order], chunk[order]
    e, later = _later(e)  # sorted already, and the sort is stable
    chunk, spans = chunk[later], np.stack([e["at"][later], e["size"][later]], 1).astype("<i4")
    order = np.argsort(chunk, kind="stable")
    cut, spans = np.searchsorted(chunk[order], np.arange(len(own) + 1)), spans[order]
    spans = [x + spans[a:z].tobytes() for x, a, z in zip(own, cut[:-1], cut[1:])]
    return pa.table({"chunk": table.column("chunk").cast(pa.int64()), "spans": pa.array(spans, pa.binary())})


def _blocks(text: np.ndarray, ends: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, first window, last window, place of the anchor) of every block of a chunk, in order of place.

    live: which windows count; a block ends where they do.
    """
    out: list[tuple[np.ndarray, ...]] = []
    # Each window is hashed in the piece where it starts. A block that a piece's end cuts is two blocks, both with
    # their anchor; their windows still meet those of whole blocks, as the anchor then has blocks that differ.
    for at in range(0, len(text), PIECE):
        far = min(len(text), at + PIECE + LENGTH - 1)
        piece = np.zeros(far - at + 40, np.uint8)
        piece[: far - at] = text[at:far]
        n = far - at - LENGTH + 1
        if n <= 0:
            continue
        eight = np.ndarray((len(piece) - 7,), "<u8", piece, 0, (1,))
        count = n + SPAN - 1
        h = eight[:count] * _M1
        for k in range(8, GRAM, 8):
            h = (h ^ (h >> np.uint64(32))) * _M3 + eight[k : k + count] * _M2
        h = (h ^ (h >> np.uint64(31))) * _M3
        h ^= h >> np.uint64(29)
        m = (h & ~np.uint64((1 << 24) - 1)) | np.arange(count, dtype=np.uint64)
        size = 1
        while size * 2 <= SPAN:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[:n], m[SPAN - size : SPAN - size + n])
        anchor = (m & np.uint64((1 << 24) - 1)).astype(np.int64)
        place = np.arange(at, at + n)
        reach = np.searchsorted(ends, [at, at + n - 1], "right")
        doc = np.repeat(np.arange(reach[0], reach[1] + 1), np.diff(np.r_[at, np.minimum(ends[reach[0] : reach[1]], at + n), at + n]))
        ok = place + LENGTH <= ends[np.minimum(doc, len(ends) - 1)]
        new = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        if live is not None:
            own = live[at : at + n]
            ok &= own
            new |= own[1:] != own[:-1]
        turn = np.flatnonzero(np.r_[True, new])
        stop = np.r_[turn[1:], n]
        full = np.add.reduceat(ok.astype(np.int64), turn)  # valid windows lead a run
        turn, stop = turn[full > 0], (turn + full)[full > 0]
        total = np.r_[np.uint64(0), np.cumsum(h * _POWER[:count])]
        last = stop - 1 + SPAN
        body = (total[last] - total[turn]) * _INVERSE[turn]
        body = (body ^ (stop - turn).astype(np.uint64) * _M2) * _M1
        name = (h[anchor[turn]] ^ _M1) * _M2  # least hashes crowd the low end; mixed again, they fill all buckets alike
        out.append(((name ^ (name >> np.uint64(32))) * _M3, body ^ (body >> np.uint64(32)), turn + at, stop - 1 + at, anchor[turn] + at))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


class _Chunk:
    """A chunk's blocks grouped by (anchor, block) hash; the same on every reading."""

    def __init__(self, ids: bytes, ends: bytes, text: bytes, copies: list[bytes] | None, bits: int, many: int) -> None:
        self.ids, self.ends = np.frombuffer(ids, "<i8"), np.frombuffer(ends, "<i8")
        self.text = zstandard.ZstdDecompressor().decompress(text) if len(text) else b""
        live, spans = None, np.frombuffer(b"".join(copies or []), "<i4").reshape(-1, 2)
        if len(spans):
            turn = np.zeros(len(self.text) + 1, np.int8)  # segments share no windows: one may begin where another ends
            turn[spans[:, 0]] += 1
            turn[spans.sum(axis=1) - (LENGTH - 1)] -= 1
            live = np.cumsum(turn[:-1], dtype=np.int8) == 0
        anchor, block, self.first, self.last, self.at = _blocks(np.frombuffer(self.text, np.uint8), self.ends, live)
        self.doc = self.ids[np.searchsorted(self.ends, self.first, "right")] if len(self.first) else self.first
        anchor = anchor >> np.uint64(64 - bits)
        key = anchor << np.uint64(BLOCK_BITS) | block & np.uint64((1 << BLOCK_BITS) - 1)
        self.order = np.argsort(key, kind="stable")  # places are in order of documents
        a, b, d = anchor[self.order], key[self.order], self.doc[self.order]
        new_anchor = np.r_[True, a[1:] != a[:-1]] if len(a) else np.empty(0, bool)
        new = np.r_[True, b[1:] != b[:-1]] if len(a) else new_anchor
        self.head = np.flatnonzero(new)  # of each class: its least document's first block
        self.size = np.diff(np.r_[self.head, len(a)])
        self.anchor, self.least = a[self.head], d[self.head]
        tail = self.head + self.size - 1
        self.several = d[tail] != self.least if len(a) else np.empty(0, bool)
        kinds = np.diff(np.r_[np.flatnonzero(new_anchor[self.head]), len(self.head)]) if len(a) else np.empty(0, np.int64)
        self.hot = np.repeat(kinds > many, kinds)  # classes of an anchor with very many kinds in this chunk
        self.sent = np.flatnonzero(~self.hot | new_anchor[self.head]) if len(a) else np.empty(0, np.int64)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array, all first ones, then all second ones: what varies little compresses away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _hashes(bits: int, buckets: int, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, ids, ends, text, copies in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "ends", "text", "copies"))):
                c = _Chunk(ids, ends, text, copies, bits, many)
                a = c.anchor[c.sent]
                at = np.r_[np.searchsorted(a, np.array([(i << bits) // buckets for i in range(buckets)], np.uint64)), len(a)]
                rows = {"bucket": [], "chunk": [], "data": []}
                for k in range(buckets):
                    s = c.sent[at[k] : at[k + 1]]
                    if len(s):
                        flags = c.several[s] | c.hot[s] << 1
                        data = _planes(np.diff(c.anchor[s], prepend=np.uint64(0))) + _planes((c.least[s].view(np.uint64) << np.uint64(1)) ^ (c.least[s] >> 63).view(np.uint64)) + flags.astype(np.uint8).tobytes()
                        rows["bucket"].append(k)
                        rows["chunk"].append(chunk)
                        rows["data"].append(pack.compress(data))
                yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), pa.array(rows["chunk"], pa.int64()), pa.array(rows["data"], pa.binary())], names=["bucket", "chunk", "data"])

    return run


def _answer(table: pa.Table, crowd: int = CROWD) -> pa.Table:
    """For one bucket: of each chunk's entries, bit planes of "anchor in several documents" and "a crowded anchor"."""
    open_ = zstandard.ZstdDecompressor()
    chunks, blobs = table.column("chunk").to_pylist(), [open_.decompress(x) for x in table.column("data").to_pylist()]
    sizes = np.array([len(b) // 17 for b in blobs])
    a = np.concatenate([np.cumsum(_unplanes(b[: n * 8])) for b, n in zip(blobs, sizes)])
    z = np.concatenate([_unplanes(b[n * 8 : n * 16]) for b, n in zip(blobs, sizes)])
    flags = np.concatenate([np.frombuffer(b, np.uint8, n, n * 16) for b, n in zip(blobs, sizes)])
    del blobs
    d = (z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64)
    order = np.argsort(a)
    a, d, f = a[order], d[order], flags[order]
    new = np.r_[True, a[1:] != a[:-1]]
    group = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    low, high = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
    known = np.maximum.reduceat(f, at)
    common = (low != high) | (known > 0)
    crowded = common & ((np.diff(np.r_[at, len(a)]) > crowd) | (known > 1))
    send, single = np.empty(len(a), bool), np.empty(len(a), bool)
    send[order], single[order] = common[group], crowded[group]
    cut = np.r_[0, np.cumsum(sizes)]
    rows = [np.packbits(np.r_[send[i:j], single[i:j]]).tobytes() for i, j in zip(cut[:-1], cut[1:])]
    counts = [int(send[i:j].sum()) + 16 * int(single[i:j].sum()) for i, j in zip(cut[:-1], cut[1:])]
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "bucket": table.column("bucket").cast(pa.int32()), "n": pa.array(sizes, pa.int64()), "bits": pa.array(rows, pa.binary()), "weight": pa.array(counts, pa.int64())})


def _front_code(rows: list[tuple[bytes, int, int, int]]) -> bytes:
    """A sorted run of (string, bytes of it that stand before the anchor, document, place): lengths shared with the string
    before, lengths of the rest, the numbers, and the rests."""
    strings = [x[0] for x in rows]
    size = np.fromiter(map(len, strings), np.int64, len(rows))
    width = int(size.max())
    flat = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in strings]), np.uint8).reshape(-1, width)
    other = flat[1:] != flat[:-1]
    first = np.where(other.any(axis=1), other.argmax(axis=1), width)
    shared = np.r_[0, np.minimum(first, np.minimum(size[1:], size[:-1]))]
    tails = [x[n:] for x, n in zip(strings, shared.tolist())]
    left, docs, places = bytes(x[1] for x in rows), np.array([x[2] for x in rows], "<i8"), np.array([x[3] for x in rows], "<i4")
    return b"".join((len(rows).to_bytes(4, "little"), shared.astype(np.uint8).tobytes(), (size - shared).astype(np.uint8).tobytes(), left, docs.tobytes(), places.tobytes(), *tails))


def _common(a: bytes, b: bytes, known: int) -> int:
    """How many bytes a and b share, of which `known` are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    step = known
    while a[step : step + 8] == b[step : step + 8]:
        step += 8
    while a[step] == b[step]:
        step += 1
    return step


def _suffixes(bits: int, ranges: int, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for chunk, ids, ends, text, copies, answers in zip(*(batch.column(c).to_pylist() for c in ("chunk", "ids", "ends", "text", "copies", "answers"))):
                c = _Chunk(ids, ends, text, copies, bits, many)
                send, single = np.zeros(len(c.head), bool), np.zeros(len(c.head), bool)
                at = 0
                for x in sorted(answers or [], key=lambda x: x["bucket"]):
                    n, own = x["n"], np.unpackbits(np.frombuffer(x["bits"], np.uint8)).astype(bool)
                    send[c.sent[at : at + n]], single[c.sent[at : at + n]] = own[:n], own[n : 2 * n]
                    at += n
                entries, gone = _entries(c, send | c.hot, single | c.hot, bits)
                entries.sort()
                # Within the chunk, a string's least document stands for it; later ones lose it here and now.
                kept, least, string = [], 0, None
                for x in entries:
                    if x[:2] != string:
                        string, least = x[:2], x[2]
                    if x[2] > least:
                        gone.append((x[3], len(x[0]) - HEAD))
                    else:
                        kept.append(x)
                del entries
                if gone:
                    yield _row(-1 - chunk, chunk, _spans(gone))  # a group of its own, which the merge hands on
                first = np.frombuffer(b"".join([x[0][:4] for x in kept]), ">u4").astype(np.uint64)
                of = (first * np.uint64(ranges)) >> np.uint64(32)
                cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(kept)]
                for low, high in zip(cut[:-1], cut[1:]):
                    if high > low:
                        yield _row(int(of[low]), chunk, pack.compress(_front_code(kept[low:high])))

    return run


def _entries(c: _Chunk, send: np.ndarray, single: np.ndarray, bits: int) -> tuple[list[tuple[bytes, int, int, int]], list[tuple[int, int]]]:
    """(string, bytes before the anchor, document, place) of what a chunk sends, and the (place, length) it can already remove.

    Later documents' blocks that equal the first of their class are removed here; the first is sent, and so are its
    document's other equal blocks, and blocks that only share the hash.
    """
    text, entries, gone = c.text, [], []
    first, last, doc, anchor = c.first[c.order].tolist(), c.last[c.order].tolist(), c.doc[c.order].tolist(), c.at[c.order].tolist()
    heads, sizes, alone = c.head.tolist(), c.size.tolist(), single.tolist()
    place = (c.anchor >> np.uint64(bits - 32) if bits > 32 else c.anchor << np.uint64(32 - bits)).astype(">u4").tobytes()
    for k in np.flatnonzero(send).tolist():
        i = heads[k]
        a, d = first[i], doc[i]
        s, begin = text[a : last[i] + LENGTH], place[4 * k : 4 * k + 4] + _ANCHORED
        for j in range(i, i + sizes[k]):
            b, z, e = first[j], last[j], doc[j]
            if j > i and e > d and text[b : z + LENGTH] == s:
                gone.append((b, len(s)))
            elif alone[k]:
                windows = [text[p : p + LENGTH] for p in range(b, z + 1)]
                entries += [(zlib.crc32(w).to_bytes(4, "big") + _SINGLE + w, 0, e, p) for p, w in enumerate(windows, b)]
            else:
                m = anchor[j]
                entries.append((begin + text[m : z + LENGTH] + text[b:m], m - b, e, b))
    return entries, gone


def _spans(spans: list[tuple[int, int]]) -> bytes:
    return np.array(spans, "<i4").reshape(-1, 2).tobytes()


def _row(range_: int, chunk: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([range_], pa.int64()), pa.array([chunk], pa.int64()), pa.array([data], pa.binary())], names=["range", "chunk", "data"])


class _Run:
    """Reads a front-coded run: the current string, the length it shares with the one before, and its numbers."""

    __slots__ = ("at", "data", "docs", "left", "n", "places", "rest", "shared", "string", "tail")

    def __init__(self, blob: bytes) -> None:
        self.n = n = int.from_bytes(blob[:4], "little")
        self.shared, self.rest, self.left = (blob[4 + i * n : 4 + (i + 1) * n] for i in range(3))
        self.docs, self.places = np.frombuffer(blob, "<i8", n, 4 + 3 * n).tolist(), np.frombuffer(blob, "<i4", n, 4 + 11 * n).tolist()
        self.data, self.tail, self.at, self.string = blob, 4 + 15 * n, -1, b""

    def next(self) -> int:
        """Steps on; the length shared with the string before, or -1 at the end."""
        self.at = at = self.at + 1
        if at == self.n:
            return -1
        h, end = self.shared[at], self.tail + self.rest[at]
        self.string = self.string[:h] + self.data[self.tail : end]
        self.tail = end
        return h


def merge(runs: list[_Run]) -> Iterator[tuple[int, int]]:
    """(run, length shared with the string before) in the order of all strings.

    A loser tree: each inner node keeps the run that lost there and `h`, the length which that run's string shares with
    the string that beat it. Going up, all strings are at least the last output; of two, the one that shares more with
    it is less, and their common prefix is the smaller length, without looking at a byte. Only on equal lengths are
    bytes compared, from there on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    h = [r.next() for r in runs] + [-1] * (k - len(runs))
    loser = [-1] * k
    # Play the leaves in; before any output, all share 0 bytes with it.
    h = [0 if x >= 0 else -1 for x in h]
    strings = [r.string for r in runs] + [b""] * (k - len(runs))

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; sets the loser's h."""
        x, y = h[a], h[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = strings[a], strings[b]
        n = _common(s, t, x)
        if n == len(s) or (n < len(t) and s[n] < t[n]):
            h[b] = n
            return a, b
        h[a] = n
        return b, a

    level = list(range(k))
    base = k
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            loser[base + i // 2] = lost
            up.append(w)
        level = up
    win = level[0]
    while h[win] >= 0:
        yield win, h[win]
        h[win] = runs[win].next()
        strings[win] = runs[win].string
        node = (win + k) >> 1
        while node:
            o = loser[node]
            x, y = h[win], h[o]
            if x == y:
                if x >= 0:
                    w, loser[node] = play(win, o)
                    win = w
            elif x < y:
                loser[node], win = win, o
            node >>= 1


def _pairs(blocks: list[tuple[bytes, int, int, int, int]], gone: list[list[tuple[int, int]]]) -> None:
    """The windows that each two blocks of one anchor share are those within the bytes they share around it."""
    for i, (s, left, d, r, p) in enumerate(blocks):
        for t, other, e, q, o in blocks[i + 1 :]:
            after, before = min(len(s) - left, len(t) - other), min(left, other)
            if d == e or after + before < HEAD + LENGTH:
                continue
            after = min(after, _common(s, t, HEAD + GRAM))
            if after + before < HEAD + LENGTH:
                continue
            before = _common(s[: -before - 1 : -1], t[: -before - 1 : -1], 0) if before else 0
            if after + before >= HEAD + LENGTH:
                if d > e:
                    gone[r].append((p + left - before, after - HEAD + before))
                else:
                    gone[q].append((o + other - before, after - HEAD + before))


def _decide(group: list[tuple[bytes, int, int, int, int]], gone: list[list[tuple[int, int]]]) -> None:
    """Which bytes of a group's entries (string, before, document, run, place) an earlier document has: all blocks of one
    anchor, or equal single windows."""
    docs = {x[2] for x in group}
    if len(docs) == 1:
        return
    classes: dict[tuple[bytes, int], list[tuple[bytes, int, int, int, int]]] = {}
    for x in group:
        classes.setdefault(x[:2], []).append(x)
    leaders = []
    for (string, _), members in classes.items():
        least = min(x[2] for x in members)
        for x in members:
            if x[2] > least:
                gone[x[3]].append((x[4], len(string) - HEAD))
            else:
                leaders.append(x)
    if len(classes) == 1:
        return
    if len(leaders) <= FEW:
        _pairs(leaders, gone)
        return
    # By ascending document, the first one that puts a window in is the least that has it.
    windows: dict[bytes, int] = {}
    for string, before, d, r, p in sorted(leaders, key=lambda x: x[2]):
        block = string[len(string) - before :] + string[HEAD : len(string) - before]
        own = [block[i : i + LENGTH] for i in range(len(block) - LENGTH + 1)]
        holder = list(map(windows.setdefault, own, repeat(d)))
        if min(holder) == d:
            continue
        start = -1
        for i, h in enumerate(holder):
            if h < d:
                start = i if start < 0 else start
            elif start >= 0:
                gone[r].append((p + start, i - 1 - start + LENGTH))
                start = -1
        if start >= 0:
            gone[r].append((p + start, len(own) - 1 - start + LENGTH))


def _merges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges range after range of a task, whose rows come in order of ranges."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        of = batch.column("range").to_numpy()
        cut = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
        for low, high in zip(cut[:-1], cut[1:]):
            if held and held[0].column("range")[0].as_py() != of[low]:
                yield from _merge(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield from _merge(pa.Table.from_batches(held)).to_batches()


def _merge(table: pa.Table) -> pa.Table:
    """One range: the places that an earlier document has, by chunk. A group of a chunk's own places is handed on."""
    chunks = table.column("chunk").to_pylist()
    if table.num_rows and table.column("range")[0].as_py() < 0:
        return table.select(["chunk", "data"]).rename_columns(["chunk", "spans"])
    open_ = zstandard.ZstdDecompressor()
    runs = [_Run(open_.decompress(x)) for x in table.column("data").to_pylist()]
    gone: list[list[tuple[int, int]]] = [[] for _ in runs]
    group: list[tuple[bytes, int, int, int, int]] = []
    alike = True  # all strings of the group are one

    def decide() -> None:
        if len(group) > 1:
            if not alike:
                _decide(group, gone)
            elif (least := min([x[2] for x in group])) < max([x[2] for x in group]):
                n = len(group[0][0]) - HEAD
                for _, _, d, r, p in group:
                    if d > least:
                        gone[r].append((p, n))

    for r, shared in merge(runs):
        run, string = runs[r], runs[r].string
        left, equal = run.left[run.at], shared == len(string)
        if not (shared >= HEAD + GRAM if string[4] == 0 else equal):
            decide()
            group, alike = [], True
        elif alike and not (equal and len(group[-1][0]) == shared and group[-1][1] == left):
            alike = False
        group.append((string, left, run.docs[run.at], r, run.places[run.at]))
    decide()
    have = [i for i, g in enumerate(gone) if g]
    return pa.table({"chunk": pa.array([chunks[i] for i in have], pa.int64()), "spans": pa.array([_spans(gone[i]) for i in have], pa.binary())})


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ends, blob, spans in zip(*(batch.column(c).to_pylist() for c in ("ids", "ends", "text", "spans"))):
                text = zstandard.ZstdDecompressor().decompress(blob) if blob else b""
                mark = np.zeros(len(text) + 1, np.int32)
                for x in spans or []:
                    at = np.frombuffer(x, "<i4").reshape(-1, 2)
                    np.add.at(mark, at[:, 0], 1)
                    np.add.at(mark, at[:, 0] + at[:, 1], -1)
                gone = np.cumsum(mark[:-1]) > 0
                raw, low, rows = np.frombuffer(text, np.uint8), 0, []
                for d, high in zip(np.frombuffer(ids, "<i8").tolist(), np.frombuffer(ends, "<i8").tolist()):
                    cut = gone[low:high]
                    n = int(cut.sum())
                    kept = raw[low:high][~cut].tobytes() if n else text[low:high]
                    edges = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if n else 0
                    rows.append({"doc_id": d, "n_bytes": high - low, "n_removed": n, "n_spans": edges, "kept_sha256": hashlib.sha256(kept).hexdigest()} | ({"kept": kept} if with_text else {}))
                    low = high
                for i in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 1024], schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text))

    return run


def _even_keys(spark, tasks: int) -> list[int]:
    """A key for each task that a shuffle of so many partitions deals to it alone."""
    found: dict[int, int] = {}
    at = 0
    while len(found) < tasks:
        more = spark.range(at, at + 16 * tasks).select("id", F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks)).alias("to")).groupBy("to").agg(F.min("id").alias("id")).collect()
        found = {r["to"]: r["id"] for r in more} | found
        at += 16 * tasks
    return [found[i] for i in range(tasks)]


def dedup(docs: DataFrame, with_text: bool = True, chunk: int = CHUNK, many: int = MANY, crowd: int = CROWD, per_range: int = RANGE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text kept) of every row of docs (doc_id, text).

    A byte goes if it lies in a LENGTH-byte string, within its document, that also starts in a document with a smaller
    doc_id. Null texts are empty. Rows that share a doc_id do not remove from one another. Rows without a doc_id take
    no part and keep all. chunk, many, crowd and per_range size the work and change no result. `kept` is binary: a removed run may cut a character. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chunks = stage(rows.where("doc_id is not null").mapInArrow(_chunks(chunk), _CHUNK), "chunks")
    size = chunks.agg(F.sum(F.octet_length("text")).alias("text"), F.sum(F.octet_length("ids")).alias("ids")).first()
    total = size["text"] or 0
    bits = min(64 - BLOCK_BITS, 20 + max(1, math.ceil(math.log2(3 * total + 2))))
    # A row for each chunk and bucket: of large tables the buckets are larger, so that there are fewer rows.
    buckets = max(1, round(3 * total / 18 / BUCKET / 4), min(16, round(3 * total / 18 / BUCKET)))
    parts = chunks.select("chunk", "ids", "ends", "text").mapInArrow(_segments(max(1, round((3 * total / SEGMENT + (size["ids"] or 0) / 8) / BUCKET))), "bucket int, chunk long, data binary, own binary")
    copies = stage(parts.groupBy("bucket").applyInArrow(_copies, "chunk long, spans binary").where("octet_length(spans) > 0"), "copies")
    # By merge at all sizes, as the spans are too many to broadcast when the table is large.
    texts = chunks.select("chunk", "ids", "ends", "text").join(copies.groupBy("chunk").agg(F.collect_list("spans").alias("copies")).hint("merge"), "chunk", "left")
    sent = texts.mapInArrow(_hashes(bits, buckets, many), "bucket int, chunk long, data binary")
    answers = stage(sent.groupBy("bucket").applyInArrow(lambda t: _answer(t, crowd), "chunk long, bucket int, n long, bits binary, weight long"), "answers")
    weight = answers.agg(F.sum("weight")).first()[0] or 0
    ranges = max(1, round(weight / per_range))
    told = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers"))  # one chunk's
    runs = texts.join(told, "chunk", "left").select(*texts.columns, "answers").mapInArrow(_suffixes(bits, ranges, many), "range long, chunk long, data binary")
    tasks = min(ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 8))
    key = _even_keys(spark, tasks)
    dealt = runs.withColumn("key", F.element_at(F.from_json(F.lit(str(key)), "array<int>"), (F.pmod("range", F.lit(tasks)) + 1).cast("int")))
    dealt = dealt.repartition(tasks, "key").sortWithinPartitions("range").select("range", "chunk", "data")
    merged = stage(dealt.mapInArrow(_merges, "chunk long, spans binary"), "merged", [answers])
    spans = merged.unionByName(copies).groupBy("chunk").agg(F.collect_list("spans").alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    done = chunks.join(spans, "chunk", "left").select("ids", "ends", "text", "spans").mapInArrow(_finish(with_text), schema)
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rest = rows.where("doc_id is null").select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept"))
    return done.unionByName(rest.select(done.columns))


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs, with_text=False)
