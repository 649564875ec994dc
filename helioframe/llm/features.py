"""Hashed n-gram indicators of whole texts, and the bounded labelled sample that the classifiers are fitted on."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import ship

DIM_BITS = 18
#: At most so many labelled rows (least by hash of their doc_id) fit a classifier.
SAMPLE_ROWS = 10_000
#: Bytes of a text that are hashed at a time; pieces overlap, and their features are united.
PIECE = 1 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _ODD[5]
    return (h ^ (h >> np.uint64(32))) * _ODD[0]


_scratch: dict[int, np.ndarray] = {}


def _repeats(word: np.ndarray) -> np.ndarray:
    """One value for each tenth of the 3-word windows that occur earlier in the piece."""
    if len(word) < 3:
        return np.empty(0, np.uint64)
    windows = word[:-2] * _ODD[0] + word[1:-1] * _ODD[1] + word[2:] * _ODD[2]
    share = 1 - len(np.unique(windows)) / len(windows)
    return np.arange(int(share * 10), dtype=np.uint64)


def _piece(text: bytes, grams: tuple[int, ...], starts_of: tuple[int, ...], pairs: bool, shift: np.uint64) -> np.ndarray:
    raw = np.frombuffer(b" " * 8 + text + b" " * 9, np.uint8)
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    inner = eight[7 : len(raw) - 8]  # from one space before the text to its end
    out = [_mix((inner & _MASK[n]) * _ODD[n - 1]) >> shift for n in grams]
    blank = _SPACE[raw]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if len(starts):
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        size = ends - starts
        head = eight[starts] & _MASK[np.minimum(size, 8)]
        tail = eight[ends - 8] & ~_MASK[8 - np.minimum(size, 8)]  # its last eight bytes
        word = head * _ODD[0] + tail * _ODD[1] + size.astype(np.uint64) * _ODD[2]
        for i in np.flatnonzero(size > 16).tolist():  # what lies between its first and last eight bytes
            word[i] ^= np.uint64(xxhash.xxh64_intdigest(raw[starts[i] + 8 : ends[i] - 8].tobytes()))
        word = _mix(word)
        out.append(_mix(word ^ _ODD[3]) >> shift)
        for n in starts_of:
            out.append(_mix((head & _MASK[n])[size > n] ^ _ODD[n]) >> shift)
        if pairs:
            out.append(_mix((word[1:] - word[:-1]) ^ _ODD[4]) >> shift)  # a word after itself is one feature, whichever word
            out.append(_mix(_repeats(word) ^ _ODD[6]) >> shift)
    return np.concatenate(out or [np.empty(0, np.uint64)])


def indicators(text: bytes, grams: tuple[int, ...] = (), starts_of: tuple[int, ...] = (), pairs: bool = False, bits: int = DIM_BITS) -> np.ndarray:
    """The distinct features of a text, hashed to 2**bits: its words, byte n-grams, the first bytes of longer words, and
    with `pairs` its pairs of neighbouring words and how many of its 3-word windows repeat."""
    shift = np.uint64(64 - bits)
    parts = [_piece(text[max(0, at - 64) : at + PIECE], grams, starts_of, pairs, shift).astype(np.int64) for at in range(0, max(len(text), 1), PIECE)]
    found = np.concatenate(parts) if len(parts) > 1 else parts[0]
    last = _scratch.setdefault(bits, np.empty(1 << bits, np.int32))  # only places written below are read
    place = np.arange(len(found), dtype=np.int32)
    last[found] = place
    return found[last[found] == place]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def sample(docs: DataFrame, labels: DataFrame, label: str, features: Callable[[bytes], list[np.ndarray]], rows: int = SAMPLE_ROWS) -> list[tuple[int, list[np.ndarray]]]:
    """(label, features) of the labelled documents that fit a classifier, in a fixed order.

    Only rows whose crc32 of the doc_id is not 0 modulo 5 count; null labels and ids are left out, and an id with
    several labels takes the largest. The ids, at most `rows`, are broadcast; the documents are featured where they lie.
    """
    ship(docs.sparkSession)
    some = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    some = some.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("id", "y", "text")

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column("text").cast(pa.binary()).to_pylist()
                made = [[x.astype("<i4").tobytes() for x in features(t or b"")] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(made, pa.list_(pa.binary()))], names=["id", "y", "x"])

    got = own.mapInArrow(run, "id long, y int, x array<binary>").toArrow()  # at most `rows` rows
    order = np.argsort(got.column("id").to_numpy(), kind="stable").tolist()
    y, x = got.column("y").to_pylist(), got.column("x")
    return [(y[i], [np.frombuffer(b.as_buffer(), "<i4") for b in x[i].values]) for i in order]


def score(docs: DataFrame, run: Callable[[bytes], float], threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; held_out is null where doc_id is."""
    ship(docs.sparkSession)

    def each(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            got = np.fromiter((run(t.as_py() or b"") for t in texts), np.float64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities (Platt's targets, Newton steps)."""
    up, down = max((y == 1).sum(), 0), max((y == 0).sum(), 0)
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, float(np.log((up + 1) / (down + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, w = p - goal, p * (1 - p) + 1e-9
        hess = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(g * margin).sum() + 1e-3 * (a - 1), g.sum()]))
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-8:
            break
    return a, b


def auc(score: np.ndarray, y: np.ndarray) -> float:
    rank = pd.Series(score).rank().to_numpy()
    pos = int((y == 1).sum())
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / max(1, pos * (len(y) - pos)))
