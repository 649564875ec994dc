"""Token ids as binary shards: one concatenated id array a shard, its document boundaries in Elias-Fano form.

Shard layout (little-endian): magic, header, validity bytes and doc ids, low bits, high bits, select samples, ids.
A boundary b_i splits into its low `l` bits, packed, and its high part, written in unary: bit (b_i >> l) + i of the
high bits is set. That takes about 2 + log2(u / n) bits a boundary. select(i) starts at the sample of every 256th set
bit, so an offset is found without decoding the others.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helioframe.llm.common import new_folder, ship, stage

MAGIC, HEADER, SAMPLE = b"HFTOKEF1", struct.Struct("<8sIIQQQQQ"), 256
VOCABULARY, END_ID = "word_bpe_49k.json", 2
#: Text bytes aimed at for one shard, the ids at which a shard is closed in any case, and the most tasks that write.
#: Beyond so many tasks, each writes several shards.
SHARD_BYTES, SHARD_IDS, TASKS = 24 << 20, 16 << 20, 20_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 700_000
#: Words of these letters alone are one piece, unchanged by the normaliser.
_PLAIN = re.compile(r"[a-zß-öø-ÿ]+")
_MARKED = re.compile(rb"[a-z][.,]\Z")
_state: dict = {}


class EliasFano:
    """A non-decreasing array of non-negative integers, with random access."""

    def __init__(self, low_bits: int, size: int, low: bytes, high: bytes, samples: np.ndarray) -> None:
        self.low_bits, self.size, self.low, self.high, self.samples = low_bits, size, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.int64)
        n, most = len(v), int(v[-1]) if len(v) else 0
        l = max(0, (most // n).bit_length() - 1) if n else 0  # noqa: E741
        low = np.packbits(((v[:, None] >> np.arange(l)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() if l else b""
        ones = (v >> l) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        bits[ones] = 1
        return cls(l, n, low, np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.int64))

    def select(self, i: int) -> int:
        """The place of set bit i of the high bits."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (c := word.bit_count()) <= left:
            left -= c
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        at, l = i * self.low_bits, self.low_bits  # noqa: E741
        low = int.from_bytes(self.low[at >> 3 : (at + l + 7) >> 3], "little") >> (at & 7) & ((1 << l) - 1)
        return (self.select(i) - i) << l | low

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.size]
        out = (ones - np.arange(self.size)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.size * self.low_bits].reshape(self.size, -1)
            out = out | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return out


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: bytes, width: int) -> bytes:
    """One shard: ids are little-endian unsigned integers of `width` bytes, sizes the ids of each document."""
    ends = EliasFano.encode(np.r_[0, np.cumsum(sizes)])
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    own = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    head = HEADER.pack(MAGIC, width, ends.low_bits, len(doc_ids), len(ids) // width, len(ends.low), len(ends.high), len(ends.samples))
    return b"".join((head, known, own, ends.low, ends.high, ends.samples.astype("<i8").tobytes(), ids))


def unpack(blob: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """The documents' ids, their boundaries and the concatenated id array of a shard."""
    magic, width, low_bits, docs, n_ids, low, high, samples = HEADER.unpack_from(blob)
    if magic != MAGIC or len(blob) != HEADER.size + docs * 9 + low + high + samples * 8 + n_ids * width:
        raise ValueError("not a whole token shard")
    at = HEADER.size
    known = blob[at : at + docs]
    own = np.frombuffer(blob, "<i8", docs, at + docs).tolist()
    at += docs * 9
    ends = EliasFano(low_bits, docs + 1, blob[at : at + low], blob[at + low : at + low + high], np.frombuffer(blob, "<i8", samples, at + low + high))
    return [d if k else None for k, d in zip(known, own)], ends, np.frombuffer(blob, f"<u{width}", n_ids, at + low + high + samples * 8)


def _printable() -> dict[int, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


_BYTES = _printable()


def _piece(model, word: str) -> list[int]:
    """The ids of one lower-case word, straight from the merges."""
    return [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(_BYTES))]


def _encoder(path: str):
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        probe = "Été l'aß, x-y's 12; naïve ÉA.\nend"
        by_word = [i for w in probe.encode().lower().split() for i in tok.encode(w.decode(), add_special_tokens=False).ids]
        width = 2 if tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        plain = _PLAIN.findall("été aß naïve end zzqxj")
        _state.update(path=path, tok=tok, cache={}, width=width, written=[i.to_bytes(width, "little") for i in range(tok.get_vocab_size(with_added_tokens=True))])
        _state["marks"] = {ord(m): b"".join(_state["written"][i] for i in tok.encode(m, add_special_tokens=False).ids) for m in ".,"}
        _state["by_word"] = by_word == tok.encode(probe, add_special_tokens=False).ids and all(_piece(tok.model, w) == tok.encode(w, add_special_tokens=False).ids for w in plain)
    return _state


def encode(texts: list[bytes], path: str) -> tuple[list[bytes], int]:
    """The ids of each text as little-endian bytes, and their width.

    This vocabulary drops white space and cuts at every end of a run of letters, so the ids of a text are those of its
    words, one after another, and of "word" and "," where a mark follows a letter and ends a word. ASCII letters are
    lower-cased first, as the tokenizer does itself. Each distinct word is encoded once and remembered; words of plain
    letters skip the normaliser, which leaves them as they are. Texts that may hold the vocabulary's special strings are
    encoded whole, and so are all texts if a probe shows that a vocabulary does not work by words.
    """
    s = _encoder(path)
    tok, model, cache, written, kind = s["tok"], s["tok"].model, s["cache"], s["written"], f"<u{s['width']}"
    if len(cache) > CACHE_WORDS:
        cache.clear()
    split = [None if b"<|" in t or not s["by_word"] else t.lower().split() for t in texts]
    odd = []
    for w in set().union(*(x for x in split if x)):
        if w in cache:
            continue
        stem = w[:-1] if _MARKED.search(w) else w
        if stem not in cache:
            if stem.isalpha():
                cache[stem] = b"".join([written[t.id] for t in model.tokenize(stem.decode())])
            elif _PLAIN.fullmatch(low := stem.decode().lower()):
                cache[stem] = b"".join([written[i] for i in _piece(model, low)])
            else:
                odd.append(w)
                continue
        if stem is not w:
            cache[w] = cache[stem] + s["marks"][w[-1]]
    for at in range(0, len(odd), 4096):
        part = odd[at : at + 4096]
        for w, e in zip(part, tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
            cache[w] = np.array(e.ids, kind).tobytes()
    get = cache.__getitem__
    return [np.array(tok.encode(t.decode(), add_special_tokens=False).ids, kind).tobytes() if x is None else b"".join(map(get, x)) for t, x in zip(texts, split)], s["width"]


def _writer(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        part, k, width = TaskContext.get().partitionId(), 0, 2
        own, ids, sizes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal own, ids, sizes, held, k
            name = f"part-{part:07d}-{k:05d}-{TaskContext.get().taskAttemptId()}.tok"  # each try its own; the manifest names those that count
            blob, count = pack(own, np.array(sizes, np.int64), b"".join(ids), width), len(own)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(blob)
            row = pa.RecordBatch.from_pylist([{"part": part, "k": k, "name": name, "docs": count, "ids": int(sum(sizes)), "bytes": len(blob)}])
            own, ids, sizes, held, k = [], [], [], 0, k + 1
            return row

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            keys = batch.column("doc_id").to_pylist()
            for at in range(0, len(keys), 128):
                got, width = encode([t or b"" for t in texts[at : at + 128].to_pylist()], path)
                end = end_id.to_bytes(width, "little")
                for d, x in zip(keys[at : at + 128], got):
                    own.append(d)
                    ids.append(x + end)
                    sizes.append(len(x) // width + 1)
                    held += sizes[-1]
                    if held >= SHARD_IDS:
                        yield close()
        if own:
            yield close()

    return run


def write_shards(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode docs (doc_id, text) into shards in ascending doc_id order; the folder, and the manifest with `start`, the ids before each shard.

    Null texts are empty; each document ends with end_id. Null doc_ids come first. Rows that repeat a doc_id follow each
    other, ordered by a hash of their text; rows equal in both are dealt over tasks by their place, as their ids are the
    same. An empty table writes no shard; more columns are ignored. A shard is a file of its try: if a task is run again,
    its earlier files are in no manifest, and go with the folder. Text is dealt by doc_id range before it is
    encoded, so that each word is encoded where its shard is written; a shard holds about SHARD_BYTES of text.
    """
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    key = [F.col("doc_id"), F.xxhash64("text"), F.col("place")]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(min(TASKS, max(1, round(total / SHARD_BYTES))), *key)
    dealt = dealt.sortWithinPartitions(*key).drop("place")
    made = dealt.mapInArrow(_writer(folder, public_tokenizers.path(vocabulary), end_id), "part long, k long, name string, docs long, ids long, bytes long")
    manifest = stage(made, "manifest")
    before = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return folder, stage(manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "index", [manifest])


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{root}/{name}") as f:
                    docs, ends, ids = unpack(f.read())
                cut = ends.decode()
                crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(cut[:-1] + start), pa.array(np.diff(cut)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the shards."""
    ship(manifest.sparkSession)
    n = max(1, min(manifest.count(), 20_000))
    return manifest.select("name", "start").repartition(n, "name").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    return read_shards(*write_shards(docs))
