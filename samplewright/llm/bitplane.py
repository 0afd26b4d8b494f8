"""Token ids in files of bit planes: blocks of ids transposed, every plane compressed with zstandard.

A shard file holds the ids of consecutive documents:

    magic "SWBP1\\0", u16 version, u32 block, u32 chunk_blocks
    chunks: for each of the planes, a zstandard frame
    index: for each chunk u64 offset, u64 first id, u32 ids, u32 planes, then u32 length of each plane
    documents: u64 count, then i64 key and u64 ids of each
    footer: u64 offset of the index, u64 offset of the documents, u32 chunks, magic

A chunk is ``chunk_blocks`` blocks of ``block`` ids. In a block, plane k of the four byte planes holds byte k of
every id; ``bits=True`` goes on to the 32 bit planes. Planes that are all zero take a few bytes. The index lets a
reader decode a range of ids without the rest.

Spark writes one shard per row of a Parquet table in the shared folder, so that any store it writes to will do.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from samplewright.llm.common import KEY, identified
from samplewright.session import scratch_path

MAGIC = b"SWBP1\0"
HEAD = struct.Struct("<6sHII")
CHUNK = struct.Struct("<QQII")
FOOT = struct.Struct("<QQI6s")
BLOCK = 4096
CHUNK_BLOCKS = 16
SHARD_IDS = 1 << 20
LETTERS = re.compile("[a-zß-öø-ÿ]+")
# Byte-level vocabularies write a byte as a letter: printable ones as they are, the others from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
# Words of Latin letters, digits and ASCII signs, and the pieces that the vocabulary's rules part them into once lowered.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^0-9a-zß-öø-ÿ]+")
SAMPLES = ("a", "the", "word", "straße", "ñandú", "éöÿ", "don't", "''s", "a'return.", "Ñu-2024,", "<a@b-3.com>", "x__y/~$%", "(12.5)[]")
MEMO = 200_000  # words remembered, and as many older ones
SLICE = 1 << 24  # bytes of text whose words are looked up at once


def to_planes(ids: np.ndarray, block: int, bits: bool) -> list[bytes]:
    """Planes of ids (uint32, filled up with zeros to whole blocks)."""
    padded = np.zeros(-(-len(ids) // block) * block, "<u4")
    padded[: len(ids)] = ids
    bytes_ = padded.view(np.uint8).reshape(-1, block, 4).transpose(2, 0, 1)
    if not bits:
        return [p.tobytes() for p in bytes_]
    return [np.packbits(p >> k & 1, axis=1).tobytes() for p in bytes_ for k in range(8)]


def from_planes(planes: list[bytes], n: int, block: int) -> np.ndarray:
    blocks = -(-n // block)
    if not n:
        return np.empty(0, "<u4")
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8).reshape(blocks, block) for p in planes], axis=2)
    else:
        raw = np.zeros((blocks, block, 4), np.uint8)
        for k, p in enumerate(planes):
            bit = np.unpackbits(np.frombuffer(p, np.uint8).reshape(blocks, -1), axis=1, count=block)
            raw[:, :, k // 8] |= bit << (k % 8)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)[:n]


def encode(ids: np.ndarray, keys: list[int], lengths: list[int], bits: bool = False, block: int = BLOCK) -> bytes:
    """A shard of documents, whose ids follow each other in ``ids``."""
    packer = zstandard.ZstdCompressor(level=3)
    out, index = [HEAD.pack(MAGIC, 1, block, CHUNK_BLOCKS)], []
    at, size = HEAD.size, block * CHUNK_BLOCKS
    for first in range(0, len(ids), size):
        part = ids[first : first + size]
        frames = [packer.compress(p) for p in to_planes(part, block, bits)]
        index.append(CHUNK.pack(at, first, len(part), len(frames)) + struct.pack(f"<{len(frames)}I", *map(len, frames)))
        out += frames
        at += sum(map(len, frames))
    table = np.array([keys, lengths], "<i8").T.tobytes()
    tail = b"".join(index)
    out += [tail, struct.pack("<Q", len(keys)), table, FOOT.pack(at, at + len(tail), len(index), MAGIC)]
    return b"".join(out)


@dataclass
class Shard:
    """A reader of one shard."""

    data: bytes

    def __post_init__(self) -> None:
        magic, version, self.block, _ = HEAD.unpack_from(self.data)
        at, docs, chunks, end = FOOT.unpack_from(self.data, len(self.data) - FOOT.size)
        if (magic, version, end) != (MAGIC, 1, MAGIC):
            raise ValueError("no shard of bit planes")
        self.index = []
        for _ in range(chunks):
            offset, first, n, planes = CHUNK.unpack_from(self.data, at)
            lengths = struct.unpack_from(f"<{planes}I", self.data, at + CHUNK.size)
            self.index.append((offset, first, n, lengths))
            at += CHUNK.size + 4 * planes
        (count,) = struct.unpack_from("<Q", self.data, docs)
        table = np.frombuffer(self.data, "<i8", 2 * count, docs + 8).reshape(-1, 2)
        self.keys, self.lengths = table[:, 0], table[:, 1]

    def _chunk(self, offset: int, n: int, lengths: tuple[int, ...]) -> np.ndarray:
        unpack, planes = zstandard.ZstdDecompressor(), []
        for length in lengths:
            planes.append(unpack.decompress(self.data[offset : offset + length]))
            offset += length
        return from_planes(planes, n, self.block)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``stop``; decodes only the chunks that hold them."""
        stop = int(self.lengths.sum()) if stop is None else stop
        parts = [
            self._chunk(o, n, lengths)[max(0, start - first) : stop - first]
            for o, first, n, lengths in self.index
            if first < stop and first + n > start
        ]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


class _Memo(dict):
    """Ids of the words met lately: when it is full, its words become the older half, and come back when they are used."""

    def __init__(self, ids: Callable[[str], bytes]) -> None:
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.ids = ids
        self.stops = {c: ids(c) for c in ".,"}

    def __missing__(self, w: str) -> bytes:
        found = self.older.get(w)
        if found is None:
            # A stop behind a letter is a piece of its own: not kept with the word, so that fewer words fill the memo.
            stop = self.stops.get(w[-1:])
            if stop and "a" <= w[-2:-1] <= "z":
                return self[w[:-1]] + stop
            found = self.ids(w)
        self[w] = found
        return found

    def turn(self) -> None:
        if len(self) > MEMO:
            self.older = dict(self)
            self.clear()


class Tokenizer:
    """Whole texts to ids, word by word: the vocabulary drops white space, so words between blanks stand alone.

    The ids of words are remembered, as words repeat. Blanks and line breaks only part words here; what other
    white space there is, the vocabulary's own rules see. A-Z are lowered beforehand, which the rules would do anyway, so
    that fewer different words are met; a text that might hold a special token is left alone. Where the rules are those of
    ``PIECES``, the pieces of plain words go to the merges as they are.
    """

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer as Loaded

        self.inner = Loaded.from_file(path)
        self.merges = self.inner.model
        self.direct = all(self._pieces(w) == self._rules(w) for w in SAMPLES)
        self.memo = _Memo(self._ids)
        self.end_id = end_id

    def _letters(self, word: str) -> list[int]:
        """Ids of a piece: nothing to normalise or to part, so its bytes go to the merges as they are."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return [t.id for t in self.merges.tokenize(word)]

    def _pieces(self, word: str) -> list[int]:
        """Ids of a plain word without special tokens."""
        return [i for piece in PIECES.findall(word.lower()) for i in self._letters(piece)]

    def _rules(self, word: str) -> list[int]:
        """Ids of any word, by all rules of the vocabulary."""
        return self.inner.encode(word, add_special_tokens=False).ids

    def _ids(self, word: str) -> bytes:
        if not self.direct:
            ids = self._rules(word)
        elif LETTERS.fullmatch(word):
            ids = self._letters(word)
        elif PLAIN.fullmatch(word) and "<|" not in word:
            ids = self._pieces(word)
        else:
            ids = self._rules(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each with the end id, and how many each has.

        Every different word of the texts is asked for once.
        """
        texts = pc.fill_null(texts, "")
        lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        words = pc.split_pattern(pc.replace_substring(lowered, "\n", " "), " ")
        met = words.flatten().dictionary_encode()
        self.memo.turn()
        known = [self.memo[w] for w in met.dictionary.to_pylist()]
        starts = np.cumsum([0, *map(len, known)]) // 4
        ids = pa.LargeListArray.from_arrays(starts, np.frombuffer(b"".join(known), "<u4")).take(met.indices)
        upto = np.diff(words.offsets.to_numpy()).cumsum()
        ends = ids.offsets.to_numpy()[upto] - ids.offsets[0].as_py()
        return np.insert(ids.flatten().to_numpy(), ends, self.end_id), np.diff(ends, prepend=0) + 1

    def __call__(self, text: str | None) -> bytes:
        """Ids with the end id, as little-endian unsigned 32-bit integers."""
        return self.encode(pa.array([text], pa.string()))[0].tobytes()


@lru_cache(maxsize=1)
def _tokenizer(path: str, end_id: int) -> Tokenizer:
    """One per worker process, so that its tasks share what it remembers."""
    return Tokenizer(path, end_id)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of the rows with up to ``SLICE`` bytes of ``text``, or one row."""
    upto, at = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().cumsum(dtype=np.int64), 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_shards(
    keyed: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    path: str | None = None,
    bits: bool = False,
    shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Encode every whole ``text`` of ``keyed`` (unique ``_doc``, text), write the shards in order of the key.

    Returns (part, shard, n_ids, content) as read back: shards of about ``shard_ids`` ids or one document;
    (part, shard) orders them. Texts are range-partitioned by the key, and a task holds one shard at a time.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, shard = _tokenizer(tokenizer_path, end_id), TaskContext.get().partitionId(), 0
        keys, ids, held = [], [], 0

        def close() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            content = encode(all_ids, keys, [len(i) for i in ids], bits)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "n_ids": [len(all_ids)], "content": [content]})

        for batch in batches:
            for some in slices(batch):
                found, sizes = tokenizer.encode(some["text"])
                for key, of_text in zip(some[KEY].to_pylist(), np.split(found, sizes.cumsum()[:-1]), strict=True):
                    keys.append(key)
                    ids.append(of_text)
                    held += len(of_text)
                    if held >= shard_ids:
                        yield close()
                        keys, ids, held, shard = [], [], 0, shard + 1
        if keys:
            yield close()

    path = path or scratch_path(keyed.sparkSession)
    schema = "part long, shard long, n_ids long, content binary"
    ordered = keyed.select(KEY, "text").repartitionByRange(KEY).sortWithinPartitions(KEY)
    ordered.mapInArrow(shards, schema).write.option("compression", "none").parquet(path)
    return keyed.sparkSession.read.schema(schema).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, base): ids of all shards before each; totals per part are added up, then inside each part."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition of the writing job
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    inside = W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    own = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("own"))
    return own.join(bases, "part").select("part", "shard", (F.col("part_base") + F.col("own")).alias("base"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(_doc, start, n_tokens, ids_crc32) of every document, from the shards' content."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, shard, content in zip(batch["part"], batch["shard"], batch["content"], strict=True):
                file = Shard(content)
                data, ends = memoryview(file.read().tobytes()), np.cumsum(file.lengths)
                crc = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends, file.lengths, strict=True)]
                yield pd.DataFrame(
                    {"part": part, "shard": shard, KEY: file.keys, "start": ends - file.lengths,
                     "n_tokens": file.lengths, "ids_crc32": np.array(crc, np.int64)}
                )

    got = shards.select("part", "shard", "content").mapInPandas(
        rows, f"part long, shard long, {KEY} long, start long, n_tokens long, ids_crc32 long"
    )
    placed = got.join(shard_starts(shards), ["part", "shard"])
    return placed.select(KEY, (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def store_documents(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, **layout
) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, as found in the shards written of ``docs``.

    NULL texts are empty, so they consist of the end id; NULL ids come last, repeated ids in any order.
    """
    keyed = identified(docs, doc_id).select(KEY, F.col(f"row.{doc_id}").alias("doc_id"), F.col(f"row.{text}").cast("string").alias("text"))
    found = read_documents(write_shards(keyed, tokenizer_path, end_id, **layout))
    return keyed.select(KEY, "doc_id").join(found, KEY).select("doc_id", "start", "n_tokens", "ids_crc32")
