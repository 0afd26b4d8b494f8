"""Alignment of two tokenizers' views of the same text, and how often their ids meet in the whole corpus.

Both sides tile the bytes of a text. In each batch of documents, ``pandas.merge_asof`` keyed by the document finds for
every token start the token of the other side that covers it. The union of both directions is every overlap, as of two
overlapping tokens the later one starts inside the other. Offsets where both sides end a token cut the text into groups.

A task keeps its documents in chunks of bounded text: one row with the distinct id pairs of the chunk, how often each
occurs, and the links of each document as positions in that list. The rows are stored once. Counts over the corpus come
from the pairs of all chunks, not from the links, and go back to the chunks by an equi-join on the pair; nothing is
broadcast but one row per id of the second side.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.session import settle

CHUNK_CHARS = 1 << 20  # characters of text in a chunk, or one document
WORD = 32  # bits of the second id in a pair

# How a byte-level tokenizer cuts a text before it merges, and letters on which all engines of such patterns
# agree.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa0-\u024f]*")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the rest follow
    from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """What one tokenizer gives: ids of texts, and the bytes of every id."""

    ends: tuple[str, str]

    def __init__(self, pieces: Sequence[bytes]) -> None:
        self.pieces = list(pieces)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        # Decimal ids as they stand inside a group, and at its end.
        self.words = [f"{i}{end}".encode() for i in range(len(self.pieces)) for end in self.ends]

    def ask(self, text: str) -> list[int]:
        raise NotImplementedError

    def encode(self, text: str) -> np.ndarray | None:
        """Ids of the text with a blank before it; None if their bytes are not those of blank and text."""
        ids = self.ask(text)
        same = b"".join(map(self.pieces.__getitem__, ids)) == b" " + text.encode("utf-8", "surrogatepass")
        return np.array(ids, np.int64) if same else None


class ByteLevel(Side):
    """A byte-level vocabulary whose ids are in the order of its merges is the same as a list of ranks, which a faster
    encoder takes. Other vocabularies, and texts with letters that engines of patterns may class differently, are encoded
    as the file says."""

    ends = (",", "|")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = byte_letters()
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        super().__init__([bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names])
        rules = json.loads(self.tokenizer.to_str())
        before, merges = rules["pre_tokenizer"] or {}, [m if isinstance(m, list) else m.split(" ") for m in rules["model"]["merges"]]
        single = len(letters)
        plain = rules["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        plain = plain and not before.get("add_prefix_space") and all(len(p) == 1 for p in self.pieces[:single])
        self.ranks = None
        if plain and names[single : single + len(merges)] == ["".join(m) for m in merges]:
            ranked = self.pieces[: single + len(merges)]
            self.ranks = tiktoken.Encoding("ranks", pat_str=CUT, mergeable_ranks={p: i for i, p in enumerate(ranked)}, special_tokens={})

    def ask(self, text: str) -> list[int]:
        if self.ranks and PLAIN.fullmatch(text):
            return self.ranks.encode_ordinary(" " + text)
        return self.tokenizer.encode(" " + text, add_special_tokens=False).ids


class Pieces(Side):
    ends = (",", ";")

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

        def piece(i: int) -> bytes:
            name = self.model.id_to_piece(i)
            return bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace("▁", " ").encode()

        super().__init__([piece(i) for i in range(self.model.get_piece_size())])

    def ask(self, text: str) -> list[int]:
        return self.model.encode(text)


@lru_cache(maxsize=1)
def sides(path_a: str, path_b: str) -> tuple[Side, Side]:
    """One of each per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    return ByteLevel(path_a), Pieces(path_b)


@dataclass
class Aligned:
    """Tokens of a batch of documents, links as positions of tokens, and the group of every token."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    n_links: np.ndarray
    n_groups: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *lists]), sizes


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the sorted values are among the others, sorted too."""
    if not len(others):
        return np.zeros(len(values), bool)
    return others[np.minimum(np.searchsorted(others, values), len(others) - 1)] == values


def _covering(starts: np.ndarray, doc: np.ndarray, by: np.ndarray, by_doc: np.ndarray) -> np.ndarray:
    """For each token start the token of the other side that covers it."""
    left = pd.DataFrame({"at": starts, "doc": doc})
    right = pd.DataFrame({"at": by, "doc": by_doc, "token": np.arange(len(by))})
    return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy(np.int64)


def align_texts(texts: list[str | None], a_side: Side, b_side: Side) -> Aligned:
    """Align both sides of every whole text. A text one side does not give back byte for byte has no tokens."""
    texts = [t or "" for t in texts]
    none, a_ids, b_ids = np.zeros(0, np.int64), [], []
    for t in texts:
        x = a_side.encode(t) if t else None
        y = b_side.encode(t) if x is not None else None
        a_ids.append(none if y is None else x)
        b_ids.append(none if y is None else y)
    (a, n_a), (b, n_b) = _flat(a_ids), _flat(b_ids)
    docs = np.arange(len(texts))
    doc_a, doc_b = np.repeat(docs, n_a), np.repeat(docs, n_b)
    # Offsets run on from document to document, the same on both sides as both tile the same bytes.
    end_a, end_b = np.cumsum(a_side.lengths[a]), np.cumsum(b_side.lengths[b])
    start_a, start_b = end_a - a_side.lengths[a], end_b - b_side.lengths[b]
    over_a = _covering(start_a, doc_a, start_b, doc_b)
    over_b = _covering(start_b, doc_b, start_a, doc_a)
    new = start_b != start_a[over_b] if len(b) else np.zeros(0, bool)  # equal starts were found from the other side
    link_a = np.concatenate([np.arange(len(a)), over_b[new]])
    link_b = np.concatenate([over_a, np.flatnonzero(new)])
    order = np.lexsort((link_b, link_a))
    link_a, link_b = link_a[order], link_b[order]
    n_links = np.bincount(doc_a[link_a], minlength=len(texts)) if len(a) else np.zeros(len(texts), np.int64)
    both = _among(end_a, end_b), _among(end_b, end_a)
    group_a, group_b = (np.cumsum(x) - x for x in both)
    n_groups = np.bincount(doc_a[both[0]], minlength=len(texts)) if len(a) else np.zeros(len(texts), np.int64)
    return Aligned(a, b, n_a, n_b, link_a, link_b, n_links, n_groups, group_a, group_b)


def group_texts(x: Aligned, a_side: Side, b_side: Side) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every document."""
    total = int(x.n_groups.sum())
    last_a = np.append(x.group_a[1:] != x.group_a[:-1], True) if len(x.a) else np.zeros(0, bool)
    last_b = np.append(x.group_b[1:] != x.group_b[:-1], True) if len(x.b) else np.zeros(0, bool)
    before_b = np.concatenate([[0], np.cumsum(np.bincount(x.group_b, minlength=total))])
    before_a = np.concatenate([[0], np.cumsum(np.bincount(x.group_a, minlength=total))])
    words = np.empty(len(x.a) + len(x.b), object)
    words[np.arange(len(x.a)) + before_b[x.group_a]] = [a_side.words[i] for i in (2 * x.a + last_a).tolist()]
    words[np.arange(len(x.b)) + before_a[x.group_b + 1]] = [b_side.words[i] for i in (2 * x.b + last_b).tolist()]
    ends = np.cumsum(x.n_a + x.n_b).tolist()
    words = words.tolist()
    return [b"".join(words[s:e])[:-1] for s, e in zip([0, *ends], ends, strict=False)]


def _chunks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    size = frame["text"].str.len().fillna(0).to_numpy(np.int64)
    # A chunk ends before the document that would bring it over the bound.
    held, first = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > CHUNK_CHARS:
            yield frame.iloc[first:i]
            held, first = 0, i
        held += n
    yield frame.iloc[first:]


def _texts(frame: pd.DataFrame) -> list[str | None]:
    return [t if isinstance(t, str) else None for t in frame["text"]]


def groups(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, groups) of every row: the aligned groups of ids, ``a1,a2|b1;a3|b2,b3``; '' without tokens."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_side, b_side = sides(path_a, path_b)
        for batch in batches:
            for part in _chunks(batch) if len(batch) else ():
                found = group_texts(align_texts(_texts(part), a_side, b_side), a_side, b_side)
                yield pd.DataFrame({"doc_id": part["doc_id"], "groups": [g.decode() for g in found]})

    rows_of = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows_of.mapInPandas(rows, f"doc_id {dict(docs.dtypes)[doc_id]}, groups string")


def chunk_rows(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One stored row per chunk of documents: what is known of each, its links, and the distinct pairs they are of."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_side, b_side = sides(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _chunks(batch) if len(batch) else ():
                x = align_texts(_texts(part), a_side, b_side)
                pair, link, times = np.unique(x.a[x.link_a] << WORD | x.b[x.link_b], return_inverse=True, return_counts=True)
                shas = [hashlib.sha256(g).hexdigest() if g else "" for g in group_texts(x, a_side, b_side)]
                # The order of a document's links does not matter; sorted, their gaps are small and pack well.
                doc = np.repeat(np.arange(len(part)), x.n_links)
                gaps = np.diff(np.sort(doc << WORD | link) & ((1 << WORD) - 1), prepend=0)
                packed = zstandard.compress(gaps.astype("<i4").reshape(-1, 1).view(np.uint8).T.tobytes(), 3)
                row = {
                    "chunk": chunk, "ids": part["doc_id"].to_numpy(object), "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.n_groups,
                    "n_links": x.n_links, "groups_sha256": shas, "pairs": pair, "times": times, "links": packed,
                }
                yield pd.DataFrame({c: pd.Series([v], dtype=object if c != "chunk" else None) for c, v in row.items()})
                chunk += 1

    kind = dict(docs.dtypes)[doc_id]
    counts = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = f"chunk long, ids array<{kind}>, {counts}, groups_sha256 array<string>, pairs array<long>, times array<long>, links binary"
    rows_of = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return settle(rows_of.mapInPandas(rows, schema))


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, n, best): links of every id pair in the corpus, and whether no pair of its second id has more."""
    listed = chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    counts = settle(listed.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")))
    second = F.col("pair").bitwiseAND(F.lit((1 << WORD) - 1))
    most = counts.groupBy(second.alias("_b")).agg(F.max("n").alias("_most"))  # a row per id of the second side
    marked = counts.join(F.broadcast(most), second == F.col("_b"))
    # Stored, so that its measured size decides how it is joined.
    return settle(marked.select("pair", "n", (F.col("n") == F.col("_most")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    Side A gets the text with a space before it, side B adds one itself. n_best counts the links whose id pair is as
    frequent in the corpus as any of its B id, count_sum adds up the pairs' counts over the links. NULL and empty texts,
    and texts that a side does not give back byte for byte, have no tokens: zeros, and '' for the digest. Repeated rows
    each have their row and count each in the corpus; NULL ids stay NULL; an empty table gives no rows.
    """
    chunks = chunk_rows(docs, path_a, path_b, doc_id, text)
    at = chunks.select("chunk", F.posexplode("pairs").alias("at", "pair"))
    known = at.join(pair_counts(chunks), "pair").groupBy("chunk").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "best"))).alias("known")
    )
    placed = chunks.drop("pairs", "times").join(
        known.select("chunk", F.col("known.n").alias("n"), F.col("known.best").alias("best")), "chunk", "left"
    )

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                sums = np.zeros((2, len(r.ids)), np.int64)
                planes = np.frombuffer(zstandard.decompress(r.links), np.uint8).reshape(4, -1)
                links = np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int64)
                if len(links):
                    values = np.stack([np.asarray(r.best).astype(np.int64), np.asarray(r.n, np.int64)])
                    upto = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values[:, links], axis=1)], axis=1)
                    ends = np.cumsum(r.n_links)
                    sums = upto[:, ends] - upto[:, ends - r.n_links]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.Series(r.ids, dtype=object), "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": r.n_links,
                        "n_best": sums[0], "count_sum": sums[1], "groups_sha256": r.groups_sha256,
                    }
                )

    counts = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return placed.mapInPandas(rows, f"doc_id {dict(docs.dtypes)[doc_id]}, {counts}, groups_sha256 string")
