"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items lie inside long documents, so the resemblance of whole texts says nothing. Items are partitioned
by their number of shingles into classes of doubling size. For each class the documents are cut into windows as
wide as the largest item of the class; the minimum of a window under a permutation is the minimum of the minima of
its halves, so one pass over the shingles serves all classes. A window with a minimum in common with an item
names a candidate, which is verified by counting the item's shingles in the whole document: both steps are joins.

Items of at most ``LEAST`` shingles resemble no window enough; they are exact: in the same pass every shingle of a
document is looked up among theirs, and one in common names a candidate.

Of longer items, a whole copy has a resemblance of at least 0.2 with each of the two windows it lies in, so with 32
permutations less than one in a million is missed. Of an item with 80 % of its shingles in a document, up to 2 in
100,000 are missed if these lie in two windows, and up to 2 in 10,000 if each lies in a window of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import KEY, identified
from samplewright.session import settle

WORD = re.compile(r"[^\W_]+")
SHINGLE = 5
PERMUTATIONS = 32
LEAST = 8  # width of the smallest windows; items of no more shingles are looked up exactly
CHUNK = 1 << 18  # shingles permuted at a time
EXACT, ALL = 0, -1  # widths that stand for the shingles of short items, and of all items
MINIMUM_BITS, SHINGLE_BITS = 18, 22  # size of a bitmap, as a power of two
MEMO = 200_000

_draw = np.random.default_rng(11)
MULTIPLIERS = _draw.integers(1, 1 << 62, PERMUTATIONS, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
ADDENDS = _draw.integers(1, 1 << 62, PERMUTATIONS, np.int64).astype(np.uint64)
PLACES = _draw.integers(1, 1 << 62, SHINGLE, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Memo(dict):
    def __missing__(self, w: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        found = self[w] = xxhash.xxh64_digest(w, 5)
        return found


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _shingle_hashes(tokens: list[str], memo: _Memo) -> np.ndarray:
    h = np.frombuffer(b"".join(map(memo.__getitem__, tokens)), np.uint64)
    n = len(h) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = sum(h[j : j + n] * PLACES[j] for j in range(SHINGLE))
    return mixed ^ (mixed >> np.uint64(29))


@dataclass
class Filters:
    """Which keys of items exist, as two bitmaps for each (width, permutation): of the first bits of a key and of the next.

    A width of ``EXACT`` holds the shingles of items of at most ``LEAST`` shingles, ``ALL`` those of every item. The size of
    the bitmaps does not depend on the number of items; with more items more keys pass, and the joins decide.
    """

    packed: dict[tuple[int, int], list[bytes]]

    def __post_init__(self) -> None:
        self.maps: dict[tuple[int, int], list[np.ndarray]] = {}
        self.widths = sorted({w for w, _ in self.packed if w > 0})

    def __reduce__(self) -> tuple:
        return Filters, (self.packed,)

    def passing(self, width: int, permutation: int, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that an item may have."""
        at = (width, permutation)
        if at not in self.packed:
            return np.empty(0, np.int64)
        if at not in self.maps:
            self.maps[at] = [np.unpackbits(np.frombuffer(x, np.uint8)).view(bool) for x in self.packed[at]]
        first, second = self.maps[at]
        bits = _filter_bits(width)
        found = np.flatnonzero(first[keys >> np.uint64(64 - bits)])
        rest = (keys[found] >> np.uint64(64 - 2 * bits)) & np.uint64((1 << bits) - 1)
        return found[second[rest]]

    def document_keys(self, docs: list[np.ndarray]) -> pd.DataFrame:
        """(doc, width, permutation, key) that an item may have too; doc is the place in the list of shingle hashes."""
        parts = [(np.empty(0, np.int64), 0, 0, np.empty(0, np.uint64))]
        full = [i for i, d in enumerate(docs) if len(d)]
        if full:
            hashes, lengths = np.concatenate([docs[i] for i in full]), np.array([len(docs[i]) for i in full])
            at = self.passing(EXACT, 0, hashes)
            parts.append((np.searchsorted(np.cumsum(lengths), at, side="right"), EXACT, 0, hashes[at]))
            if self.widths:
                parts += self._window_keys(hashes, lengths)
        out = pd.DataFrame(
            {
                "doc": np.concatenate([p[0] for p in parts]),
                "width": np.repeat([p[1] for p in parts], [len(p[0]) for p in parts]),
                "permutation": np.repeat([p[2] for p in parts], [len(p[0]) for p in parts]),
                "key": np.concatenate([p[3] for p in parts]).view(np.int64),
            }
        ).drop_duplicates()
        return out.assign(doc=np.array(full, np.int64)[out["doc"]] if full else out["doc"])

    def _window_keys(self, hashes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple]:
        tiles = -(-lengths // LEAST)
        begin = np.repeat(np.cumsum(lengths) - lengths, tiles)
        within = np.arange(tiles.sum()) - np.repeat(np.cumsum(tiles) - tiles, tiles)
        starts, owner = begin + within * LEAST, np.repeat(np.arange(len(lengths)), tiles)
        for i in range(PERMUTATIONS):
            low, own, at, width = np.minimum.reduceat(hashes * MULTIPLIERS[i] + ADDENDS[i], starts), owner, within, LEAST
            while True:
                passed = self.passing(width, i, low)
                yield own[passed], width, i, low[passed]
                if width >= self.widths[-1]:
                    break
                heads = np.flatnonzero(at % 2 == 0)
                low, own, at, width = np.minimum.reduceat(low, heads), own[heads], at[heads] // 2, width * 2


def _filter_bits(width: int) -> int:
    return MINIMUM_BITS if width > 0 else SHINGLE_BITS


def _grams(tokens: list[str]) -> list[str]:
    return [" ".join(x) for x in zip(*[tokens[j:] for j in range(SHINGLE)], strict=False)]


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Items of at least one shingle, by their words."""
    for batch in batches:
        tokens = [words(t) for t in batch["text"]]
        long_enough = [len(w) >= SHINGLE for w in tokens]
        kept = [" ".join(w) for w, ok in zip(tokens, long_enough, strict=True) if ok]
        yield pd.DataFrame({"item": batch["item"][long_enough].to_numpy(), "body": pd.Series(kept, dtype=object)})


def _in_chunks(rows: Iterator[list[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Lists of rows as frames of about ``CHUNK`` rows."""
    held: list[tuple] = []
    for some in rows:
        held += some
        if len(held) >= CHUNK:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different shingles of an item and their hashes."""
    memo = _Memo()

    def rows() -> Iterator[list[tuple]]:
        for batch in batches:
            for entry, body in zip(batch["entry"], batch["body"], strict=True):
                tokens = body.split(" ")
                own = dict(zip(_grams(tokens), _shingle_hashes(tokens, memo).view(np.int64).tolist(), strict=True))
                yield [(entry, len(own), gram, key) for gram, key in own.items()]

    return _in_chunks(rows(), ["entry", "n_item", "gram", "key"])


def _minima(tokens: list[str], memo: _Memo) -> tuple[int, np.ndarray] | None:
    """The class of an item by its number of shingles, and its minimum under each permutation; none if it is short."""
    n, width = len(set(_grams(tokens))), LEAST
    if n <= LEAST:
        return None
    while width < n:
        width *= 2
    h = _shingle_hashes(tokens, memo)
    return width, np.array([(h * m + a).min() for m, a in zip(MULTIPLIERS, ADDENDS, strict=True)], np.uint64)


def _item_minima(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = _Memo()

    def rows() -> Iterator[list[tuple]]:
        for batch in batches:
            for entry, body in zip(batch["entry"], batch["body"], strict=True):
                found = _minima(body.split(" "), memo)
                if found:
                    yield [(entry, found[0], i, key) for i, key in enumerate(found[1].view(np.int64).tolist())]

    return _in_chunks(rows(), ["entry", "width", "permutation", "key"])


def _bitmap(cells: pd.DataFrame) -> pd.DataFrame:
    width, permutation, probe = (int(x) for x in cells.iloc[0][["width", "permutation", "probe"]])
    bits = np.zeros(1 << _filter_bits(width), bool)
    bits[cells["cell"].to_numpy()] = True
    return pd.DataFrame({"width": [width], "permutation": [permutation], "probe": [probe], "bits": [np.packbits(bits).tobytes()]})


def item_filters(keys: DataFrame) -> Filters:
    """Bitmaps of (width, permutation, key), made of their different cells, of which there is a fixed number."""
    bits = F.when(F.col("width") > 0, MINIMUM_BITS).otherwise(SHINGLE_BITS)
    cell = lambda bits, probe: F.shiftrightunsigned("key", 64 - bits * (probe + 1)).bitwiseAND((1 << bits) - 1)
    probes = F.array(
        *[
            F.struct(
                F.lit(p).alias("probe"), F.when(bits == MINIMUM_BITS, cell(MINIMUM_BITS, p)).otherwise(cell(SHINGLE_BITS, p)).alias("cell")
            )
            for p in (0, 1)
        ]
    )
    cells = keys.select("width", "permutation", F.explode(probes).alias("x")).select("width", "permutation", "x.*").distinct()
    maps = cells.groupBy("width", "permutation", "probe").applyInPandas(_bitmap, "width int, permutation int, probe int, bits binary")
    packed: dict[tuple[int, int], list[bytes]] = {}
    for r in sorted(maps.collect(), key=lambda r: r.probe):
        packed.setdefault((r.width, r.permutation), []).append(bytes(r.bits))
    return Filters(packed)


def _document_keys(filters: Filters, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo = _Memo()

    def keys(ids: list[int], hashes: list[np.ndarray]) -> pd.DataFrame:
        found = filters.document_keys(hashes)
        return found.assign(doc=np.array(ids, np.int64)[found["doc"]])

    for batch in batches:
        ids, hashes, held = [], [], 0
        for doc, text in zip(batch["doc"], batch["text"], strict=True):
            ids.append(doc)
            hashes.append(_shingle_hashes(words(text), memo))
            held += len(hashes[-1])
            if held >= CHUNK:
                yield keys(ids, hashes)
                ids, hashes, held = [], [], 0
        if ids:
            yield keys(ids, hashes)


def _document_grams(filters: Filters, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The different shingles of a document that an item may have."""
    memo = _Memo()

    def rows() -> Iterator[list[tuple]]:
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"], strict=True):
                tokens = words(text)
                at = filters.passing(ALL, 0, _shingle_hashes(tokens, memo)).tolist()
                yield [(doc, gram) for gram in {" ".join(tokens[i : i + SHINGLE]) for i in at}]

    return _in_chunks(rows(), ["doc", "gram"])


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = 0.8,
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): items with at least ``threshold`` of their shingles in a document.

    A shingle is five words (letters and digits, lower case); n_item counts an item's different shingles. Ids keep their
    types. NULL, empty and shorter items are contained in nothing, NULL and empty texts contain nothing; rows without a
    document or item id are passed over. A repeated id gives a row for each of its rows.

    The keys of items are a table. Tasks see bitmaps of them only; what passes is joined to the table by (width,
    permutation, key), and the pairs found to the shingles of both sides. One pass over the documents finds the
    pairs, a second one reads the documents of pairs.
    """
    spark = docs.sparkSession
    keyed = identified(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    tests = identified(items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "item_id")
    texts = keyed.select(F.col(KEY).alias("doc"), F.col("row.text").cast("string").alias("text")).dropna()

    # Items with the same words are one entry.
    bodies = tests.select(F.col(KEY).alias("item"), F.col("row.text").cast("string").alias("text")).dropna()
    bodies = bodies.mapInPandas(_bodies, "item long, body string")
    bodies = settle(bodies.withColumn("digest", F.sha2("body", 256)))
    first = bodies.groupBy("digest").agg(F.min(F.struct("item", "body")).alias("x"))
    entries = settle(first.select("digest", F.col("x.item").alias("entry"), "x.body"))
    grams = settle(entries.select("entry", "body").mapInPandas(_item_grams, "entry long, n_item long, gram string, key long"))
    minima = entries.select("entry", "body").mapInPandas(_item_minima, "entry long, width int, permutation int, key long")
    short = grams.filter(F.col("n_item") <= LEAST).select("entry", F.lit(EXACT).alias("width"), F.lit(0).alias("permutation"), "key")
    keys = settle(minima.union(short))
    every = grams.select(F.lit(ALL).alias("width"), F.lit(0).alias("permutation"), "key")
    sent = spark.sparkContext.broadcast(item_filters(keys.drop("entry").union(every)))

    seen = texts.mapInPandas(lambda batches: _document_keys(sent.value, batches), "doc long, width int, permutation int, key long")
    pairs = settle(seen.join(keys, ["width", "permutation", "key"]).select("doc", "entry").distinct())
    again = texts.join(settle(pairs.select("doc").distinct()), "doc", "left_semi")
    have = again.mapInPandas(lambda batches: _document_grams(sent.value, batches), "doc long, gram string")
    want = pairs.join(grams.select("entry", "n_item", "gram"), "entry")
    counted = want.join(have, ["doc", "gram"]).groupBy("doc", "entry").agg(F.first("n_item").alias("n_item"), F.count(F.lit(1)).alias("n_shared"))
    found = settle(counted.filter(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9))

    members = bodies.select("item", "digest").join(entries.select("digest", "entry"), "digest").select("item", "entry")
    ids = keyed.select(F.col(KEY).alias("doc"), "row.doc_id")
    item_ids = tests.select(F.col(KEY).alias("item"), "row.item_id")
    return (
        found.join(members, "entry")
        .join(item_ids, "item")
        .join(ids, "doc")
        .select("doc_id", "item_id", "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    )
