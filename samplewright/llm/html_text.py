"""Main text of web pages: markup says what a block is, and a suffix array over each host says what pages share.

A page is read as a stream of blocks (the text between two block-level tags). The token of a block is a hash of the host,
the tags before it and its text. The suffixes of all streams of a host are sorted: a suffix is known by its first
``DEPTH`` tokens, equal ones are first collapsed to one row with the smallest and largest page, so a template of a hot
host is one row, and the rest is sorted by ranges of tokens, so that a hot host is spread over all of them.
The common prefix with the nearest suffix of another page, before or after it, is the length of the repeat that starts
there; ranges hand their ends to the next by one row each. Long repeats across distinct pages cover blocks, and every page is
joined with its own.

A block is dropped if its element is no text of an article (menu, header, footer, aside, notice, advert, form, comments),
if the page has a container of its article and the block is outside, or if it has none and a repeat covers the block. Of
a page that is nearly all covered, a copy of another, nothing is dropped as repeated. Passages that articles share stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import KEY, identified
from samplewright.session import scratch, scratch_path, settle, shuffles_removed

DEPTH = 4  # blocks a suffix is sorted by; longer repeats show as overlapping ones
REPEAT_WORDS, REPEAT_BLOCKS = 5, 3  # a repeat is long with so many words, or so many blocks
COPY = 5  # a page with so many times more repeated than other words is a copy

# Elements of the markup language by what they hold.
VOID = set("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = set("script style textarea title xmp noembed noframes iframe plaintext".split())
SILENT = set(
    "head script style title template noscript iframe object svg math canvas audio video map select option datalist "
    "button textarea form fieldset nav footer aside menu dialog menuitem noembed noframes".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup "
    "option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
SILENT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
SILENT_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside rail widget widgets related "
    "recommended recommendations promo promotion ad ads adv advert adverts advertisement advertising sponsor sponsored "
    "banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments disqus reply replies respond pagination pager search toolbar skip "
    "copyright".split()
)
ARTICLE_NAMES = set("article articlebody post story entry content main maincontent".split())
ARTICLE_ENDS = set("article articlebody body content text main maincontent post story entry".split())
# What an open element is closed by, if its own end is missing: tags that start a sibling.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "p": BLOCKS,
}
# An implied end does not reach out of these.
SCOPES = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"},
    "option": {"select"}, "p": set(),
}

PART = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
PLACE_DROPPED, PLACE_ARTICLE, PLACE_OPEN = 0, 1, 2


def _named(value: str) -> list[list[str]]:
    """The words of every class or id name."""
    return [[w.lower() for w in NAME.findall(n)] for n in value.split()]


def _silent(tag: str, attributes: dict[str, str], inside: bool, code: bool) -> bool:
    """Whether an element holds no text of an article. Names inside code are those of its syntax."""
    if tag in SILENT:
        return True
    if "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if attributes.get("role", "").lower() in SILENT_ROLES:
        return True
    if tag == "header" and not inside:
        return True
    if code or tag in ("html", "body", "main"):
        return False
    for words in _named(attributes.get("class", "") + " " + attributes.get("id", "")):
        if words and not {"with", "has", "no"} & set(words) and (words[0] in SILENT_NAMES or words[-1] in SILENT_NAMES):
            return tag not in HEADINGS
    return False


def _rank(tag: str, attributes: dict[str, str]) -> int:
    """How surely an element is the container of an article: 3 the element of that name, 2 the main part, 1 by its name."""
    if tag == "article":
        return 3
    if tag == "main" or attributes.get("role", "").lower() in ("main", "article"):
        return 2
    if attributes.get("itemprop", "").lower() == "articlebody":
        return 3
    if tag in ("div", "section", "td"):
        for words in _named(attributes.get("class", "") + " " + attributes.get("id", "")):
            if words and words[0] in ARTICLE_NAMES and words[-1] in ARTICLE_ENDS:
                return 1
    return 0


def parse(page: str | None, host: str = "") -> list[tuple[str, int, int]]:
    """(text, place, token) of every block with text, in page order; scripts, styles, comments and the head are none.

    A token is a hash of the host, the tags since the block before, and the text.

    Missing and stray ends are put up with: an end closes the nearest open element of its name, an element without an
    end ends with its parent or where a sibling begins.
    """
    page = page or ""
    # Tag, whether its text is dropped (2: inside a block, which goes on around it), rank of the surest container around.
    stack: list[tuple[str, int, int]] = []
    blocks, text, marks = [], [], []
    silent, rank, at, size = 0, 0, 0, len(page)
    ranks = []

    def close() -> None:
        words = "".join(text).split()
        text.clear()
        if words:
            joined = " ".join(words)
            token = xxhash.xxh64_intdigest("\n".join((host, *marks, joined)).encode("utf-8", "replace"), 7)
            blocks.append((joined, silent, token - (1 << 64) if token >= 1 << 63 else token))
            ranks.append(rank)
            marks.clear()

    def pop(to: int) -> None:
        nonlocal silent, rank
        del stack[to:]
        _, silent, rank = stack[-1] if stack else ("", 0, 0)

    while at < size:
        m = PART.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if silent < 2 and not m[0].startswith(("<!", "<?")):
                text.append(html.unescape(m[0]))
            continue
        tag = tag.lower()
        if m[1]:
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if tag in BLOCKS:
                close()
            if k is not None:
                if any(s[0] in BLOCKS for s in stack[k:]):
                    close()
                pop(k)
            continue
        if tag in BLOCKS:
            close()
        for name, siblings in CLOSED_BY.items():
            if tag in siblings:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        close()
                        pop(i)
                        break
                    if stack[i][0] in SCOPES[name] or name == "p" and stack[i][0] in BLOCKS:
                        break
        if tag == "br":
            text.append(" ")
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[3])} if m[3].strip(" /") else {}
        marks.append(f"{tag} {attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}")
        if tag in VOID:
            continue
        if tag in RAW:  # its content is no markup
            end = re.compile(rf"</{tag}\s*/?>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if not silent and _silent(tag, attributes, rank > 0, any(s[0] in ("pre", "code") for s in stack)):
            silent = 1 if tag in BLOCKS else 2
        if not silent:
            rank = max(rank, _rank(tag, attributes))
        stack.append((tag, silent, rank))
    close()
    best = max((r for (_, s, _), r in zip(blocks, ranks, strict=True) if not s), default=0)
    return [
        (t, PLACE_DROPPED if s or r < best else PLACE_ARTICLE if best else PLACE_OPEN, token)
        for (t, s, token), r in zip(blocks, ranks, strict=True)
    ]


def host_of(url: str | None) -> str:
    try:
        return (urlsplit((url or "").strip()).hostname or "").lower()
    except ValueError:
        return ""


def parsed(batch: pd.DataFrame) -> list[list[tuple[str, int, int]]]:
    known = zip(batch["html"], batch["url"], strict=True)
    return [parse(h if isinstance(h, str) else None, host_of(u if isinstance(u, str) else None)) for h, u in known]


def read_blocks(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html and others): the others, and what each page says by itself.

    ``tokens``, ``places`` and ``words`` (how many) are those of all blocks; ``packed`` are the texts of the blocks that
    are not dropped by their place, joined by a line feed (none has one) and compressed, as they go through a shuffle.
    """
    others = [c for c in pages.columns if c not in ("url", "html")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            pages_ = parsed(batch)
            yield batch[others].assign(
                packed=[packer.compress("\n".join(b[0] for b in p if b[1] != PLACE_DROPPED).encode()) for p in pages_],
                places=[[b[1] for b in p] for p in pages_],
                words=[[b[0].count(" ") + 1 for b in p] for p in pages_],
                tokens=[[b[2] for b in p] for p in pages_],
            )

    kinds = dict(pages.dtypes)
    own = "packed binary, places array<tinyint>, words array<int>, tokens array<long>"
    return pages.mapInPandas(rows, ", ".join([*(f"{c} {kinds[c]}" for c in others), own]))


def suffixes(pages: DataFrame) -> DataFrame:
    """(_doc, at, s1 .. sDEPTH): every suffix of every stream of ``pages`` (_doc, and url, html or the tokens of
    ``read_blocks``) by its first tokens, 0 past the end."""
    read = pages if "tokens" in pages.columns else read_blocks(pages)
    first = ", ".join(f"coalesce(get(tokens, i + {k}), 0L) AS s{k + 1}" for k in range(DEPTH))
    return read.select(KEY, F.expr(f"inline(transform(tokens, (t, i) -> struct(i AS at, {first})))"))


def _reach(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each sorted distinct suffix (its tokens; 0 past the end) how many tokens it shares with one of another page.

    A suffix on two pages shares all of its own. Another shares what it has in common with the nearest suffix before or
    after it that is not of the same page alone.
    """
    n = len(key)
    own = (key != 0).sum(axis=1)
    same = np.cumprod(key[1:] == key[:-1], axis=1) if n else np.zeros((0, DEPTH), np.int64)
    common = (same * (key[1:] != 0)).sum(axis=1)
    single = low == high
    best = np.where(single, 0, own)
    for order in (1, -1):
        c = np.concatenate([[0], common]) if order == 1 else np.concatenate([common, [0]])[::-1]
        s, p = single[::order], low[::order]
        reach = c.copy()
        # Neighbours of the same page pass on what they share themselves.
        again = np.flatnonzero(s[1:] & s[:-1] & (p[1:] == p[:-1])) + 1
        for i in again.tolist():
            reach[i] = min(c[i], reach[i - 1])
        best = np.maximum(best, np.minimum(reach[::order], own))
    return best


def repeats(ends: DataFrame) -> DataFrame:
    """(s1 .. sDEPTH, reach) of the suffixes that share tokens with another page of their host.

    Equal suffixes are one row with their smallest and largest page before anything is sorted. Every range of the sort
    is scanned in batches; its first and last rows, up to one of another page, are kept and looked at again together.
    """
    names = [f"s{k}" for k in range(1, DEPTH + 1)]
    distinct = ends.groupBy(*names).agg(F.min(KEY).alias("low"), F.max(KEY).alias("high"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail, first = None, True
        for batch in batches:
            rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            if not len(rows):
                continue
            reach = _reach(rows[names].to_numpy(np.int64), rows["low"].to_numpy(), rows["high"].to_numpy())
            yield rows.assign(reach=reach, edge=False)[reach > 0]
            # Rows at the end stay for the next batch, back to one that is not of the last row's page alone.
            back = _back(rows)
            tail = rows.iloc[back:]
            if first:  # from the first row on to one of another page
                at = _back(rows.iloc[::-1])
                yield rows.iloc[: len(rows) - at].assign(reach=0, edge=True)
                first = at == 0
        if tail is not None:
            yield tail.assign(reach=0, edge=True)

    def _back(rows: pd.DataFrame) -> int:
        """Where the rows begin that a later one may need: the last of another page than the last row's, or of several."""
        low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
        other = np.flatnonzero((low != high) | (low != low[-1]))
        return int(other[-1]) if len(other) else 0

    schema = ", ".join(f"{c} long" for c in [*names, "low", "high", "reach"]) + ", edge boolean"
    ranged = distinct.repartitionByRange(*names).sortWithinPartitions(*names)
    scanned = settle(ranged.mapInPandas(scan, schema))

    def join_edges(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.drop_duplicates(names).sort_values(names, ignore_index=True)
        reach = _reach(rows[names].to_numpy(np.int64), rows["low"].to_numpy(), rows["high"].to_numpy())
        return rows.assign(reach=reach)[reach > 0]

    # Two rows per range of the sort, and the rows beside them that are of the same page alone.
    met = scanned.filter("edge").groupBy().applyInPandas(join_edges, schema).select(*names, "reach")
    inner = scanned.filter("NOT edge").select(*names, "reach")
    return inner.unionByName(met).groupBy(*names).agg(F.max("reach").alias("reach"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """One row per row of ``pages``: (page_id, url, text, n_chars, n_blocks, n_repeated).

    ``text`` is the main text: character references decoded, white space inside a block one blank, blocks in page order
    joined by a line feed; n_repeated of the n_blocks blocks lie in long repeats across pages of the host. NULL and
    empty pages, and pages without an article, have an empty text. Pages without a URL are one host. Repeated rows are
    pages of their own, copies of each other; NULL ids stay; an empty table gives no rows.
    """
    spark, known = pages.sparkSession, dict(pages.dtypes)
    keyed = identified(pages, page_id).select(
        KEY,
        F.col(f"row.{page_id}").alias("page_id"),
        F.col(f"row.{url}").alias("given"),
        F.col(f"row.{url}").cast("string").alias("url"),
        F.col(f"row.{html_column}").cast("string").alias("html"),
    )
    # Stored, as the order, the way back to the pages and the texts need it, and reading the markup is most of the work.
    path = scratch_path(spark)
    blocks = read_blocks(keyed)
    blocks.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(blocks.schema).parquet(path)
    ends = suffixes(read)
    mark = F.xxhash64(*[f"s{k}" for k in range(1, DEPTH + 1)]).alias("mark")
    # Stored, so that the join has plain shuffles on both sides and a suffix of many pages is split.
    with scratch(spark) as own, shuffles_removed(spark):
        found = settle(repeats(ends).select(mark, "reach"))
        # Stored, so that the order and its shuffles are gone when the texts move.
        starts = own.keep(
            ends.select(KEY, "at", mark).join(found, "mark").groupBy(KEY).agg(
                F.sort_array(F.collect_list(F.struct("at", "reach"))).alias("starts")
            )
        )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = zip(batch["packed"], batch["words"], batch["places"], batch["starts"], strict=True)
            out = [main_text(unpacker.decompress(t).decode(), w, p, s) for t, w, p, s in rows]
            yield batch[["page_id", "given"]].assign(text=[o[0] for o in out], n_blocks=[o[1] for o in out], n_repeated=[o[2] for o in out])

    # By the same plan at every size, so that figures of small tables hold for large ones.
    joined = read.join(starts.hint("merge"), KEY, "left").select("page_id", "given", "packed", "words", "places", "starts")
    texts = joined.mapInPandas(decide, f"page_id {known[page_id]}, given {known[url]}, text string, n_blocks long, n_repeated long")
    return texts.select(
        "page_id", F.col("given").alias("url"), "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_repeated"
    )


def main_text(kept: str, words: list[int], places: list[int], starts: list | None) -> tuple[str, int, int]:
    """The text of a page from the lines of its ``kept`` blocks, those not dropped by their place, the words and places of
    all, and the repeats (at, blocks) on it; how many blocks, and how many repeated."""
    n = len(places)
    words = np.asarray(words, np.int64)
    step, upto = np.zeros(n + 1, np.int64), np.concatenate([[0], np.cumsum(words)])
    for s in starts if starts is not None else ():
        first, last = s["at"], s["at"] + s["reach"]
        if s["reach"] >= REPEAT_BLOCKS or upto[last] - upto[first] >= REPEAT_WORDS:
            step[first] += 1
            step[last] -= 1
    covered = np.cumsum(step[:-1]) > 0
    place = np.asarray(places, np.int64)
    open_ = place == PLACE_OPEN
    if words[open_ & covered].sum() > COPY * words[open_ & ~covered].sum():
        open_ = np.zeros(n, bool)  # a copy of another page: what is repeated is its text
    dropped = place == PLACE_DROPPED
    if (open_ & covered).any():
        keep = ~(open_ & covered)[~dropped]
        kept = "\n".join(t for t, k in zip(kept.split("\n"), keep.tolist(), strict=True) if k)
    return kept, n, int(covered.sum())
