"""Problem 3: cutting oversized items at natural boundaries.

Every place in an item has a boundary strength. A sparse table over (strength, place) answers the
strongest place in any window in constant time, the rightmost of equals. Each piece ends at the
strongest place of the permissible window, and the next one steps back by the overlap.

Defined results: items that are null or not longer than their limit give no pieces; an item's
pieces are numbered from 0, none is longer than the limit, each shares exactly the overlap with
the piece before, and without the overlaps they join to the item; an item without any natural
place is cut at the limit, or before the placeholder or marked letter that lies there; repeated items give their pieces once; extra columns are ignored;
items of any length are cut whole, the table being made for one block of an item at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast

PIECE_SCHEMA = "item_kind string, owner_id string, item_idx int, piece_no int, start_pos long, end_pos long, n_pieces int, strength int, text string"
ARROW_SCHEMA = pa.schema([("item_kind", pa.string()), ("owner_id", pa.string()), ("item_idx", pa.int32()), ("piece_no", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("n_pieces", pa.int32()), ("strength", pa.int32()), ("text", pa.string())])

# Strengths of a cut right after a character, weakest first.
WORD, CLAUSE, SENTENCE, LINE, BLOCK = 1, 2, 3, 4, 5
SPACES = [9, 11, 12, 32, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
CLAUSE_ENDS = [ord(c) for c in ",;:)]}|，；：、）،؛"]
SENTENCE_ENDS = [ord(c) for c in ".!?।॥。！？۔؟…"]
QUOTES = [ord(c) for c in "\"'”’»)]"]
IDEOGRAPH_ENDS = [ord(c) for c in "。！？；，、"]  # followed by no space
# Fixed value: how placeholders are written. A lone section sign is none.
PLACEHOLDER = re.compile(r"§[A-Z]+:[^§\s]+§")
BLOCK_ROWS = 1 << 18


def in_placeholder(cp: np.ndarray) -> np.ndarray:
    """For each place k from 0 to len(cp) whether a cut between k - 1 and k would part a placeholder."""
    out = np.zeros(len(cp) + 1, bool)
    if (cp == 0xA7).any():
        for m in PLACEHOLDER.finditer(cp.tobytes().decode("utf-32-le")):
            out[m.start() + 1 : m.end()] = True
    return out


def strengths(cp: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """For each place k from 0 to len(cp) the strength of a cut between k - 1 and k. 0: no natural place. kept: places inside placeholders, if they are known."""
    n = len(cp)
    out = np.zeros(n + 1, np.int8)
    if n == 0:
        return out
    space, nl = np.isin(cp, SPACES), cp == 10
    blank = space | nl
    begins = np.zeros(n + 1, bool)  # a word begins at k after white space
    begins[1:n] = blank[:-1] & ~blank[1:]
    begins[n] = True
    out[begins] = WORD
    # the last character before the white space that ends at k, looking through closing quotes
    at = np.arange(n)
    solid = np.maximum.accumulate(np.where(~blank, at, -1))
    core = np.maximum.accumulate(np.where(~blank & ~np.isin(cp, QUOTES), at, -1))
    k = np.flatnonzero(begins)
    last, inner = solid[k - 1], core[k - 1]
    ok = last >= 0
    out[k[ok & np.isin(cp[np.maximum(last, 0)], CLAUSE_ENDS)]] = CLAUSE
    ends = (inner >= 0) & (last - inner <= 3) & np.isin(cp[np.maximum(inner, 0)], SENTENCE_ENDS)
    out[k[ends]] = SENTENCE
    tight = np.flatnonzero(np.isin(cp[: n - 1], IDEOGRAPH_ENDS) & ~blank[1:]) + 1 if n > 1 else np.zeros(0, int)
    out[tight] = np.maximum(out[tight], np.where(np.isin(cp[tight - 1], SENTENCE_ENDS), SENTENCE, CLAUSE))
    # lines and blocks: white space with one or more line ends
    lines = np.concatenate([[0], np.cumsum(nl)])
    count = lines[k] - lines[np.where(ok, last + 1, 0)]
    out[k[count == 1]] = LINE
    out[k[count > 1]] = BLOCK
    out[in_placeholder(cp) if kept is None else kept] = 0
    return out


class StrongestCut:
    """Sparse table of range maxima over (strength, place): the strongest place of a window, the rightmost of equals."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.key = strength.astype(np.int64) << 40 | np.arange(len(strength))
        self.levels = [self.key]
        width = 1
        while width * 2 <= min(widest, len(strength)):
            a = self.levels[-1]
            self.levels.append(np.maximum(a[:-width], a[width:]))
            width *= 2

    def query(self, low: int, high: int) -> tuple[int, int]:
        """(place, strength) for low <= place <= high; the window may be as wide as the table was made for."""
        k = min((high - low + 1).bit_length() - 1, len(self.levels) - 1)
        best = max(self.levels[k][low], self.levels[k][high - (1 << k) + 1])
        if (1 << k) * 2 < high - low + 1:  # wider than the levels: walk
            best = max(int(self.levels[k][i]) for i in [*range(low, high - (1 << k) + 2, 1 << k), high - (1 << k) + 1])
        return int(best) & ((1 << 40) - 1), int(best) >> 40


def cut(cp: np.ndarray, max_chars: int, overlap: int, fill: float = 0.5) -> list[tuple[int, int, int]]:
    """(start, end, strength of the end) of each piece. A piece has at least fill of its limit where that allows a natural cut."""
    n = len(cp)
    if max_chars < 1 or overlap < 0 or overlap >= max_chars:
        raise ValueError("the limit must be at least 1, the overlap from 0 to below the limit")
    if n <= max_chars:
        return [(0, n, BLOCK)]
    out, start = [], 0
    block = max(BLOCK_ROWS, 4 * max_chars)
    table, origin, kept = None, 0, in_placeholder(cp)
    while n - start > max_chars:
        if table is None or start + max_chars > origin + block:
            origin = start
            back = max(0, origin - 64)  # what comes before decides the first strengths
            stop = min(n, origin + block + 64)
            s = strengths(cp[back:stop], kept[back : stop + 1])[origin - back :]
            table = StrongestCut(s, max_chars)
        low, high = start + max(overlap + 1, int(max_chars * fill)), start + max_chars
        at, power = table.query(low - origin, high - origin)
        if power == 0 and start + overlap + 1 < low:
            at, power = table.query(start + overlap + 1 - origin, high - origin)
        end = at + origin if power else _hard_cut(cp, kept, start + overlap + 1, high)
        out.append((start, end, power))
        start = end - overlap
    out.append((start, n, BLOCK))
    return out


def _hard_cut(cp: np.ndarray, kept: np.ndarray, low: int, high: int) -> int:
    """The last place up to high, and from low on, that parts neither a placeholder nor a mark or joiner from its letter; high if there is none."""
    k = high
    while k >= low and (kept[k] or _joined(cp, k)):
        k -= 1
    return k if k >= low else high


def _joined(cp: np.ndarray, k: int) -> bool:
    """A cut before k would part a mark or joiner from its letter."""
    c = int(cp[k])
    return c >= 0x300 and (c in (0x200C, 0x200D) or unicodedata.category(chr(c))[0] == "M" or int(cp[k - 1]) == 0x200D)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for kind, owner, idx, text, most, over in zip(*(c.to_pylist() for c in batch.columns)):
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        spans = cut(cp, most, over)
        m = len(spans)
        yield pa.RecordBatch.from_arrays([
            pa.array([kind] * m), pa.array([owner] * m, pa.string()), pa.array([idx] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([a for a, _, _ in spans], pa.int64()), pa.array([b for _, b, _ in spans], pa.int64()), pa.array([m] * m, pa.int32()), pa.array([p for _, _, p in spans], pa.int32()),
            pa.array([text[a:b] for a, b, _ in spans], pa.string()),
        ], schema=ARROW_SCHEMA)


def _cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from _pieces(b)


def split_oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of the items(item_kind, owner_id, item_idx, text) longer than max_chars of limits(item_kind, max_chars, overlap_chars).

    Spark drops what isn't too long before Python sees it; nothing is shuffled but the pieces'
    keys, to drop repeated deliveries.
    """
    lim = limits.where("item_kind IS NOT NULL AND max_chars >= 1").groupBy("item_kind").agg(F.min("max_chars").cast("int").alias("max_chars"), F.min_by("overlap_chars", F.struct("max_chars", "overlap_chars")).cast("int").alias("overlap_chars"))
    d = items.select("item_kind", F.col("owner_id").cast("string").alias("owner_id"), F.col("item_idx").cast("int").alias("item_idx"), "text").join(checked_broadcast(lim), "item_kind")
    d = d.where(F.length("text") > F.col("max_chars")).select("item_kind", "owner_id", "item_idx", "text", "max_chars", F.least(F.greatest(F.coalesce("overlap_chars", F.lit(0)), F.lit(0)), F.col("max_chars") - 1).alias("overlap_chars"))
    return d.mapInArrow(_cut_all, PIECE_SCHEMA)


def once(pieces: DataFrame) -> DataFrame:
    """The pieces without those of repeated deliveries."""
    return pieces.dropDuplicates(["item_kind", "owner_id", "item_idx", "piece_no"])


def items_of(paragraphs: DataFrame, context_cache: DataFrame) -> DataFrame:
    """Paragraphs and cached batches as items."""
    p = paragraphs.select(F.lit("paragraph").alias("item_kind"), F.col("doc_id").alias("owner_id"), F.col("para_idx").alias("item_idx"), "text")
    c = context_cache.select(F.lit("context").alias("item_kind"), F.col("session_id").alias("owner_id"), F.col("batch_num").alias("item_idx"), F.col("content").alias("text"))
    return p.unionByName(c)
