"""Problem 6: evaluation passages that leaked into the corpus.

Prefix-filtered set join on shingles of five words. A pass over all documents keeps, for each
document, the places of shingles that occur in any item. The number of documents that hold a
shingle, counted over the whole corpus, orders every item's shingles by rarity. As many of the most
common ones as together cover fewer of the item's words than a case must are left out; a document
that holds a case shares one of the rest, the item's prefix, so only those are joined, and a phrase
that many items have in common joins none of them. Pairs that pass the bounds on length and number
are verified exactly: their shingles' places are intersected, and over windows of the document of
about the item's size it is found what share of the item's words stands in common shingles.

A case is a part of two fifths of the item's words, even with words changed or sentences in
another order, so the measure is a containment, COVER = 0.32: two fifths less what light edits
break. (A similarity of 0.8 of whole texts would miss it.)

Defined results: null and empty texts hold nothing; an item shorter than a shingle can't be found;
an item that occurs in several documents is found in each; a repeated document or item counts
once; ties in rarity are ordered by the shingle; texts of any length are searched whole; empty
tables give an empty result; extra columns are ignored. Case, punctuation and look-alike
characters make no difference.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import checked_broadcast
from .lookalike import consistent_array, consistent_text
from .shared import cut_lineage

SHINGLE = 5
COVER = 0.32  # least share of the item's words that common shingles cover within a window
WINDOW = 1.25  # a window's length, in lengths of the item
MAX_ITEM_CHARS = 10_000_000  # up to here, 5 million words at most, the items' words are broadcast; beyond, shingles are joined by shuffle
WORD, ASCII_WORD = regex.compile(r"[\p{L}\p{N}\p{M}_]+"), re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Runs of letters, numbers, marks and low lines, in lower case."""
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


class ItemIndex:
    """Words and shingles of all items as numbers, exact for any number of words.

    The first k words of all shingles are numbered level by level: a number of k - 1 words and the
    next word make a key, its rank among the level's keys is the number of the k words.
    """

    def __init__(self, texts: list[list[str]]):
        self.word_id: dict[str, int] = {}
        keys = [np.array([self.word_id.setdefault(x, len(self.word_id)) for x in w], np.int64) for w in texts]
        self.base = max(len(self.word_id), 1)
        flat = np.concatenate([np.zeros(0, np.int64), *keys])
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        n = max(len(flat) - SHINGLE + 1, 0)
        inside = row[:n] == row[SHINGLE - 1 :][:n]
        at = np.flatnonzero(inside)
        number = flat[at]
        self.levels = []
        for k in range(1, SHINGLE):
            level, number = np.unique(number * self.base + flat[at + k], return_inverse=True)
            self.levels.append(level)
        self.of_item = np.split(number, np.searchsorted(row[at], np.arange(1, len(keys)))) if keys else []

    def shingles(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the item shingles in a row of word numbers, of which -1 is an unknown word."""
        n = max(len(ids) - SHINGLE + 1, 0)
        at = np.flatnonzero(ids[:n] >= 0)
        number = ids[at]
        for k, level in enumerate(self.levels, 1):
            key = number * self.base + ids[at + k]
            i = np.minimum(np.searchsorted(level, key), max(len(level) - 1, 0))
            ok = (level[i] == key) & (ids[at + k] >= 0) if len(level) else np.zeros(len(at), bool)
            at, number = at[ok], i[ok]
        return at, number


HITS = "doc_id long, n_words int, pos array<int>, sh array<long>"
HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int32()), ("pos", pa.list_(pa.int32())), ("sh", pa.list_(pa.int64()))])


def find_hits(index: ItemIndex, doc_id: pa.Array, text: pa.Array, size: int = 500) -> Iterator[pa.RecordBatch]:
    """Places of item shingles in a batch of texts."""
    get = index.word_id.get
    for o in range(0, len(text), size):
        part = consistent_array(text.slice(o, size))
        lists = [words(t) for t in part.to_pylist()]
        n = np.array([len(w) for w in lists])
        if not n.sum():
            continue
        ids = np.fromiter((get(x, -1) for w in lists for x in w), np.int64, n.sum())
        at, i = index.shingles(ids)
        row = np.repeat(np.arange(len(n)), n)
        start = np.concatenate([[0], np.cumsum(n)])
        hit = row[at] == row[at + SHINGLE - 1]
        at, i = at[hit], i[hit]
        if len(at) == 0:
            continue
        r = row[at]
        docs, first = np.unique(r, return_index=True)
        off = pa.array(np.concatenate([first, [len(r)]]), pa.int32())
        pos = pa.ListArray.from_arrays(off, pa.array(at - start[r], pa.int32()))
        yield pa.RecordBatch.from_arrays([doc_id.slice(o, size).take(pa.array(docs)), pa.array(n[docs], pa.int32()), pos, pa.ListArray.from_arrays(off, pa.array(i, pa.int64()))], schema=HITS_ARROW)


def _hits(documents: DataFrame, index: ItemIndex) -> DataFrame:
    spark = documents.sparkSession
    packed = spark.sparkContext.broadcast(pickle.dumps(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = pickle.loads(packed.value)
        for b in batches:
            yield from find_hits(ix, b.column(0), b.column(1))

    d = documents.where("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, HITS)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _shingle_texts(text: pd.Series) -> pd.Series:
    lists = [words(t) for t in text]
    return pd.Series([[" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)] for w in lists])


def _by_shuffle(documents: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits and item shingles for item sets too large to broadcast: all shingles of both sides, joined on their text, which is numbered once."""

    def shingled(df: DataFrame, key: str) -> DataFrame:
        d = df.where(f"{key} IS NOT NULL AND length(text) > 0").select(key, _shingle_texts(consistent_text(F.col("text"))).alias("s")).where("size(s) > 0")
        return d.select(key, (F.size("s") + SHINGLE - 1).alias("n_words"), F.posexplode("s").alias("pos", "s"))

    it = cut_lineage(shingled(items.dropDuplicates(["item_id"]), "item_id"))
    name = cut_lineage(it.select("s").distinct().withColumn("sh", F.monotonically_increasing_id()))
    docs = shingled(documents.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").join(name, "s")
    hits = docs.groupBy("doc_id", "n_words").agg(F.sort_array(F.collect_set(F.struct("pos", "sh"))).alias("x")).select("doc_id", "n_words", F.col("x.pos").alias("pos"), F.col("x.sh").alias("sh"))
    return hits, it.join(name, "s").groupBy("item_id", F.col("n_words").alias("item_words")).agg(F.sort_array(F.collect_list(F.struct("pos", "sh"))).alias("x")).select("item_id", "item_words", F.col("x.sh").alias("item_sh"))


def prefix_shingles(at: np.ndarray, sh: np.ndarray, docs: np.ndarray, item_words: int, cover: float) -> list[int]:
    """An item's shingles without the most common ones (docs: documents that hold each) that together cover less than cover of its words. at, sh: places and shingles."""
    order = np.lexsort((sh, docs))[::-1]
    groups = np.split(order, np.flatnonzero(np.diff(sh[order])) + 1)
    held = np.zeros(item_words, bool)
    for k, group in enumerate(groups):
        held[(at[group][:, None] + np.arange(SHINGLE)).ravel()] = True
        if held.sum() / item_words >= cover:
            return [int(sh[g[0]]) for g in groups[k:]]
    return []


VERIFIED = T.StructType([T.StructField("cover", T.DoubleType()), T.StructField("from_word", T.IntegerType()), T.StructField("to_word", T.IntegerType())])


def best_window(pos: np.ndarray, item_pos: np.ndarray, item_words: int) -> tuple[float, int, int]:
    """Over windows of about the item's length the largest share of the item's words in common shingles, and the first such window."""
    order = np.lexsort((item_pos, pos))
    p, q = np.asarray(pos)[order].tolist(), np.asarray(item_pos)[order].tolist()
    width = int(item_words * WINDOW) + SHINGLE
    held, covered, best, first = [0] * (item_words + SHINGLE), 0, (0, 0, 0), 0
    for i in range(len(p)):
        for k in range(q[i], q[i] + SHINGLE):
            covered += held[k] == 0
            held[k] += 1
        while p[i] + SHINGLE - p[first] > width:
            for k in range(q[first], q[first] + SHINGLE):
                held[k] -= 1
                covered -= held[k] == 0
            first += 1
        if covered > best[0]:
            best = (covered, p[first], p[i] + SHINGLE)
    return best[0] / max(item_words, 1), best[1], best[2]


def shared_places(pos: np.ndarray, sh: np.ndarray, item_sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the document and in the item of each shingle that both have, every place with every place."""
    order = np.argsort(item_sh, kind="stable")
    ordered = item_sh[order]
    low, high = np.searchsorted(ordered, sh, "left"), np.searchsorted(ordered, sh, "right")
    n = high - low
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(pos, n), order[np.repeat(low, n) + inside]


@F.pandas_udf(VERIFIED)
def _verify(pos: pd.Series, sh: pd.Series, item_sh: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_window(*shared_places(a, b, c), k) for a, b, c, k in zip(pos, sh, item_sh, n)], columns=["cover", "from_word", "to_word"])


def leaked_items(documents: DataFrame, items: DataFrame, cover: float = COVER, max_item_chars: int = MAX_ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, cover, from_word, to_word) of each document that holds a passage of an item."""
    spark: SparkSession = documents.sparkSession
    items = items.where("item_id IS NOT NULL AND length(text) > 0").select("item_id", "text")
    if items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] <= max_item_chars:
        rows = items.dropDuplicates(["item_id"]).select("item_id", consistent_text(F.col("text")).alias("text")).orderBy("item_id").collect()
        lists = [words(x["text"]) for x in rows]
        index = ItemIndex(lists)
        item_sh = spark.createDataFrame([(x["item_id"], len(w), of.tolist()) for x, w, of in zip(rows, lists, index.of_item) if len(of)], "item_id long, item_words int, item_sh array<long>")
        hits = _hits(documents, index).dropDuplicates(["doc_id"])
    else:
        hits, item_sh = _by_shuffle(documents, items)
        item_sh = cut_lineage(item_sh)
    hits = cut_lineage(hits)
    # rarity over the whole corpus
    common = hits.select(F.explode(F.array_distinct("sh")).alias("sh")).groupBy("sh").agg(F.count("*").alias("docs"))
    counted = item_sh.select("item_id", "item_words", F.posexplode("item_sh").alias("i", "sh")).join(common, "sh").groupBy("item_id", "item_words").agg(F.sort_array(F.collect_list(F.struct("i", "sh", "docs"))).alias("x"))
    prefix = counted.select("item_id", "item_words", F.explode(_prefix(cover)(F.col("x.i"), F.col("x.sh"), F.col("x.docs"), F.col("item_words"))).alias("sh"))
    seen = hits.select("doc_id", "n_words", F.explode(F.array_distinct("sh")).alias("sh"))
    cand = seen.join(checked_broadcast(prefix), "sh").where(F.col("n_words") >= F.col("item_words") * cover).select("doc_id", "item_id").distinct()
    # the candidates' places, intersected pair by pair; enough different shingles of the item, else no window can do
    both = cand.join(hits.select("doc_id", "pos", "sh"), "doc_id").join(checked_broadcast(item_sh), "item_id")
    least = F.ceil(F.col("item_words") * cover / SHINGLE)
    g = both.where(F.size(F.array_intersect("sh", "item_sh")) >= least).withColumn("v", _verify("pos", "sh", "item_sh", "item_words"))
    return g.where(F.col("v.cover") >= cover).select("doc_id", "item_id", "v.cover", "v.from_word", "v.to_word")


def _prefix(cover: float):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(at: pd.Series, sh: pd.Series, docs: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([prefix_shingles(a, s, d, k, cover) for a, s, d, k in zip(at, sh, docs, n)])

    return run
