"""Problem 7: mixing sources to target weights by weighted fair queueing.

Every use of a document has a virtual finish time: the tokens of its source up to and including
it, in shuffled order, divided by the source's weight. All uses in order of finish time, cut off at
the total budget, are the mix; at any cut the sources have their shares but for one document.

Running sums never gather a source into one task: documents fall into buckets by their shuffle
hash, the buckets' sums are accumulated (one small row per source and bucket), and each document
adds its place within its bucket. The total budget by default is the largest at which every source
that occurs still meets its share within its repeats.

Defined results: null and empty texts have no tokens and aren't used; sources are compared in
lower case with spaces and hyphens as underscores; a source that is null or has no target isn't
used; a target without documents is reported with share 0 and its weight is divided among the
others in proportion; a redelivered document counts once; equal hashes are ordered by id; empty
tables give an empty mix and a report of zeros; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import checked_broadcast
from .shared import TOKENIZERS, cut_lineage, encoding

SEED = 20240719
DOCS_PER_BUCKET = 512
MOST_TARGETS = 10_000  # up to here the targets, and plans of one row for each, are broadcast


def source_name(c: Column) -> Column:
    """One spelling of a source's name."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))), r"[ \-]+", "_")


# Fixed value: a space alone between two other characters. The tokenizers' split patterns take a space with what follows it, so a piece begins there and a text cut before it has the same tokens.
CUT = re.compile(r"(?<=\S) (?=\S)")


def slices(text: str, size: int) -> Iterator[str]:
    """The text in slices of at least size characters, cut only where the tokenizer's own pieces end; a text without such a place after size characters stays whole from there."""
    at = 0
    while len(text) - at > size and (m := CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(documents: DataFrame, tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", slice_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, source, tokens). Texts are counted whole; slices of slice_chars characters bound the memory of long ones and change no count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for b in batches:
            counts = [sum(len(enc.encode_ordinary(x)) for x in slices(t, slice_chars)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["doc_id", "source", "tokens"])

    d = documents.where("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), source_name(F.col("source")).alias("source"), "text")
    return d.mapInArrow(run, "doc_id long, source string, tokens long")


def _targets(targets: DataFrame) -> DataFrame:
    t = targets.where("source IS NOT NULL AND target_share > 0").withColumn("source", source_name(F.col("source")))
    return t.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).cast("int").alias("max_repeats"))


def mix_sources(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, docs_per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """(source, doc_id, repeat_no, tokens, finish_time) of the mix, range-sorted by finish time over all partitions. counts must give the same rows each time it is read."""
    # sources are few: a join by shuffle would put most documents into a few tasks
    t = checked_broadcast(_targets(targets), MOST_TARGETS)
    few = targets.limit(MOST_TARGETS + 1).count() <= MOST_TARGETS
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    docs = counts.where("tokens > 0").join(t, "source").groupBy("source", "doc_id").agg(F.max("tokens").alias("tokens"), F.first("target_share").alias("w"), F.first("max_repeats").alias("m"))
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    docs = cut_lineage(docs)
    per_source = docs.groupBy("source").agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("n"), F.first("w").alias("w"), F.first("m").alias("m"))
    # one row for each target: its size is bounded by the table of targets
    whole = Window.partitionBy()
    plan = per_source.withColumn("weight", F.col("w") / F.sum("w").over(whole)).withColumn("most", F.min(F.col("all_tokens") * F.col("m") / F.col("weight")).over(whole))
    plan = plan.withColumn("budget", F.least(F.lit(float(total_tokens)), F.sum(F.col("all_tokens") * F.col("m")).over(whole).cast("double")) if total_tokens is not None else F.col("most"))
    plan = plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / docs_per_bucket))).withColumn("top", F.max(F.col("all_tokens") * F.col("m") / F.col("weight")).over(whole)).select("source", "all_tokens", "m", "weight", "budget", "buckets", "top")
    b = docs.select("source", "doc_id", "tokens", "h").join(small(plan.select("source", "buckets")), "source").withColumn("bucket", F.floor(F.shiftrightunsigned("h", 24) / F.lit(float(1 << 40)) * F.col("buckets")).cast("long")).drop("buckets")
    in_bucket = Window.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 24), "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("run", F.sum("tokens").over(in_bucket))
    sums = b.groupBy("source", "bucket").agg(F.sum("tokens").alias("s"))
    sums = _running(sums).select("source", "bucket", "before")
    placed = b.join(sums, ["source", "bucket"]).join(small(plan), "source").withColumn("cum", F.col("before") + F.col("run"))
    # with shares to meet a source is used up to budget * weight tokens; when others run out, up to the whole budget
    most = F.col("budget") * (F.col("weight") if total_tokens is None else F.lit(1.0)) / F.col("all_tokens")
    uses = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.least(F.col("m").cast("long"), F.floor(most) + 1).cast("int"))))
    uses = uses.withColumn("finish_time", ((F.col("repeat_no") - 1) * F.col("all_tokens") + F.col("cum")) / F.col("weight"))
    # by virtual time v all sources together have taken v tokens, until one runs out: below that the budget is a bound on finish time
    kept = uses.where(F.col("finish_time") <= F.col("budget")) if total_tokens is None else _truncate(uses)
    return kept.select("source", "doc_id", F.col("repeat_no").cast("int").alias("repeat_no"), "tokens", "finish_time").orderBy("finish_time", "source", "doc_id", "repeat_no")


def _running(sums: DataFrame, step: int = 4096) -> DataFrame:
    """Adds before, the sum of s over the source's earlier buckets, by two levels so that no task holds more than about step rows of a source at a time."""
    s = sums.withColumn("block", F.floor(F.col("bucket") / step))
    inner = Window.partitionBy("source", "block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = s.groupBy("source", "block").agg(F.sum("s").alias("bs"))
    outer = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("bs").over(outer), F.lit(0))).select("source", "block", "base")
    return s.withColumn("in_block", F.coalesce(F.sum("s").over(inner), F.lit(0))).join(blocks, ["source", "block"]).withColumn("before", F.col("base") + F.col("in_block"))


def _truncate(uses: DataFrame, bins: int = 1 << 16) -> DataFrame:
    """The uses in order of finish time up to the budget, by a range sort over bins of finish time: only the bin in which the budget falls is ordered row by row."""
    uses = cut_lineage(uses.select("source", "doc_id", "repeat_no", "tokens", "finish_time", "budget", "top"))
    u = uses.withColumn("bin", F.least(F.floor(F.col("finish_time") / F.col("top") * bins), F.lit(bins - 1)).cast("long"))
    per = u.groupBy("bin").agg(F.sum("tokens").alias("t"), F.max("budget").alias("budget"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most `bins` rows
    per = per.withColumn("before", F.coalesce(F.sum("t").over(w), F.lit(0))).where("before < budget").withColumn("whole", F.col("before") + F.col("t") <= F.col("budget")).select("bin", "before", "whole")
    u = u.join(per, "bin")
    in_bin = Window.partitionBy("bin").orderBy("finish_time", "source", "doc_id", "repeat_no").rowsBetween(Window.unboundedPreceding, 0)
    part = u.where("NOT whole").withColumn("upto", F.col("before") + F.sum("tokens").over(in_bin)).where("upto <= budget").drop("upto")
    return u.where("whole").unionByName(part)


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, documents, uses, most_uses, tokens, share) of each target."""
    got = mix.groupBy("source", "doc_id").agg(F.count("*").alias("u"), F.sum("tokens").alias("t")).groupBy("source").agg(F.count("*").alias("documents"), F.sum("u").alias("uses"), F.max("u").alias("most_uses"), F.sum("t").alias("tokens"))
    r = _targets(targets).join(got, "source", "left").na.fill(0, ["documents", "uses", "most_uses", "tokens"])
    return r.withColumn("share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0))).select("source", "target_share", "max_repeats", "documents", "uses", "most_uses", "tokens", "share")
