"""Differences between two versions of a document's texts."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENS = r"[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]"
SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("hl", T.BooleanType())]))


def diff_tokens(text: Column) -> Column:
    """Words, white space and single other characters."""
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def _tokens(text: str) -> list[str]:
    return re.findall(r"\w+|\s+|[^\w\s]", text)


def align(old: str | None, new: str | None) -> list[dict]:
    """The new text as segments, hl where it differs from the old one; what was deleted leaves nothing."""
    a, b = _tokens(old or ""), _tokens(new or "")
    # the matcher is quadratic at worst: it sees only what is left between the common head and tail
    least = min(len(a), len(b))
    head = next((i for i in range(least) if a[i] != b[i]), least)
    tail = next((i for i in range(least - head) if a[-1 - i] != b[-1 - i]), least - head)
    middle = difflib.SequenceMatcher(None, a[head : len(a) - tail], b[head : len(b) - tail], autojunk=False).get_opcodes()
    spans = [("equal", 0, head), *((op, j + head, k + head) for op, _, _, j, k in middle), ("equal", len(b) - tail, len(b))]
    out: list[dict] = []
    for op, j, k in spans:
        text = "".join(b[j:k])
        if op == "delete" or not text:
            continue
        if out and out[-1]["hl"] == (op != "equal"):
            out[-1]["text"] += text
        else:
            out.append({"text": text, "hl": op != "equal"})
    return out


@F.pandas_udf(SEGMENTS)
def highlighted(old: pd.Series, new: pd.Series) -> pd.Series:
    """Sequence alignment has no expression among Spark's; it runs by Arrow batches, on changed rows only."""
    return pd.Series([align(x, y) for x, y in zip(old, new)])


def highlighted_segments(changes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seg_no, text, hl): the segments of each changed text, of whatever part of a document."""
    s = changes.select(*keys, F.posexplode(highlighted(F.col("old"), F.col("new"))).alias("seg_no", "s"))
    return s.select(*keys, "seg_no", "s.text", "s.hl")


def changed(before: DataFrame, after: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, old, new) of texts that differ; a place missing before is empty, one missing after is ignored."""
    b = before.select(*keys, F.col(text).alias("old"))
    a = after.select(*keys, F.col(text).alias("new")).where("new IS NOT NULL")
    return a.join(b, keys, "left").withColumn("old", F.coalesce("old", F.lit(""))).where("old <> new").select(*keys, "old", "new")
