"""Sessions with a language model: history, context of earlier batches, acronym state, caches, budgets.

All are windows keyed by session; sums over a session's tokens only grow, so "stop at the first
overflow" is a filter on a running sum.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS_PER_CHAR = 0.35
STATE = r"(?s)^ACRONYM_STATE:(\{.*?\})\n\n(.*)$"


def token_estimate(text: Column, per_char: float = TOKENS_PER_CHAR) -> Column:
    """Tokens of a text, roughly: a fixed share of its characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) * F.lit(per_char).cast("decimal(4,2)")).cast("long")


def total_estimate(tokens: Column, factor: float = 2.3) -> Column:
    """Tokens of a prompt and its reply."""
    return F.floor(tokens * F.lit(factor).cast("decimal(4,2)")).cast("long")


def last_messages(df: DataFrame, session: str, order: str, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(F.col(order).desc()))).where(F.col("_n") <= n).drop("_n")


def trimmed_history(df: DataFrame, session: str, order: str, text: str, limit: int) -> DataFrame:
    """The newest messages whose tokens together stay within the limit; the first that overflows ends it."""
    w = Window.partitionBy(session).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("tokens", token_estimate(F.col(text))).withColumn("tokens_so_far", F.sum("tokens").over(w)).where(F.col("tokens_so_far") <= limit)


def state_of(content: Column) -> Column:
    """The acronym state at a batch's head as map<string, boolean>; null if there is none or it can't be read."""
    return F.from_json(F.regexp_extract(content, STATE, 1), "map<string,boolean>")


def text_of(content: Column) -> Column:
    """A batch's content without its state."""
    body = F.regexp_extract(content, STATE, 2)
    return F.when(content.rlike(STATE) & state_of(content).isNotNull(), body).otherwise(content)


def with_previous(df: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """Adds previous: the texts of all earlier batches of the session, joined by empty lines. Quadratic in a session by definition."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous", F.array_join(F.collect_list(text).over(w), "\n\n"))


def states_so_far(df: DataFrame, session: str, order: str, content: str) -> DataFrame:
    """(session, order, acronym, is_new): acronyms known before each batch come from the earliest batch that has them."""
    each = df.select(session, order, F.explode(F.map_keys(state_of(F.col(content)))).alias("acronym"))
    return each.groupBy(session, "acronym").agg(F.min(order).alias("first_batch"), F.count("*").alias("batches"))


def cache_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def missing_prompts(prompts: DataFrame, cache: DataFrame, prompt: str = "prompt") -> DataFrame:
    """(key, prompt) of the distinct prompts that the cache(key, response) doesn't hold: what is left to ask."""
    keyed = prompts.select(cache_key(F.col(prompt)).alias("key"), F.col(prompt).alias("prompt")).groupBy("key").agg(F.first("prompt").alias("prompt"))
    return keyed.join(cache.select("key"), "key", "left_anti")


def fresh(df: DataFrame, at: Column, now: Column, seconds: float = 600) -> DataFrame:
    """The cached rows no older than so many seconds; one without a time is stale."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1e6
    return df.where(age < seconds)


def reconciled(original: Column, returned: Column) -> Column:
    """Returned segments if there are as many as originals, each only if it has the same footnote placeholders; else all originals."""
    notes = lambda s: F.regexp_extract_all(s, F.lit(r"§FOOTNOTE:\d+§"), F.lit(0))
    return F.when(F.size(original) == F.size(returned), F.zip_with(original, returned, lambda o, r: F.when(notes(o) == notes(r), r).otherwise(o))).otherwise(original)


def reply_segments(reply: Column) -> Column:
    """A reply cut at lines of three dashes, trimmed, without empty segments."""
    return F.filter(F.transform(F.split(reply, r"\n---\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def corrected_text(reply: Column) -> Column:
    """What follows a line that begins with Corrected:, null if there is none."""
    return F.when(reply.rlike(r"(?im)^\s*Corrected:"), F.regexp_replace(F.regexp_extract(reply, r"(?ims)^\s*Corrected:\s*\n?(.*)$", 1), r"^\s+|\s+$", ""))


def split_prompt(prompt: Column) -> Column:
    """The part of a prompt before Input text:, for the system's turn; a prompt without it loses its {text}."""
    return F.when(prompt.contains("Input text:"), F.regexp_replace(F.split_part(prompt, F.lit("Input text:"), F.lit(1)), r"^\s+|\s+$", "")).otherwise(F.trim(F.replace(prompt, F.lit("{text}"), F.lit(""))))


def json_object(reply: Column) -> Column:
    """The outermost {...} of a noisy reply; null if it isn't JSON."""
    body = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.get_json_object(body, "$").isNotNull(), body)


def rate_map(reply: Column) -> Column:
    """code -> rate out of a reply: its JSON, else every "ABC": number in it."""
    parsed = F.from_json(json_object(reply), "map<string,double>")
    keys = F.regexp_extract_all(reply, F.lit(r'"([A-Za-z]{3})"\s*:\s*([0-9]+(?:\.[0-9]+)?)'), F.lit(1))
    values = F.regexp_extract_all(reply, F.lit(r'"([A-Za-z]{3})"\s*:\s*([0-9]+(?:\.[0-9]+)?)'), F.lit(2))
    loose = F.map_from_arrays(F.transform(keys, lambda k: F.upper(k)), F.transform(values, lambda v: v.cast("double")))
    good = F.map_filter(parsed, lambda k, v: v.isNotNull())
    return F.coalesce(F.when(F.size(good) > 0, F.transform_keys(good, lambda k, v: F.upper(k))), F.when(F.size(keys) > 0, loose))


def snippet(results: Column, words: int = 500, first: int = 1500, then: int = 1000) -> Column:
    """Search results as one snippet: the first words of all, cut twice, with three dots if cut the second time."""
    w = F.slice(F.filter(F.flatten(F.transform(results, lambda r: F.split(r, r"\s+"))), lambda x: x != ""), 1, words)
    s = F.substring(F.array_join(w, " "), 1, first)
    return F.when(F.length(s) > then, F.concat(F.substring(s, 1, then), F.lit("..."))).otherwise(s)


def simulate_limiter(calls: DataFrame, stream: str, at: str, tokens: str, limit: int, window_s: float = 60.0) -> DataFrame:
    """Adds wait_s and sent_at: calls of a stream in order through a token bucket that empties window_s after its first call.

    Stateful over one stream's calls; each stream is one group, in one task.
    """
    fields = calls.schema
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fields)}, wait_s double, sent_at double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, tokens], kind="stable")
        used, opened, clock, waits, sent = 0, None, None, [], []
        for t, k in zip(pdf[at], pdf[tokens]):
            now = float(t) if clock is None else max(float(t), clock)
            if opened is None or now - opened >= window_s:
                used, opened = 0, now
            if used and used + k > limit:
                now = opened + window_s
                used, opened = 0, now
            used += k
            clock = now
            waits.append(now - float(t))
            sent.append(now)
        return pdf.assign(wait_s=waits, sent_at=sent)

    return calls.groupBy(stream).applyInPandas(one, schema)


def halved_batches(df: DataFrame, keys: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Adds part: batches over the limit are halved by rows, and halves again, until they fit or hold one row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        parts, todo = [], [(0, len(pdf))]
        while todo:
            a, b = todo.pop()
            if b - a > 1 and pdf[size].iloc[a:b].sum() > limit:
                mid = a + ((b - a) // 2 or 1)
                todo += [(mid, b), (a, mid)]
            else:
                parts.append((a, b))
        number = [i for i, (a, b) in enumerate(sorted(parts)) for _ in range(b - a)]
        return pdf.assign(part=pd.Series(number, dtype="int32"))

    return df.groupBy(*keys).applyInPandas(one, f"{fields}, part int")
