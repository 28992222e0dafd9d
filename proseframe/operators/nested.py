"""Problem 2: flat, linked tables out of deeply nested JSON records.

A batch of bodies is one byte array. Bitmaps of quotes, escapes, brackets and delimiters are made
over it; prefix sums give string membership and nesting depth; one stable sort by depth gives every
value its container, hence its key, its element tag and its parent. Spans of the wanted elements
are then cut out and emitted as rows that lead to their parents. No record is parsed by itself;
only a body that is wrapped once more as a JSON string is unwrapped first.

Defined results: null, empty, blank or invalid bodies (cut off, mismatched, bad literal, bad
escape) give no rows; an element whose value is null is an empty element; an empty list holds no
element; null items in lists of an element count as empty elements; a repeated record gives its
rows once; a run outside any paragraph has no p_no and is left out of the run table; extra columns
of the input are ignored; an empty table gives empty tables. Records of any length and depth are
handled whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The element tags that become rows, and their kinds.
TAGS = {"w:p": "p", "w:r": "r", "w:footnote": "note", "w:endnote": "note", "w:tc": "cell", "w:txbxContent": "box", "w:t": "t"}
NODE_SCHEMA = "rec_id long, node_no int, parent_no int, kind string, tag string, depth int, p_no int, r_no int, holder string, attr_id string, style string, text string, bold boolean"
ARROW_SCHEMA = pa.schema([("rec_id", pa.int64()), ("node_no", pa.int32()), ("parent_no", pa.int32()), ("kind", pa.string()), ("tag", pa.string()), ("depth", pa.int32()), ("p_no", pa.int32()), ("r_no", pa.int32()), ("holder", pa.string()), ("attr_id", pa.string()), ("style", pa.string()), ("text", pa.string()), ("bold", pa.bool_())])
SLICE_BYTES = 4 << 20  # records are worked on in slices of about so many bytes, to bound the memory of the bitmaps
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13]] = True
_KIND = np.zeros(256, np.uint8)
for _i, _c in enumerate("{}[]:,", 1):
    _KIND[ord(_c)] = _i
OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COLON, COMMA, STRING, LITERAL = range(1, 9)
_VALUE, _ENDED = np.zeros(9, bool), np.zeros(9, bool)
_VALUE[[OPEN_O, OPEN_A, STRING, LITERAL]] = True
_ENDED[[CLOSE_O, CLOSE_A, STRING, LITERAL]] = True
_NUMBER = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdefABCDEF"]] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[[*b'"\\/bfnrtu']] = True


def _unwrapped(body: pa.Array) -> pa.Array:
    """Bodies that are JSON strings holding JSON, unwrapped; nulls and broken ones empty."""
    body = pc.fill_null(body.cast(pa.large_string()), "")
    wrapped = pc.match_substring_regex(body, r'^\s*"')
    while pc.any(wrapped).as_py():
        at = np.flatnonzero(wrapped.to_numpy(zero_copy_only=False))
        new = []
        for s in body.take(pa.array(at)).to_pylist():
            try:
                s = json.loads(s)
            except ValueError:
                s = ""
            new.append(s if isinstance(s, str) and s.encode("utf-8", "ignore").decode() == s else "")
        body = pc.replace_with_mask(body, wrapped, pa.array(new, pa.large_string()))
        wrapped = pc.match_substring_regex(body, r'^\s*"')
    return body


def structure(raw: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens of all records: where they begin and end, their kind, record, depth; and which records are valid."""
    n, records = len(raw), len(first) - 1
    row = np.repeat(np.arange(records, dtype=np.int32), np.diff(first))
    # a backslash escapes the next byte if the run of backslashes that it ends is odd
    slash = np.flatnonzero(raw == 92)
    escaped = np.zeros(n, bool)
    if len(slash):
        fresh = np.ones(len(slash), bool)
        fresh[1:] = (np.diff(slash) > 1) | (row[slash[1:]] != row[slash[:-1]])
        run = slash - np.maximum.accumulate(np.where(fresh, slash, 0)) + 1
        after = slash[run % 2 == 1] + 1
        after = after[after < n]
        escaped[after[row[after] == row[after - 1]]] = True
    quote = (raw == 34) & ~escaped
    total = np.zeros(n + 1, np.int32)
    np.cumsum(quote, out=total[1:])
    inside = ((total[1:] - total[first[row]]) & 1).astype(bool)  # from an opening quote up to before its closing one
    body = inside & ~quote
    bad = np.zeros(records, bool)
    odd = (total[first[1:]] - total[first[:-1]]) % 2 == 1
    bad |= odd
    bad[row[body & (raw < 32)]] = True
    at = np.flatnonzero(escaped)
    at = at[body[at]]
    bad[row[at[~_ESCAPED[raw[at]]]]] = True
    bad[row[slash[~inside[slash]]]] = True
    u = at[raw[at] == 117]
    if len(u):
        for k in range(1, 5):
            v = np.minimum(u + k, n - 1)
            bad[row[u[~(_HEX[raw[v]] & body[v] & (row[v] == row[u]))]]] = True
    out = ~inside & ~quote
    marks = out & (_KIND[raw] > 0)
    opens = quote & inside
    lit = out & ~marks & ~_SPACE[raw]
    begins = lit.copy()
    begins[1:] &= ~(lit[:-1] & (row[1:] == row[:-1]))
    ends = lit.copy()
    ends[:-1] &= ~(lit[1:] & (row[1:] == row[:-1]))
    token = marks | opens | begins
    at = np.flatnonzero(token)
    kind = np.where(marks[at], _KIND[raw[at]], np.where(opens[at], STRING, LITERAL)).astype(np.uint8)
    end = at + 1
    closing = np.flatnonzero(quote & ~inside)
    op = np.flatnonzero(opens)
    ok = ~odd[row[op]]
    str_end = np.full(len(op), 0)
    str_end[ok] = closing[~odd[row[closing]]] + 1
    end[kind == STRING] = str_end
    end[kind == LITERAL] = np.flatnonzero(ends) + 1
    trow = row[at]
    step = np.where((kind == OPEN_O) | (kind == OPEN_A), 1, np.where((kind == CLOSE_O) | (kind == CLOSE_A), -1, 0))
    tfirst = np.searchsorted(trow, np.arange(records + 1))
    level = np.concatenate([[0], np.cumsum(step)])
    depth = level[1:] - level[tfirst[trow]]  # after the token
    level_end = level[tfirst[1:]] - level[tfirst[:-1]]
    bad |= (level_end != 0) | (np.diff(tfirst) == 0)
    if len(depth):
        bad[trow[depth < 0]] = True
    return {"at": at, "end": end, "kind": kind, "row": trow, "depth": depth, "first": tfirst, "bad": bad, "step": step}


def _containers(s: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each token the number of the bracket it lies in (for a bracket: the one around it), -1 at the top; for each bracket token its partner."""
    n = len(s["at"])
    opens, closes = s["step"] == 1, s["step"] == -1
    inner = np.where(opens, s["depth"], np.where(closes, s["depth"] + 1, s["depth"]))  # depth inside
    outer = np.where(opens, s["depth"] - 1, s["depth"])
    # entries: every token at the depth it lies in, and every bracket at the depth it makes
    br = np.flatnonzero(opens | closes)
    idx = np.concatenate([np.arange(n), br])
    dep = np.concatenate([outer, inner[br]])
    sub = np.concatenate([np.ones(n, np.int64), np.where(opens[br], 0, 2)])
    is_open = np.concatenate([np.zeros(n, bool), opens[br]])
    is_close = np.concatenate([np.zeros(n, bool), closes[br]])
    dep = np.maximum(dep, -1)  # lower in broken records only
    deep = int(dep.max(initial=0)) + 2
    order = np.argsort(((s["row"][idx].astype(np.int64) * deep + dep + 1) * (n + 1) + idx) * 3 + sub)  # by record, depth, place
    row_o, dep_o, idx_o = s["row"][idx[order]], dep[order], idx[order]
    open_at = np.maximum.accumulate(np.where(is_open[order], np.arange(len(order)), -1)) if len(order) else order
    same = (open_at >= 0) & (row_o[open_at] == row_o) & (dep_o[open_at] == dep_o)
    found = np.where(same, idx_o[open_at], -1)
    own = ~(is_open[order] | is_close[order])
    container = np.full(n, -1)
    container[idx_o[own]] = found[own]
    partner = np.full(n, -1)
    c = is_close[order]
    partner[idx_o[c]] = found[c]
    good = c & (found >= 0)
    partner[found[good]] = idx_o[good]
    return container, partner


def _check(s: dict[str, np.ndarray], container: np.ndarray, partner: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Marks records that break JSON's grammar as bad."""
    kind, row, bad = s["kind"], s["row"], s["bad"]
    n = len(kind)
    if n == 0:
        return bad
    close = s["step"] == -1
    wrong = close & ((partner < 0) | (kind[np.maximum(partner, 0)] != kind - 1))
    in_object = (container >= 0) & (kind[np.maximum(container, 0)] == OPEN_O)
    before = np.zeros(n, np.uint8)
    before[1:] = np.where(row[1:] == row[:-1], kind[:-1], 0)
    after = np.zeros(n, np.uint8)
    after[:-1] = np.where(row[1:] == row[:-1], kind[1:], 0)
    is_key = (kind == STRING) & in_object & (after == COLON)
    value = _VALUE[kind] & ~is_key
    top = container < 0
    wrong |= is_key & ~np.isin(before, [OPEN_O, COMMA])
    wrong |= value & in_object & (before != COLON)
    wrong |= value & ~in_object & ~top & ~np.isin(before, [OPEN_A, COMMA])
    wrong |= value & top & (before != 0)
    ended = _ENDED[before]
    wrong |= (kind == COLON) & ~(in_object & (before == STRING))
    wrong |= (kind == COMMA) & (top | ~ended)
    wrong |= (kind == CLOSE_O) & ~(ended | (before == OPEN_O))
    wrong |= (kind == CLOSE_A) & ~(ended | (before == OPEN_A))
    wrong |= (kind == COMMA) & np.isin(after, [COMMA, CLOSE_O, CLOSE_A, 0])
    keys = np.zeros(n, bool)
    keys[1:] = is_key[:-1]
    wrong |= (kind == COLON) & ~keys
    lit = np.flatnonzero(kind == LITERAL)
    texts = [raw[a:b].tobytes() for a, b in zip(s["at"][lit], s["end"][lit])]
    fine = {t: t in (b"true", b"false", b"null") or _NUMBER.fullmatch(t) is not None for t in set(texts)}
    wrong[lit] |= np.array([not fine[t] for t in texts], bool)
    bad[row[wrong]] = True
    return bad


def _same(raw: np.ndarray, at: np.ndarray, end: np.ndarray, word: str) -> np.ndarray:
    """Which spans are the word."""
    w = word.encode()
    hit = (end - at) == len(w)
    at = at[hit]
    ok = np.ones(len(at), bool)
    for k, c in enumerate(w):
        ok &= raw[at + k] == c
    out = hit.copy()
    out[hit] = ok
    return out


def _string(raw: np.ndarray, a: int, b: int) -> str:
    s = raw[a:b].tobytes()
    if b"\\" not in s:
        return s.decode("utf-8")
    return json.loads(b'"' + s + b'"').encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _ranks(group: np.ndarray) -> np.ndarray:
    """0, 1, .. within each group, in the given order."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    start = np.ones(len(g), bool)
    start[1:] = g[1:] != g[:-1]
    first = np.maximum.accumulate(np.where(start, np.arange(len(g)), 0)) if len(g) else np.zeros(0, int)
    rank = np.empty(len(g), np.int64)
    rank[order] = np.arange(len(g)) - first
    return rank


def flatten_batch(rec_id: pa.Array, body: pa.Array) -> pa.RecordBatch:
    """The nodes of a batch of records."""
    body = _unwrapped(body)
    off = np.frombuffer(body.buffers()[1], np.int64, len(body) + 1, body.offset * 8)
    raw = np.frombuffer(body.buffers()[2], np.uint8)[off[0] : off[-1]] if body.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    s = structure(raw, off - off[0])
    if len(s["at"]) == 0:
        return pa.RecordBatch.from_pylist([], ARROW_SCHEMA)
    container, partner = _containers(s)
    bad = _check(s, container, partner, raw)
    kind, row, at, end = s["kind"], s["row"], s["at"], s["end"]
    n = len(kind)
    parent = np.maximum(container, 0)
    in_object = (container >= 0) & (kind[parent] == OPEN_O)
    is_key = np.zeros(n, bool)
    is_key[:-1] = (kind[:-1] == STRING) & in_object[:-1] & (kind[1:] == COLON)
    value = _VALUE[kind] & ~is_key
    key = np.full(n, -1)  # token of the key whose value, or an item of whose list, this is
    direct = value & in_object
    key[direct] = np.flatnonzero(direct) - 2
    item = value & (container >= 0) & ~in_object
    outer = np.where(item, container, np.arange(n))  # of lists in lists the outermost, by pointer doubling
    while (outer[outer] != outer).any():
        outer = outer[outer]
    key[item] = key[outer[item]]
    # tags
    names = {t: np.zeros(n, bool) for t in [*TAGS, "@w:id", "w:pStyle", "@w:val", "#text", "w:b"]}
    keys = np.flatnonzero(is_key)
    for t in names:
        names[t][keys] = _same(raw, at[keys] + 1, end[keys] - 1, t)
    has_key = value & (key >= 0)
    safe = np.maximum(key, 0)
    tag = np.full(n, -1, np.int8)
    for i, t in enumerate(TAGS):
        tag[has_key & names[t][safe] & (kind != OPEN_A) & ~bad[row]] = i
    of_kind = lambda *kinds: np.isin(tag, [i for i, k in enumerate(TAGS.values()) if k in kinds])
    # nearest ancestors, by pointer doubling over containers
    def nearest(good: np.ndarray) -> np.ndarray:
        """Of each token the nearest container (not itself) in good, else -1."""
        up = np.where(container < 0, n, container)
        jump = np.concatenate([np.where(good, np.arange(n), up), [n]])
        while True:
            new = jump[jump]
            if (new == jump).all():
                break
            jump = new
        res = jump[up]
        return np.where(res == n, -1, res)

    is_p, is_r, is_t, is_note = (of_kind(k) for k in ("p", "r", "t", "note"))
    holders = of_kind("cell", "box", "note")
    nodes = (tag >= 0) & ~is_t
    p_of, r_of, h_of, n_of = nearest(is_p), nearest(is_r), nearest(holders), nearest(nodes)
    p_no = np.full(n, -1)
    p_no[is_p] = _ranks(row[is_p])
    r_no = np.full(n, -1)
    r_in = np.flatnonzero(is_r & (p_of >= 0))
    r_no[r_in] = _ranks(p_of[r_in])
    at_node = np.flatnonzero(nodes)
    m = len(at_node)
    number = np.full(n, -1)
    number[at_node] = _ranks(row[at_node])
    place = np.full(n, -1)
    place[at_node] = np.arange(m)
    quoted = kind == STRING
    spans = lambda v: _strings(raw, at[v] + quoted[v], end[v] - quoted[v])
    named = lambda word: has_key & names[word][safe] & ~bad[row]
    # ids of notes
    v = np.flatnonzero(named("@w:id") & direct & ((kind == STRING) | (kind == LITERAL)))
    v = v[is_note[container[v]]]
    ids = _scattered(place[container[v]], pc.utf8_trim_whitespace(spans(v)), m)
    # the holder of a paragraph is that of its runs too
    own_p = np.where(is_p[at_node], at_node, np.where(is_r[at_node], p_of[at_node], -1))
    hp = np.where(own_p >= 0, h_of[np.maximum(own_p, 0)], -1)
    notes = np.flatnonzero(is_note)
    of_note = np.zeros(n, int)
    of_note[notes] = np.arange(len(notes))
    note_names = pc.binary_join_element_wise("note:", pc.fill_null(ids.take(pa.array(place[notes])), ""), "")
    which = np.where(hp < 0, 0, np.where(of_kind("cell")[hp], 1, np.where(of_kind("box")[hp], 2, 3 + of_note[hp])))
    holder = pa.concat_arrays([pa.array(["body", "cell", "box"]), note_names.cast(pa.string())]).take(pa.array(which, mask=own_p < 0))
    # styles: the value beside or under a paragraph's w:pStyle, the last of several
    v = np.flatnonzero(named("@w:val") & direct & quoted)
    v = v[(key[container[v]] >= 0) & names["w:pStyle"][key[container[v]]] & (p_of[container[v]] >= 0)]
    style = _scattered(place[p_of[container[v]]], spans(v), m)
    # w:b is on unless its own or its only attribute's value says off
    v = np.flatnonzero(named("w:b") & (r_of >= 0))
    only = (kind[v] == OPEN_O) & (partner[v] - v == 4)
    w = np.where(only, np.minimum(v + 3, n - 1), v)
    said = lambda x: _same(raw, at[w] + quoted[w], end[w] - quoted[w], x)
    value_off = (said("0") | said("false")) & (only | (kind[v] == LITERAL)) | said("off") & only
    bold = np.zeros(m, np.int8)
    bold[place[r_of[v]]] = np.where(value_off, 1, 2)
    # texts: the strings in a run's w:t elements, joined in reading order
    t_of = nearest(is_t)
    v = np.flatnonzero(quoted & (r_of >= 0) & (is_t | named("#text") & (t_of >= 0)))
    v = v[np.argsort(place[r_of[v]], kind="stable")]
    runs_with, first = np.unique(place[r_of[v]], return_index=True)
    text = _scattered(runs_with, _joined_strings(spans(v), first), m)
    no = lambda x: pa.array(x, pa.int32(), mask=x < 0)
    up = n_of[at_node]
    pick = lambda words: pa.array(words).take(pa.array(tag[at_node]))
    return pa.RecordBatch.from_arrays([
        rec_id.take(pa.array(row[at_node])).cast(pa.int64()), pa.array(number[at_node], pa.int32()), no(np.where(up >= 0, number[up], -1)), pick(list(TAGS.values())), pick(list(TAGS)),
        pa.array(s["depth"][at_node], pa.int32()), no(np.where(own_p >= 0, p_no[own_p], -1)), no(r_no[at_node]), holder, ids, style, text, pa.array(bold == 2, pa.bool_(), mask=bold == 0),
    ], schema=ARROW_SCHEMA)


def _strings(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans as strings; only those with escapes are looked at one by one."""
    size = end - at
    off = np.concatenate([[0], np.cumsum(size)])
    body = raw[np.repeat(at - off[:-1], size) + np.arange(off[-1])]
    out = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
    slashes = np.concatenate([[0], np.cumsum(body == 92)])
    odd = slashes[off[1:]] > slashes[off[:-1]]
    if odd.any():
        out = pc.replace_with_mask(out, pa.array(odd), pa.array([_string(raw, a, b) for a, b in zip(at[odd], end[odd])], pa.large_string()))
    return out


def _joined_strings(parts: pa.Array, first: np.ndarray) -> pa.Array:
    """Neighbouring strings joined; first has the number of each result's first part."""
    if len(parts) == 0:
        return parts
    off = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, parts.offset * 8)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(off[np.concatenate([first, [len(parts)]])].tobytes()), parts.buffers()[2])


def _scattered(place: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """An array of n strings with the values at their places, the last of several, else null."""
    which = np.full(n, -1)
    which[place] = np.arange(len(place))
    return values.take(pa.array(which, mask=which < 0)).cast(pa.string())


def nested_nodes(df: DataFrame, rec_id: str = "rec_id", body: str = "body_json") -> DataFrame:
    """One row for each paragraph, run, footnote, cell and box of each readable record, with its parent's number.

    Only the two columns are read. A repeated record's rows are dropped after flattening, so that
    the bodies themselves are never shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1 if len(size) else []
            for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                yield flatten_batch(b.column(0).slice(a, z - a), b.column(1).slice(a, z - a))

    only = df.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(body).alias("body")).where("rec_id IS NOT NULL AND body IS NOT NULL")
    return only.mapInArrow(run, NODE_SCHEMA).dropDuplicates(["rec_id", "node_no"])


def flat_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The related tables: paragraphs, runs, footnotes. node_no and parent_no link them within a record."""
    return {
        "paragraphs": nodes.where("kind = 'p'").select("rec_id", "p_no", "node_no", "parent_no", "holder", "style"),
        "runs": nodes.where("kind = 'r' AND p_no IS NOT NULL").select("rec_id", "p_no", "r_no", "node_no", "parent_no", "holder", "text", "bold"),
        "footnotes": nodes.where("kind = 'note'").select("rec_id", "node_no", "parent_no", F.col("attr_id").alias("note_id")),
    }


def runs_of_records(df: DataFrame) -> DataFrame:
    """(rec_id, p_no, r_no, holder) of each run in a readable record."""
    return flat_tables(nested_nodes(df))["runs"].select("rec_id", "p_no", "r_no", "holder")
