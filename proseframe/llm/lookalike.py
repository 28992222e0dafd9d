"""Problem 5: one consistent form for texts that look the same.

The text column is handled as Arrow buffers: one decode per batch gives a flat array of code
points, lookup tables give each point's class and replacement, expansion offsets make room for
decompositions, and marks are put in canonical order and composed by table, for all rows at once.
No row is looked at by a string call.

Consistent form: NFC; invisible marks gone (joiners stay where a joining script needs them);
special spaces are plain spaces; full-width, mathematical, ligature and presentation forms are
plain letters; letters of another alphabet inside a word are those of the word's own alphabet. A
word of nothing but look-alikes takes the alphabet of the words around it; alone it stays, in
capitals as in small letters. The dotless i and its like stay where their alphabet may be meant.

Defined results: null stays null; an empty text stays empty; texts of any length are handled
whole; equal texts give equal results; an empty table gives an empty table; other columns are
never touched.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

LATIN, CYRILLIC, GREEK, ARMENIAN, CJK, JOINING, OTHER = range(1, 8)

# Look-alike letters, as a reader of Latin text takes them.
CYRILLIC_AS_LATIN = (
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY Һh ԚQ ԜW ӀI "
    "аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw ӏl ѵv ґr вb кk мm нh тt ьb"
)
GREEK_AS_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv αa ρp υu ιi κk χx γy ϲc ϳj Ϲc"
ARMENIAN_AS_LATIN = "օo սu հh ոn զq ցg ՕO ՍU ՏS"
LATIN_ODD = "ɡg ʏY ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs"
# Letters of living alphabets that look like others; they stay where nothing speaks against them.
LATIN_LIVING = "ıi ɩi ɑa ɪI"
# Letters that speak for an alphabet with the dotless i or its like.
LIVING_SIGNS = "şŞğĞİçÇöÖüÜəƏɛƐɔƆŋŊʋƲɖƉ\u0306\u0307\u0308\u0327"
LIVING_WORDS = 5  # so many other Latin words without such a letter speak against one

# Code point ranges of the alphabets that matter here.
RANGES = {
    LATIN: [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA722, 0xA7FF)],
    CYRILLIC: [(0x400, 0x481), (0x48A, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)],
    GREEK: [(0x370, 0x373), (0x376, 0x377), (0x37B, 0x37D), (0x37F, 0x37F), (0x386, 0x386), (0x388, 0x3FF), (0x1F00, 0x1FFF)],
    ARMENIAN: [(0x531, 0x556), (0x560, 0x588)],
    CJK: [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3041, 0x30FF), (0x3105, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA960, 0xA97F), (0xAC00, 0xD7FB), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
    JOINING: [(0x620, 0x65F), (0x66E, 0x6D3), (0x6D5, 0x6DC), (0x6DF, 0x6E8), (0x6EA, 0x6FC), (0x700, 0x8FF), (0x900, 0x963), (0x970, 0xDFF), (0x1000, 0x109F), (0x1780, 0x17D3), (0x1CD0, 0x1CFF), (0xA8E0, 0xA8FF)],
    OTHER: [(0x591, 0x5F4), (0xE00, 0xFFF), (0x10A0, 0x10FF), (0x1200, 0x167F), (0x2D00, 0x2DDF)],
}
#: What shows nothing and changes nothing: soft hyphen, zero widths, joiners, directions, fillers, selectors, tags.
INVISIBLE = [(0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF)]
#: Blocks whose compatibility forms stand for plain characters (superscripts, subscripts, fractions and signs aren't here).
COMPAT = [(0x149, 0x149), (0x132, 0x133), (0x13F, 0x140), (0x17F, 0x17F), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0xB5, 0xB5), (0x2160, 0x217F), (0x210A, 0x2115), (0x2119, 0x211D), (0x2124, 0x2124), (0x2128, 0x2138), (0x2145, 0x2149), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB50, 0xFDF9), (0xFE70, 0xFEFC), (0xFF01, 0xFF9F), (0xFFE0, 0xFFE6), (0x2F00, 0x2FD5), (0x1D400, 0x1D7FF)]
TOP = 0x110000
NOT_CASED = 0x3000  # the ideographic space


def _pairs(text: str) -> list[tuple[int, int]]:
    return [(ord(p[0]), ord(p[1])) for p in text.split()]


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, made once per process from the Unicode database."""
    script, word, ccc = np.zeros(TOP, np.uint8), np.zeros(TOP, bool), np.zeros(TOP, np.uint8)
    for s, spans in RANGES.items():
        for a, b in spans:
            script[a : b + 1] = s
    single, invisible, wide_punct, symbol = np.arange(TOP, dtype=np.uint32), np.zeros(TOP, bool), np.zeros(TOP, bool), np.zeros(TOP, bool)
    for a, b in INVISIBLE:
        invisible[a : b + 1] = True
    seen = [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x11000, 0x11FFF), *range(0x1D100, 0x1D800), *range(0x1F000, 0x1FB00), *range(0x2F800, 0x2FA20)]
    compat = np.zeros(TOP, bool)
    for a, b in COMPAT:
        compat[a : b + 1] = True
    expand: dict[int, str] = {}  # compatibility forms of more than one character
    canon: dict[int, str] = {}  # full canonical decompositions
    compose: dict[tuple[int, int], int] = {}
    mark = np.zeros(TOP, bool)
    for o in seen:
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if kind[0] == "M":
            mark[o] = True
        if kind == "So":
            symbol[o] = True
        if kind == "Zs":
            single[o] = 32
        if k := unicodedata.combining(c):
            ccc[o] = k
        if compat[o] and not invisible[o] and (to := unicodedata.normalize("NFKC", c)) != c:
            if len(to) == 1:
                single[o] = ord(to)
            else:
                expand[o] = to
            if 0xFF01 <= o <= 0xFFE6 and kind[0] in "PS":
                wide_punct[o] = True
        if 0xAC00 <= o < 0xD7A4:  # Hangul syllables stay composed; jamo compose by rule below
            continue
        if (d := unicodedata.decomposition(c)) and d[0] != "<":
            canon[o] = unicodedata.normalize("NFD", c)
            p = [int(x, 16) for x in d.split()]
            if len(p) == 2 and unicodedata.normalize("NFC", c) == c:
                compose[p[0], p[1]] = o
    for lead in range(19):
        for vowel in range(21):
            lv = 0xAC00 + (lead * 21 + vowel) * 28
            compose[0x1100 + lead, 0x1161 + vowel] = lv
            for tail in range(1, 28):
                compose[lv, 0x11A7 + tail] = lv + tail
    single[0x2010] = single[0x2011] = ord("-")
    single[0x2028] = single[0x2029] = single[0x85] = 10
    word[:128] = [chr(i).isalnum() for i in range(128)]
    word |= (script > 0) | mark
    to_latin, kind_of = np.zeros(TOP, np.uint32), np.zeros(TOP, np.uint8)
    back = {CYRILLIC: np.zeros(TOP, np.uint32), GREEK: np.zeros(TOP, np.uint32)}
    for s, text in ((CYRILLIC, CYRILLIC_AS_LATIN), (GREEK, GREEK_AS_LATIN), (ARMENIAN, ARMENIAN_AS_LATIN), (LATIN, LATIN_ODD), (LATIN, LATIN_LIVING)):
        for a, b in _pairs(text):
            to_latin[a], kind_of[a] = b, s
            if s in back and not back[s][b]:
                back[s][b] = a
    for a, b in _pairs(CYRILLIC_AS_LATIN)[-6:]:  # small letters that only look like small capitals: proof of Cyrillic, unless the word has Latin
        back[CYRILLIC][b] = back[CYRILLIC][b] if back[CYRILLIC][b] != a else 0
    flat, start, length = [0], np.zeros(TOP, np.int64), np.ones(TOP, np.int64)
    for o, to in canon.items():
        start[o], length[o] = len(flat), len(to)
        flat += map(ord, to)
    flat_k, start_k, length_k = [0], np.zeros(TOP, np.int64), np.ones(TOP, np.int64)
    for o, to in expand.items():
        start_k[o], length_k[o] = len(flat_k), len(to)
        flat_k += map(ord, to)
    keys = np.array([a << 21 | b for a, b in compose], np.int64)
    order = np.argsort(keys)
    unstable = np.zeros(TOP, bool)  # needs the pass that decomposes and composes
    unstable[list(canon)] = [unicodedata.normalize("NFC", chr(o)) != chr(o) for o in canon]
    second = np.zeros(TOP, bool)
    second[[b for _, b in compose]] = True
    unstable |= second | (ccc > 0)
    living, sign = np.zeros(TOP, bool), np.zeros(TOP, bool)
    living[[a for a, _ in _pairs(LATIN_LIVING)]] = True
    sign[[ord(c) for c in LIVING_SIGNS]] = True
    joins = (script == JOINING) | (mark & np.isin(script, [JOINING, OTHER]))
    special = invisible | (single != np.arange(TOP)) | (length_k > 1) | unstable | (to_latin > 0)
    return {
        "script": script, "word": word, "ccc": ccc, "single": single, "invisible": invisible, "wide": wide_punct, "symbol": symbol, "mark": mark, "to_latin": to_latin, "kind_of": kind_of,
        "back_c": back[CYRILLIC], "back_g": back[GREEK], "flat": np.array(flat, np.uint32), "start": start, "length": length, "flat_k": np.array(flat_k, np.uint32), "start_k": start_k, "length_k": length_k,
        "keys": keys[order], "composed": np.array(list(compose.values()), np.uint32)[order], "unstable": unstable, "living": living, "sign": sign, "joins": joins, "special": special,
    }


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat code points of an Arrow string array, and the offsets of its rows in them. Nulls are empty."""
    if len(text) == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    text = text.cast(pa.large_string()) if pa.types.is_string(text.type) else text
    if text.null_count:
        text = pc.fill_null(text, "")
    off = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return cp, lead[off - off[0]]


def to_arrow(cp: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of code_points."""
    width = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), out=width[1:])
    body = cp.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(width[offsets].astype(np.int64).tobytes()), pa.py_buffer(body)).cast(pa.string())


def _neighbour(row: np.ndarray, good: np.ndarray, value: np.ndarray, forward: bool) -> np.ndarray:
    """For each place the value at the nearest good place before it (or after it) in the same row, else 0."""
    n = len(row)
    if n == 0:
        return value
    if not forward:
        return _neighbour(row[::-1], good[::-1], value[::-1], True)[::-1]
    at = np.where(good, np.arange(n), -1)
    at = np.maximum.accumulate(at)
    at = np.concatenate([[-1], at[:-1]])
    ok = (at >= 0) & (row[at] == row)
    return np.where(ok, value[at], 0)


def _expand(cp: np.ndarray, row: np.ndarray, flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces each point that has a place in flat by the points there."""
    n, has = length[cp], start[cp] > 0
    if not has.any():
        return cp, row
    first = np.cumsum(n) - n
    inside = np.arange(n.sum()) - np.repeat(first, n)
    source = np.repeat(cp, n)
    return np.where(np.repeat(has, n), flat[np.minimum(np.repeat(start[cp], n) + inside, len(flat) - 1)], source), np.repeat(row, n)


def _nfc(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """NFC of all rows at once: expand, order marks by class, compose by table."""
    if len(cp) == 0:
        return cp, row
    cp, row = _expand(cp, row, t["flat"], t["start"], t["length"])
    ccc = t["ccc"][cp].astype(np.int64)
    begins = np.ones(len(cp), bool)
    begins[1:] = row[1:] != row[:-1]
    order = np.argsort(np.cumsum((ccc == 0) | begins) * 256 + ccc, kind="stable")
    cp, row = cp[order].astype(np.int64), row[order]
    while True:
        ccc = t["ccc"][cp].astype(np.int64)
        begins = np.ones(len(cp), bool)
        begins[1:] = row[1:] != row[:-1]
        base = np.maximum.accumulate(np.where((ccc == 0) | begins, np.arange(len(cp)), -1))
        nth = np.arange(len(cp)) - base
        gone = np.zeros(len(cp), bool)
        last = np.zeros(len(cp), np.int64)  # at a base: class of the last mark that stays
        marks = np.flatnonzero(nth)
        by = marks[np.argsort(nth[marks], kind="stable")]
        for step in np.split(by, np.flatnonzero(np.diff(nth[by])) + 1) if len(by) else []:
            b, k = base[step], ccc[step]
            key = cp[b] << 21 | cp[step]
            i = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            fits = (t["keys"][i] == key) & (last[b] < k) & (ccc[b] == 0)
            cp[b[fits]] = t["composed"][i[fits]]
            gone[step[fits]] = True
            last[b[~fits]] = k[~fits]
        cp, row = cp[~gone], row[~gone]
        both = np.zeros(len(cp), bool)
        both[1:] = (row[1:] == row[:-1]) & (t["ccc"][cp[1:]] == 0) & (t["ccc"][cp[:-1]] == 0)
        key = np.where(both, np.concatenate([[0], cp[:-1]]) << 21 | cp, 0)
        i = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = both & (t["keys"][i] == key)
        hit[1:] &= ~hit[:-1]
        if not hit.any():
            return cp.astype(np.uint32), row
        cp[np.flatnonzero(hit) - 1] = t["composed"][i[hit]]
        cp, row = cp[~hit], row[~hit]


def consistent(cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The consistent form of rows of code points; row has each point's row number, ascending."""
    t = tables()
    if len(cp) == 0:
        return cp, row
    # invisible marks, but for joiners inside words of scripts that join, and selectors of symbols
    hidden = t["invisible"][cp]
    if hidden.any():
        seen = ~hidden
        before, after = _neighbour(row, seen, cp, True), _neighbour(row, seen, cp, False)
        joiner = (cp == 0x200C) | (cp == 0x200D)
        stays = joiner & t["joins"][before] & (t["joins"][after] | (t["ccc"][before] == 9))
        stays |= ((cp == 0x200D) & t["symbol"][before] & t["symbol"][after]) | ((cp >= 0xFE00) & (cp <= 0xFE0F) & (t["symbol"][before] | (t["script"][before] == CJK)))
        keep = ~hidden | stays
        cp, row = cp[keep], row[keep]
        if len(cp) == 0:
            return cp, row
    # compatibility forms and spaces; wide punctuation and the wide space belong to CJK text
    wide = t["wide"][cp] | (cp == NOT_CASED)
    plain = t["single"][cp]
    if wide.any():
        letter = (t["script"][cp] > 0) | t["word"][cp] | ((cp >= 0xFF10) & (cp <= 0xFF5A) & ~t["wide"][cp])
        script = np.where(letter, np.where(t["script"][cp] == CJK, 2, 1), 0)
        before, after = _neighbour(row, letter, script, True), _neighbour(row, letter, script, False)
        proper = np.where(cp == NOT_CASED, (before == 2) & (after == 2), (before == 2) | (after == 2) | ((before == 0) & (after == 0)))
        plain = np.where(wide & proper, cp, plain)
    cp, row = _expand(plain, row, t["flat_k"], t["start_k"], t["length_k"])
    # letters of another alphabet
    cp = _alphabets(cp, row, t)
    # compose
    need = t["unstable"][cp]
    if need.any():
        rows = np.zeros(row[-1] + 1, bool)
        rows[row[need]] = True
        some = rows[row]
        a, ra = _nfc(cp[some], row[some], t)
        cp, row = np.concatenate([cp[~some], a]), np.concatenate([row[~some], ra])
        order = np.argsort(row, kind="stable")
        cp, row = cp[order], row[order]
    return cp, row


def _alphabets(cp: np.ndarray, row: np.ndarray, t: dict[str, np.ndarray]) -> np.ndarray:
    """Gives look-alike letters the alphabet of their word; a word of nothing but look-alikes that of its neighbours."""
    like = t["to_latin"][cp] > 0
    if not like.any():
        return cp
    inside = t["word"][cp]
    begin = inside.copy()
    begin[1:] &= ~(inside[:-1] & (row[1:] == row[:-1]))
    at = np.flatnonzero(begin)
    number = np.where(inside, np.cumsum(begin) - 1, -1)
    words = len(at)
    count = lambda m: np.bincount(number[inside & m], minlength=words)
    script, kind = t["script"][cp], t["kind_of"][cp]
    latin = count((script == LATIN) & (kind == 0))
    odd = count(kind == LATIN)
    strict = {s: count((script == s) & (kind == 0)) for s in (CYRILLIC, GREEK, ARMENIAN)}
    conf = {s: count(kind == s) for s in (CYRILLIC, GREEK, ARMENIAN)}
    strict_all, conf_all = sum(strict.values()), sum(conf.values())
    # a letter of a living alphabet stays, unless its word has a look-alike of another kind or a w, or its row has many Latin words and no sign of that alphabet
    living = count(t["living"][cp])
    if living.any():
        wrow = row[at]
        others, signs = (np.bincount(wrow, m, minlength=wrow[-1] + 1)[wrow] for m in ((latin > 0) & (living == 0), count(t["sign"][cp]) > 0))
        proven = (conf_all > 0) | (odd > living) | (count((cp == 119) | (cp == 87)) > 0) | ((others >= LIVING_WORDS) & (signs == 0))
        odd = np.where(proven, odd, odd - living)
    else:
        proven = np.ones(words, bool)
    foreign = strict_all + conf_all
    to_latin = (latin > 0) & (strict_all == 0) & (conf_all + odd > 0)
    # a Cyrillic or Greek word with a few Latin letters in it
    back_c, back_g = t["back_c"][cp], t["back_g"][cp]
    reverse = {s: (latin > 0) & (strict[s] > 0) & (strict[s] + conf[s] > latin) & (count((script == LATIN) & (back > 0)) == latin) for s, back in ((CYRILLIC, back_c), (GREEK, back_g))}
    # only look-alikes: the nearest words in the row decide
    open_ = (conf_all > 0) & (latin == 0) & (strict_all == 0)
    wrow = row[at]
    state = np.where((latin > 0) | to_latin, 1, np.where(foreign > 0, np.where(open_, 0, 2), np.where(odd > 0, 1, 0)))
    before, after = _neighbour(wrow, state > 0, state, True), _neighbour(wrow, state > 0, state, False)
    upper = count(kind > 0) == count((kind > 0) & ((t["to_latin"][cp] >= 65) & (t["to_latin"][cp] <= 90)))
    lone_ok = ((before == 1) | (after == 1)) & (before != 2) & (after != 2)
    digits = count((cp >= 48) & (cp <= 57)) > 0
    greek_word = conf[GREEK] > 0
    to_latin |= open_ & (lone_ok | (digits & (before != 2) & (after != 2))) & (~greek_word | upper)
    out = cp.copy()
    safe = np.maximum(number, 0)
    m = inside & like & to_latin[safe] & ~(t["living"][cp] & ~proven[safe])
    out[m] = t["to_latin"][cp[m]]
    for s, back in ((CYRILLIC, back_c), (GREEK, back_g)):
        m = inside & (script == LATIN) & (back > 0) & reverse[s][safe]
        out[m] = back[m]
    return out


def consistent_array(text: pa.Array) -> pa.Array:
    """The consistent form of an Arrow string array."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    t = tables()
    cp, offsets = code_points(text)
    if len(cp) == 0:
        return text
    odd = np.concatenate([[0], np.cumsum(t["special"][cp])])
    rows = odd[offsets[1:]] > odd[offsets[:-1]]
    if not rows.any():
        return text
    length = np.diff(offsets)
    picked = np.repeat(rows, length)
    new, at = consistent(cp[picked], np.repeat(np.arange(rows.sum()), length[rows]))
    size = np.bincount(at, minlength=rows.sum())
    fixed = to_arrow(new, np.concatenate([[0], np.cumsum(size)]))
    mask = pa.array(rows)
    if text.null_count:
        mask = pc.and_(mask, pc.is_valid(text))
    return pc.replace_with_mask(text.cast(pa.string()), mask, fixed)


@arrow_udf(StringType())
def _consistent_udf(text: pa.Array) -> pa.Array:
    return consistent_array(text)


def consistent_text(text: Column) -> Column:
    """The consistent form of a text column. Plain ASCII is already in it and never leaves the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _consistent_udf(text)).otherwise(text)


def with_consistent(df: DataFrame, text: str = "text", out: str = "consistent") -> DataFrame:
    """df and one more column, its consistent text."""
    return df.withColumn(out, consistent_text(F.col(text)))


def inconsistent_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text isn't in the consistent form. ASCII rows are dropped before Python sees them."""
    odd = df.where(F.col(text).rlike(r"[^\x00-\x7F]"))
    return odd.where(_consistent_udf(F.col(text)) != F.col(text))
