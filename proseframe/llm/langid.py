"""Problem 8: the language of documents and of their segments, by word-first backoff.

A word that the model knows is scored by its log frequency in each language; an unseen one by the
longest of its character n-grams that the model knows, from five letters down to one. Sentences
get the language of the highest sum; a sentence with little evidence follows its neighbours;
neighbouring sentences of one language form a segment.

The model is fitted on a bounded sample of labelled rows: about sample_docs rows of each language,
taken by hash of their id from all rows with a usable label, and sample_chars characters of each
(both parameters; rows without a label don't change the sample). It is then cleaned of wrong labels: every half of the sample is judged by the
other half's model, languages that their own documents don't bear out are dropped, and sentences
are counted for the language they are judged to be in. All documents are labelled, whole.

Defined results: null, empty and blank texts, and texts without letters, have no language and give
no rows; a repeated document gives its rows once; ties go to the language whose code comes first;
very long sentences are judged in stretches of STRETCH words; without usable labels no language is
known and the result is empty; extra columns are ignored. Words of any length are scored whole; in
scripts that write no spaces (Chinese, Japanese, Thai, Lao, Khmer, Burmese, Tibetan) each character
counts as a word. A segment's confidence is the mean probability of its language over its words.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 600
SAMPLE_CHARS = 16_384
MIN_DOCS = 5
ALPHA = 0.05
LONGEST, FLOOR = 5, -8.0
WEAK = 2.5  # nats between the best and the second language of a sentence, below which its neighbours decide
STRETCH = 60
SLICE = 400

# ISO 639-1, 639-2/T, 639-2/B where different, English names.
LANGUAGES = """
en eng English|fr fra fre French|de deu ger German|es spa Spanish Castilian|pt por Portuguese|it ita Italian|nl nld dut Dutch Flemish|sv swe Swedish|da dan Danish|no nor Norwegian|nb nob Bokmal|fi fin Finnish|is isl ice Icelandic|pl pol Polish|cs ces cze Czech|sk slk slo Slovak|sl slv Slovenian|hr hrv Croatian|sr srp Serbian|bs bos Bosnian|bg bul Bulgarian|mk mkd mac Macedonian|ro ron rum Romanian|hu hun Hungarian|el ell gre Greek|tr tur Turkish|ru rus Russian|uk ukr Ukrainian|be bel Belarusian|et est Estonian|lv lav Latvian|lt lit Lithuanian|ga gle Irish|cy cym wel Welsh|ca cat Catalan|eu eus baq Basque|gl glg Galician|sq sqi alb Albanian|mt mlt Maltese|ar ara Arabic|he heb Hebrew|fa fas per Persian Farsi|ps pus Pashto|ku kur Kurdish|ur urd Urdu|hi hin Hindi|bn ben Bengali Bangla|ne nep Nepali|si sin Sinhala Sinhalese|ta tam Tamil|te tel Telugu|kn kan Kannada|ml mal Malayalam|mr mar Marathi|gu guj Gujarati|pa pan Punjabi Panjabi|or ori Odia|as asm Assamese|dv div Dhivehi|sd snd Sindhi|zh zho chi Chinese Mandarin cmn|ja jpn Japanese|ko kor Korean|vi vie Vietnamese|th tha Thai|lo lao Lao|km khm Khmer|my mya bur Burmese|id ind Indonesian|ms msa may Malay|tl tgl Tagalog|sw swa Swahili|am amh Amharic|so som Somali|af afr Afrikaans|zu zul Zulu|mn mon Mongolian|kk kaz Kazakh|uz uzb Uzbek|ky kir Kyrgyz|tg tgk Tajik|ka kat geo Georgian|hy hye arm Armenian|az aze Azerbaijani|la lat Latin|eo epo Esperanto
"""
CODE = {n.lower(): x.split()[0] for x in LANGUAGES.strip().split("|") for n in x.split()}
# What ends a sentence, and what isn't part of a word.
ENDS = r"[.!?…]+(?=[\s\x00\"'”’)\]»]|$)|[।॥。！？۔؟။។]|\n+"
SINGLE = r"㐀-鿿぀-ヿ\u0e01-\u0e4e\u0e80-\u0ece\u0f40-\u0fbc\u1000-\u1049\u1780-\u17d3"  # scripts without spaces: each character is a word
TOKEN = re.compile(rf"[{SINGLE}]|[^\s\d!-/:-@\[-`{{-~\x80-¿×÷‐-⁞₠-⃏、-〟।॥。，；：！？（）۔،؛؟{SINGLE}\x00]+|" + ENDS + r"|\x00")
END = re.compile(ENDS)
STOP, SEP = 0, 1  # ids of sentence ends and of the separator of texts


def label_codes(label: Column) -> Column:
    """The ISO 639-1 codes that a label names: codes of two or three letters, with or without region, or English names; several by semicolons."""
    names = F.create_map(*[F.lit(x) for kv in CODE.items() for x in kv])
    one = lambda x: F.regexp_replace(F.lower(F.trim(F.regexp_replace(x, r"[\s\u00a0]+", " "))), r"[-_].*$", "")
    parts = F.transform(F.split(F.coalesce(label, F.lit("")), "[;,/|]"), lambda x: F.element_at(names, one(x)))
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))


def words_of(texts: list[str]) -> list[str]:
    """Lower-case words and sentence ends of all texts in one pass, each text ended by a zero character."""
    return TOKEN.findall("\x00".join(t.replace("\x00", " ") for t in texts).lower() + "\x00")


class Grams:
    """Character n-grams of one to LONGEST letters as numbers, each with a row of scores.

    The n-grams of a length are numbered by rank: the number of the first n - 1 letters and the next
    letter make a key. A known n-gram's beginning is known too, as it occurs at least as often.
    """

    def __init__(self, letters: np.ndarray, keys: list[np.ndarray], scores: list[np.ndarray]):
        self.letters, self.keys, self.scores = letters, keys, scores

    @staticmethod
    def spread(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all words, each between low lines, and the word of each."""
        text = "".join(f"_{w}_" for w in words)
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])

    @classmethod
    def count(cls, words: list[str], weights: np.ndarray, least: float = 2.0) -> Grams:
        """Of all words, weighted by languages (rows of weights) and words; n-grams that weigh less than least together are left out."""
        cp, word = cls.spread(words)
        letters, letter = np.unique(cp, return_inverse=True)
        at, number = np.arange(len(cp)), np.zeros(len(cp), np.int64)
        keys, scores = [], []
        for n in range(1, LONGEST + 1):
            ok = at + n <= len(cp)
            ok[ok] = word[at[ok] + n - 1] == word[at[ok]]
            at, number = at[ok], number[ok]
            key, which = np.unique(number * len(letters) + letter[at + n - 1], return_inverse=True)
            of = word[at]
            m = np.stack([np.bincount(which, w[of], len(key)) for w in weights]) if len(key) else np.zeros((len(weights), 0))
            known = m.sum(0) >= least
            keys.append(key[known])
            scores.append(_relative(m[:, known], 0.5) if known.any() else np.zeros((0, len(weights)), np.float32))
            number = (np.cumsum(known) - 1)[which]
            at, number = at[known[which]], number[known[which]]
        return cls(letters, keys, scores)

    def score(self, words: list[str]) -> np.ndarray:
        """For each word the mean score of its longest known n-grams; zeros if it has none."""
        cp, word = self.spread(words)
        letter = np.searchsorted(self.letters, cp)
        letter[letter == len(self.letters)] = 0
        known = self.letters[letter] == cp if len(self.letters) else np.zeros(len(cp), bool)
        at, number = np.arange(len(cp)), np.zeros(len(cp), np.int64)
        out = np.zeros((len(words), self.scores[0].shape[1]), np.float32)
        for n, (keys, scores) in enumerate(zip(self.keys, self.scores), 1):
            ok = at + n <= len(cp)
            ok[ok] = (word[at[ok] + n - 1] == word[at[ok]]) & known[at[ok] + n - 1]
            at, number = at[ok], number[ok]
            if len(at) == 0 or len(keys) == 0:
                break
            key = number * len(self.letters) + letter[at + n - 1]
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[i] == key
            at, number = at[hit], i[hit]
            tells = cp[at] != 95 if n == 1 else np.ones(len(at), bool)  # a low line alone says nothing
            of = word[at[tells]]  # ascending
            first = np.flatnonzero(np.diff(of, prepend=-1))
            if len(first):
                out[of[first]] = np.add.reduceat(scores[number[tells]], first, axis=0) / np.diff(np.append(first, len(of)))[:, None]
        return out


class Model(dict):
    """word -> row of the score table; unseen words are scored by n-grams, all those of a batch at once, and kept while there is room."""

    def __init__(self, languages: list[str], vocabulary: dict[str, int], scores: np.ndarray, grams: Grams, room: int = 300_000, room_letters: int = 10_000_000):
        super().__init__(vocabulary)
        self.languages, self.scores, self.grams, self.room, self.room_letters = languages, scores, grams, room, room_letters
        self.table, self.used, self.letters = scores, len(scores), 0

    def learn(self, tokens: list[str]) -> None:
        """Scores the tokens that aren't known yet."""
        unseen = list(set(tokens).difference(self))
        ends = [w for w in unseen if END.match(w)]
        self.update(dict.fromkeys(ends, STOP))
        words = [w for w in unseen if w not in self]
        if not words:
            return
        if self.used + len(words) > len(self.table):
            self.table = np.concatenate([self.table[: self.used], np.zeros((max(self.used, len(words)), self.table.shape[1]), np.float32)])
        self.table[self.used : self.used + len(words)] = self.grams.score(words)
        self.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)
        self.letters += sum(map(len, words))

    def trim(self) -> None:
        """Forgets unseen words when there are too many."""
        if self.used > len(self.scores) + self.room or self.letters > self.room_letters:
            for w in [w for w, i in self.items() if i >= len(self.scores)]:
                del self[w]
            self.used, self.letters = len(self.scores), 0

    def backoff(self, word: str) -> np.ndarray:
        return self.grams.score([word])[0]


def _relative(counts: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Log frequencies of each word (column) in each language (row), relative to their sum over languages; words by languages."""
    logs = np.log(counts + alpha) - np.log(counts.sum(1, keepdims=True) + alpha * counts.shape[1])
    logs -= np.logaddexp.reduce(logs, axis=0, keepdims=True)
    return np.maximum(logs.T, FLOOR).astype(np.float32)


def fit(texts: list[str], labels: list[str]) -> Model | None:
    """The model of labelled texts, wrong labels cleaned away."""
    languages = sorted({x for x in labels if x})
    if not languages:
        return None
    vocabulary: dict[str, int] = {".": STOP, "\x00": SEP}
    tokens = words_of(texts)
    ids = np.array([STOP if w != "\x00" and END.match(w) else vocabulary.setdefault(w, len(vocabulary)) for w in tokens])
    doc = np.cumsum(ids == SEP) - (ids == SEP)
    sentence = np.cumsum((ids == STOP) | (ids == SEP))
    real = ids > SEP
    ids, doc, sentence = ids[real], doc[real], sentence[real]
    if len(ids) == 0:
        return None
    _, sentence = np.unique(sentence, return_inverse=True)
    s_doc = np.zeros(sentence[-1] + 1, int)
    s_doc[sentence] = doc
    label = np.array([languages.index(x) if x else -1 for x in labels])
    fold = np.arange(len(texts)) % 2
    v = len(vocabulary)

    def count(who: np.ndarray, k: int, half: int) -> np.ndarray:
        """Words by language of the sentences' languages in who, over one half of the documents."""
        lang = who[sentence]
        m = (lang >= 0) & (fold[doc] == half)
        return np.bincount(lang[m] * v + ids[m], minlength=k * v).reshape(k, v).astype(np.float64)

    def judge(models: list[np.ndarray], by: np.ndarray, n: int) -> np.ndarray:
        """Sums of word scores by group, every word scored by the model of the other half."""
        out = np.zeros((n, models[0].shape[1]))
        for half in (0, 1):
            m = fold[doc] == half
            s = models[1 - half][ids[m]]
            for j in range(s.shape[1]):
                out[:, j] += np.bincount(by[m], s[:, j], n)
        return out

    who = label[s_doc]
    models = [_relative(count(who, len(languages), h)) for h in (0, 1)]
    prior = np.log(np.bincount(label[label >= 0], minlength=len(languages)) + 1.0)
    best = (judge(models, doc, len(texts)) + prior).argmax(1)
    kept = [i for i in range(len(languages)) if (label == i).sum() >= MIN_DOCS and (best[label == i] == i).mean() >= 0.5]
    if not kept:
        kept = [int(np.bincount(label[label >= 0]).argmax())]
    new = {old: i for i, old in enumerate(kept)}
    languages = [languages[i] for i in kept]
    who = np.array([new.get(x, -1) for x in best])[s_doc]
    for _ in range(3):
        models = [_relative(count(who, len(languages), h)) for h in (0, 1)]
        who = judge(models, sentence, len(s_doc)).argmax(1)
    counts = count(who, len(languages), 0) + count(who, len(languages), 1)
    total = counts.sum(0)
    words = np.array(list(vocabulary), dtype=object)
    often = (total >= 2) & (np.arange(v) > SEP)
    scores = np.concatenate([np.zeros((2, len(languages)), np.float32), _relative(counts[:, often])])
    final = {".": STOP, "\x00": SEP} | {w: i for i, w in enumerate(words[often], 2)}
    seen = np.flatnonzero(counts.sum(0) > 0)
    return Model(languages, final, scores, Grams.count(words[seen].tolist(), np.log1p(counts[:, seen])))


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """Fits on about sample_docs labelled documents of each language, taken by hash of their id, and on sample_chars characters of each."""
    usable = documents.where("doc_id IS NOT NULL AND length(text) > 0").withColumn("_codes", label_codes(F.col("lang"))).where(F.size("_codes") == 1).withColumn("c", F.get("_codes", F.lit(0)))
    per = {r["c"]: r["n"] for r in usable.groupBy("c").agg(F.count("*").alias("n")).collect()}  # as many rows as LANGUAGES at most
    if not per:
        return None
    # a hash below the share of its range that gives a language sample_docs rows
    low = {c: int(-(2**63) + min(1.0, sample_docs / n) * (2**64 - 1)) if n > sample_docs else 2**63 - 1 for c, n in per.items()}
    bound = F.element_at(F.create_map(*[F.lit(x) for kv in low.items() for x in kv]), F.col("c"))
    rows = usable.where(F.xxhash64("doc_id") <= bound).select("doc_id", "c", F.substring("text", 1, sample_chars).alias("text")).toPandas()
    rows = rows.sort_values(["doc_id", "text", "c"]).drop_duplicates("doc_id")
    return fit(rows["text"].tolist(), rows["c"].tolist())


SEGMENT_SCHEMA = "doc_id long, seg_no int, lang string, confidence double, n_sentences int, n_words int, start_pos long, end_pos long"
ARROW_SCHEMA = pa.schema([("doc_id", pa.int64()), ("seg_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32()), ("n_words", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64())])


def _fill(value: np.ndarray, good: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Gives places that aren't good the value of the nearest good place before them in their group, else after them."""
    n = len(value)
    at = np.maximum.accumulate(np.where(good, np.arange(n), -1))
    ok = (at >= 0) & (group[at] == group)
    out = np.where(ok, value[at], value)
    back = np.minimum.accumulate(np.where(good, np.arange(n), n)[::-1])[::-1]
    after = np.minimum(back, n - 1)
    ok2 = ~ok & (back < n) & (group[after] == group)
    return np.where(ok2, value[after], out)


def segments_of(model: Model, texts: list[str]) -> dict[str, np.ndarray]:
    """Segments of the texts: number of the text, language, confidence, sentences, words, first and last sentence."""
    tokens = words_of(texts)
    model.learn(tokens)
    ids, table = np.fromiter(map(model.__getitem__, tokens), np.int64, len(tokens)), model.table
    model.trim()
    end, sep = ids == STOP, ids == SEP
    word = ~(end | sep)
    # long stretches without an end are judged in parts
    cut = np.flatnonzero(end | sep)
    begin = np.concatenate([[0], cut[:-1] + 1])
    part = np.arange(len(ids)) - np.repeat(begin, cut + 1 - begin)
    fresh = np.zeros(len(ids), bool)
    fresh[begin[begin < len(ids)]] = True
    fresh |= word & (part % STRETCH == 0) & (part > 0)
    stretch = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    sums = np.add.reduceat(table[ids], first, axis=0)
    n_words = np.add.reduceat(word.astype(np.int64), first)
    doc = (np.cumsum(sep) - sep)[first]
    real_no = np.cumsum(end | sep) - (end | sep)
    has = n_words > 0
    sums, n_words, doc, number = sums[has], n_words[has], doc[has], real_no[first][has]
    if len(doc) == 0:
        z = np.zeros(0, np.int64)
        return {k: z for k in ("doc", "lang", "conf", "sentences", "words", "a", "b")}
    k = sums.shape[1]
    best = sums.argmax(1)
    top = sums[np.arange(len(best)), best]
    if k > 1:
        rest = np.partition(sums, k - 2, axis=1)[:, k - 2]
    else:
        rest = top - 20
    every = np.logaddexp.reduce(sums.astype(np.float64), axis=1)
    strong = (top - rest >= WEAK) & (n_words >= 2)
    lang = _fill(best, strong, doc)
    start = np.ones(len(doc), bool)
    start[1:] = (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])
    at = np.flatnonzero(start)
    last = np.concatenate([at[1:], [len(doc)]]) - 1
    support = np.exp(sums[np.arange(len(lang)), lang] - every)
    words = np.add.reduceat(n_words, at)
    judged = np.ones(len(doc), np.int64)
    return {"doc": doc[at], "lang": lang[at], "conf": np.add.reduceat(support * n_words, at) / words, "sentences": np.add.reduceat(judged, at), "words": words, "a": number[at], "b": number[last]}


def _offsets(text: str, offset: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of the sentences numbered from a to b; the text's own first sentence has the number offset."""
    ends = [m.end() for m in END.finditer(text)]
    begin = lambda i: 0 if i <= 0 else ends[min(i, len(ends)) - 1]
    return [(begin(a - offset), ends[b - offset] if b - offset < len(ends) else len(text)) for a, b in pairs]


def segments(documents: DataFrame, model: Model | None) -> DataFrame:
    """Segments of all documents, in one pass and without a shuffle."""
    spark = documents.sparkSession
    d = documents.where("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return spark.createDataFrame([], SEGMENT_SCHEMA)
    packed = spark.sparkContext.broadcast(pickle.dumps((model.languages, {w: i for w, i in model.items() if i < len(model.scores)}, model.scores, model.grams)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*pickle.loads(packed.value))
        names = np.array(m.languages, dtype=object)
        for b in batches:
            for o in range(0, b.num_rows, SLICE):
                part = b.slice(o, SLICE)
                texts = part.column(1).to_pylist()
                s = segments_of(m, texts)
                doc = s["doc"]
                if len(doc) == 0:
                    continue
                opens = np.ones(len(doc), bool)
                opens[1:] = doc[1:] != doc[:-1]
                no = np.arange(len(doc)) - np.maximum.accumulate(np.where(opens, np.arange(len(doc)), 0))
                a, z = np.zeros(len(doc), np.int64), np.array([len(texts[i]) for i in doc], np.int64)
                several = np.bincount(doc, minlength=len(texts)) > 1
                if several.any():
                    ends = np.cumsum([len(END.findall(t)) + 1 for t in texts])
                    for i in np.flatnonzero(several):
                        at = np.flatnonzero(doc == i)
                        spans = _offsets(texts[i], int(ends[i - 1]) if i else 0, list(zip(s["a"][at].tolist(), s["b"][at].tolist())))
                        a[at], z[at] = [x for x, _ in spans], [x for _, x in spans]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(no, pa.int32()), pa.array(names[s["lang"]], pa.string()), pa.array(s["conf"], pa.float64()), pa.array(s["sentences"], pa.int32()), pa.array(s["words"], pa.int32()), pa.array(a), pa.array(z)], schema=ARROW_SCHEMA)

    return d.mapInArrow(run, SEGMENT_SCHEMA)


def document_languages(segs: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the language of most words of each document; its share of the words times their confidence."""
    per = segs.dropDuplicates(["doc_id", "seg_no"]).groupBy("doc_id", "lang").agg(F.sum("n_words").alias("w"), F.sum(F.col("n_words") * F.col("confidence")).alias("c"))
    top = per.groupBy("doc_id").agg(F.max_by(F.struct("lang", "c"), F.struct("w", F.col("c"), F.expr("translate(lang, 'abcdefghijklmnopqrstuvwxyz', 'zyxwvutsrqponmlkjihgfedcba')"))).alias("t"), F.sum("w").alias("all"))
    return top.select("doc_id", F.col("t.lang").alias("lang"), (F.col("t.c") / F.col("all")).alias("confidence"))


def unnamed_passages(documents: DataFrame, model: Model | None, min_sentences: int = 2) -> DataFrame:
    """(doc_id, lang) of passages of min_sentences or more in a language that the document's label doesn't name."""
    segs = segments(documents, model).where(F.col("n_sentences") >= min_sentences).select("doc_id", "lang").distinct()
    labels = documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), label_codes(F.col("lang")).alias("codes")).select("doc_id", F.explode("codes").alias("lang")).distinct()
    return segs.join(labels, ["doc_id", "lang"], "left_anti")
