"""Problem 10: abusive, hateful or sexual content."""

from __future__ import annotations

import json
import random
import re
import unicodedata
from collections import Counter, defaultdict
from hashlib import md5
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import kept_folder, spread
from ..sources.stores import VersionedStore, stamped_files
from ..sources.tables import table
from . import abuse_examples
from .text import delook, fold, repair

SLOTS = 1 << 18  # hashed terms
FACTORS = 6
WINDOW, STRIDE = 18, 6  # words of a window over sentences longer than LONG
LONG = 24
PER_TEMPLATE = 24  # sentences made of each template
SAMPLE_DOCS = 4_000  # documents, at most, whose sentences serve as further harmless examples
SAMPLE_UNITS = 20_000  # sentences, at most, of them
COMMON = 3  # times from which a word of the corpus may be itself and no misspelling
PEER = 0.25  # share of another word's frequency that its misspellings don't reach
EPOCHS, BATCH, RATE, DECAY = 4, 256, 0.08, 2e-6
SEED = 7
FORM = 3  # of how words are cut and hashed; a kept filter of another form is not used
EXCLUDE = 0.5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

_LEET = str.maketrans("013457$@!", "oieastsai")
_DOTTED = re.compile(r"\b(?:[^\W\d_][.\-_*·]){2,}[^\W\d_]\b\.?")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
# quick to look for, and in every text that has one of the two
_MAY_DOT, _MAY_SPACE = re.compile(r"(?<=[.\-_*·])[^\W\d_](?=[.\-_*·])"), re.compile(r" [^\W\d_] [^\W\d_] [^\W\d_]")
# music as code: only what its notation consists of, so that a sentence in it is read
_NOTATION = re.compile(r"\\relative\b\s*(?:[a-h](?:is|es)?[',]*)?\s*\{(?:[\s|<>(){}\[\]~^_.\-\"0-9/',!?=:]|\\[A-Za-z]+|(?<![A-Za-z])(?:[a-hrs](?:isis|eses|is|es)?)(?![A-Za-z]))*")
_CODE = re.compile(r"https?://\S+|</?[A-Za-z][^<>]{0,200}>|<\|?/?[a-z_]+\|?>")
# words, numbers, words with stars or digits for letters
_TOKEN = re.compile(r"[a-z]+(?![a-z0-9$@*])|[a-z]+(?:\*{1,}[a-z]*)|[a-z][a-z0-9$@]*|[0-9$@]*[$@0-9][a-z$@][a-z0-9$@]*|[0-9]+|\$|@|[^\W\d_a-z]+")
# what may be one of those before it is folded, and where a sentence ends
_CHUNK = re.compile(r"[\w\u0300-\u036f$@*]+|[.!?;](?=\s)|[.!?](?=[A-ZÁÉÍÓÚÄÖÜÀÈÇ])|\n")
_ENDS = frozenset(".!?;\n")
_LINE = re.compile(r"(?:^|\n)\s*>+ ?|-\n\s*(?=[a-zß-ÿ])")


def _words(chunk: str) -> tuple[str, ...] | None:
    """The plain words of a run of letters, digits and signs; None ends a sentence."""
    if chunk in _ENDS:
        return None
    return tuple(w if w.isalpha() or "*" in w else "0" if w.isdigit() else w.translate(_LEET) for w in _TOKEN.findall(fold(chunk)))


class Memo(dict):
    """What a function says of each chunk, found once; forgotten when there are many."""

    def __init__(self, say, most: int = 500_000):
        self.say, self.most = say, most

    def __missing__(self, chunk):
        if len(self) >= self.most:
            self.clear()
        got = self[chunk] = self.say(chunk)
        return got


_UNITS = Memo(_words)


def units(text: str, memo: Memo = _UNITS) -> list[list]:
    """The text as runs of plain words (or of what ``memo`` makes of them): sentences, and
    windows over long ones, since without punctuation a sentence runs into the next. A
    sentence of one word belongs to the one after it, or before it at the end. Disguises
    are undone: look-alike and invisible letters, broken encodings, letters with dots or
    spaces between, digits and signs for letters. Words with stars keep them."""
    s = delook(repair(text))
    if "\\relative" in s:
        s = _NOTATION.sub(" ", s)
    if "<" in s or "://" in s:
        s = _CODE.sub(" ", s)
    if "\n" in s or s.startswith(">"):
        s = _LINE.sub(" ", s)
    if _MAY_DOT.search(s):
        s = _DOTTED.sub(lambda m: re.sub(r"[.\-_*·]", "", m.group()) + (" ." if m.group().endswith("..") else ""), s)
    if _MAY_SPACE.search(s):
        s = _SPACED.sub(lambda m: m.group().replace(" ", ""), s)
    parts: list[list] = []
    words: list = []
    for chunk in _CHUNK.findall(s):
        got = memo[chunk]
        if got is not None:
            words += got
        elif len(words) > 1:
            parts.append(words)
            words = []
    if len(words) > 1 or words and not parts:
        parts.append(words)
    elif words:
        parts[-1] = parts[-1] + words
    out = []
    for words in parts:
        if len(words) <= LONG:
            out.append(words)
        else:
            out += [words[i : i + WINDOW] for i in range(0, len(words) - WINDOW + STRIDE, STRIDE)]
    return out


class Lexicon:
    """The words of the examples; brings misspelt and starred words back to them."""

    def __init__(self, counts: Counter):
        self.counts = counts
        self.near: dict[str, list[str]] = defaultdict(list)
        self.starred: dict[tuple, list[str]] = defaultdict(list)
        for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if len(w) >= 5:
                for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    self.near[k].append(w)
            if len(w) >= 3:
                self.starred[(w[0], len(w), w[-1])].append(w)
                self.starred[(w[0], len(w), "")].append(w)
        self.memo: dict[str, str] = {}

    def touches(self, w: str) -> bool:
        """Whether ``plain`` might take ``w`` for a misspelling."""
        return len(w) >= 5 and w not in self.counts and "*" not in w and (w in self.near or any(w[:i] + w[i + 1 :] in self.near for i in range(len(w))))

    def neighbours(self, w: str) -> set[str]:
        """The words about one edit away."""
        return {v for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in self.near.get(k, ()) if abs(len(v) - len(w)) <= 1}

    def plain(self, w: str) -> str:
        if w in self.counts or len(w) < 4 and "*" not in w:
            return w
        got = self.memo.get(w)
        if got is None:
            got = w
            if "*" in w:
                hits = self.starred.get((w[0], len(w), "" if w[-1] == "*" else w[-1]), ())
                got = hits[0] if hits else "*"
            elif len(w) >= 5:
                best = self.neighbours(w)
                if best:
                    got = max(best, key=lambda v: (self.counts[v], v))
            if len(self.memo) < 500_000:
                self.memo[w] = got
        return got


def word_id(w: str) -> int:
    """A number for a word, the same everywhere."""
    return crc32(w.encode()) + 1


def ids(rows: list[list[str]]) -> list[list[int]]:
    known = Memo(word_id)
    return [[known[w] for w in r] for r in rows]


def terms(rows: list[list[int]]) -> np.ndarray:
    """For each run of words, as numbers, its hashed words, neighbouring pairs and pairs
    one apart, each once; the rest is slot 0, whose weights are kept at nought."""
    sizes = np.array([len(r) for r in rows], int)
    most = max(1, int(sizes.max(initial=1)))
    h = np.zeros((len(rows), most), np.uint64)
    h[np.arange(most) < sizes[:, None]] = [w for r in rows for w in r]
    cols = [h * _MIX[0]]
    for gap in (1, 2):
        if most > gap:
            a, b = h[:, :-gap], h[:, gap:]
            cols.append(np.where((a > 0) & (b > 0), a * _MIX[gap] + b * _MIX[3] + np.uint64(gap), np.uint64(0)))
    t = np.concatenate(cols, 1)
    t = np.where(t > 0, (t ^ (t >> np.uint64(31))) * _MIX[4] >> np.uint64(20), np.uint64(0)) % np.uint64(SLOTS - 1) + (t > 0)
    t = -np.sort(-t.astype(np.int32), axis=1)
    t = t[:, : max(1, int((t > 0).sum(1).max(initial=1)))]
    t[:, 1:][t[:, 1:] == t[:, :-1]] = 0
    return t


class Machine:
    """A factorization machine: bias + sum of weights + sum over pairs of terms of the
    product of their factor vectors, through a logistic. The pair sum is taken in
    linear time. Trained by AdaGrad on mini-batches in a fixed order."""

    def __init__(self, rng: np.random.Generator):
        self.bias = 0.0
        self.w = np.zeros(SLOTS, np.float32)
        self.v = rng.normal(0, 0.05, (SLOTS, FACTORS)).astype(np.float32)
        self.v[0] = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        v = self.v[x]
        s = v.sum(1)
        return self.bias + self.w[x].sum(1) + 0.5 * (s * s - (v * v).sum(1)).sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))

    def fit(self, x_all: np.ndarray, labels: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS) -> None:
        gw, gv, gb = np.full(SLOTS, 1e-6, np.float32), np.full((SLOTS, FACTORS), 1e-6, np.float32), 1e-6
        order, lengths = np.arange(len(x_all)), x_all.shape[1] - (x_all[:, ::-1] > 0).argmax(1)
        for _ in range(epochs):
            rng.shuffle(order)
            batches = []
            for at in range(0, len(order), 32 * BATCH):
                # batches of like length waste little on filling up
                part = order[at : at + 32 * BATCH]
                part = part[np.argsort(lengths[part], kind="stable")]
                batches += np.split(part, range(BATCH, len(part), BATCH))
            for k in rng.permutation(len(batches)):
                pick = batches[k]
                x = x_all[pick, : max(1, int(lengths[pick].max()))]
                v = self.v[x]
                s = v.sum(1)
                m = self.bias + self.w[x].sum(1) + 0.5 * (s * s - (v * v).sum(1)).sum(1)
                e = (1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[pick]).astype(np.float32) / 16
                self_slots, where = np.unique(x, return_inverse=True)
                where = where.reshape(-1)
                dw = np.bincount(where, np.repeat(e, x.shape[1]), len(self_slots)).astype(np.float32)
                full = (e[:, None, None] * (s[:, None, :] - v)).reshape(-1, FACTORS)
                dv = np.stack([np.bincount(where, full[:, f], len(self_slots)) for f in range(FACTORS)], 1).astype(np.float32)
                dw += DECAY * self.w[self_slots]
                dv += DECAY * self.v[self_slots]
                gw[self_slots] += dw * dw
                gv[self_slots] += dv * dv
                self.w[self_slots] -= RATE * dw / np.sqrt(gw[self_slots])
                self.v[self_slots] -= RATE * 0.5 * dv / np.sqrt(gv[self_slots])
                db = float(e.sum())
                gb += db * db
                self.bias -= RATE * db / gb**0.5
                self.w[0] = 0
                self.v[0] = 0


class Filter:
    """The trained machine with its lexicon; scores texts."""

    def __init__(self, machine: Machine, lexicon: Lexicon):
        self.machine, self.lexicon = machine, lexicon
        self.memo = Memo(self._ids)

    def _ids(self, chunk: str) -> tuple[int, ...] | None:
        words = _words(chunk)
        return None if words is None else tuple(word_id(self.lexicon.plain(w)) for w in words)

    def __getstate__(self) -> tuple:
        return self.machine, self.lexicon

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the highest probability of its parts; 0 without words."""
        rows, owner = [], []
        for i, t in enumerate(texts):
            if t:
                r = units(t, self.memo)
                rows += r
                owner += [i] * len(r)
        out = np.zeros(len(texts))
        owners = np.array(owner, int)
        by_length = np.argsort(np.array([len(r) for r in rows], int), kind="stable")
        for at in range(0, len(rows), 4096):
            pick = by_length[at : at + 4096]
            np.maximum.at(out, owners[pick], self.machine.probability(terms([rows[k] for k in pick])))
        return out

    def parts(self) -> list[tuple[str, bytes]]:
        """The filter as named pieces of bytes."""
        m = self.machine
        words = json.dumps(sorted(self.lexicon.counts.items())).encode()
        return [("bias", np.float64(m.bias).tobytes()), ("w", m.w.tobytes()), ("v", m.v.tobytes()), ("words", words)]

    @staticmethod
    def of_parts(parts: dict[str, bytes]) -> Filter:
        m = Machine(np.random.default_rng(0))
        m.bias = float(np.frombuffer(parts["bias"], np.float64)[0])
        m.w = np.frombuffer(parts["w"], np.float32).copy()
        m.v = np.frombuffer(parts["v"], np.float32).reshape(SLOTS, FACTORS).copy()
        return Filter(m, Lexicon(Counter(dict(json.loads(parts["words"])))))


def example_units(seed: int = SEED, per_template: int = PER_TEMPLATE) -> tuple[list[list[str]], list[int]]:
    """The examples as runs of plain words, with their labels."""
    pairs = abuse_examples.examples(per_template, seed)
    rng = random.Random(seed)
    rows_words: list[list[str]] = []
    labels: list[int] = []
    plain = [s for s, y in pairs if not y]
    for s, y in pairs:
        for text in (s, s + " " + rng.choice(plain)) if rng.random() < 0.3 else (s,):
            # run into its neighbour as where punctuation is lost
            text = re.sub(r"[.,!?:;]", "", text) if rng.random() < 0.25 else text
            for u in units(text):
                rows_words.append(u)
                labels.append(y)
    for s in plain:
        # and harmless pieces, since texts break off anywhere
        words = [w for u in units(s) for w in u]
        if words:
            a = rng.randrange(len(words))
            rows_words.append(words[a : a + rng.randint(1, 4)])
            labels.append(0)
    return rows_words, labels


def example_counts(rows_words: list[list[str]]) -> Counter:
    return Counter(w for u in rows_words for w in u if "*" not in w)


def ordinary(counts: dict[str, int], n_docs: int, lexicon: Lexicon) -> Counter:
    """Of words counted in ``n_docs`` documents those near a word of ``lexicon`` that
    are words themselves and no misspellings: seen ``COMMON`` times, and either that
    often in every ``SAMPLE_DOCS`` documents or no fewer than ``PEER`` times as often as
    any word they could be taken for. Both are rates, so the size of the corpus doesn't
    matter. With how often they occur in ``SAMPLE_DOCS`` documents, if there are more."""
    scale = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    return Counter({w: max(1, round(n * scale)) for w, n in counts.items() if n >= COMMON and lexicon.touches(w) and (n * scale >= COMMON or n >= PEER * max((counts.get(v, 0) for v in lexicon.neighbours(w)), default=0))})


# letters with marks, by the letter they are a form of
_MARKED = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xDF, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].isascii() and unicodedata.normalize("NFKD", chr(c))[0].isalpha()}


def common_words(docs: DataFrame, seed: int = SEED, per_template: int = PER_TEMPLATE) -> Counter:
    """The ``ordinary`` words of the whole corpus. Every document is counted, whole, by
    column expressions and before the shuffle; what is gathered are words of the
    examples and those one edit away, whatever the corpus."""
    lexicon = Lexicon(example_counts(example_units(seed, per_template)[0]))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def near(batches):
        known = shared.value
        for pdf in batches:
            yield pdf[[w in known.counts or known.touches(w) for w in pdf["word"]]]

    # words are told apart first and folded then: there are fewer of them than text
    words = docs.where("text <> ''").select(F.explode(F.split(F.lower("text"), "[^a-zß-ɏ]+")).alias("raw")).where("length(raw) >= 5")
    plain = F.translate(F.replace("raw", F.lit("ß"), F.lit("ss")), "".join(_MARKED), "".join(_MARKED.values()))
    counted = words.groupBy("raw").agg(F.count("*").alias("n")).groupBy(plain.alias("word")).agg(F.sum("n").alias("n"))
    counted = counted.where(f"n >= {COMMON}").mapInPandas(near, "word string, n long")
    return ordinary({r.word: r.n for r in counted.collect()}, docs.count(), lexicon)


def train(harmless: list[str], seed: int = SEED, per_template: int = PER_TEMPLATE, common: Counter | None = None) -> Filter:
    """A filter from the examples and a bounded sample of the corpus. The corpus has
    no labels: a first machine, of the examples alone, leaves out of the sample what
    it finds likely to be abusive; the second takes the rest as harmless. ``common``
    are the corpus's ``common_words``; without them those of the sample are taken."""
    rows_words, labels = example_units(seed, per_template)
    counts = example_counts(rows_words)
    sample = [u for t in harmless for u in units(t)][:SAMPLE_UNITS]
    if common is None:
        common = Counter({w: n for w, n in Counter(w for u in sample for w in u).items() if n >= COMMON})
    first_lexicon = Lexicon(counts)
    np_rng = np.random.default_rng(seed)

    def hide(u: list[str]) -> list[str]:
        """Some words of a bad example left out, so that it doesn't hang on one."""
        return [w for w in u if np_rng.random() > 0.12] or u

    rows = [hide(u) if y else u for u, y in zip(rows_words, labels)]
    y = np.array(labels, np.float32)
    first = Machine(np.random.default_rng(seed))
    first.fit(terms(ids(rows)), y, np.random.default_rng(seed + 1), 4)
    mapped = [[first_lexicon.plain(w) for w in u] for u in sample]
    p = np.concatenate([first.probability(terms(ids(mapped[i : i + 4096]))) for i in range(0, len(mapped), 4096)]) if mapped else np.zeros(0)
    kept = [u for u, q in zip(sample, p) if q < 0.5]
    cut = random.Random(seed)
    pieces = []
    for u in kept:
        a = cut.randrange(len(u))
        pieces.append(u[a : a + cut.randint(1, 5)])
    kept += pieces
    # common words of the corpus are themselves and not misspellings of the examples'
    lexicon = Lexicon(counts + common)
    rows += [[lexicon.plain(w) for w in u] for u in kept]
    y = np.concatenate([y, np.zeros(len(kept), np.float32)])
    machine = Machine(np.random.default_rng(seed))
    machine.fit(terms(ids(rows)), y, np.random.default_rng(seed + 2))
    return Filter(machine, lexicon)


def sample_texts(docs: DataFrame, most: int = SAMPLE_DOCS) -> list[str]:
    """At most ``most`` texts, chosen by a hash of their id, cut to 4,000 letters. Only
    the training sample is bounded; every document is scored whole."""
    chosen = docs.where("text is not null").select("doc_id", F.substring("text", 1, 4000).alias("text")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return [r.text for r in chosen.collect()]


def fitted(spark: SparkSession, base: str) -> Filter:
    """The filter for the documents below ``base``: fitted once and kept in the shared
    folder, until the documents, the examples or the parameters change."""
    made_of = [*stamped_files(spark, f"{base}/documents.parquet"), *(repr(t) for t in (abuse_examples.SLOTS, abuse_examples.BAD, abuse_examples.GOOD, abuse_examples.PLAIN))]
    made_of.append(repr((SLOTS, FACTORS, PER_TEMPLATE, SAMPLE_DOCS, SAMPLE_UNITS, COMMON, PEER, EPOCHS, BATCH, RATE, DECAY, SEED, FORM)))
    store = VersionedStore(f"{kept_folder(spark)}/abuse_filter/{md5(chr(10).join(made_of).encode()).hexdigest()}")
    kept = store.read(spark)
    if kept is not None:
        return Filter.of_parts({r.name: bytes(r.body) for r in kept.collect()})  # four parts of fixed size
    docs = table(spark, base, "documents", ["doc_id", "text"])
    model = train(sample_texts(docs), common=common_words(docs))
    store.write(spark.createDataFrame(model.parts(), "name string, body binary").coalesce(1), 0)
    return model


def scored(docs: DataFrame, model: Filter | None = None) -> DataFrame:
    """(doc_id, source, score): the probability that the text abuses, threatens,
    degrades, hates or is sexually explicit, that of its worst part. Null, empty and
    blank texts score 0. The texts are never shuffled; the filter (some 8 MB whatever
    the corpus) goes to the workers once."""
    spark = docs.sparkSession
    model = model or train(sample_texts(docs), common=common_words(docs))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        f = shared.value
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "score": np.round(f.scores(list(part["text"])), 4)})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double")


def _docs(spark, base):
    return spread(table(spark, base, "documents", ["doc_id", "source", "text"]))


def p10_found(spark: SparkSession, base: str) -> DataFrame:
    return scored(_docs(spark, base), fitted(spark, base)).where(F.col("score") >= EXCLUDE).select("doc_id").distinct()


def p10_scores(spark: SparkSession, base: str) -> DataFrame:
    return scored(_docs(spark, base), fitted(spark, base)).select("doc_id", "score", (F.col("score") >= EXCLUDE).alias("exclude"))


def p10_rates(spark: SparkSession, base: str) -> DataFrame:
    """Share of documents to exclude, per source."""
    s = scored(_docs(spark, base), fitted(spark, base))
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum((F.col("score") >= EXCLUDE).cast("int")).alias("n_exclude"), F.round(F.avg((F.col("score") >= EXCLUDE).cast("double")), 6).alias("rate"))
