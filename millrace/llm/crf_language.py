"""Language of words and documents by a linear-chain conditional random field.

The features of a word are its byte bigrams and trigrams with their edges
(n-grams), its first and last two, three and four bytes (affixes), and itself
(a learned lexicon), hashed into one weight table; transitions between the
labels of neighbouring words are learned with them. The training sequences are
spliced from passages of documents of different languages, so the transitions
learn how often a text switches.

A text's words are labelled by forward-backward. The recursions run over a grid
of short chunks of all texts at once: a first pass gives the transfer matrix of
every chunk, the chunks of a text are chained, and a second pass fills in the
marginals. That is exact, whatever the length of a text.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_few, ship, table
from .words import U64, Words, slices, text_buffer, trim_memory

FEATURES = 1 << 16
#: Bounds of the training sample: rows in all, and characters of each.
SAMPLE_ROWS, SAMPLE_CHARS = 2000, 6000
#: Most labels that a model learns: the most frequent ones.
LABELS = 128
FOLDS = 5
#: Bytes of text whose features are in memory at once (a longer text goes alone).
SLICE_TEXT = 1 << 17
_CHUNK = 32


def _fold(raw: np.ndarray, off: np.ndarray) -> Words:
    """Words with A-Z and the Latin-1 capitals of UTF-8 lower-cased."""
    words = Words(raw, off, punct=True)
    low = words.folded.copy()
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    words.folded = low
    return words


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    x = x.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(kind * 0x85EBCA6B & 0xFFFFFFFF)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return (x >> np.uint32(16)).astype(np.int32)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature slots, offsets by word): each word's features lie together."""
    n = words.n
    if not n:
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    s, e = words.starts, words.ends
    size = e - s
    # The words' bytes with a blank before and after each, end to end.
    at = np.cumsum(size + 2) - (size + 2)
    flat = np.full(int(at[-1] + size[-1] + 2) + 2, 32, np.uint32)
    where = np.arange(int(size.sum())) + np.repeat(at + 1 - (np.cumsum(size) - size), size)
    take = np.arange(int(size.sum())) + np.repeat(s - (np.cumsum(size) - size), size)
    flat[where] = words.folded[take]
    two = flat[:-1] << np.uint32(8) | flat[1:]
    three = two[:-1] << np.uint32(8) | flat[2:]
    gram2, gram3 = _slot(two, 1), _slot(three, 2)
    # Of each word: bigrams size+1, trigrams size, then six affixes and the lexicon entry.
    end = at + size + 1
    grab = lambda i: flat[np.clip(i, 0, len(flat) - 1)]
    pre2 = grab(at + 1) << np.uint32(8) | grab(at + 2)
    pre3 = pre2 << np.uint32(8) | grab(np.minimum(at + 3, end))
    pre4 = pre3 << np.uint32(8) | grab(np.minimum(at + 4, end))
    suf2 = grab(end - 2) << np.uint32(8) | grab(end - 1)
    suf3 = grab(np.maximum(end - 3, at)) << np.uint32(16) | suf2
    suf4 = grab(np.maximum(end - 4, at)) << np.uint32(24) | suf3
    lexicon = (words.hashes() >> U64(32)).astype(np.uint32)
    fixed = np.stack([_slot(pre2, 3), _slot(pre3, 4), _slot(pre4, 5), _slot(suf2, 6), _slot(suf3, 7), _slot(suf4, 8), _slot(lexicon, 9)], 1)
    count = 2 * size + 1 + fixed.shape[1]
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(first[-1]), np.int32)

    def place(grams: np.ndarray, many: np.ndarray, shift: np.ndarray) -> None:
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(first[:-1] + shift, many) + step] = grams[np.repeat(at, many) + step]

    place(gram2, size + 1, np.zeros(n, np.int64))
    place(gram3, size, size + 1)
    out[(first[1:] - fixed.shape[1])[:, None] + np.arange(fixed.shape[1])] = fixed
    return out, first


def _grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks by text, and the text of each chunk."""
    chunks = -(-lengths // _CHUNK)
    return chunks, np.repeat(np.arange(len(lengths)), chunks)


def marginals(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word; ``emit`` (words, labels) scores, ``first`` offsets by text."""
    return forward_backward(emit, first, trans, start)[0]


def forward_backward(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities, forward vectors up to a factor) of each word."""
    total, k = emit.shape
    if not total:
        return np.empty((0, k)), np.empty((0, k))
    lengths = np.diff(first)
    texts = np.flatnonzero(lengths)
    lengths, begin = lengths[texts], first[:-1][texts]
    chunks, text = _grid(lengths)
    c0 = np.cumsum(chunks) - chunks
    nth = np.arange(len(text)) - c0[text]
    pos = begin[text][:, None] + nth[:, None] * _CHUNK + np.arange(_CHUNK)
    inside = nth[:, None] * _CHUNK + np.arange(_CHUNK) < lengths[text][:, None]
    score = np.exp(emit - emit.max(1, keepdims=True))
    grid = np.where(inside[:, :, None], score[np.where(inside, pos, 0)], 1.0)
    t = np.exp(trans - trans.max())
    head = nth == 0
    n = len(text)

    def scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
        return x / x.max(axis=axes, keepdims=True)

    # Transfer of each chunk: row vector in, row vector out (forward); the same matrix serves backward.
    m = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for j in range(_CHUNK):
        step = (m.reshape(-1, k) @ t).reshape(n, k, k)
        if j == 0:
            step[head] = m[head]
        step = scaled(step * grid[:, j][:, None, :], (1, 2))
        live = inside[:, j]
        m = np.where(live[:, None, None], step, m) if not live.all() else step
    into = np.empty((n, k))
    back = np.empty((n, k))
    most = int(chunks.max())
    into[c0] = np.exp(start - start.max())
    for i in range(1, most):
        own = c0[chunks > i] + i
        into[own] = scaled(np.einsum("ni,nij->nj", into[own - 1], m[own - 1]), (1,))
    last = c0 + chunks - 1
    back[last] = 1.0
    for i in range(1, most):
        own = last[chunks > i] - i
        back[own] = scaled(np.einsum("nij,nj->ni", m[own + 1], back[own + 1]), (1,))
    forward = np.empty((n, _CHUNK, k))
    a = into
    for j in range(_CHUNK):
        step = a @ t
        if j == 0:
            step[head] = a[head]
        step = scaled(step * grid[:, j], (1,))
        a = np.where(inside[:, j][:, None], step, a)
        forward[:, j] = a
    out = np.empty((n, _CHUNK, k))
    b = back
    # ``back`` of a chunk is the backward vector after its last word, seen from the next
    # chunk's matrix; within the chunk it steps down word by word.
    for j in range(_CHUNK - 1, -1, -1):
        live = inside[:, j][:, None]
        out[:, j] = forward[:, j] * b
        b = np.where(live, scaled((grid[:, j] * b) @ t.T, (1,)), b)
    flat = out[inside]
    flat /= flat.sum(1, keepdims=True)
    res, ahead = np.empty((total, k)), np.empty((total, k))
    res[pos[inside]], ahead[pos[inside]] = flat, forward[inside]
    return res, ahead


class Model:
    """Weights of features and transitions for ``labels``."""

    def __init__(self, labels: list[str], slots: int = FEATURES) -> None:
        self.labels = labels
        k = len(labels)
        self.weights = np.zeros((slots, k), np.float32)
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: Words) -> np.ndarray:
        slots, first = features(words)
        if not words.n:
            return np.zeros((0, len(self.labels)))
        return np.add.reduceat(self.weights[slots], first[:-1], axis=0).astype(np.float64)

    def words(self, words: Words) -> np.ndarray:
        return marginals(self.emissions(words), words.first, self.trans, self.start)

    def texts(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Label with the largest mean probability over a text's words, and that mean."""
        return self.judged(texts)[:2]

    def judged(self, texts: pa.Array) -> tuple[list[str], list[float], list[float]]:
        """What ``texts`` gives, and the mean over a text's words of the probability of each word's own best label."""
        names, scores, sure = [], [], []
        for i, j, raw, off in slices(texts, SLICE_TEXT):
            words = _fold(raw, off)
            sums = np.zeros((words.texts, max(1, len(self.labels))))
            each = np.zeros(words.texts)
            if self.labels and words.n:
                p = self.words(words)
                full = np.flatnonzero(words.counts)
                sums[full] = np.add.reduceat(p, words.first[:-1][full], axis=0) / words.counts[full, None]
                each[full] = np.add.reduceat(p.max(1), words.first[:-1][full]) / words.counts[full]
            letters = _has_letter(words, texts.slice(i, j - i))
            best = sums.argmax(1)
            for d in range(words.texts):
                if letters[d] and words.counts[d] and self.labels:
                    names.append(self.labels[best[d]])
                    scores.append(min(1.0, float(sums[d, best[d]])))
                    sure.append(min(1.0, float(each[d])))
                else:
                    names.append("und")
                    scores.append(0.0)
                    sure.append(0.0)
        return names, scores, sure


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _has_letter(words: Words, texts: pa.Array) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTER[words.raw])])
    out = seen[words.off[1:]] > seen[words.off[:-1]]
    for d in np.flatnonzero(~out & (np.diff(words.off) > 0)):
        out[d] = any(unicodedata.category(c)[0] == "L" for c in texts[int(d)].as_py() or "")
    return out


def splice(passages: list[tuple[int, Words]], sequences: int, length: int, rng: np.random.Generator) -> list[list[tuple[int, int, int]]]:
    """Training sequences: up to four stretches (passage, first word, end) of different passages."""
    by_label: dict[int, list[int]] = {}
    for i, (y, w) in enumerate(passages):
        if w.n:
            by_label.setdefault(y, []).append(i)
    labels = sorted(by_label)
    out = []
    for _ in range(sequences if labels else 0):
        row = []
        parts = int(rng.integers(1, 5))
        for _ in range(parts):
            i = int(rng.choice(by_label[labels[int(rng.integers(len(labels)))]]))
            n = passages[i][1].n
            size = int(min(n, max(1, rng.integers(1, 2 * length // parts))))
            a = int(rng.integers(0, n - size + 1))
            row.append((i, a, a + size))
        out.append(row)
    return out


def train(rows: list[tuple[str, str]], sequences: int = 2400, length: int = 40, epochs: int = 4, rate: float = 0.25, seed: int = 7) -> Model:
    """Fit a model to ``rows`` of (label, text) by adaptive gradient steps on the log likelihood."""
    labels = sorted({y for y, _ in rows})
    model = Model(labels)
    k = len(labels)
    if not k:
        return model
    rng = np.random.default_rng(seed)
    place = {y: i for i, y in enumerate(labels)}
    passages = [(place[y], _fold(*text_buffer(pa.array([t], pa.string())))) for y, t in sorted(rows)]
    feats = [features(w) for _, w in passages]
    plan = splice(passages, sequences, length, rng)
    seen_w, seen_t, seen_s = np.full(model.weights.shape, 1e-3, np.float32), np.full((k, k), 1e-3), np.full(k, 1e-3)
    batch = 60
    for _ in range(epochs if plan else 0):
        order = rng.permutation(len(plan))
        for b in range(0, len(order), batch):
            slots, sizes, gold, first = [], [], [], [0]
            for q in order[b : b + batch]:
                for i, a, e in plan[q]:
                    f, at = feats[i]
                    slots.append(f[at[a] : at[e]])
                    sizes.append(np.diff(at[a : e + 1]))
                    gold.append(np.full(e - a, passages[i][0]))
                first.append(first[-1] + sum(e - a for _, a, e in plan[q]))
            s, size, y, bounds = np.concatenate(slots), np.concatenate(sizes), np.concatenate(gold), np.array(first)
            word_at = np.cumsum(size) - size
            emit = np.add.reduceat(model.weights[s], word_at, axis=0).astype(np.float64)
            p, ahead = forward_backward(emit, bounds, model.trans, model.start)
            err = -p
            err[np.arange(len(y)), y] += 1.0
            touched, inverse = np.unique(s, return_inverse=True)
            by = np.repeat(np.arange(len(y)), size)
            grad = np.stack([np.bincount(inverse, weights=err[by, c], minlength=len(touched)) for c in range(k)], 1) / batch
            grad -= 1e-5 * model.weights[touched]
            seen_w[touched] += grad**2
            model.weights[touched] += (rate * grad / np.sqrt(seen_w[touched])).astype(np.float32)
            inner = np.ones(len(y), bool)
            inner[bounds[:-1]] = False
            right = np.flatnonzero(inner)
            pair = transitions(p, ahead, right, model.trans)
            real = np.zeros((k, k))
            np.add.at(real, (y[right - 1], y[right]), 1.0)
            g = (real - pair) / batch
            seen_t += g**2
            model.trans += rate * g / np.sqrt(seen_t)
            heads = bounds[:-1]
            g = (np.bincount(y[heads], minlength=k) - p[heads].sum(0)) / batch
            seen_s += g**2
            model.start += rate * g / np.sqrt(seen_s)
    return model


def transitions(p: np.ndarray, ahead: np.ndarray, right: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected transitions into the words ``right``, by forward-backward.

    A pair's joint is forward(left) * transition * emission(right) *
    backward(right), and a word's probability is (forward(left) @ transition) *
    emission * backward: so the last two come from the probabilities.
    """
    a, t = ahead[right - 1], np.exp(trans - trans.max())
    rest = p[right] / np.maximum(a @ t, 1e-300)
    return t * (a.T @ rest)


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, labels: int = LABELS) -> list[tuple[str, str]]:
    """A bounded sample of the labelled documents outside the held-out fold; none gives an empty list.

    Of the ``labels`` most frequent languages (ties by name) equally many
    documents each, ``rows`` in all at most, chosen by a hash of their id; of a
    longer text one stretch of ``chars`` characters at a place that the hash
    gives. Rows that repeat a document and its label count once.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where((fold("doc_id") != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", F.lit("train")))
    counts = known.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(min(labels, rows)).collect()
    if not counts:
        return []
    each = max(1, rows // len(counts))
    # A hash threshold for each language, before any exchange, leaves about twice the sample however many rows there are.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, 2.0 * each / r.rows)])
    few = known.where(F.col("h") / 2.0**64 + 0.5 < F.coalesce(F.element_at(share, F.col("lang")), F.lit(0.0))).select("lang", "h", "doc_id").distinct().collect()
    taken: dict[str, list[int]] = {}
    for lang, _, doc_id in sorted(few):
        if len(taken.setdefault(lang, [])) < each:
            taken[lang].append(doc_id)
    ids = docs.sparkSession.createDataFrame([(d, y) for y, ds in taken.items() for d in ds], "doc_id long, lang string")
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.char_length("text") - chars + 1)).cast("int") + 1
    # ``ids`` holds at most ``rows`` rows.
    got = known.join(F.broadcast(ids), ["doc_id", "lang"]).select("doc_id", "lang", F.substr("text", at, F.lit(chars)).alias("text"))
    return [(r.lang, r.text) for r in got.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, from its text alone."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = sent.value.texts(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        trim_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language.

    Rejected are texts that are ``und`` and texts whose words' best labels, each
    word's own, hold less than ``least`` of the probability on average: a text
    in several languages stays where its words are labelled with confidence.
    """
    ship(docs.sparkSession)
    read_few(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, _, sure = sent.value.judged(b.column(at))
            yield b.filter(pa.array([n != "und" and s >= least for n, s in zip(names, sure)], pa.bool_()))
        trim_memory()

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from ``docs(doc_id, text, lang)`` and predict every text's language.

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text where nothing is labelled. A null doc_id is never learned from and not
    held out. Repeated rows get a row each; extra columns are ignored.
    """
    return predict(docs, train(training_rows(docs)))


def op5_crf_language(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS
