"""Toxicity scores from a counterfactual-regularised linear classifier."""

from __future__ import annotations

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import binary_views, small_batches, table, text_of, worker_state

# Group terms by language, whose exchange must not change a score.
IDENTITY = {
    "en": (
        "women men girls boys woman man muslim muslims christian christians jewish jews hindu buddhist catholic protestant atheist "
        "gay lesbian bisexual transgender straight black white asian african american european latino hispanic arab indian chinese "
        "mexican immigrant immigrants refugee refugees disabled deaf blind old young elderly people"
    ).split(),
    "de": "frauen männer mädchen jungen frau mann muslim muslime christ christen jude juden hindu buddhist atheist schwul lesbisch schwarze weiße asiaten afrikaner amerikaner türken araber polen einwanderer flüchtling flüchtlinge behinderte gehörlose blinde alte junge leute".split(),
    "fr": "femmes hommes filles garçons femme homme musulman musulmans chrétien chrétiens juif juifs hindou bouddhiste athée gay lesbienne noirs blancs asiatiques africains américains arabes chinois immigré immigrés réfugié réfugiés handicapés sourds aveugles vieux jeunes gens".split(),
    "es": "mujeres hombres chicas chicos mujer hombre musulmán musulmanes cristiano cristianos judío judíos hindú budista ateo gay lesbiana negros blancos asiáticos africanos americanos árabes chinos inmigrante inmigrantes refugiado refugiados discapacitados sordos ciegos viejos jóvenes gente".split(),
}
GROUPS = [[t.encode() for t in terms] for terms in IDENTITY.values()]
PLACES = {t: (g, i) for g, terms in enumerate(GROUPS) for i, t in reversed(list(enumerate(terms)))}
SENTENCE = re.compile(rb"[.!?\n]+")
CUT = 0.3
SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))
CACHE = 200_000


def features(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings, so that inflected forms share evidence."""
    n = len(word)
    return [zlib.crc32(word)] + [zlib.crc32(b"^" + word[:k]) for k in (5, 6, 7, 8) if n > k]


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def counted(view) -> np.ndarray:
    """Feature hashes over a text's distinct words, each as often as distinct words have it."""
    words = set(bytes(view).translate(SEPARATORS).split())
    return np.array([h for w in sorted(words) for h in features(w)], np.uint32)


def swapped(view) -> np.ndarray:
    """What the swap of a group term in one sentence changes in a text's features: for each term of
    each sentence and one other of its language, drawn by the sentence, the features that come
    (number << 33 | hash) and that go (with bit 32). Swaps that change alike count once a text."""
    sentences = [set(x.translate(SEPARATORS).split()) for x in SENTENCE.split(bytes(view))]
    named = [(words, words & PLACES.keys()) for words in sentences]
    if not any(terms for _, terms in named):
        return np.zeros(0, np.uint64)
    often = collections.Counter(w for words in sentences for w in words)
    out: dict[tuple[bytes, bytes, bool], None] = {}
    for words, terms in named:
        for t in sorted(terms):
            group, i = PLACES[t]
            others = GROUPS[group]
            to = others[(i + 1 + zlib.crc32(b" ".join(sorted(words))) % (len(others) - 1)) % len(others)]
            out[t, to, often[t] == 1] = None
    rows = []
    for k, (t, to, goes) in enumerate(out):
        rows += [(k << 33) | h for h in features(to) if to not in often]
        rows += [(k << 33) | (1 << 32) | h for h in features(t) if goes]
    return np.array(rows, np.uint64)


class Linear:
    """Weights by feature hash, summed over a text's distinct words, and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.weights = dict(zip(hashes.tolist(), weights.tolist()))
        self.bias, self.cache = bias, {}

    def word(self, word: bytes) -> float:
        got = self.weights.get
        return sum(got(h, 0.0) for h in features(word))

    def score(self, view) -> float:
        cache = self.cache
        words = set(bytes(view).translate(SEPARATORS).split())
        values = list(map(cache.get, words))
        if None in values:
            if len(cache) > CACHE:
                cache.clear()
            values = [v if v is not None else cache.setdefault(w, self.word(w)) for w, v in zip(words, values)]
        z = self.bias + sum(sorted(values))  # sorted: the same sum in every order of the set
        return float(1.0 / (1.0 + np.exp(-min(max(z, -40.0), 40.0))))


def hopeful(rows: list[np.ndarray], labels: np.ndarray, least_df: int, always: np.ndarray, bits: int = 22) -> list[np.ndarray]:
    """Each row's features whose bin of hashes is frequent and telling enough to be chosen;
    counted row by row, so that memory does not follow the sum of all rows."""
    mask = np.uint32((1 << bits) - 1)
    df, pos = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
    for row, label in zip(rows, labels):
        bins = np.unique(row & mask)
        df[bins] += 1
        pos[bins] += label
    rate = float(labels.mean()) if len(labels) else 0.1
    good = (df >= least_df) & (np.abs(pos - df * rate) > 1.5 * np.sqrt(df * rate * (1 - rate)))
    good[always & mask] = True
    return [row[good[row & mask]] for row in rows]


def fit(rows: list[np.ndarray], labels: np.ndarray, swaps: list[np.ndarray], most: int = 30_000, least_df: int = 4, rounds: int = 300, l2: float = 2e-4, swap: float = 1.0) -> Linear:
    """Logistic regression whose loss adds swap * mean (score change)^2 over counterfactual
    pairs: labelled texts with a group term swapped in one sentence (``swapped``), and each
    term by itself swapped for the next of its language (a neutral mention)."""
    names = [zlib.crc32(t) for t in PLACES]
    rows = hopeful(rows, labels, least_df, np.array(names, np.uint32))
    lens = np.array([len(r) for r in rows], int)
    flat = np.concatenate(rows) if lens.sum() else np.zeros(0, np.uint32)
    doc = np.repeat(np.arange(len(rows)), lens)
    vocab, col = np.unique(flat, return_inverse=True)
    pair = np.unique(doc.astype(np.int64) * max(1, len(vocab)) + col)  # presence: count a feature once a text
    p_doc, p_col = pair // max(1, len(vocab)), pair % max(1, len(vocab))
    df = np.bincount(p_col, minlength=len(vocab)).astype(float)
    pos = np.bincount(p_col, weights=labels[p_doc], minlength=len(vocab))
    n, rate = max(1, len(rows)), float(labels.mean()) if len(rows) else 0.1
    z = np.abs(pos - df * rate) / np.sqrt(df * rate * (1 - rate) + 1e-9)
    z[df < least_df] = -1.0
    z[np.isin(vocab, np.array(names, np.uint32))] = np.inf
    keep = np.sort(np.argsort(-z, kind="stable")[:most])
    keep = keep[z[keep] > 2.0]
    chosen = np.union1d(vocab[keep], np.array(names, np.uint32))
    m = len(chosen)
    place = np.searchsorted(chosen, flat)
    ok = (place < m) & (chosen[np.minimum(place, m - 1)] == flat)
    cols, docs = place[ok], doc[ok]
    # one row for each swap: +1 for a feature that comes, -1 for one that goes
    bare = [np.array([h for h in features(to)] + [(1 << 32) | h for h in features(t)], np.uint64) for terms in GROUPS for t, to in zip(terms, terms[1:] + terms[:1])]
    every = [x for x in [*swaps, *bare] if len(x)]
    entry = np.concatenate(every)
    change = np.unique((np.repeat(np.arange(len(every), dtype=np.uint64), [len(x) for x in every]) << np.uint64(31)) | (entry >> np.uint64(33)), return_inverse=True)[1].ravel()
    hashes, sign = (entry & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.where(entry >> np.uint64(32) & np.uint64(1), -1.0, 1.0)
    spot = np.minimum(np.searchsorted(chosen, hashes), m - 1)
    has = chosen[spot] == hashes
    n_swaps = int(change.max()) + 1
    change, spot, sign = change[has], spot[has], sign[has]
    w, b = np.zeros(m), float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
    mw, vw, mb, vb = np.zeros(m), np.zeros(m), 0.0, 0.0
    for t in range(1, rounds + 1):
        s = b + np.bincount(docs, weights=w[cols], minlength=n)[:n]
        g = (1 / (1 + np.exp(-np.clip(s, -40, 40))) - labels) / n if len(rows) else np.zeros(n)
        gw = np.bincount(cols, weights=g[docs], minlength=m) + l2 * w
        moved = np.bincount(change, weights=sign * w[spot], minlength=n_swaps)
        gw += 2 * swap / n_swaps * np.bincount(spot, weights=sign * moved[change], minlength=m)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * g.sum(), 0.999 * vb + 0.001 * g.sum() ** 2
        rate_t = 0.05 * (1 - 0.9 * t / rounds)
        w -= rate_t * (mw / (1 - 0.9**t)) / (np.sqrt(vw / (1 - 0.999**t)) + 1e-8)
        b -= rate_t * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Linear(chosen, w, float(b))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000, **settings) -> Linear:
    """Fits on at most ``sample_rows`` labelled rows (the stated bound) of the training folds:
    those of smallest hash of doc_id. Null ids and labels are left out; of repeated labels
    the greatest counts. Executors send feature hashes only."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.filter(fold_of(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).join(F.broadcast(sample), "doc_id")

    def encode(batches):
        for batch in batches:
            views = binary_views(batch.column("text"))
            blobs = [pa.array([f(v).tobytes() for v in views], pa.binary()) for f in (counted, swapped)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *blobs], ["doc_id", "toxic", "hashes", "swaps"])

    got = texts.mapInArrow(encode, "doc_id long, toxic int, hashes binary, swaps binary").toArrow().sort_by([("doc_id", "ascending"), ("hashes", "ascending")])
    rows, swaps = ([np.frombuffer(v, kind) for c in got.column(name).chunks for v in binary_views(c)] for name, kind in (("hashes", np.uint32), ("swaps", np.uint64)))
    return fit(rows, np.minimum(np.array(got.column("toxic").to_pylist(), float), 1.0), swaps, **settings)


def score_documents(docs: DataFrame, model: Linear, cut: float = CUT) -> DataFrame:
    """Adds held_out, score and predicted to every document; scores see the text alone.

    Null and empty texts get the score of the bias; a null doc_id is not held out; repeated
    rows are scored each; an empty table gives no rows. All columns of ``docs`` are kept,
    except that columns named held_out, score or predicted are replaced.
    """
    weights, bias = (np.array(list(model.weights), np.uint32), np.array(list(model.weights.values()))), model.bias
    docs = docs.drop("held_out", "score", "predicted")
    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def rate(text: pa.Array) -> pa.Array:
        linear = worker_state(("linear", key), lambda: Linear(*weights, bias))
        return pa.array([linear.score(v) for v in binary_views(text)], pa.float64())

    key = zlib.crc32(weights[1].tobytes() + np.float64(bias).tobytes())
    scored = docs.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))).withColumn("score", rate(text_of().cast("binary")))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select("doc_id", "held_out", "score", "predicted")


QUERIES, ORACLE_SQL = {"op7_toxicity": op7_toxicity}, {}
