"""Packing documents into fixed windows: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import small_batches, table, text_of, worker_state

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LATIN = re.compile("[^\x00-˿]|<\\|")  # outside it, or a special token's mark: no lower-casing ahead
CORE_TAIL = re.compile("([a-zß-öø-ÿ]+)([.,!?;:%&$*#]+)")
LETTERS = re.compile("[a-zß-öø-ÿ]+")
SPACES = re.compile("[ \n\t\r]")
CACHE = 80_000_000  # bytes of each of two generations of words in a Python worker
ENTRY = 150  # bytes of a cached word besides its ids
PART = 1_000_000  # characters split into words at a time


class WordTokenizer:
    """Token ids of whole texts through a cache of white-space chunks, bounded in bytes.

    The cache has two generations: words are looked up in the young one, then moved there
    from the old one; a full young one becomes the old one, so that frequent words stay.

    The vocabulary's rules drop white space and never join across it, so the ids of a
    text are those of its chunks in turn. Texts below U+0300 have no combining marks, so
    lower-casing them ahead changes nothing; a run of letters and a run of punctuation
    after it are separate words to the tokenizer. Everything else reaches it unchanged.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old, self.size = Tokenizer.from_file(path), {}, {}, 0
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that the young cache lacks, which then keeps them."""
        new = {c: self.old[c] for c in chunks if c in self.old}
        split = {c: m.groups() for c in chunks if c not in new and (m := CORE_TAIL.fullmatch(c))}
        for p in {p for pair in split.values() for p in pair}:
            if (known := self.young.get(p) or self.old.get(p)) is not None:
                new[p] = known
        parts = dict.fromkeys(p for c in chunks if c not in new for p in split.get(c, (c,)) if p not in new)
        letters = [p for p in parts if LETTERS.fullmatch(p)]
        for i in range(0, len(letters), 4096):
            words = letters[i : i + 4096]  # each is one word, so its ids end at a word-end token
            ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
            at = np.nonzero(self.ends[ids])[0] + 1
            if len(at) == len(words):
                body, at = ids.tobytes(), (4 * at).tolist()
                new.update(zip(words, [body[a:b] for a, b in zip([0, *at], at)]))
        todo = [p for p in parts if p not in new]
        for i in range(0, len(todo), 4096):
            for part, e in zip(todo[i : i + 4096], self.tokenizer.encode_batch_fast(todo[i : i + 4096], add_special_tokens=False)):
                new[part] = np.array(e.ids, np.uint32).tobytes()
        for c, (core, tail) in split.items():
            new[c] = new[core] + new[tail]
        added = sum(map(len, new.values())) + ENTRY * len(new)
        if self.size + added > CACHE:
            self.old, self.young, self.size = self.young, {}, 0
        if added <= CACHE:  # more than that at once, as from one text of rare words, is not kept
            self.young.update(new)
            self.size += added
        return new

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; long texts go in parts cut at white space."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, total = [], 0
        for i, text in enumerate(texts):
            if not LATIN.search(text):
                text = text.lower()
            a = 0
            while len(text) - a > PART:
                end = SPACES.search(text, a + PART)
                if not end:
                    break
                held.append((i, text[a : end.start()]))
                self.flush(held, out)
                held, total, a = [], 0, end.end()
            held.append((i, text[a:] if a else text))
            total += len(text) - a
            if total >= PART:
                self.flush(held, out)
                held, total = [], 0
        self.flush(held, out)
        return [b"".join(x) if len(x) != 1 else x[0] for x in out]

    def flush(self, parts: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        """Appends the ids of each (text number, part) to its text's list."""
        split, missing = [], set()
        for i, text in parts:
            chunks = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            found = list(map(self.young.get, chunks))
            if None in found:
                missing.update([c for c, x in zip(chunks, found) if x is None])
            split.append((i, chunks, found))
        new = self.learn(list(missing)) if missing else {}
        for i, chunks, found in split:
            out[i].append(b"".join([new[c] if x is None else x for c, x in zip(chunks, found)] if None in found else found))


def combinations(hist: np.ndarray, window: int, most: int) -> list[tuple[int, ...]]:
    """Shallow combinations of present lengths that need no padding: single powers of two,
    pairs and triples that fill the window; of the triples, the ``most`` best supplied."""
    here = np.nonzero(hist)[0]
    out = [(1 << e,) for e in range(window.bit_length() - 1) if hist[1 << e]]
    out += [(int(a), int(window - a)) for a in here if a <= window - a and hist[window - a]]
    found = [np.zeros((4, 0), np.int64)]
    for a in here[here <= window // 3]:
        b = here[(here >= a) & (here <= (window - a) // 2)]
        c = window - a - b
        supply = np.minimum(np.minimum(hist[a], hist[b]), hist[c])
        here_too = np.nonzero(supply)[0]
        found.append(np.stack([np.full(len(here_too), a), b[here_too], c[here_too], supply[here_too]]))
    triples = np.concatenate(found, axis=1)
    best = np.argsort(-triples[3], kind="stable")[:most]
    out += list(zip(*triples[:3, best].tolist()))
    return out


def solve_counts(combos: list[tuple[int, ...]], hist: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 that bring the lengths used closest to the
    histogram, by accelerated projected gradient steps."""
    rows = np.array([r for c in combos for r in c], int)
    cols = np.array([j for j, c in enumerate(combos) for _ in c], int)
    n, m = len(combos), len(hist)
    degree = np.bincount(rows, minlength=m)
    step = 1.0 / max(1.0, 3.0 * float(degree.max(initial=1)))
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(rounds):
        gap = hist - np.bincount(rows, weights=y[cols], minlength=m)
        new = np.maximum(0.0, y + step * np.bincount(cols, weights=gap[rows], minlength=n))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(lengths: np.ndarray, window: int, most: int) -> tuple[np.ndarray, ...]:
    """Pieces (document, start, length, sequence, offset) that hold every id once."""
    full, rest = lengths // window, lengths % window
    doc = [np.repeat(np.arange(len(lengths)), full)]
    first = np.cumsum(full) - full
    start = [(np.arange(int(full.sum())) - np.repeat(first, full)) * window]
    length, seq, offset = [np.full(len(doc[0]), window)], [np.arange(len(doc[0]))], [np.zeros(len(doc[0]), int)]
    n_seq = len(doc[0])
    owners = np.nonzero(rest)[0]
    owners = owners[np.argsort(rest[owners], kind="stable")]
    hist = np.bincount(rest[owners], minlength=window + 1)
    base = np.cumsum(hist) - hist
    left = hist.copy()
    combos = combinations(hist, window, most)
    counts = solve_counts(combos, hist.astype(float)) if combos else np.zeros(0)
    for j in np.argsort(-counts, kind="stable"):
        combo = combos[j]
        need = {r: combo.count(r) for r in combo}
        times = min([int(round(counts[j])), *(int(left[r]) // k for r, k in need.items())])
        if times <= 0:
            continue
        at = np.zeros(times, int)
        for r in combo:
            left[r] -= times
            who = owners[base[r] + left[r] : base[r] + left[r] + times]
            doc.append(who), start.append(full[who] * window), length.append(np.full(times, r))
            seq.append(n_seq + np.arange(times)), offset.append(at.copy())
            at += r
        n_seq += times
    # greedy: what is left runs on, cut at window ends; the last stretch is cut at powers of two
    who = np.concatenate([owners[base[r] : base[r] + left[r]] for r in range(window, 0, -1)] or [np.zeros(0, int)]).astype(int)
    sizes = rest[who]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    cuts = list(range(window, total // window * window + 1, window))
    spare, pos = total % window, total // window * window
    for e in range(window.bit_length() - 1, -1, -1):
        if spare >> e & 1:
            pos += 1 << e
            cuts.append(pos)
    cuts = np.array(cuts, int)
    if total:
        points = np.union1d(np.concatenate([[0], ends]), cuts)
        a, b = points[:-1], points[1:]
        piece = np.searchsorted(ends, a, side="right")
        in_seq = np.searchsorted(cuts, a, side="right")
        doc.append(who[piece])
        start.append(full[who[piece]] * window + a - (ends[piece] - sizes[piece]))
        length.append(b - a), seq.append(n_seq + in_seq)
        offset.append(a - np.concatenate([[0], cuts])[in_seq])
        n_seq += len(cuts)
    return tuple(np.concatenate(x).astype(np.int64) for x in (doc, start, length, seq, offset)) + (n_seq,)


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, block_tokens: int = 4_000_000,
                   triples: int = 4096, with_ids: bool = False) -> DataFrame:
    """Packs (doc_id, text) into sequences of at most ``window`` tokens, a power of two.

    Runs as one pass without a shuffle: each partition packs blocks of about
    ``block_tokens`` tokens, solves each block's histogram and leaves no padding, since
    what the solution does not place is cut at window ends and, at the block's end, at
    powers of two. Null texts count as empty (one end id); null doc_ids are kept; repeated
    rows are packed each for itself; texts of any length are cut as needed; an empty table
    gives no rows; other columns are ignored. ``with_ids`` adds the ids of each piece
    (little-endian unsigned 32-bit). sequence_id is the partition's number times 2**32
    plus a count, so a rerun of a lost task gives the same rows.
    """
    end = np.array([end_id], np.uint32).tobytes()
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids

    def run(batches):
        words = worker_state(("tokenizer", tokenizer), lambda: WordTokenizer(tokenizer))
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        ids, blobs, held, made = [], [], 0, 0

        def flush():
            nonlocal ids, blobs, held, made
            doc_ids, sizes = pa.concat_arrays(ids), np.array([len(b) // 4 for b in blobs], np.int64)
            doc, start, length, seq, offset, n = plan(sizes, window, triples)
            views = [memoryview(b) for b in blobs]
            spans = list(zip(doc.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist()))
            crc = np.fromiter((zlib.crc32(views[d][a:b]) for d, a, b in spans), np.int64, len(spans))
            cols = [doc_ids.take(pa.array(doc)), *map(pa.array, (start, length, crc, sizes[doc], base + made + seq, offset))]
            if with_ids:
                cols.append(pa.array([bytes(views[d][a:b]) for d, a, b in spans], pa.binary()))
            ids, blobs, held, made = [], [], 0, made + n
            out = pa.RecordBatch.from_arrays(cols, names)
            for i in range(0, out.num_rows, 20_000):
                yield out.slice(i, 20_000)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids.append(part.column("doc_id"))
                new = [b + end for b in words.ids(part.column("text").to_pylist())]
                blobs += new
                held += sum(map(len, new)) // 4
                if held >= block_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES, ORACLE_SQL = {"op4_packing": op4_packing}, {}
