"""Suffix-array deduplication: removes every byte covered by a long string that starts twice.

A suffix array over all bytes would sort each byte's suffix. Here only sampled suffixes
are sorted: each window of WINDOW bytes picks as anchor the gram of GRAM bytes of least
hash within it (the leftmost of equals). Equal windows pick equal anchors at equal
offsets, so it is enough to compare, among anchors of equal gram, the suffixes to the
right and the reversed prefixes to the left. Both are put in order by deep-shallow
sorting; the neighbours' common prefixes then tell for every offset which windows are
equal. Contexts that are equal as a whole are members of one class, of which only one is
sorted. Nothing is missed and nothing is compared twice, however often a string occurs.

Anchors whose gram occurs once go at once, after a count of grams that combines before it
is shuffled; of the texts, only those with open contexts or spans are moved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import deepshallow
from lattica.llm.common import binary_views, marked_rows, park, small_batches, table, text_of, worker_state

WINDOW, GRAM = 400, 64
PASSAGE = (256, 48)  # window and gram for passages of some 50 words
CHUNK = 400_000
GROUP = 4096  # contexts of one gram that one task sorts together
BATCH = 6_000
LEVELS = (64, 8, 1)

_rng = np.random.default_rng(20240601)
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        ones = np.ones(size, np.uint64)
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = BASE, INVERSE
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _powers[size]
    return up[:n], down[:n]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit rolling hash of the gram at each byte."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[:-1], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(views: list, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, anchor, first window, last window) for texts joined in one buffer;
    places count within each text."""
    sizes = np.array([len(v) for v in views], np.int64)
    data = np.frombuffer(b"".join(views), np.uint8)
    ends = np.cumsum(sizes)
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 5
    grams = gram_hashes(data, gram)
    tagged = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    pick = (sliding_least(tagged, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(pick), bool)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        inside[a : max(a, b - window + 1)] = True
    new = np.ones(len(pick), bool)
    new[1:] = (pick[1:] != pick[:-1]) | ~inside[:-1]
    first = np.nonzero(new & inside)[0]
    stop = np.ones(len(pick), bool)
    stop[:-1] = new[1:] | ~inside[1:]
    last = np.nonzero(stop & inside)[0]
    text = np.searchsorted(ends, first, side="right")
    at, start = pick[first], (ends - sizes)[text]
    return text, grams[at].view(np.int64), at - start, first - start, last - start


def pieces(views: list, window: int, most: int = CHUNK):
    """Lists of (text, offset, bytes) of about ``most`` bytes. A long text is cut so that each of
    its windows is in one piece."""
    held, total = [], 0
    for i, v in enumerate(views):
        for a in range(0, max(1, len(v) - window + 1), most):
            held.append((i, a, v[a : a + most + window - 1]))
            total += len(held[-1][2])
            if total >= most:
                yield held
                held, total = [], 0
    if held:
        yield held


def digest(*parts) -> bytes:
    h = hashlib.blake2b(digest_size=16)
    for p in parts:
        h.update(p)
    return h.digest()


def small(n: int) -> bytes:
    return n.to_bytes(4, "little")


ANCHORS = "doc_id long, h long, key long, dg binary, at int, p1 int, p2 int"


def anchor_finder(window: int, gram: int, chunk: int):
    def find(batches):
        worker_state("none", dict)  # a reused worker frees what another operator kept
        for batch in batches:
            for part in pieces(binary_views(batch.column("text")), window, chunk):
                text, key, at, p1, p2 = anchors([v for _, _, v in part], window, gram)
                dg = [digest(part[t][2][x : y + window], small(z - x)) for t, x, y, z in zip(text.tolist(), p1.tolist(), p2.tolist(), at.tolist())]
                offset = np.array([a for _, a, _ in part], np.int64)[text]
                rows = pa.array(np.array([i for i, _, _ in part], np.int64)[text])
                for i in range(0, len(dg), 20_000):
                    s = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows[s]), batch.column("h").take(rows[s]), pa.array(key[s]), pa.array(dg[s], pa.binary()), *(pa.array(x[s] + offset[s], pa.int32()) for x in (at, p1, p2))],
                        ["doc_id", "h", "key", "dg", "at", "p1", "p2"],
                    )

    return find


CONTEXTS = "doc_id long, h long, grp binary, ctx binary, p1 int, lo int, hi int, off int"


def context_cutter(window: int):
    """The bytes that the windows of each open anchor cover; lo..hi are its offsets."""

    def cut(batches):
        for batch in batches:
            views = binary_views(batch.column("text"))
            out: list[tuple] = []
            for i, picks in enumerate(batch.column("picks").to_pylist()):
                for p in picks:
                    out.append((i, p["key"].to_bytes(8, "little", signed=True), bytes(views[i][p["p1"] : p["p2"] + window]), p["p1"], p["at"] - p["p2"], p["at"] - p["p1"], p["at"] - p["p1"]))
                if len(out) > 5000 or i == len(views) - 1:
                    cols = list(zip(*out)) if out else [()] * 7
                    rows = pa.array(cols[0], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(rows), batch.column("h").take(rows), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary()), *(pa.array(c, pa.int32()) for c in cols[3:])],
                        ["doc_id", "h", "grp", "ctx", "p1", "lo", "hi", "off"],
                    )
                    out = []

    return cut


def repeated(grp: np.ndarray, ctx: list[bytes], off: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first offset, last offset) of runs of windows that another row of the group has too.

    A window at offset o starts o bytes before the anchor. Two rows share it if their
    suffixes from the anchor agree in window - o bytes and their reversed prefixes in o.
    """
    right = [c[o : o + window] for c, o in zip(ctx, off.tolist())]
    left = [c[:o][::-1] for c, o in zip(ctx, off.tolist())]
    classes = []
    for strings, width in ((right, window), (left, max(1, int(off.max(initial=0))))):
        mat = deepshallow.matrix_of(strings, width)
        order = deepshallow.sort(mat, grp)
        classes.append((order, deepshallow.neighbours(mat, np.array([len(s) for s in strings], np.int64), grp, order)))
    (r_order, r_lcp), (l_order, l_lcp) = classes
    n, top = len(grp), int(hi.max(initial=0))
    shared = np.zeros((n, top + 2), bool)
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(lo.min(initial=0)), top + 1):
        here = np.nonzero((lo <= o) & (o <= hi))[0]
        if len(here) < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < window - o)
        l_class[l_order] = np.cumsum(l_lcp < o)
        key = r_class[here] * (n + 1) + l_class[here]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        shared[here[by[1:][same]], o] = True
        shared[here[by[:-1][same]], o] = True
    edge = np.diff(np.pad(shared, ((0, 0), (1, 0))).astype(np.int8), axis=1)
    rows, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return rows, first, after - 1


SPANS = "doc_id long, h long, start int, stop int"


def spans_of(rows, first, last, doc_id, h, at, window):
    """Removed bytes of runs of windows: offsets count back from the anchor."""
    names = ["doc_id", "h", "start", "stop"]
    take = pa.array(rows)
    return pa.RecordBatch.from_arrays([doc_id.take(take), h.take(take), pa.array(at[rows] - last, pa.int32()), pa.array(at[rows] - first + window, pa.int32())], names)


def group_searcher(window: int):
    """Rows come sorted by group; whole groups are searched together."""

    def search(t: pa.Table):
        t = t.combine_chunks()
        codes = t.column("grp").combine_chunks().dictionary_encode()
        grp = np.asarray(codes.indices if isinstance(codes, pa.DictionaryArray) else codes.chunk(0).indices, dtype=np.int64)
        ints = {c: np.asarray(t.column(c), dtype=np.int64) for c in ("p1", "lo", "hi", "off")}
        rows, first, last = repeated(grp, t.column("ctx").to_pylist(), ints["off"], ints["lo"], ints["hi"], window)
        return spans_of(rows, first, last, t.column("doc_id").combine_chunks(), t.column("h").combine_chunks(), ints["p1"] + ints["off"], window)

    def run(batches):
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                held.append(pa.Table.from_batches([batch.slice(i, BATCH)]))
                count += held[-1].num_rows
                if count >= BATCH:
                    t = pa.concat_tables(held)
                    grp = t.column("grp")
                    end = grp[-1]
                    cut = t.num_rows
                    while cut and grp[cut - 1] == end:  # the last group may go on
                        cut -= 1
                    if cut:
                        yield search(t.slice(0, cut))
                    held, count = [t.slice(cut)], t.num_rows - cut
        if count:
            yield search(pa.concat_tables(held))

    return run


def splitter(step: int, window: int):
    """Splits rows of groups too large for one task by blocks of ``step`` offsets: a block's
    group is the gram with the bytes that all its windows share."""

    def split(batches):
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("grp", "ctx", "p1", "lo", "hi", "off")]
            for i, (grp, ctx, p1, lo, hi, off) in enumerate(zip(*cols)):
                for b in range(lo // step, hi // step + 1):
                    near, far = b * step, b * step + step - 1
                    a, z = max(lo, near), min(hi, far)
                    core = digest(grp, small(step), small(b), ctx[max(0, off - near) : off - far + window])
                    whole = ctx[off - z : off - a + window]
                    out.append((i, core, digest(whole, small(a), small(z)), whole, p1 + off - z, a, z, z))
            c = list(zip(*out)) if out else [()] * 8
            rows = pa.array(c[0], pa.int64())
            whole = pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("h").take(rows), *(pa.array(x, pa.binary()) for x in c[1:4]), *(pa.array(x, pa.int32()) for x in c[4:])],
                ["doc_id", "h", "grp", "dg", "ctx", "p1", "lo", "hi", "off"],
            )
            for i in range(0, len(out), 5000):
                yield whole.slice(i, 5000)

    return split


def by_class(rows: DataFrame, group: str, rep: list[str]) -> DataFrame:
    """One row per (group, dg) that has company: its count, the group's classes, one representative."""
    classes = rows.groupBy(group, "dg").agg(F.count("*").alias("n"), F.min(F.struct(*rep)).alias("rep"))
    groups = classes.groupBy(group).agg(F.count("*").alias("classes"), F.sum("n").alias("rows")).filter("rows > 1").drop("rows")
    return classes.join(groups, group)


def repeated_spans(docs: DataFrame, window: int, gram: int, chunk: int) -> DataFrame:
    """(doc_id, h, start, stop): byte ranges, overlapping ones included, that are to go."""
    rep = ["doc_id", "h", "at", "p1", "p2"]
    every = park(docs.mapInArrow(anchor_finder(window, gram, chunk), ANCHORS), "anchors")
    keys = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    found = park(every.join(keys, "key", "left_semi"), "repeated-grams")
    classes = park(by_class(found, "key", rep), "classes")
    whole = found.join(classes.filter("n > 1").select("key", "dg"), ["key", "dg"]).select("doc_id", "h", F.col("p1").alias("start"), (F.col("p2") + window).alias("stop"))
    out = [whole]
    open_ = classes.filter("classes > 1")
    picks = park(open_.select("rep.*", "key").groupBy("doc_id", "h").agg(F.collect_list(F.struct("key", "at", "p1", "p2")).alias("picks")), "picks")
    marks = marked_rows(picks)
    picks = picks.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "hh")
    texts = docs.filter(marks("doc_id", "h")).join(picks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh"))).select("doc_id", "h", "text", "picks")
    contexts = park(texts.mapInArrow(context_cutter(window), CONTEXTS).dropDuplicates(["doc_id", "h", "p1"]), "contexts")
    for step in (None, *LEVELS):
        if step is None:
            rows = contexts
        else:
            rows = park(hot.mapInArrow(splitter(step, window), CONTEXTS.replace("ctx binary", "dg binary, ctx binary")), "blocks")  # noqa: F821
            parts = park(by_class(rows, "grp", ["doc_id", "h", "p1", "lo", "hi", "off"]), "block-classes")
            out.append(rows.join(parts.filter("n > 1").select("grp", "dg"), ["grp", "dg"]).select("doc_id", "h", F.col("p1").alias("start"), (F.col("p1") + F.col("hi") - F.col("lo") + window).alias("stop")))
            kept = parts.filter("classes > 1").select("grp", "dg", "rep", "classes")
            same = [F.col(f"rep.{c}").eqNullSafe(F.col(c)) for c in ("doc_id", "h", "p1")]
            rows = rows.join(kept, ["grp", "dg"]).filter(same[0] & same[1] & same[2]).dropDuplicates(["grp", "dg"]).select(*[c.split()[0] for c in CONTEXTS.split(", ")])
            rows = park(rows, "block-open")
        sizes = park(rows.groupBy("grp").agg(F.count("*").alias("classes")).filter(F.col("classes") > 1), "group-sizes")
        usual = rows.join(sizes.filter(F.col("classes") <= GROUP).select("grp"), "grp").select(*[c.split()[0] for c in CONTEXTS.split(", ")])
        out.append(usual.repartition("grp").sortWithinPartitions("grp").mapInArrow(group_searcher(window), SPANS))
        hot = rows.join(sizes.filter(F.col("classes") > GROUP).select("grp"), "grp").select(*[c.split()[0] for c in CONTEXTS.split(", ")])
        if step == 1 or hot.isEmpty():
            break
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans


def keep(view, spans) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal runs removed)."""
    if not spans:
        return bytes(view), 0, 0
    kept, at, runs, end = [], 0, 0, -1
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if start > end:
            kept.append(view[at:start])
            runs += 1
        end = max(end, stop)
        at = end
    kept.append(view[at:])
    body = b"".join(kept)
    return body, len(view) - len(body), runs


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK, as_text: bool = False, counted: tuple[int, int] | None = None) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (the remaining bytes) to every document.

    A byte goes if a string of ``window`` bytes covers it that also starts elsewhere in any
    document's UTF-8 bytes, its own included; matches never cross documents and are judged
    on the input. Null texts are empty; texts under ``window`` bytes stay; repeated rows count
    as separate documents; null doc_ids are kept; an empty table gives no rows. All other
    columns of ``docs`` stay; clashing ones of the four new names are replaced. ``as_text``
    gives kept as a string, without parts of characters that a cut leaves. ``counted`` is
    another window and gram: n_repeated then counts the bytes that repeated strings of that
    length cover, whether they go or not.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept", *(["n_repeated"] if counted else [])]
    small_batches(docs.sparkSession)
    docs = docs.drop(*made)
    ided = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).withColumn("h", F.xxhash64("text"))
    body = ided.select("doc_id", "h", "text")
    spans = park(repeated_spans(body, window, gram, chunk), "spans").withColumn("goes", F.lit(True))
    if counted:
        spans = spans.union(park(repeated_spans(body, *counted, chunk), "spans-counted").withColumn("goes", F.lit(False)))
    sets = [F.collect_set(F.when(F.col("goes") == goes, F.struct("start", "stop"))).alias(name) for name, goes in (("_spans", True), ("_counted", False))]
    spans = spans.groupBy("doc_id", "h").agg(*sets)
    marks = marked_rows(spans.select("doc_id", "h"))
    spans = spans.withColumnRenamed("doc_id", "_d").withColumnRenamed("h", "_h")
    body = text_of().cast("binary")
    doc_id, h = F.col("doc_id").cast("long"), F.xxhash64(body)

    @F.arrow_udf(f"struct<n_bytes: long, n_removed: long, n_spans: long, kept: {'string' if as_text else 'binary'}{', n_repeated: long' if counted else ''}>")
    def cut(text: pa.Array, spans: pa.Array, more: pa.Array) -> pa.Array:
        views, found = binary_views(text), spans.to_pylist()
        parts = [keep(v, s) for v, s in zip(views, found)]
        bodies = pa.array([p[0].decode("utf-8", "ignore") for p in parts], pa.string()) if as_text else pa.array([p[0] for p in parts], pa.binary())
        arrays = [pa.array([len(v) for v in views], pa.int64()), pa.array([p[1] for p in parts], pa.int64()), pa.array([p[2] for p in parts], pa.int64()), bodies]
        if counted:
            arrays.append(pa.array([keep(v, s)[1] for v, s in zip(views, more.to_pylist())], pa.int64()))
        return pa.StructArray.from_arrays(arrays, made)

    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.withColumn("_marked", marks(doc_id, h))
    some = held.filter("_marked").join(spans, doc_id.eqNullSafe(F.col("_d")) & (h == F.col("_h")), "left")
    some = some.withColumn("_cut", cut(body, F.col("_spans"), F.col("_counted"))).select(*columns, "_cut.*")
    none = [F.octet_length(body).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), text_of() if as_text else body, F.lit(0).cast("long")]
    return some.unionByName(held.filter("NOT _marked").select(*columns, *[c.alias(k) for c, k in zip(none, made)]))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text`` and ``n_chars`` brought up to date.
    Parts of characters that a cut leaves are dropped."""
    done = remove_repeats(docs, window, gram, as_text=True).withColumn("text", F.col("kept"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_repeated: bytes in repeated passages of some 50 words."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), counted=PASSAGE)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


QUERIES, ORACLE_SQL = {"op2_suffix": op2_suffix}, {}
