"""N-gram Jaccard join by prefix filters under several global token orders.

Texts of equal shingle set form one class. If two sets have a Jaccard similarity of t or
more, then under every order of all tokens the first n - ceil(t n) + 1 tokens of each
hold a common token. Order A sorts light tokens by hash and puts a bounded list of
frequent (heavy) tokens behind them, the most frequent last, so that a prefix rarely
holds a passage that many texts quote. Orders B and C are by other hashes.

Candidates come from order A. A token in few prefixes pairs them all; how many tokens a
pair shares then bounds its overlap. A token in many prefixes first pairs each with one
central set, its hub, so that a group of copies is not expanded into all its pairs; the
sets that are still in different components after that are paired as well, so that no
link is lost. Of the candidates, those stay that meet in the prefixes B and C too; only
for them whole sets are fetched and compared. Links become components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import shingles
from lattica.llm.common import binary_views, in_slots, park, slot_bits, slot_of, small_batches, table, text_of, trim, unique_rows, worker_state

WORDS = 5
NUM, DEN = 4, 5  # the similarity, as a fraction
HEAVY_DF = 10
HEAVY_MOST = 131_072  # bound of the broadcast list of heavy tokens
GROUP = 24  # prefixes that a light token pairs in full
WINDOW = 2_000_000
ORDERS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def prefix_size(n):
    return n - (NUM * n + DEN - 1) // DEN + 1


def each_set(batch):
    worker_state("none", dict)  # a reused worker frees what another operator kept
    trim()
    views = binary_views(batch.column("text"))
    for a, b in shingles.ranges(views):
        yield from zip(range(a, b), shingles.sets_of(views[a:b], WORDS))


def slices(batch: pa.RecordBatch, size: int = 50_000):
    for i in range(0, batch.num_rows, size):
        yield batch.slice(i, size)


def record(schema: str, columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])


def count_tokens(batches):
    """(tok, n): tokens that at least two and at least one in 2,000 texts of a window share.
    Windows of about WINDOW tokens bound the memory; every token of every text is counted."""
    held: list[np.ndarray] = []
    total = 0

    def frequent():
        toks, n = np.unique(np.concatenate(held), return_counts=True)
        keep = n >= max(2, len(held) // 2000)
        return record("tok long, n long", [toks[keep].view(np.int64), n[keep]])

    for batch in batches:
        for _, s in each_set(batch):
            held.append(s)
            total += len(s)
            if total >= WINDOW:
                yield from slices(frequent())
                held, total = [], 0
    if held:
        yield from slices(frequent())


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def other_prefix(s: np.ndarray, order: np.uint64, p: int) -> np.ndarray:
    """The prefix of a set under another order of all tokens, as 32 bits a token."""
    mixed = shingles.mix(s ^ order)
    return np.partition(mixed, p - 1)[:p].astype(np.uint32).view(np.int32)


PREFIXES = "doc_id long, th long, s long, n int, last long, light array<long>, heavy array<int>, b array<int>, c array<int>"


def splitter(heavy):
    """Each set's id, size and prefixes. Heavy tokens are named by their rank in order A;
    ``last`` tells where prefix A ends: a rank, or below 0 a light token without its last bit."""

    def split(batches):
        often, ranks = heavy.value
        for batch in batches:
            rows = []
            for i, s in each_set(batch):
                n = len(s)
                if not n:
                    rows.append((i, 0, 0, 0, *[s.view(np.int64)], *[np.zeros(0, np.int32)] * 3))
                    continue
                p = prefix_size(n)
                is_heavy, place = np.zeros(n, bool), None
                if len(often):
                    place = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    is_heavy = often[place] == s
                light = s[~is_heavy][:p]
                rest = np.sort(ranks[place[is_heavy]])[: p - len(light)] if len(light) < p else np.zeros(0, np.int32)
                last = int(rest[-1]) if len(rest) else int(light[-1] >> np.uint64(1)) - (1 << 63)
                rows.append((i, set_id(s), n, last, light.view(np.int64), rest, *[other_prefix(s, k, p) for k in ORDERS]))
            c = list(zip(*rows)) if rows else [()] * 8
            at = pa.array(c[0], pa.int64())
            out = record(PREFIXES, [batch.column("doc_id").take(at), batch.column("th").take(at), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), lists(c[4], np.int64), *[lists(x, np.int32) for x in c[5:]]])
            yield from slices(out, 2000)

    return split


def lists(arrays, kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if len(arrays) else np.zeros(0, kind)))


def near_size(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    return DEN * small >= NUM * large


MET = "kind int, a long, b long"
PAIR, ROW = 0, 1


def meet_on_tokens(group: int):
    """Rows sorted by (tok, n, s) to PAIR rows (smaller set, larger set) for each token in at
    most ``group`` sets, and ROWs (tok, set) of wider tokens. No more than a batch and ``group``
    rows are held."""

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        wide = None  # a token known to be in more sets, whose rows go on
        for batch in batches:
            cols = [np.concatenate([h, np.asarray(batch.column(k), dtype=np.int64)]) for h, k in zip(held, ("tok", "s", "n"))]
            tok, s = cols[:2]
            fresh = np.ones(len(tok), bool)
            fresh[1:] = (tok[1:] != tok[:-1]) | (s[1:] != s[:-1])
            cols = [c[fresh] for c in cols]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last token may go on
            yield from settle([c[:cut] for c in cols], wide)
            held = [c[cut:] for c in cols]
            if len(held[0]) and (len(held[0]) > group or held[0][0] == wide):
                wide = held[0][0]
                yield from settle([c[:-1] for c in held], wide)
                held = [c[-1:] for c in held]  # its last row, to know repetitions of it
        yield from settle(held, wide)

    def settle(cols, wide):
        tok, s, n = cols
        if not len(tok):
            return
        starts = np.nonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))[0]
        sizes = np.diff(np.append(starts, len(tok)))
        many = np.repeat((sizes > group) | (tok[starts] == wide), sizes) if wide is not None else np.repeat(sizes > group, sizes)
        yield from slices(record(MET, [np.full(int(many.sum()), ROW), tok[many], s[many]]))
        at, d = np.nonzero(~many)[0], 1
        while True:
            at = at[at + d < len(tok)]
            at = at[(tok[at] == tok[at + d]) & near_size(n[at], n[at + d])]
            if not len(at):
                break
            yield from slices(record(MET, [np.full(len(at), PAIR), s[at], s[at + d]]))
            d += 1

    return run


def need(nx, ny):
    """The least overlap of a linked pair: ceil(t / (1 + t) * (nx + ny))."""
    return F.ceil(NUM * (nx + ny) / F.lit(float(NUM + DEN)) - 1e-9).cast("int")


def prefix(n):
    return n - F.ceil(NUM * n / F.lit(float(DEN)) - 1e-9).cast("int") + 1


FACTS = ("s", "n", "last", "h", "g")


def can_link(a: Column, b: Column, c: Column | int = 0) -> Column:
    """False if sizes and prefixes A rule a link out; ``c``: how many paired tokens two sets have.

    Of the prefix that ends first, every token that the other set has is in the other's
    prefix: one of the ``c`` or of the wide tokens, of which each has ``g``. At a tie of
    light ends one token may lie behind, as ends lack a bit. Two prefixes that reach heavy
    tokens, of which each has ``h``, hold all light tokens of either set.
    """
    least = need(a["n"], b["n"])
    both = (a["h"] > 0) & (b["h"] > 0)

    def fits(s, t):
        spare = s["n"] - least + c
        tie = ((s["last"] == t["last"]) & (s["last"] < 0)).cast("int")
        ok = (s["last"] > t["last"]) | (prefix(s["n"]) - F.least(a["g"], b["g"]) <= spare + tie)
        return ok & (~both | (prefix(s["n"]) - s["h"] - F.least(a["g"] - a["h"], b["g"] - b["h"]) <= spare))

    return fits(a, b) & fits(b, a) & (DEN * F.least(a["n"], b["n"]) >= NUM * F.greatest(a["n"], b["n"]))


def first_shared(a: Column, b: Column) -> Column:
    """False if two sets cannot link by rows of one token as the first that they share: none of
    the ``pos`` tokens before it in either prefix is common."""
    least = need(a["n"], b["n"])
    return (a["pos"] <= a["n"] - least) & (b["pos"] <= b["n"] - least) & can_link(a, b)


def own(f: Column) -> Column:
    """The share of tokens that are not wide: the less, the more central a set is among copies."""
    return (prefix(f["n"]) - f["g"]) / f["n"]


def oriented(pairs: DataFrame) -> DataFrame:
    """Distinct (x, y) of facts a and b, the more central set first: a hub is then on one side."""
    key = [F.struct(own(f).alias("k"), f["s"].alias("s")) for f in (F.col("a"), F.col("b"))]
    return pairs.select(F.least(*key)["s"].alias("x"), F.greatest(*key)["s"].alias("y")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("x").alias("s")).union(pairs.select(F.col("y").alias("s"))).distinct()


def marked(docs: DataFrame, pairs: DataFrame):
    """A broadcast bitmap of fixed size of one document for each set in ``pairs``. False hits cost
    time only, since joins on the sets' ids follow."""
    reps = docs.select("s", "doc_id", "th").join(ends(pairs), "s").groupBy("s").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("r.*")
    return slot_bits(reps, "doc_id", "th")


def hits(batch: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(in_slots(bits, batch.column("slot"))))


def meet_elsewhere(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose prefixes B and C have a common token as well."""
    held = marked(docs, pairs)

    def scan(batches):
        for batch in batches:
            yield hits(batch, held.value).drop_columns(["slot"])

    both = docs.select("s", "b", "c", slot_of("doc_id", "th").alias("slot")).mapInArrow(scan, "s long, b array<int>, c array<int>")
    left, right = (both.select(F.col("s").alias(k), F.struct("b", "c").alias(f"of_{k}")) for k in ("x", "y"))
    found = pairs.join(left, "x").join(right, "y").filter(F.arrays_overlap("of_x.b", "of_y.b") & F.arrays_overlap("of_x.c", "of_y.c"))
    return park(found.select("x", "y").distinct(), "candidates")


def meet(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def verify_pairs(batches):
    for batch in batches:
        keep = []
        left, right = binary_views(batch.column("ix")), binary_views(batch.column("iy"))
        for i in range(batch.num_rows):
            x, y = np.frombuffer(left[i], np.uint64), np.frombuffer(right[i], np.uint64)
            both = meet(x, y)
            if DEN * both >= NUM * (len(x) + len(y) - both):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("x").take(at), batch.column("y").take(at)], ["x", "y"])


def verify(texts: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked ones of ``pairs``, by the whole sets of one text of each."""
    pairs = meet_elsewhere(docs, pairs)
    held = marked(docs, pairs)

    def scan(batches):
        for batch in batches:
            batch, rows = hits(batch, held.value), []
            for _, s in each_set(batch):
                rows.append((set_id(s), s.tobytes()))
                if len(rows) == 500:
                    yield record("s long, items binary", zip(*rows))
                    rows = []
            if rows:
                yield record("s long, items binary", zip(*rows))

    sets = park(texts.select("text", slot_of("doc_id", "th").alias("slot")).mapInArrow(scan, "s long, items binary"), "sets")
    left, right = (sets.select(F.col("s").alias(k), F.col("items").alias(f"i{k}")) for k in ("x", "y"))
    return park(pairs.join(right, "y").join(left, "x").mapInArrow(verify_pairs, "x long, y long").distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(s, root): the smallest node that each node of an edge reaches, by alternating
    large-star and small-star rounds; a logarithmic number of rounds even for chains."""
    now = park(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "stars")
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least2.select("u", F.col("m").alias("v"))).distinct()
        now = park(small, "stars")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("s"), F.col("v").alias("root"))
        before = state


def with_facts(pairs: DataFrame, facts: DataFrame, a: str, b: str) -> DataFrame:
    left, right = (facts.select(F.col("s").alias(k), F.struct(*FACTS).alias(f)) for k, f in ((a, "a"), (b, "b")))
    return pairs.join(left, a).join(right, b)


def star_pairs(rows: DataFrame) -> DataFrame:
    """Each row's set with its token's hub, the most central set. Pairs that share narrow tokens
    too are among the paired ones already, so here none count."""
    hubs = rows.groupBy("tok").agg(F.min(F.struct(own(F.col("f")).alias("k"), F.col("f.s").alias("s"), "f")).alias("hub")).select("tok", F.col("hub.f").alias("b"))
    return rows.select("tok", F.col("f").alias("a")).join(hubs, "tok").filter((F.col("a.s") != F.col("b.s")) & first_shared(F.col("a"), F.col("b")))


def apart_pairs(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of a token's sets that are in different components: the sets outside its largest
    component with all others that are not in their own."""
    placed = park(rows.withColumn("s", F.col("f.s")).join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")).drop("s"), "placed")
    parts = placed.groupBy("tok", "root").count().groupBy("tok").agg(F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    placed = placed.join(parts.select("tok", F.col("top.root").alias("giant")), "tok")
    odd = placed.filter("root <> giant").select("tok", F.col("f").alias("a"), F.col("root").alias("ra"))
    other = placed.select("tok", F.col("f").alias("b"), F.col("root").alias("rb"), (F.col("root") == F.col("giant")).alias("main"))
    return odd.join(other, "tok").filter((F.col("ra") != F.col("rb")) & (F.col("main") | (F.col("a.s") < F.col("b.s"))) & first_shared(F.col("a"), F.col("b")))


def link_classes(texts: DataFrame, group: int = GROUP, heavy_df: int = HEAVY_DF, heavy_most: int = HEAVY_MOST) -> tuple[DataFrame, DataFrame]:
    """(documents with s and n; (s, root) of the classes that are linked to another)."""
    spark = texts.sparkSession
    small_batches(spark)
    tokens = texts.select("text").mapInArrow(count_tokens, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")).filter(F.col("n") > heavy_df)
    often = tokens.orderBy(F.col("n").desc(), "tok").limit(heavy_most).select("tok").toArrow()  # bounded
    often = np.asarray(often.column("tok"), dtype=np.int64).view(np.uint64)[::-1]
    order = np.argsort(often, kind="stable")  # place in order A is rank: the most frequent last
    heavy = spark.sparkContext.broadcast((often[order], order.astype(np.int32)))
    docs = park(texts.mapInArrow(splitter(heavy), PREFIXES), "prefixes")
    rows = docs.filter("n > 0")
    light = rows.select(F.explode("light").alias("tok"), "s", "n")
    met = park(light.repartition("tok").sortWithinPartitions("tok", "n", "s").mapInArrow(meet_on_tokens(group), MET), "met")
    deep = rows.filter("size(heavy) > 0").groupBy("s").agg(F.first("heavy").alias("heavy")).select(F.posexplode(F.col("heavy").cast("array<long>")).alias("i", "tok"), "s")
    wide = park(deep.unionByName(met.filter(F.col("kind") == ROW).select(F.lit(None).cast("int").alias("i"), F.col("a").alias("tok"), F.col("b").alias("s"))), "wide")

    facts = rows.select("s", "n", "last", F.size("heavy").alias("h")).dropDuplicates(["s"]).join(wide.groupBy("s").agg(F.count("*").cast("int").alias("g")), "s", "left")
    facts = park(facts.fillna(0, ["g"]).select(*FACTS), "facts")
    counted = met.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.count("*").cast("int").alias("c")).withColumnsRenamed({"a": "p", "b": "q"})
    close = with_facts(counted, facts, "p", "q").filter(can_link(F.col("a"), F.col("b"), F.col("c")))
    pos = F.coalesce(prefix(F.col("n")) - F.col("h") + F.col("i"), F.lit(0))  # not known of light tokens
    rows = park(wide.join(facts, "s").select("tok", F.struct(*FACTS, pos.alias("pos")).alias("f")), "wide-facts")
    first = park(oriented(close).union(oriented(star_pairs(rows))).distinct(), "pairs")
    links = verify(texts, docs, first)
    roots = components(links)

    second = park(oriented(apart_pairs(rows, roots)).join(first, ["x", "y"], "left_anti"), "pairs-apart")
    if not second.isEmpty():
        more = verify(texts, docs, second)
        if not more.isEmpty():
            roots = components(links.union(more))
    return docs.select("doc_id", "th", "s", "n"), roots


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Two documents link at a Jaccard similarity of 0.8 or more of their sets of 5-word
    shingles; component_id is the smallest doc_id reachable by links. Null and empty texts
    and texts without words have an empty set and link with nothing; texts of fewer words
    have their whole sequence as one shingle. Repeated rows link with each other. A null
    doc_id is kept and is never the smallest unless its component has no other. Extra
    columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    known, roots = link_classes(texts, **settings)
    labels = known.filter("n > 0").groupBy("s").agg(F.min("doc_id").alias("label")).join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))
    least = labels.groupBy("root").agg(F.min("label").alias("component_id"))
    named = labels.select("s", "root").join(least, "root").select("s", "component_id")
    linked = known.filter("n > 0").join(named, "s").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    return linked.unionByName(known.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of smallest doc_id of each group of linked documents, and every document
    without links, with all columns of ``docs``. Of repeated rows one stays; a null doc_id
    counts as the greatest."""
    th = F.xxhash64(text_of().cast("binary"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    known, roots = link_classes(texts)
    member = known.filter("n > 0").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s"))
    chosen = member.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("r")).select(F.col("r.doc_id").alias("_d"), F.col("r.th").alias("_t"))
    chosen = park(chosen.union(known.filter("n = 0").select("doc_id", "th").distinct()), "kept")
    return unique_rows(docs, known).withColumn("_th", th).join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left_semi").drop("_th")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY 1
"""
QUERIES, ORACLE_SQL = {"op3_jaccard": op3_jaccard}, {"op3_jaccard": ORACLE}
