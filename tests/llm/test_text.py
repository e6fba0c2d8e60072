import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import deepshallow, op2_suffix, op3_jaccard, op4_packing, shingles
from lattica.llm.op4_packing import WordTokenizer, default_tokenizer, pack_documents, plan
from lattica.llm.op8_licenses import BASE, automaton, evaluate, postfix, scan, scan_licenses
from lattica.llm.op9_mixing import mix, mixed_documents
from lattica.llm.op10_html import DEFAULT, best_region, extract, main_text, stream

KIND = "doc_id long, text string, lang string, source string, n_chars long, h long, s string, n int, size string, key string"


def docs(spark, texts, sources=None):
    """Documents with clashing extra columns; a list of texts or of (doc_id, text)."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "s", 1, "z", "k") for (i, t), s in zip(rows, sources or ["a"] * len(rows))], KIND)


def words(n, rng, size=400):
    return " ".join(rng.choice(VOCABULARY[:size]) for _ in range(n))


VOCABULARY = [f"w{i:x}é" if i % 7 == 0 else f"w{i:x}" for i in range(4000)]


def removed(texts, window=400):
    """Brute force of the removal of repeated strings of so many bytes."""
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[p : p + window] for b in bodies for p in range(len(b) - window + 1))
    out = []
    for b in bodies:
        mark = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if seen[b[p : p + window]] > 1:
                mark[p : p + window] = b"\1" * window
        runs = sum(1 for k in range(len(mark)) if mark[k] and (not k or not mark[k - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "chunk"), [(4096, 1_000_000), (3, 700)])
def test_repeated_passages(spark, monkeypatch, group, chunk):
    monkeypatch.setattr(op2_suffix, "GROUP", group)
    rng = random.Random(4)
    shared, other = words(120, rng), words(90, rng)
    texts = [words(60, rng) + shared + words(30, rng) for _ in range(8)] + [shared[: 380 + i] + words(50, rng) for i in range(8)]
    texts += [None, "", "a" * 900, "ab" * 450, words(300, rng), shared, shared, other + words(5, rng) + other, words(20, rng) + shared[:399], shared[100:] + "é" * 300]
    df = docs(spark, texts)
    got = op2_suffix.remove_repeats(df, chunk=chunk, counted=op2_suffix.PASSAGE).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("x"), "h", "n_repeated").collect()
    want = removed(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.x) for r in got} == dict(enumerate(want))
    assert {r.doc_id: r.n_repeated for r in got} == {i: x[1] for i, x in enumerate(removed(texts, 256))}
    twice = docs(spark, [(1, shared), (1, shared), (None, shared[50:]), (None, None)])
    got = op2_suffix.remove_repeats(twice).select("n_bytes", "n_removed").collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == sorted(x[:2] for x in removed([shared, shared, shared[50:], None]))
    assert op2_suffix.remove_repeats(docs(spark, [])).collect() == []
    kept = op2_suffix.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == len(texts)


def test_long_texts_in_pieces():
    """Pieces of a long text hold each window once, and its shingles are those of the whole."""
    rng = random.Random(9)
    for n in (0, 1, 399, 400, 401, 1399, 1400, 1401, 5000):
        starts = [a + w for part in op2_suffix.pieces([bytes(n)], 400, 1000) for _, a, v in part for w in range(max(0, len(v) - 399))]
        assert starts == list(range(max(0, n - 399)))
    body = words(3000, rng).encode() + b" \n\t" + words(500, rng).encode()
    assert all((a == b).all() for a, b in zip(shingles.sets_of([body], 5, most=700), shingles.sets_of([body], 5)))
    short = [b"", b"a", b"a b c", body, b"d e f g h i"]
    alone = [s for a, b in shingles.ranges(short, 1000) for s in shingles.sets_of(short[a:b], 5, most=1000)]
    assert len(alone) == 5 and all((a == b).all() for a, b in zip(alone, shingles.sets_of(short, 5)))


def test_deep_shallow_sort():
    rng = random.Random(1)
    for _ in range(40):
        base = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([3, 150, 300]))) for _ in range(4)]
        strings = [rng.choice(base)[: rng.randint(1, 300)] for _ in range(rng.choice([0, 1, 2, 60]))]
        mat = deepshallow.matrix_of(strings, 304)
        groups = np.array([rng.randrange(3) for _ in strings], np.int64)
        order = deepshallow.sort(mat, groups, rng.choice([8, 128]))
        keys = [(groups[i], mat[i].tobytes()) for i in order]
        assert keys == sorted(keys)


def classes(texts):
    """Brute force of components by shingle similarity."""
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


PATHS = [{}, {"heavy_df": 3, "heavy_most": 20, "group": 2}]


@pytest.mark.parametrize("settings", PATHS)
def test_near_duplicates(spark, settings):
    rng = random.Random(8)
    base, passage = words(150, rng, 4000).split(), words(60, rng, 4000)
    texts = [None, "", " \t", "One two", "one TWO", "one two three", words(400, rng, 4000)]
    for changes in (0, 1, 2, 3, 4, 5, 3, 2, 4, 4, 4, 5, 5):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        texts.append(" ".join(w))
    texts += [words(150, rng, 4000) + " " + passage for _ in range(6)] + [passage, passage + " x", passage.upper()]
    chain = words(60, rng, 4000).split()
    texts += [" ".join(chain[i * 2 : i * 2 + 45]) for i in range(8)]
    df = docs(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op3_jaccard.near_duplicates(df, **settings).collect()}
    want = classes(texts)
    assert got == want
    kept = op3_jaccard.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()}


@pytest.mark.parametrize("settings", [{"heavy_df": 1}, {"heavy_df": 40, "group": 2}])
def test_near_duplicates_of_unequal_size(spark, settings):
    """Documents that another extends by a quarter at most, plain or with a passage that many quote."""
    rng = random.Random(5)
    texts, passages = [], [words(9, rng, 4000), words(40, rng, 4000)]
    for size, more in [(8, 2)] * 60 + [(16, 4)] * 30 + [(80, 20)] * 15 + [(8, 3), (80, 21)] * 5:
        quoted = rng.choice(["", "", *passages])
        own = max(0, size + 4 - len(quoted.split()))
        x = f"{words(own, rng, 4000)} {quoted}".split()[-size - 4 :]
        texts += rng.sample([" ".join(x), " ".join([*x, *words(more, rng, 4000).split()])], 2)
    df, want = docs(spark, texts), classes(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op3_jaccard.near_duplicates(df, **settings).collect()} == want


@pytest.mark.parametrize("settings", PATHS)
def test_near_duplicates_of_every_size(spark, settings):
    """Sets of 1 to 60 shingles, with words cut, added or changed at either end, and popular lines."""
    rng = random.Random(11)
    lines, texts = [words(n, rng, 4000).split() for n in (6, 12, 25)], []
    for size in [*range(5, 65), *range(5, 20), 40, 60]:
        base = [*rng.choice([[], [], [], *lines]), *words(size, rng, 4000).split()][:size]
        for _ in range(rng.choice([2, 3, 5])):
            cut, w = rng.randrange(1 + size // 5), list(base)
            w = rng.choice([w[cut:], w[: size - cut], w + words(cut, rng).split(), words(cut, rng).split() + w, w[cut // 2 : size - cut // 2]])
            if w and rng.random() < 0.3:
                w[rng.choice([0, -1])] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    got = op3_jaccard.near_duplicates(docs(spark, texts), **settings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == classes(texts)


def test_near_duplicates_edge_rows(spark):
    rng = random.Random(2)
    a = words(40, rng)
    odd = docs(spark, [(7, a), (7, a), (None, a), (3, None), (None, "")])
    got = op3_jaccard.near_duplicates(odd).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 7), (3, 3), (7, 7), (7, 7)]
    assert op3_jaccard.keep_one(odd).count() == 3
    assert op3_jaccard.near_duplicates(docs(spark, [])).collect() == []


def test_tokens_match_the_library():
    from tokenizers import Tokenizer

    path, rng = default_tokenizer(), random.Random(1)
    mine, theirs = WordTokenizer(path), Tokenizer.from_file(path)
    alphabet = "abAB Σς İ̱Hh́é\x0b\x85\xa0\t\n12'sS.,!ßÀ²½漢🙂​ _-"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["x<|endoftext|>y", "<|ENDOFTEXT|>", "don't I'M.", ""]
    assert mine.ids(texts) == [np.array(e.ids, np.uint32).tobytes() for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_packing_plans():
    rng = np.random.default_rng(0)
    for top, n in ((5, 0), (5, 3000), (300, 700), (9000, 900), (2049, 1)):
        sizes = rng.integers(1, top, n)
        doc, start, length, seq, offset, made = plan(sizes, 2048, 500)
        assert length.sum() == sizes.sum() and (length > 0).all()
        used = np.bincount(seq, weights=length, minlength=made).astype(int)
        assert all(u == 2048 or (0 < u < 2048 and u & (u - 1) == 0) for u in used)
        for keys, at, whole in ((doc, start, sizes), (seq, offset, used)):
            order = np.lexsort((at, keys))
            k, a, m = keys[order], at[order], length[order]
            same = k[1:] == k[:-1]
            assert (a[1:][same] == (a + m)[:-1][same]).all() and (a[1:][~same] == 0).all() and (np.bincount(k, weights=m, minlength=len(whole)) == whole).all()


def test_packing_round_trip(spark):
    rng = random.Random(6)
    texts = [None, "", words(5000, rng), "Hello, world!", "Hello, world!"] + [words(rng.randint(1, 300), rng) for _ in range(40)]
    tokenizer = WordTokenizer(default_tokenizer())
    rows = pack_documents(docs(spark, texts), default_tokenizer(), with_ids=True).collect()
    joined: dict = collections.defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(joined[r.doc_id]) == 4 * r.start and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        joined[r.doc_id] += bytes(r.ids)
    end = np.array([1], np.uint32).tobytes()
    assert joined == {i: ids + end for i, ids in enumerate(tokenizer.ids([t or "" for t in texts]))}
    assert pack_documents(docs(spark, []), default_tokenizer()).collect() == []
    odd = pack_documents(docs(spark, [(None, "a b"), (1, "a b"), (1, "a b"), (None, None)]), default_tokenizer()).collect()
    assert sum(r.length for r in odd if r.doc_id == 1) == 2 * odd[0].doc_tokens and sum(r.length for r in odd if r.doc_id is None) == odd[0].doc_tokens + 1


def test_words_of_long_texts(monkeypatch):
    """A long text's ids are those of the whole, whatever the parts and the size of the cache."""
    rng = random.Random(3)
    texts = [words(3000, rng, 4000), "x " * 500, "é" * 2000, words(40, rng), ""]
    want = WordTokenizer(default_tokenizer()).ids(texts)
    for part, cache in ((500, 24_000_000), (700, 4_000), (10_000, 40_000)):
        monkeypatch.setattr(op4_packing, "PART", part)
        monkeypatch.setattr(op4_packing, "CACHE", cache)
        small = WordTokenizer(default_tokenizer())
        assert small.ids(texts) == want == small.ids(texts) and small.size <= cache


def test_licence_phrases(spark):
    rng, machine = random.Random(2), automaton()
    parts = "CC by BY-NC mit license License. Apache gnu general public é x 9 MIT\nlicense cc".split(" ")
    texts = [None, "", "MIT-license; mit license"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    for r in scan_licenses(docs(spark, texts)).collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[r.doc_id] or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = sorted((i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        labels = ",".join(sorted({x[1] for x in at}))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, labels)
        assert set(filter(None, labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\n", machine)[5:] == ("apache,bsd,mit", 0.75, True)


def test_licences_in_long_texts_and_odd_rows(spark):
    """10 MB take seconds, not a time that grows with the square of the matches."""
    text = "mit license, GNU general public license or so " * 220_000
    got = scan(text.encode(), automaton())
    assert got[:5] == (220_000 * 8, 440_000, 0, 220_000 * 8 - 6, "gpl,mit")
    rows = scan_licenses(docs(spark, [(None, "mit license"), (1, "cc by"), (1, "cc by"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, r.labels) for r in rows) == [(0, 2, 1, "mit"), (1, 2, 1, "cc-by"), (1, 2, 1, "cc-by"), (2, 0, 0, "")]
    assert scan_licenses(docs(spark, [])).collect() == []


@pytest.mark.parametrize(
    ("text", "order", "labels", "free"),
    [("MIT OR GPL-2.0-only", "MIT GPL-2.0-only or", {"mit", "gpl"}, True), ("MIT AND GPL-2.0 WITH X", "MIT GPL-2.0 X with and", {"mit", "gpl"}, False), ("(MIT", "", set(), False), ("A or B and C", "A B C and or", {"a", "b", "c"}, False), ("MIT)", "MIT", {"mit"}, True), ("", "", set(), False)],
)
def test_licence_expressions(text, order, labels, free):
    assert postfix(text) == order.split() and evaluate(postfix(text)) == (labels, free)


def test_mixing(spark):
    rng = random.Random(3)
    texts = [words(rng.randint(1, 60), rng) for _ in range(400)] + [None, ""]
    sources = [rng.choice(["b", "a", None, "c", "zz"]) for _ in texts[:-1]] + ["empty"]
    df = docs(spark, texts, sources)
    rows = mix(df).collect()
    total, sums, targets = sum(r["size"] for r in rows), collections.Counter(), {}
    for r, s in ((r, sources[r.doc_id]) for r in rows):
        assert r.taken <= 3 * r["size"] and r["size"] == len((texts[r.doc_id] or "").split())
        sums[s] += r.taken
        targets[s] = r.target
    weights = dict(zip(["a", "b", "c", "empty", "zz", None], [5, 2, 1, 5, 2, 1]))
    own = collections.Counter()
    for t, s in zip(texts, sources):
        own[s] += len((t or "").split())
    want, open_, rest = {}, dict(weights), total
    while open_:
        level = rest / sum(open_.values())
        over = [s for s in open_ if level * open_[s] > 3 * own[s]]
        if not over:
            want |= {s: level * w for s, w in open_.items()}
            break
        for s in over:
            want[s] = 3.0 * own[s]
            rest -= want[s]
            del open_[s]
    assert all(abs(targets[s] - want[s]) < 1e-6 for s in want) and all(abs(sums[s] - want[s]) <= 60 for s in want)
    assert sorted(map(tuple, mix(df.repartition(3)).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert mixed_documents(df).groupBy("doc_id").count().agg(F.sum("count")).first()[0] == sum(r.copies for r in rows)
    assert mix(docs(spark, [])).collect() == [] and mixed_documents(docs(spark, [None])).collect() == []
    odd = mix(docs(spark, [(1, "a b"), (1, "a b"), (None, "a b c"), (None, "a b c"), (2, None)], ["s", "s", "s", None, None])).collect()
    assert sorted((r.doc_id or 0, r["size"], r.source_size) for r in odd) == [(0, 3, 3), (0, 3, 7), (1, 2, 7), (1, 2, 7), (2, 0, 3)] and all(r.taken <= 3 * r["size"] for r in odd)


PAGES = [
    ("<html><body><header>Site</header><div class='sidebar'>s <div>x</div> y</div><main><h1>T</h1><p>One <b>two</b>three&nbsp;&lt;b&gt; <a href=x>link</a></p><aside>no</aside><p class=\"ad\">buy<p>Four</p><div id=comments><p>bad</p></div><p>Five</main><footer>f</footer>", "T One twothree <b> link Four Five"),
    ("<article><script>var t='</p><p>no</p>'</script><p>A\n  b</p><!-- no <p>x</p> --><style>p{}</style><form><input>no</form>C &am", "A b C &am"),
    ("<body><ul><li><a>Home</a><li><a>News</a></ul><p>Alpha beta gamma.</p><p>More words.</p><div class='cookie-notice'>We</div><ul><li>A</ul>", "Alpha beta gamma. More words."),
    ("", ""), ("plain words", "plain words"), ("<nav>never closed <article><p>Kept</p>", "Kept"),
    ("<html><head><title>t</title><body><p>Hello <i>there</i>, world</p>", "Hello there, world"),
    ("<div class='content has-sidebar'><main class='search-results'><p>One two three</p></main></div><div class=sidebar>no</div>", "One two three"),
    ("<form action=x><div class=sidebar>no</div><article><header><p>by me</p><h1>Title</h1></header><p>Text of it</p></article><section id=comments><article class=comment>bad</article></section></form>", "Title Text of it"),
    ("<body><nav>Home About<p>The text begins here.</p><p>It ends here.</p>", "The text begins here. It ends here."),
    ("<body><p>How to do it well:</p><ol><li>First do this thing well</li><li>Then do that thing too</li></ol><p>Done with it all.</p>", "How to do it well: First do this thing well Then do that thing too Done with it all."),
    ("<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Shop now</a></div><div>A text with <a href=x>a link</a>, no marks.</div><div><a>Terms</a> <a>Imprint</a></div>", "A text with a link, no marks."),
]


def test_region_is_best():
    rng = random.Random(7)
    for _ in range(500):
        scores = [rng.choice([-3, -1, -0.5, 0, 1, 2]) for _ in range(rng.randint(0, 12))]
        a, b = best_region(scores)
        sums = {(i, j): sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)}
        top = max([0, *sums.values()])
        assert sum(scores[a:b]) == top and (a, b) == (min((k for k, v in sums.items() if v == top), key=lambda k: (k[0], -k[1])) if top > 0 else (0, 0))


def test_region_leaves_words_out():
    """The scan, not the lists of marks, leaves out what lies around a text without marks."""
    page = PAGES[-1][0]
    kept = [v for k, v in stream(page) if k not in ("tag", "boiler", "none")]
    assert "Home" in "".join(kept) and "Imprint" in "".join(kept) and "Home" not in extract(page, DEFAULT)


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert extract(page, DEFAULT) == text


def test_pages(spark):
    rows = [(i, f"u{i}", p, "clash") for i, (p, _) in enumerate(PAGES)] + [(None, None, None, "clash")]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)} | {None: ("", 0)}
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    twice = main_text(spark.createDataFrame([(1, "u", PAGES[0][0]), (1, "u", PAGES[0][0])], "page_id long, url string, html string")).collect()
    assert len(twice) == 2 and {r.text for r in twice} == {PAGES[0][1]}
    assert best_region([1, -5, 2, 3, -1, 2, -9, 4]) == (2, 6) and best_region([-1.0]) == (0, 0) and best_region([]) == (0, 0)
