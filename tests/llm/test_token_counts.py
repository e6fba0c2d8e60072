import random

import numpy as np

from lattica.llm.op4_packing import WordTokenizer, default_tokenizer
from lattica.llm.op5_tokencounts import END, count_tokens, scan
from tests.llm.test_text import docs, words


def flat(spark, files, size):
    rows = [(f, i // size, np.array(t[i : i + size], np.uint16).tobytes()) for f, t in files.items() for i in range(0, len(t), size)]
    return spark.createDataFrame(rows, "file_id long, block long, data binary").repartition(3)


def test_scan_against_brute_force(spark):
    rng = random.Random(1)
    files = {f: [END if rng.random() < 0.15 else rng.randrange(100) for _ in range(rng.randrange(60))] for f in range(20)}
    files |= {20: [1] * 30, 21: [END] * 9, 22: [], 23: [1] * 25 + [END]}
    want = set()
    for f, tokens in files.items():
        start, index = 0, 0
        for i, t in enumerate([*tokens, None]):
            if t == END or (t is None and start < len(tokens)):
                want.add((f, index, start, i - start, t == END))
                start, index = i + 1, index + 1
    for size in (1, 4, 1000):
        got = scan(flat(spark, files, size)).collect()
        assert len(got) == len(want) and {(r.file_id, r.doc_index, r.start, r.n_tokens, r.ended) for r in got} == want
    assert scan(flat(spark, {}, 4)).collect() == []


def test_counts_of_documents(spark):
    rng = random.Random(2)
    texts = [None, "", "a <|endoftext|> b", words(3000, rng)] + [words(rng.randrange(40), rng) for _ in range(60)]
    tokenizer = WordTokenizer(default_tokenizer())
    want = sorted((i, len(b) // 4) for i, b in enumerate(tokenizer.ids([t or "" for t in texts])))
    got = count_tokens(docs(spark, texts).repartition(3), default_tokenizer(), block=50).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want
    twice = count_tokens(docs(spark, [(1, "a b"), (1, "a b"), (None, "c")]), default_tokenizer()).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in twice) == [(0, 1), (1, 2), (1, 2)]
    assert count_tokens(docs(spark, []), default_tokenizer()).collect() == []
