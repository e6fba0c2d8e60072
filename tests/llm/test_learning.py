import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm.common import table
from lattica.llm.op7_toxicity import IDENTITY, features, score_documents, swapped, train
from tests.llm.test_text import docs

SF = "/root/testdata/sf0.1"


def test_held_out_ranking(spark):
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = score_documents(d, train(d, labels)).join(labels, "doc_id").filter("held_out").select("score", "toxic", "predicted").toPandas()
    rank, pos = rows.score.rank().to_numpy(), (rows.toxic == 1).to_numpy()
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.98 and rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()
    assert (rows.predicted[~pos] == 0).mean() > 0.98


def test_swaps_in_sentences():
    """Each group term of a sentence is swapped within its language; features shared with another
    sentence, or there already, do not move."""
    def moves(text):
        out: dict = {}
        for x in swapped(text.encode()).tolist():
            out.setdefault(x >> 33, set()).add((x & 0xFFFFFFFF, -1 if x >> 32 & 1 else 1))
        return list(out.values())

    assert moves("no group here. none there") == []
    for lang, term in (("en", "women"), ("de", "männer"), ("fr", "juifs"), ("es", "jóvenes")):
        (one,) = moves(f"x {term.upper() if lang == 'en' else term} y. z")
        gone, come = ({h for h, s in one if s == sign} for sign in (-1, 1))
        assert gone == set(features(term.encode())) and any(come == set(features(t.encode())) for t in IDENTITY[lang] if t != term)
    assert all(s == 1 for one in moves("women here. women there!") for _, s in one) and len(moves("a women. b men\nc")) == 2


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_group_names_do_not_move_scores(spark, lang):
    rng, texts, marks, terms = random.Random(1), [], [], IDENTITY[lang]
    for i in range(400):
        bad = i % 4 == 0
        group = rng.choice(terms[:6]) if bad or rng.random() < 0.3 else terms[-1]
        texts.append(" ".join(["idiot" if bad else "table", group, *(f"x{rng.randrange(50)}" for _ in range(12))]))
        marks.append((i, 0, int(bad)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    spread = {}
    for swap in (0.0, 50.0):
        model = train(docs(spark, texts), labels, swap=swap)
        spread[swap] = np.ptp([model.word(t.encode()) for t in terms[:6] + terms[-1:]])
    assert spread[50.0] < spread[0.0] / 3


def test_odd_rows(spark):
    labels = spark.createDataFrame([(0, 0, 1), (0, 0, 1), (1, 0, 0), (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, [(0, "bad " * 5000), (1, "good"), (None, "bad"), (5, None), (5, None)]).withColumn("score", F.lit("clash"))
    got = score_documents(d, train(d, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    empty = docs(spark, [])
    assert score_documents(empty, train(empty, labels.limit(0))).collect() == []
