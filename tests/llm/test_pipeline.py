import random

import pytest

import corpus_pipeline as P
from lattica.llm.common import park, table
from tests.llm.test_text import classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = []
    for name, stage in P.STAGES[:-1]:
        out = park(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
        docs = out
    assert kept[0] >= kept[1] and kept[1] == kept[2] and kept[2] >= kept[3]
    assert [n for n, _ in P.STAGES] == ["toxicity", "jaccard", "suffix", "mixing", "packing"]
    assert P.run(spark, SF).count() == P.STAGES[-1][1](spark, docs, SF).count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, "en", None, 0), (1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5)]])
def test_empty_and_null_tables(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(len(rows)).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == (1 if rows else 0)


def test_jaccard_stage_keeps_one_of_unequal_sizes(spark):
    rng = random.Random(5)
    texts = []
    for size, more in [(8, 2)] * 60 + [(16, 4)] * 30 + [(80, 20)] * 15 + [(8, 3)] * 5:
        w = [f"w{rng.randrange(4000)}" for _ in range(size + 4 + more)]
        texts += rng.sample([" ".join(w[: size + 4]), " ".join(w)], 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = P.jaccard(spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {c for _, c in classes(texts).values()}
