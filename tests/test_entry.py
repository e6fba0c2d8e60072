import __spark_entry__ as entry
from lattica.sources import tables as G


def test_registry_is_consistent():
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len([n for n in names if n.startswith("graph_")]) >= 45


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "label", "score", "in_degree", "out_degree"] and df.count() == 25


def test_max_flow_counts_all_shipments(spark):
    d = "/root/testdata/sf0.01"
    weight = {(r.src, r.dst): r.weight for r in G.shipments(spark, d).collect()}
    rows = entry.queries()["graph_max_flow"](spark, d).collect()
    cut = {(r.src, r.dst) for r in rows}
    seen, todo = {"N:0"}, ["N:0"]
    while todo:
        v = todo.pop()
        for a, b in weight.keys() - cut:
            if a == v and b not in seen:
                seen.add(b)
                todo.append(b)
    assert "N:7" not in seen and abs(sum(weight[e] for e in cut) - rows[0].max_flow) < 1e-6
