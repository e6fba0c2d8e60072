"""Work on a whole graph in one executor task, for graphs of a checked size."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.graph import GraphError


def one_task(rows: DataFrame, kernel, schema: str, limit: int) -> DataFrame:
    n = rows.count()
    if n > limit:
        raise GraphError(f"{n} rows exceed the limit of {limit} for a sequential kernel")
    return rows.groupBy(F.lit(1).alias("_graph")).applyInPandas(lambda pdf: kernel(pdf.drop(columns="_graph", errors="ignore")), schema)


def children_of(pdf: pd.DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for a, b in pdf.dropna(subset=["dst"]).sort_values("dst")[["src", "dst"]].drop_duplicates().itertuples(index=False):
        out[a].append(b)
    return out
