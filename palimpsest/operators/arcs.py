"""Open topics (arcs): an ordered fold of each user's edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.scan import arrival

LOOK = 20


def arcs(edges: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``edges(user_id, id, embedding, sequence_number?)`` -> ``user_id, id, arc_id, opened``: an edge joins the most similar of its user's newest arcs if
    that similarity is above their mean, else it opens an arc. An arc is named by its first edge. The fold keeps at most ``LOOK``
    arcs of a user in memory. ``heads(user_id, id, embedding, sequence_number)``: the edges that opened the arcs there are."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "id"])
        names: list[int] = []
        vectors: list[np.ndarray] = []
        out, opened = [], []
        told = rows.loc[~rows["head"]]
        for i, v, head in zip(rows["id"], rows["embedding"], rows["head"], strict=True):
            v = np.asarray(v, dtype=np.float64)
            if head:
                names, vectors = [*names, int(i)][-LOOK:], [*vectors, v][-LOOK:]
                continue
            sims = np.array([float(v @ a) for a in vectors[-LOOK:]])
            if len(sims) > 1 and sims.max() > sims.mean():
                out.append(names[-LOOK:][int(sims.argmax())])
                opened.append(False)
            else:
                names.append(int(i))
                vectors.append(v)
                out.append(int(i))
                opened.append(True)
            names, vectors = names[-LOOK:], vectors[-LOOK:]
        return pd.DataFrame({"user_id": told["user_id"], "id": told["id"], "arc_id": out, "opened": opened})

    rows = edges.select("user_id", "id", "embedding", arrival(edges)[0].alias("place"), F.lit(False).alias("head"))
    if heads is not None:
        rows = rows.unionByName(heads.select("user_id", "id", "embedding", arrival(heads)[0].alias("place"), F.lit(True).alias("head")))
    return rows.groupBy("user_id").applyInPandas(fold, "user_id long, id long, arc_id long, opened boolean")
