"""Nearest neighbours of a stated query set against all rows, exactly, by blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

QUERY_BLOCK, ROW_BLOCK = 512, 16_384  # a block of scores is 34 MB


def nearest(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, id, similarity, rank): the `k` rows with the highest cosine similarity to each query, itself left out, ties by id.

    Queries and rows are each dealt to blocks by hash; a block of queries meets a block of rows in one task, as a matrix product that
    keeps its k best a query. What is shuffled is the rows once a query block and k rows a query and row block. Null and zero vectors
    have no neighbours.
    """
    n_queries, n_rows = queries.count(), rows.count()
    q_blocks, r_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.lit(True).alias("asks"), deal(id_col, q_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1))).alias("r"))
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), deal(id_col, r_blocks).alias("r"))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        asks, held = frame[frame["asks"]], frame[~frame["asks"]]
        if asks.empty or held.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        ids, qids = held["id"].to_numpy(), asks["id"].to_numpy()
        asked_units, units, take = _unit(np.stack(asks["v"].to_numpy())), _unit(np.stack(held["v"].to_numpy())), min(k, len(ids))
        found = []
        for at in range(0, len(qids), QUERY_BLOCK):  # hashing may deal a block somewhat more
            scores = asked_units[at : at + QUERY_BLOCK] @ units.T
            scores[(qids[at : at + QUERY_BLOCK, None] == ids[None, :]) | ~np.isfinite(scores)] = -np.inf
            least = np.partition(scores, len(ids) - take, axis=1)[:, len(ids) - take]  # the k-th best; ties with it stay, and Spark ranks them by id
            q, r = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            found.append(pd.DataFrame({"query_id": qids[at + q], "id": ids[r], "similarity": scores[q, r]}))
        best = pd.concat(found).sort_values(["query_id", "similarity", "id"], ascending=[True, False, True])
        return best.groupby("query_id").head(k)

    kind = dict(rows.dtypes)[id_col]
    met = asked.unionByName(base).filter("v is not null").groupBy("q", "r").applyInPandas(best, f"query_id {kind}, id {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(norm > 0, m / norm, np.nan)
