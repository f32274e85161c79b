"""The serving surface over DataFrames: requests in, labels, probabilities and evidence out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from postmill.functions import text as T
from postmill.operators import explain, models as M
from postmill.schema import DOMAINS, LABELS

MOST_CHARS, MOST_TEXTS = 6000, 64


def check_request(texts: list[str], kind: str, batch: bool = False) -> list[str]:
    """The texts of a request, or ValueError. Single texts beyond MOST_CHARS are refused, in a batch they are cut."""
    if kind not in DOMAINS:
        raise ValueError(f"type must be one of {DOMAINS}")
    if not texts or len(texts) > (MOST_TEXTS if batch else 1):
        raise ValueError("number of texts")
    if any(not t for t in texts) or (not batch and len(texts[0]) > MOST_CHARS):
        raise ValueError("length of text")
    return [t[:MOST_CHARS] for t in texts]


def health() -> dict[str, str]:
    """What a health check answers."""
    from postmill import __version__

    return {"status": "ok", "version": __version__}


def model_card(report: DataFrame, name: str) -> str:
    """The model card as JSON: a metric table of a run (a row a domain) under the model's name."""
    rows = [r.asDict() for r in report.limit(100).collect()]
    return json.dumps({"model": name, "labels": list(LABELS), "threshold": M.THRESHOLD, "metrics": rows}, sort_keys=True)


def classify(df: DataFrame, model: DataFrame, id_col: str = "msg_id", text_col: str = "text", explained: bool = True) -> DataFrame:
    """(id, label, probabilities, scam_probability, evidence) for every row, by the naive Bayes tables of `fit_bernoulli_nb`."""
    presence = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(T.tokenize(F.col(text_col)))).alias("term"))
    scores = M.nb_scores(presence, df.select(F.col(id_col).alias("id")), model)
    p = [F.col(f"p_{x}") for x in LABELS]
    label = F.element_at(F.array(*map(F.lit, LABELS)), M.decide(*p) + 1)
    rounded = F.create_map(*(part for x, c in zip(LABELS, p) for part in (F.lit(x), F.round(c, 4))))
    out = scores.select("id", label.alias("label"), rounded.alias("probabilities"), F.round(1 - p[0], 4).alias("scam_probability"))
    if not explained:
        return out
    words = explain.occlusion(df, model, scores, id_col, text_col)
    evidence = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "impact"))).alias("evidence"))
    return out.join(evidence, "id", "left")
