"""Which words a naive Bayes decision rests on, by occlusion: a word's impact is the change of the scam log-odds when it is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from postmill.functions import text as T
from postmill.operators.models import log_odds
from postmill.schema import LABELS

MOST_WORDS, LEAST_IMPACT, TOP = 60, 0.05, 6


def occlusion(df: DataFrame, model: DataFrame, scores: DataFrame, id_col: str = "msg_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(id, word, position, start, end, impact): up to `top` words of each message with an impact of at least LEAST_IMPACT, and where each stands in the text (characters from 0, end excluded).

    Looks at a message's first MOST_WORDS words, as the score of one word among many more says little. Leaving out a word takes away
    the terms that no other word holds, so the new score follows from the old one; no text is scored again. Messages of fewer than
    two words have no evidence. scores: (id, p_*) of the same model.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    spans: Column = T.words(F.col("text"))
    words = texts.select("id", F.posexplode(F.when(F.size(spans) >= 2, spans)).alias("position", "word"))
    terms = words.select("id", "position", F.explode(F.array_distinct(T.tokenize(F.col("word")))).alias("term"))
    alone = terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("position")).filter((F.col("n") == 1) & (F.col("position") < MOST_WORDS))
    lost = alone.join(model.select("term", "label", "yes"), "term").groupBy("id", "position").agg(*(F.sum(F.when(F.col("label") == x, F.col("yes")).otherwise(0.0)).alias(x) for x in LABELS))
    z = [F.log(F.greatest(F.col(f"p_{x}"), F.lit(1e-300))) - F.col(x) for x in LABELS]
    best = F.greatest(*z)
    legit = F.exp(z[0] - best) / (F.exp(z[0] - best) + F.exp(z[1] - best) + F.exp(z[2] - best))
    impact = F.round(log_odds(1 - F.col("p_legit")) - log_odds(1 - legit), 3)
    weighed = lost.join(scores, "id").select("id", "position", impact.alias("impact")).filter(F.abs("impact") >= LEAST_IMPACT)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.abs("impact")), "position"))
    best_words = weighed.withColumn("rank", rank).filter(F.col("rank") <= top)
    # runs of words and blanks by turns: the word's own run, and the length of what stands before it
    runs = F.regexp_extract_all("text", F.lit(r"(?U)\S+|\s+"), F.lit(0))
    placed = best_words.join(texts.withColumn("runs", runs), "id").withColumn("at", 2 * F.col("position") + F.get("runs", F.lit(0)).rlike(r"(?U)^\s").cast("int"))
    word, start = F.get("runs", F.col("at")), F.length(F.array_join(F.slice("runs", 1, F.col("at")), ""))
    return placed.select("id", word.alias("word"), "position", start.alias("start"), (start + F.length(word)).alias("end"), "impact")
