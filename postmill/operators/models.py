"""Scorers: closed-form naive Bayes over long tables, logistic regression by spark.ml, the decision rule, temperature."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from postmill.operators import features as X
from postmill.runtime import cut, release, spread
from postmill.schema import LABELS

THRESHOLD = 0.5


def decide(p_legit: Column, p_spam: Column, p_phishing: Column, threshold: float = THRESHOLD) -> Column:
    """0 legit, 1 spam, 2 phishing: a scam if the two scam classes together reach the threshold, then the likelier, spam in a tie."""
    return F.when(1 - p_legit >= threshold, F.when(p_spam >= p_phishing, 1).otherwise(2)).otherwise(0)


def log_odds(p: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (1 - p))


def fit_bernoulli_nb(presence: DataFrame, labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """(label, term, yes, base): log weight of a term's presence in a class, and the class's score of a row with no terms.

    presence: distinct (id, term); labels: (id, label); vocab: (term). Smoothing 1, priors as counted.
    """
    classes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    classes = classes.crossJoin(F.broadcast(classes.agg(F.sum("n_class").alias("n_all"))))
    seen = presence.join(labels, "id").join(vocab.select("term"), "term").groupBy("label", "term").agg(F.count(F.lit(1)).alias("n_term"))
    grid = vocab.select("term").crossJoin(F.broadcast(classes)).join(seen, ["label", "term"], "left")
    theta = (F.coalesce("n_term", F.lit(0)) + 1) / (F.col("n_class") + 2)
    cells = grid.select("label", "term", (F.log(theta) - F.log(1 - theta)).alias("yes"), F.log(1 - theta).alias("no"), F.log(F.col("n_class") / F.col("n_all")).alias("prior"))
    base = cells.groupBy("label").agg((F.sum("no") + F.first("prior")).alias("base"))
    return cells.select("label", "term", "yes").join(F.broadcast(base), "label")


def fit_nb(counts: DataFrame, labels: DataFrame, vocabulary: int = 3000, selected: int = 1000) -> DataFrame:
    """The published naive Bayes chain: TF-IDF over the `vocabulary` commonest terms of the labelled rows, of these the `selected` that differ most by class (chi-squared), presence of these.

    counts: (id, term, tf), labelled or not; labels: (id, label) of the training rows. Returns the table of `fit_bernoulli_nb`.
    """
    own = cut(counts.join(labels.select("id"), "id"))
    weights = cut(X.tfidf(own, X.vocabulary(own, max_terms=vocabulary), labels.agg(F.count(F.lit(1)).alias("n"))))
    chosen = X.top(X.chi_squared(weights, labels).withColumn("k", F.round("chi2", 6)), "k", selected)
    terms = cut(chosen.select("term"))
    model = cut(fit_bernoulli_nb(own.select("id", "term"), labels, terms))
    release(own, weights, terms)
    return model


def nb_scores(presence: DataFrame, ids: DataFrame, model: DataFrame) -> DataFrame:
    """(id, p_legit, p_spam, p_phishing): a row without known terms has the base scores."""
    base = model.select("label", "base").distinct()
    hits = presence.join(model.select("label", "term", "yes"), "term").groupBy("id", "label").agg(F.sum("yes").alias("s"))
    scores = ids.crossJoin(F.broadcast(base)).join(hits, ["id", "label"], "left").select("id", "label", (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("s"))
    wide = scores.groupBy("id").agg(*(F.max(F.when(F.col("label") == x, F.col("s"))).alias(x) for x in LABELS))
    best = F.greatest(*LABELS)
    total = sum((F.exp(F.coalesce(F.col(x) - best, F.lit(-745.0))) for x in LABELS[1:]), F.exp(F.coalesce(F.col(LABELS[0]) - best, F.lit(-745.0))))
    return wide.select("id", *((F.exp(F.coalesce(F.col(x) - best, F.lit(-745.0))) / total).alias(f"p_{x}") for x in LABELS))


def logistic_regression(train: DataFrame, test: DataFrame, features: str = "features", label: str = "y", c: float = 10.0, iterations: int = 300) -> DataFrame:
    """`test` with `probability` and `prediction` of a balanced multinomial regression with inverse strength `c`."""
    from pyspark.ml.classification import LogisticRegression

    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))  # a row a class
    sizes = [r["_n"] for r in counts.collect()]
    n = sum(sizes)
    weighted = train.join(F.broadcast(counts), label).withColumn("_w", F.lit(float(n)) / (F.col("_n") * max(len(sizes), 1)))
    lr = LogisticRegression(featuresCol=features, labelCol=label, weightCol="_w", family="multinomial", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=iterations, tol=1e-4)
    return lr.fit(weighted).transform(test)


def text_vectors(prepared: DataFrame, train_ids: DataFrame, id_col: str = "msg_id", text_col: str = "text", words: int = 300_000, grams: int = 150_000) -> DataFrame:
    """(id, features): sublinear TF-IDF of words and word pairs beside that of character n-grams inside words (2 to 5), each of length 1.

    Vocabularies are those of the training rows: terms in two of them or more, the `words` commonest; n-grams in three or more, the
    `grams` commonest. They are sent to every task, which makes whole vectors of its rows; the counts of a row's terms, hundreds, are
    never written.
    """
    rows = prepared.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = spread(rows).withColumn("tokens", F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)))
    n = train_ids.count()
    counts = cut(X.totals(rows.join(train_ids, "id", "left_semi")))
    halves = []
    for half, least, most in ((0, 2, words), (1, 3, grams)):
        vocab = counts.filter((F.col("half") == half) & (F.col("df") >= least)).orderBy(F.desc("total"), "term").limit(most).select("term", "df").toPandas().sort_values("term")
        halves.append((vocab["term"].tolist(), np.log((n + 1) / (vocab["df"].to_numpy(np.float64) + 1)) + 1))
    out = X.vectors(X.text_weights(rows, *halves), max(sum(len(terms) for terms, _ in halves), 1))
    release(counts)
    return out


def hashed_features(df: DataFrame, terms: Column, size: int = 1 << 16, out: str = "features") -> DataFrame:
    """Sparse vectors of hashed term counts, weighted by inverse document frequency."""
    from pyspark.ml.feature import IDF, HashingTF

    counted = HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=size).transform(df.withColumn("_terms", terms))
    return IDF(inputCol="_tf", outputCol=out, minDocFreq=2).fit(counted).transform(counted).drop("_terms", "_tf")


def temperature_grid(df: DataFrame, low: float = 0.5, high: float = 3.0, steps: int = 26) -> DataFrame:
    """(temperature, nll): mean negative log-likelihood of the label at each temperature; df has y and p_legit, p_spam, p_phishing."""
    grid = df.sparkSession.range(steps).select((F.lit(low) + F.col("id") * ((high - low) / (steps - 1))).alias("temperature"))
    z = [F.log(F.greatest(F.col(f"p_{x}"), F.lit(1e-12))) / F.col("temperature") for x in LABELS]
    own = F.element_at(F.array(*z), F.col("y") + 1)
    total = F.log(F.exp(z[0]) + F.exp(z[1]) + F.exp(z[2]))
    return df.crossJoin(F.broadcast(grid)).groupBy("temperature").agg(F.avg(total - own).alias("nll"))


def score_with(df: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], list[list[float]]]], id_col: str = "msg_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """(id, p_legit, p_spam, p_phishing) by any model: `scorer` builds it once a task and is then called with texts and domains.

    Batches are formed in order of length, so that padded models waste little.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("domain")).sortWithinPartitions(F.length("text"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = scorer()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                scores = predict(part["text"].fillna("").tolist(), part["domain"].tolist())
                yield pd.DataFrame({"id": part["id"].to_numpy()} | {f"p_{x}": [float(s[k]) for s in scores] for k, x in enumerate(LABELS)})

    return rows.mapInPandas(run, f"id {df.schema[id_col].dataType.simpleString()}, p_legit double, p_spam double, p_phishing double")


def onnx_scorer(model: str, tokenizer: str, max_len: dict[str, int], temperature: float = 1.0):
    """A scorer for `score_with`: an ONNX classifier and its tokenizer file, each at the same path on every machine.

    Texts are cut to the length of their own domain and padded to the longest of the batch.
    """

    def build():
        import numpy as np
        import onnxruntime
        import tokenizers

        encoder = tokenizers.Tokenizer.from_file(tokenizer)
        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1  # tasks are the parallelism
        network = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
        inputs = {x.name for x in network.get_inputs()}

        def predict(texts: list[str], domains: list[str]) -> list[list[float]]:
            ids = [encoder.encode(t).ids[: max_len[d]] for t, d in zip(texts, domains)]
            width = max(map(len, ids), default=1)
            tokens, mask = np.zeros((len(ids), width), np.int64), np.zeros((len(ids), width), np.int64)
            for row, own in enumerate(ids):
                tokens[row, : len(own)], mask[row, : len(own)] = own, 1
            given = {"input_ids": tokens, "attention_mask": mask, "token_type_ids": np.zeros_like(tokens)}
            (logits,) = network.run(None, {k: v for k, v in given.items() if k in inputs})[:1]
            odds = np.exp((logits - logits.max(axis=1, keepdims=True)) / temperature)
            return (odds / odds.sum(axis=1, keepdims=True)).tolist()

        return predict

    return build


class QuotaExhausted(RuntimeError):
    """No key has calls left."""


def parse_label(answer: str) -> str:
    """The label in a service's answer: a JSON object with `label`, or the bare word; `error` for anything else."""
    try:
        value = json.loads(answer)
        answer = value.get("label", "") if isinstance(value, dict) else value
    except ValueError:
        pass
    answer = answer.strip().lower() if isinstance(answer, str) else ""
    return answer if answer in LABELS else "error"


def remote_scorer(make_client: Callable[[str], Callable[[str, str], str]], keys: list[str], attempts: int = 6, wait: Callable[[float], None] = lambda s: None, pause: float = 0.0):
    """label(text, system) by a remote service: keys take over from one another when their quota ends, failures are tried again with growing waits, unknown labels read `error`.

    pause: least seconds between two calls, waited for with `wait`.
    """
    state = {"key": 0, "client": None, "last": None}

    def throttle() -> None:
        now = time.monotonic()
        if pause and state["last"] is not None and (left := state["last"] + pause - now) > 0:
            wait(left)
        state["last"] = time.monotonic()

    def label(text: str, system: str) -> str:
        while state["key"] < len(keys):
            if state["client"] is None:
                state["client"] = make_client(keys[state["key"]])
            for k in range(attempts):
                throttle()
                try:
                    return parse_label(state["client"](text, system))
                except QuotaExhausted:
                    break
                except (ConnectionError, TimeoutError):
                    wait(min(60.0, 5.0 * 2**k))
            else:
                return "error"
            state.update(key=state["key"] + 1, client=None)
        raise QuotaExhausted("all keys are used up")

    return label


def answer_pending(messages: DataFrame, done: DataFrame, labeller: Callable[[], Callable[[str, str], str]], model: str, variant: str, system: str = "", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(model, variant, id, label, secs) of the messages without a usable answer in `done` yet; append it to the cache and call again to resume.

    labeller: builds, once a task, what labels a text. done: (model, variant, id, label).
    """
    usable = done.filter((F.col("model") == model) & (F.col("variant") == variant) & F.col("label").isin(*LABELS)).select(F.col("id").alias(id_col))
    pending = messages.select(F.col(id_col).cast("string").alias(id_col), F.col(text_col).alias("text")).join(usable, id_col, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = labeller()
        for frame in frames:
            said, took = [], []
            for text in frame["text"].fillna(""):
                began = time.perf_counter()
                said.append(label(text, system))
                took.append(time.perf_counter() - began)
            yield pd.DataFrame({"model": model, "variant": variant, "id": frame[id_col].to_numpy(), "label": said, "secs": took})

    return pending.mapInPandas(run, "model string, variant string, id string, label string, secs double")
