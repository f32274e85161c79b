"""Queries of the experiments: transfer between channels, leakage of random splits, added sources, shortcuts of a corpus, classic classifiers, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postmill.functions import text as T
from postmill.operators import dedup, models as M, split
from postmill.operators.neighbours import nearest
from postmill.plans.corpus import CLEAN, corpus
from postmill.plans.models import LABELLED, NB_TERMS, SELECTED, VOCABULARY, nb_counts, nb_sql
from postmill.plans.registry import query
from postmill.runtime import cut, table
from postmill.schema import LABELS, label_index

DRAWS = 3  # repetitions of the leakage experiment, each with a random split of its own
_T = f"WITH t AS {NB_TERMS.format(key='msg_id', text='text', rows='corpus')}, x AS (SELECT *, {CLEAN} AS s FROM corpus WHERE {LABELLED}), "


def _flagged_sql(model: str, test: str, by: str) -> str:
    """Rows, flagged share and accuracy of a scorer (`model`, a query of scores) over `test`, (id, label, and `by`)."""
    hit = "CASE WHEN 1 - p0 >= 0.5 THEN 1.0 ELSE 0.0 END"
    return f"SELECT {by}, count(*) AS n_rows, round(avg({hit}), 4) AS flagged, round(avg(CASE WHEN (1 - p0 >= 0.5) = (label <> 'legit') THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM ({test}) JOIN ({model}) USING (id) GROUP BY ALL"


def _fit_sql(train: str, terms: str = "t", ids: str = "SELECT DISTINCT id FROM t") -> str:
    return f"WITH {nb_sql(train, terms, ids)} SELECT id, p0 FROM q"


def fitted(counts: DataFrame, train: DataFrame) -> DataFrame:
    """The naive Bayes table of train rows (msg_id, label), by the published chain."""
    return M.fit_nb(counts, train.select(F.col("msg_id").alias("id"), "label"), VOCABULARY, SELECTED)


def _flagged(counts: DataFrame, test: DataFrame, model: DataFrame, by: list[str]) -> DataFrame:
    scores = M.nb_scores(counts, test.select(F.col("msg_id").alias("id")), model)
    hit = (1 - F.col("p_legit") >= M.THRESHOLD).cast("double")
    right = (hit == (F.col("label") != "legit").cast("double")).cast("double")
    return test.join(scores.withColumnRenamed("id", "msg_id"), "msg_id").groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(hit), 4).alias("flagged"), F.round(F.avg(right), 4).alias("accuracy"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).filter(F.col("label").isin(*LABELS)).withColumn("split", F.lower(F.trim("split")))


_CHANNELS = (("sms", ["sms"]), ("email", ["email"]), ("both", ["sms", "email"]))
_ALL = "SELECT msg_id AS id FROM corpus"


@query(
    _T + "y0 AS (SELECT 1) " + " UNION ALL ".join(
        f"SELECT '{name}' AS trained_on, * FROM (" + _flagged_sql(_fit_sql("SELECT msg_id AS id, label FROM x WHERE s = 'train' AND domain IN (" + ", ".join(f"'{c}'" for c in channels) + ")", ids=_ALL), "SELECT msg_id AS id, label, domain FROM x WHERE s = 'test'", "domain") + ")"
        for name, channels in _CHANNELS
    )
)
def transfer_matrix(spark, sf_dir):
    """Accuracy on each channel of scorers trained on one channel or both."""
    rows = labelled(spark, sf_dir)
    counts = nb_counts(rows)
    out = None
    for name, channels in _CHANNELS:
        model = fitted(counts, rows.filter((F.col("split") == "train") & F.col("domain").isin(*channels)))
        part = _flagged(counts, rows.filter("split = 'test'"), model, ["domain"]).withColumn("trained_on", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query()
def leakage_experiment(spark, sf_dir):
    """Accuracy under random splits of all SMS, and of SMS without exact copies: mean and deviation over DRAWS splits."""
    sms = dedup.with_key(labelled(spark, sf_dir).filter("domain = 'sms'"))
    counts = nb_counts(sms)
    out = None
    for name, rows in (("all rows", sms), ("no exact copies", dedup.exact_dedup(sms))):
        for draw in range(DRAWS):
            held = cut(split.stratified_holdout(rows.select("msg_id", "label", "domain"), "label", 0.15, str(draw)))
            model = fitted(counts, held.filter("not is_test"))
            part = _flagged(counts, held.filter("is_test"), model, ["domain"]).withColumn("rows", F.lit(name))
            out = part if out is None else out.unionByName(part)
    return out.groupBy("rows", "domain").agg(F.sum("n_rows").alias("n_rows"), F.round(F.avg("accuracy"), 4).alias("mean_accuracy"), F.round(F.stddev_pop("accuracy"), 4).alias("std_accuracy"))


_HELD = "coalesce(('0x' || substr(md5('42:' || \"group\"), 1, 8))::bigint / 4294967296.0 < 1 / 3.0, true)"
_HELD_TEST = f"SELECT msg_id AS id, label, domain FROM x WHERE s = 'test' UNION ALL SELECT msg_id, label, 'external' FROM x WHERE s = 'external' AND {_HELD}"
_ABLATED = {"without": "", "with": f" UNION ALL SELECT msg_id, label FROM x WHERE s = 'external' AND NOT {_HELD}"}


@query(
    _T + "y0 AS (SELECT 1) "
    + " UNION ALL ".join(f"SELECT '{name}' AS external_in_training, * FROM (" + _flagged_sql(_fit_sql(f"SELECT msg_id AS id, label FROM x WHERE s = 'train'{more}", ids=_ALL), _HELD_TEST, "domain") + ")" for name, more in _ABLATED.items())
)
def source_ablation(spark, sf_dir):
    """Scores with and without two thirds of the external campaigns in training, on the third held back and on the test split."""
    rows = labelled(spark, sf_dir)
    external = rows.filter("split = 'external'").withColumn("held", F.col("group").isNull() | (T.draw("42", F.col("group")) < 1 / 3))
    train = rows.filter("split = 'train'").select("msg_id", "label")
    test = rows.filter("split = 'test'").select("msg_id", "label", "domain").union(external.filter("held").select("msg_id", "label", F.lit("external")))
    counts = nb_counts(rows)
    out = None
    for name, part in (("without", train), ("with", train.union(external.filter("not held").select("msg_id", "label")))):
        scored = _flagged(counts, test, fitted(counts, part), ["domain"]).withColumn("external_in_training", F.lit(name))
        out = scored if out is None else out.unionByName(scored)
    return out


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail of the shortcut audit: training rows of one legitimate and one phishing source, test rows by `set`."""
    mail = labelled(spark, sf_dir).filter("domain = 'email'")
    chosen = mail.filter(((F.col("split") == "train") & (((F.col("source") == "mail_corp") & (F.col("label") == "legit")) | (F.col("source") == "mail_phish"))) | (F.col("split") == "test"))
    seen = F.when((F.col("source") == "mail_corp") & (F.col("label") == "legit"), "legit, seen source").when((F.col("source") == "mail_lists") & (F.col("label") == "legit"), "legit, unseen source").when(F.col("source") == "mail_phish", "phishing")
    return chosen.withColumn("set", seen)


VARIANTS = {"as packaged": lambda: F.coalesce("text_as_packaged", "text"), "raw": lambda: F.col("text"), "scrubbed": lambda: T.prepare(F.col("text"), F.col("domain"))}
_MAIL = f"SELECT *, CASE WHEN source = 'mail_corp' AND label = 'legit' THEN 'legit, seen source' WHEN source = 'mail_lists' AND label = 'legit' THEN 'legit, unseen source' WHEN source = 'mail_phish' THEN 'phishing' END AS \"set\" FROM (SELECT *, {CLEAN} AS s FROM corpus WHERE {LABELLED} AND domain = 'email') WHERE (s = 'train' AND ((source = 'mail_corp' AND label = 'legit') OR source = 'mail_phish')) OR s = 'test'"


def _audit_sql(name: str, text: str) -> str:
    terms = NB_TERMS.format(key="msg_id", text="body", rows=f"(SELECT msg_id, {text} AS body FROM mail)")
    scored = f"WITH t AS {terms}, " + nb_sql("SELECT msg_id AS id, label FROM mail WHERE s = 'train'", ids="SELECT msg_id AS id FROM mail") + " SELECT id, p0 FROM q"
    return f"SELECT '{name}' AS variant, * FROM (" + _flagged_sql(scored, "SELECT msg_id AS id, label, \"set\" FROM mail WHERE s = 'test' AND \"set\" IS NOT NULL", '"set"') + ")"


def _audit(spark: SparkSession, sf_dir: str, variants: list[str]) -> DataFrame:
    out = None
    for name in variants:
        rows = cut(audited(spark, sf_dir).select("msg_id", "label", "split", "set", VARIANTS[name]().alias("text")))
        counts = nb_counts(rows)
        part = _flagged(counts, rows.filter("split = 'test' and `set` is not null"), fitted(counts, rows.filter("split = 'train'")), ["set"]).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH mail AS ({_MAIL}) " + " UNION ALL ".join((_audit_sql("as packaged", "coalesce(text_as_packaged, text)"), _audit_sql("raw", "text"))))
def shortcut_audit(spark, sf_dir):
    """Do scorers learn the collection instead of the matter? Legitimate mail of a seen and an unseen source and phishing flagged, as packaged and as raw text."""
    return _audit(spark, sf_dir, ["as packaged", "raw"])


@query()
def shortcut_audit_scrubbed(spark, sf_dir):
    """The audit on text from which what gives a collection away is scrubbed."""
    return _audit(spark, sf_dir, ["scrubbed"])


@query()
def classic_classifiers(spark, sf_dir):
    """Multinomial and Gaussian naive Bayes, a decision tree and a forest on hashed words of SMS: accuracy on the test split."""
    from pyspark.ml.classification import DecisionTreeClassifier, NaiveBayes, RandomForestClassifier

    rows = labelled(spark, sf_dir).filter("domain = 'sms'").select("msg_id", "split", label_index(F.col("label")).cast("double").alias("y"), T.tokenize(F.col("text")).alias("tokens"))
    vectors = cut(M.hashed_features(rows, F.col("tokens"), size=256))
    train, test = vectors.filter("split = 'train'"), vectors.filter("split = 'test'")
    kinds = {
        "multinomial": NaiveBayes(modelType="multinomial", labelCol="y"), "gaussian": NaiveBayes(modelType="gaussian", labelCol="y"),
        "tree": DecisionTreeClassifier(labelCol="y", maxDepth=5, seed=2), "forest": RandomForestClassifier(labelCol="y", numTrees=50, maxDepth=5, seed=2),
    }
    out = None
    for name, learner in kinds.items():
        scored = learner.fit(train).transform(test).select(F.lit(name).alias("classifier"), (F.col("prediction") == F.col("y")).cast("double").alias("hit"))
        out = scored if out is None else out.union(scored)
    return out.groupBy("classifier").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("hit"), 4).alias("accuracy"))


_Q = "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, list_cosine_similarity(a.e, b.e) AS s FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM s) "


@query(_Q + "SELECT query_id, id, rank FROM r WHERE rank <= 5")
def nearest_vectors(spark, sf_dir):
    """The five nearest of every vector whose id 20 divides, against all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter("vec_id % 20 = 0"), vectors, 5).select("query_id", "id", "rank")


@query(_Q + ", c AS (SELECT query_id, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY ALL), v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS k FROM c) SELECT query_id, label AS voted FROM v WHERE k = 1")
def knn_vote(spark, sf_dir):
    """The label most of a vector's five nearest have."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    votes = nearest_vectors(spark, sf_dir).join(labels, "id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("voted"))


@query(f"SELECT label, term, count(*) AS n_rows FROM (SELECT msg_id, label, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM corpus WHERE {CLEAN} = 'train' AND label IN ('legit', 'spam', 'phishing')) GROUP BY ALL HAVING count(*) >= 20")
def bag_of_words(spark, sf_dir):
    rows = labelled(spark, sf_dir).filter("split = 'train'").select("label", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term"))
    return rows.groupBy("label", "term").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows >= 20")
