"""Text quality, weighted terms and classification."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import collapsed_code


def quality(text: Column) -> Column:
    """0.4 * share of letters + 0.2 * (1 - share of lines that end in a hyphen) + 0.2 each for the words abstract and introduction;
    0 for null and empty texts."""
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n")
    broken = F.size(F.filter(lines, lambda x: x.endswith("-"))) / F.size(lines)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.length(text)
    has = lambda w: F.when(text.rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])"), 0.2).otherwise(0.0)
    return F.when(F.length(text) > 0, 0.4 * letters + 0.2 * (1 - broken) + has("abstract") + has("introduction")).otherwise(0.0)


def weighted_terms(docs: DataFrame, key: str, text: str, min_df: int = 2, max_df: float = 0.9) -> DataFrame:
    """(key, term, weight): tf * (ln((1 + n) / (1 + df)) + 1) of words of two characters or more, scaled to length 1 per document;
    terms in fewer than `min_df` documents or more than the share `max_df` are left out."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]{2,}"), F.lit(0)).alias("t"))
    tf = rows.select(key, F.explode("t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = rows.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), how="cross").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    raw = tf.join(df, "term").withColumn("w", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


class SmoothIdf(Estimator):
    """Counts in `_c` times ln((1 + n) / (1 + df)) + 1, in `_x`."""

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol="_c", outputCol="_x").fit(dataset).idf.toArray()  # without the 1
        return ElementwiseProduct(inputCol="_c", outputCol="_x", scalingVec=Vectors.dense(idf + 1))


def class_pipeline(text: str, label: str) -> Pipeline:
    """Words and pairs of words (English stop words out), smoothed idf, unit length, one linear support vector machine per class.

    All terms in two texts or more and at most nine tenths of them are used; the driver holds the terms and a weight of each per class."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="_w", outputCol="_s"),
        NGram(n=2, inputCol="_s", outputCol="_p"),
        SQLTransformer(statement="SELECT *, concat(_s, _p) AS _t FROM __THIS__"),
        CountVectorizer(inputCol="_t", outputCol="_c", minDF=2, maxDF=0.9, vocabSize=2**31 - 1),
        SmoothIdf(),
        Normalizer(inputCol="_x", outputCol="features", p=2.0),
        StringIndexer(inputCol=label, outputCol="label", handleInvalid="keep"),
        OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01), featuresCol="features", labelCol="label"),
    ]
    return Pipeline(stages=stages)


def train_classes(docs: DataFrame, text: str, label: str) -> PipelineModel:
    """Fit on the rows with text and label."""
    return class_pipeline(text, label).fit(docs.where(F.col(text).isNotNull() & F.col(label).isNotNull()))


def predict_classes(model: PipelineModel, docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, predicted)."""
    names = model.stages[-2].labels
    rows = docs.withColumn(text, F.coalesce(text, F.lit("")))
    out = model.transform(rows)
    return out.select(key, F.get(F.array(*map(F.lit, [*names, None])), F.col("prediction").cast("int")).alias("predicted"))


def save_classes(model: PipelineModel, path: str) -> None:
    """Keep a fitted classifier at a path that the cluster shares, over an older one."""
    model.write().overwrite().save(path)


def load_classes(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def dataset(codes: DataFrame, texts: DataFrame, key: str, code: str, text: str, depth: int = 4) -> DataFrame:
    """(key, text, label): the texts of all labelled files with their codes cut to `depth` parts; a file without a text has an empty one."""
    label = collapsed_code(F.col(code), depth).alias("label")
    return codes.join(texts.select(key, text), key, "left").select(key, F.coalesce(text, F.lit("")).alias("text"), label)
