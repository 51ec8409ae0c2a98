"""Out-of-fold predictions of spark.ml pipelines: one fit per fold, on rows purged of the fold's sessions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, HashingTF, Imputer, NGram, Normalizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from convolytics.functions import text as T
from convolytics.operators import sparse
from convolytics.operators.splits import purged_pairs
from convolytics.sources.sinks import materialize, scratch


def numeric_logistic(columns: Sequence[str], c: float = 1.0, target: str = "target", n: int = 1000) -> Pipeline:
    filled = [f"_{x}" for x in columns]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), LogisticRegression(featuresCol="_features", labelCol=target, regParam=1 / (c * n), maxIter=50)])


def hashed_text_logistic(text: str, features: int = 1 << 15, alpha: float = 1e-4, target: str = "target") -> Pipeline:
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"(?U)\w+", gaps=False, minTokenLength=2)
    return Pipeline(stages=[words, NGram(n=2, inputCol="_w", outputCol="_b"), HashingTF(inputCol="_w", outputCol="_h1", numFeatures=features), HashingTF(inputCol="_b", outputCol="_h2", numFeatures=features), VectorAssembler(inputCols=["_h1", "_h2"], outputCol="_h"), Normalizer(inputCol="_h", outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=target, regParam=alpha, standardization=False, maxIter=50)])


def word_hashes(text: str, out: str, features: int, grams: int = 2, least: int = 2) -> list:
    """Stages: hashed counts of words and of runs of up to `grams` words, together a row of length 1."""
    stages = [RegexTokenizer(inputCol=text, outputCol=f"{out}_w1", pattern=r"(?U)\w+", gaps=False, minTokenLength=least)]
    stages += [NGram(n=n, inputCol=f"{out}_w1", outputCol=f"{out}_w{n}") for n in range(2, grams + 1)]
    stages += [HashingTF(inputCol=f"{out}_w{n}", outputCol=f"{out}_h{n}", numFeatures=features) for n in range(1, grams + 1)]
    return [*stages, VectorAssembler(inputCols=[f"{out}_h{n}" for n in range(1, grams + 1)], outputCol=f"{out}_all"), Normalizer(inputCol=f"{out}_all", outputCol=out)]


def scaled(column: str, out: str, weight: float, size: int) -> ElementwiseProduct:
    return ElementwiseProduct(inputCol=column, outputCol=out, scalingVec=Vectors.dense([weight] * size))


def dense_block(columns: Sequence[str], out: str, weight: float) -> list:
    """Stages: median for what is missing, standardised on the rows fitted, then scaled."""
    filled = [f"_{c}" for c in columns]
    return [Imputer(strategy="median", inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol=f"{out}_raw"), StandardScaler(inputCol=f"{out}_raw", outputCol=f"{out}_std", withMean=True), scaled(f"{out}_std", out, weight, len(columns))]


def logistic(features: str, alpha: float, target: str = "target", weight: str | None = None) -> LogisticRegression:
    model = LogisticRegression(featuresCol=features, labelCol=target, regParam=alpha, standardization=False, maxIter=50)
    return model.setWeightCol(weight) if weight else model


def text_and_dense_logistic(text: str, columns: Sequence[str], features: int = 1 << 15, dense_weight: float = 0.2, alpha: float = 1e-4, weight: str | None = None) -> Pipeline:
    """Hashed words beside scaled numeric columns; for a penalty C on n rows, alpha = 1 / (C * n)."""
    return Pipeline(stages=[*word_hashes(text, "_text", features), *dense_block(columns, "_dense", dense_weight), VectorAssembler(inputCols=["_text", "_dense"], outputCol="_features"), logistic("_features", alpha, weight=weight)])


def embedding_logistic(vector: str, c: float = 0.1, n: int = 1000, columns: Sequence[str] = (), dense_weight: float = 0.08) -> Pipeline:
    """On a vector column (array_to_vector of interaction or of a variant), with numeric columns beside it if named."""
    dense = dense_block(columns, "_dense", dense_weight) if columns else []
    return Pipeline(stages=[*dense, VectorAssembler(inputCols=[vector, *(["_dense"] if columns else [])], outputCol="_features"), logistic("_features", 1 / (c * n))])


def lean(df: DataFrame, name: str = "features") -> DataFrame:
    """df written to the shared folder and read again without the columns' metadata. VectorAssembler names each slot in
    them, and every job of a fit would ship these names of 2**16 slots and what made the rows to every task."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(StructType([StructField(f.name, f.dataType) for f in df.schema])).parquet(path)


def fitted(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """pipeline.fit(train), whose last stage (a model) reads features that are made and written once."""
    *made, last = pipeline.getStages()
    before = Pipeline(stages=made).fit(train)
    columns = [last.getFeaturesCol(), last.getLabelCol(), *([last.getWeightCol()] if last.isSet("weightCol") else [])]
    return PipelineModel([*before.stages, last.fit(lean(before.transform(train).select(columns)))])


class NaiveBayesLogistic:
    """Logistic regression on hashed words, each bucket scaled by its log ratio between the classes of the rows fitted."""

    def __init__(self, text: str, features: int = 1 << 17, c: float = 1.0, target: str = "target"):
        self.text, self.features, self.c, self.target = text, features, c, target

    def fit(self, train: DataFrame) -> PipelineModel:
        hashes = Pipeline(stages=word_hashes(self.text, "_text", self.features)).fit(train)
        hashed = lean(hashes.transform(train).select("_text", self.target))
        sums = {int(r[0]): (r[1].toArray(), r[2]) for r in hashed.groupBy(self.target).agg(Summarizer.sum(F.col("_text")), F.count("*")).collect()}
        (pos, n_pos), (neg, n_neg) = sums[1], sums[0]
        ratio = np.log(((pos + 1) / (n_pos + 1)) / ((neg + 1) / (n_neg + 1)))
        by_ratio = ElementwiseProduct(inputCol="_text", outputCol="_features", scalingVec=Vectors.dense(ratio))
        model = logistic("_features", 1 / (self.c * (n_pos + n_neg)), self.target).fit(by_ratio.transform(hashed))
        return PipelineModel([hashes, by_ratio, model])


def session_weights(train: DataFrame, power: float = 1.0, session: str = "session_id", out: str = "weight") -> DataFrame:
    """train with out: the session's rows to the power of -power, with mean 1."""
    sizes = train.groupBy(session).agg(F.count("*").alias("_n"))
    mean = sizes.agg((F.sum(F.col("_n") * F.pow("_n", F.lit(-power))) / F.sum("_n")).alias("_mean"))
    return train.join(sizes, session).crossJoin(mean).withColumn(out, F.pow("_n", F.lit(-power)) / F.col("_mean")).drop("_n", "_mean")


class SessionWeighted:
    """A pipeline whose rows weigh by session; the pipeline's model takes the weight column."""

    def __init__(self, pipeline: Pipeline, power: float = 1.0, session: str = "session_id", weight: str = "weight"):
        self.pipeline, self.power, self.session, self.weight = pipeline, power, session, weight

    def fit(self, train: DataFrame) -> PipelineModel:
        return fitted(self.pipeline, session_weights(train, self.power, self.session, self.weight))


def fit_and_save(df: DataFrame, parts: dict[str, Pipeline | NaiveBayesLogistic | SessionWeighted], folder: str) -> dict[str, PipelineModel]:
    """Each part fitted on all rows and written below folder; PipelineModel.load reads it again."""
    fitted = {name: p.fit(df) for name, p in parts.items()}
    for name, model in fitted.items():
        model.write().overwrite().save(f"{folder.rstrip('/')}/{name}")
    return fitted


def as_vector(df: DataFrame, array: str, out: str) -> DataFrame:
    return df.withColumn(out, array_to_vector(array))


def features_logistic(alpha: float) -> Pipeline:
    """On a ready column of features; for a penalty C on n rows, alpha = 1 / (C * n)."""
    return Pipeline(stages=[logistic("features", alpha)])


def stored_fold(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """What a finished fold has written, or None. The mark beside it is written last."""
    try:
        spark.read.text(f"{path}-done").count()
    except AnalysisException:
        return None
    return spark.read.schema(schema).parquet(path)


def rows_digest(df: DataFrame, settings: str) -> str:
    """A name for rows, in any order, and settings."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{n}|{total}|{df.schema.simpleString()}|{settings}".encode()).hexdigest()[:24]


def out_of_fold(
    df: DataFrame, pipeline: Callable[[int], Pipeline] | Pipeline | NaiveBayesLogistic | SessionWeighted, folds: int = 5, key: str = "response_id", purge: str = "session_id", target: str = "target",
    features: Callable[[DataFrame, int], DataFrame] | None = None, store: str | None = None, settings: str = "",
) -> DataFrame:
    """key, fold, target, p. A fold whose training rows hold one class only gets their mean.

    A function gets the number of training rows of the fold, from which penalties are taken. The rows are written once to
    the shared folder; fits and predictions of all folds read them there. features: gives rows the columns
    that a fold's fit and its predictions read besides. store: a folder where each fold's predictions are kept under a digest of
    the rows and settings (which name the model); a run that was broken off goes on with the folds that are missing.
    """
    spark = df.sparkSession
    # the folds of a row's session, so that each fold's training rows are a filter and no wide row is shuffled for them
    seen = df.groupBy(purge).agg(F.collect_set("fold").alias("_folds"))
    all_rows = materialize(df.join(seen, purge, "left").select(*df.columns, "_folds"), "oof")
    rows = all_rows.drop("_folds")
    train_rows = purged_pairs(rows.select("fold", purge, target), purge, folds).groupBy("eval_fold")
    facts = {r[0]: r[1:] for r in train_rows.agg(F.count("*"), F.avg(target), F.min(target), F.max(target)).collect()}  # k rows
    present = {r[0] for r in rows.select("fold").distinct().collect()}  # k rows
    kept = f"{store.rstrip('/')}/{rows_digest(rows, settings)}" if store else None

    def with_features(part: DataFrame, fold: int) -> DataFrame:
        return part if features is None else features(part, fold)

    def one(fold: int) -> DataFrame:
        held = rows.where(F.col("fold") == fold)
        n, mean, least, most = facts.get(fold, (0, 0.5, None, None))
        if least == most or fold not in present:
            return held.select(key, "fold", target, F.lit(mean).cast("double").alias("p"))
        train = all_rows.where((F.col("fold") != fold) & ~F.coalesce(F.array_contains("_folds", fold), F.lit(False))).drop("_folds")
        own = pipeline(n) if callable(pipeline) else pipeline
        model = fitted(own, with_features(train, fold)) if isinstance(own, Pipeline) else own.fit(with_features(train, fold))
        return model.transform(with_features(held, fold)).select(key, "fold", target, vector_to_array("probability")[1].alias("p"))

    def resumed(fold: int) -> DataFrame:
        if not kept:
            return one(fold)
        schema = StructType([*(rows.schema[c] for c in (key, "fold", target)), StructField("p", DoubleType())])
        path = f"{kept}/fold-{fold}"
        known = stored_fold(spark, path, schema)
        if known is None:
            one(fold).write.mode("overwrite").parquet(path)
            spark.range(1).select(F.lit(settings).alias("value")).write.mode("overwrite").text(f"{path}-done")
        return spark.read.schema(schema).parquet(path) if known is None else known

    return reduce(DataFrame.unionByName, [resumed(f) for f in range(folds)])


def tf_idf_documents(df: DataFrame, texts: Mapping[str, tuple[Column, int, int, str | None]], folds: int = 5, keep: Sequence[str] = ()) -> tuple[DataFrame, list[sparse.Places]]:
    """keep, and for each text i the terms of the row's document (t{i}: numbers of terms that some fold's vocabulary has;
    n{i}: how often), with what each vocabulary makes of these numbers.

    texts: by name (terms, features, least documents, document's column). Where a column names the document (a session),
    its distinct values are fitted on, once each, and every row gets its document's weights; else each row is a document,
    and rows of the same terms are counted together. What is written has no weights, which differ by fold: small whole
    numbers, once for all folds.
    """
    joined, places, offset = df.select(*keep, *[(F.col(doc) if doc else F.md5(F.array_join(terms, "\n"))).alias(f"_d{i}") for i, (terms, _, _, doc) in enumerate(texts.values())]), [], 0
    for i, (name, (terms, size, least, doc)) in enumerate(texts.items()):
        if doc:
            own = df.dropDuplicates(["fold", doc]).select("fold", F.col(doc).alias("doc"), terms.alias("_t"), F.lit(1).cast("long").alias("m"))
        else:
            own = df.groupBy("fold", terms.alias("_t")).agg(F.count("*").alias("m")).withColumn("doc", F.md5(F.array_join("_t", "\n")))
        counts = materialize(sparse.counted(own, ["fold", "doc", "m"], F.col("_t")), f"terms-{name}")
        place = sparse.Places(sparse.vocabulary(counts, size, least, folds).where("eval_fold >= 0"), size, offset, folds)
        numbers = df.sparkSession.createDataFrame(place.numbered(), "term string, t int")
        entries = counts.join(F.broadcast(numbers), "term").groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("t", F.col("tf").cast("int").alias("n")))).alias("e"))  # a document may be in several folds
        joined = joined.join(entries.select(F.col("doc").alias(f"_d{i}"), F.col("e.t").alias(f"t{i}"), F.col("e.n").alias(f"n{i}")), f"_d{i}", "left")
        places.append(place)
        offset += size
    return joined.drop(*[f"_d{i}" for i in range(len(texts))]), places


def tf_idf_out_of_fold(df: DataFrame, texts: Mapping[str, tuple[Column, int, int, str | None]], c: float = 1.0, folds: int = 5, key: str = "response_id", store: str | None = None) -> DataFrame:
    """key, fold, target, p of a logistic regression with penalty C on TF-IDF blocks side by side, each fitted for each fold
    on the documents of the others (texts as in tf_idf_documents). A fold's vectors are made where they are read."""
    rows, places = tf_idf_documents(df, texts, folds, [key, "session_id", "fold", "target"])
    settings = f"tf-idf {c} {sorted((n, str(t), *x) for n, (t, *x) in texts.items())}"
    weighed = lambda part, fold: sparse.weighed(part, places, fold)
    return out_of_fold(rows, lambda n: logistic("features", 1 / (c * n)), folds, key, features=weighed, store=store, settings=settings)


def blocks_out_of_fold(
    df: DataFrame, rows: DataFrame, size: int, columns: Sequence[str] = (), dense_weight: float = 0.12, alpha: float = 1e-4, folds: int = 5, key: str = "response_id", store: str | None = None, settings: str = "blocks",
) -> DataFrame:
    """key, fold, target, p of a logistic regression on sparse rows (key, slot, value) of `size` slots, such as those of
    sparse.beside, with numeric columns beside them, which are standardised on the rows fitted and scaled."""
    made = df.select(key, "session_id", "fold", "target", *[F.col(c).cast("double").alias(c) for c in columns])
    own = made.join(sparse.as_vectors(rows, made, [key], size, "_blocks"), key)
    parts = [*(dense_block(columns, "_dense", dense_weight) if columns else []), VectorAssembler(inputCols=["_blocks", *(["_dense"] if columns else [])], outputCol="features")]
    fit = lambda n: Pipeline(stages=[*parts, logistic("features", alpha)])
    return out_of_fold(own, fit, folds, key, store=store, settings=f"{settings} {size} {list(columns)} {dense_weight} {alpha}")


class Bundle:
    """Fitted parts with weights, saved as one folder and applied to rows in one pass, as a batch or a stream.

    The score is the weighted mean of the parts' probabilities, clipped. What is saved: the parts, their weights, the
    columns they read and the version of Spark that fitted them; loading checks the columns of the rows it is given.
    """

    def __init__(self, parts: Mapping[str, PipelineModel], weights: Mapping[str, float], columns: Mapping[str, str], version: str):
        if set(parts) != set(weights) or abs(sum(weights.values()) - 1) > 1e-9 or min(weights.values()) < 0:
            raise ValueError("each part needs a weight, and weights sum to 1")
        self.parts, self.weights, self.columns, self.version = dict(parts), dict(weights), dict(columns), version

    @classmethod
    def fit(cls, df: DataFrame, parts: Mapping[str, Pipeline | NaiveBayesLogistic | SessionWeighted], weights: Mapping[str, float], columns: Sequence[str]) -> Bundle:
        kinds = {c: df.schema[c].dataType.simpleString() for c in columns}
        return cls({name: p.fit(df) for name, p in parts.items()}, weights, kinds, df.sparkSession.version)

    def save(self, folder: str) -> None:
        base = folder.rstrip("/")
        for name, model in self.parts.items():
            model.write().overwrite().save(f"{base}/parts/{name}")
        about = json.dumps({"weights": self.weights, "columns": self.columns, "version": self.version}, sort_keys=True)
        spark = SparkSession.active()
        spark.range(1).select(F.lit(about).alias("value")).coalesce(1).write.mode("overwrite").text(f"{base}/about")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Bundle:
        base = folder.rstrip("/")
        about = json.loads(spark.read.text(f"{base}/about").first()[0])
        return cls({name: PipelineModel.load(f"{base}/parts/{name}") for name in about["weights"]}, about["weights"], about["columns"], about["version"])

    def score(self, df: DataFrame, key: str = "response_id", out: str = "score") -> DataFrame:
        """key, out. Rows are transformed by one part after another, so none is read twice; a row's score doesn't depend on
        the rows beside it."""
        wrong = {c: kind for c, kind in self.columns.items() if c not in df.columns or df.schema[c].dataType.simpleString() != kind}
        if wrong:
            raise ValueError(f"missing columns, or columns of another type: {wrong}")
        own = df.select(key, *[c for c in self.columns if c != key])
        kept = own.columns
        for i, (name, model) in enumerate(sorted(self.parts.items())):
            own = model.transform(own).select(*kept, vector_to_array("probability")[1].alias(f"_p{i}"))
            kept = own.columns
        mixed = sum((F.lit(float(self.weights[name])) * F.col(f"_p{i}") for i, name in enumerate(sorted(self.parts))), F.lit(0.0))
        return own.select(key, T.clip(mixed).alias(out))
