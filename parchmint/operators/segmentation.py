"""Segmentation of sentence sequences.

Sentences are rows (doc_id, pos, embedding, label). Average-linkage clustering over a path keeps the distances of
neighbours, so k clusters are the pieces between the k - 1 widest gaps: a lag and a rank instead of a clustering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is null or zero."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def adjacent(rows: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """rows with gap: the cosine distance to the sentence before (null at the first), and n, the sentences of the document."""
    w = Window.partitionBy(doc_col).orderBy("pos")
    before = F.lag("embedding").over(w)
    first = F.row_number().over(w) == 1
    return rows.withColumn("n", F.count("*").over(Window.partitionBy(doc_col))).withColumn("gap", F.when(first, F.lit(None).cast("double")).otherwise(1 - cosine(before, F.col("embedding"))))


def numbered(rows: DataFrame, starts: Column, doc_col: str = "doc_id") -> DataFrame:
    """rows with segment, which goes up by one at each row where `starts` holds."""
    w = Window.partitionBy(doc_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(starts.cast("int")).over(w).cast("int"))


def labels_to_segments(rows: DataFrame, doc_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """A label of 1 starts a segment, but for the first sentence's."""
    first = F.row_number().over(Window.partitionBy(doc_col).orderBy("pos")) == 1
    flagged = rows.withColumn("__s", (F.col(label_col) == 1) & ~first)
    return numbered(flagged, F.col("__s"), doc_col).drop("__s")


def greedy(rows: DataFrame, threshold: float = 0.5, doc_col: str = "doc_id") -> DataFrame:
    """A segment starts where neighbours' cosine is below the threshold."""
    gaps = adjacent(rows, doc_col)
    return numbered(gaps, F.coalesce(1 - F.col("gap") < threshold, F.lit(False)), doc_col).drop("gap", "n")


def ranked_gaps(rows: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """rows with gap, n and gap_rank (1 for the widest gap; the earlier of equal ones first; null at the first row)."""
    gaps = adjacent(rows, doc_col)
    w = Window.partitionBy(doc_col).orderBy(F.desc_nulls_last("gap"), "pos")
    return gaps.withColumn("gap_rank", F.when(F.col("gap").isNotNull(), F.row_number().over(w)))


def clusters(n: Column, alpha: Column | int, max_chunks: int | None = None) -> Column:
    """max(2, n div alpha), at most max_chunks and n."""
    k = F.greatest(F.lit(2), F.floor(n / alpha).cast("int"))
    return F.least(k if max_chunks is None else F.least(k, F.lit(max_chunks)), n.cast("int"))


def gap_cut(rows: DataFrame, k: Column | int | None = None, alpha: int = 4, max_chunks: int | None = None, doc_col: str = "doc_id") -> DataFrame:
    """Segments between the k - 1 widest gaps; k given, or by alpha from the number of sentences. k under 2: one segment."""
    ranked = ranked_gaps(rows, doc_col)
    wanted = clusters(F.col("n"), alpha, max_chunks) if k is None else F.least(F.lit(k) if isinstance(k, int) else k, F.col("n").cast("int"))
    return numbered(ranked, F.coalesce(F.col("gap_rank") <= wanted - 1, F.lit(False)), doc_col).drop("gap", "gap_rank", "n")


def pair_features(rows: DataFrame, doc_col: str = "doc_id", label_col: str = "label") -> DataFrame:
    """Per pair of neighbours: both embeddings, their cosine and their difference as features, and the second's label."""
    w = Window.partitionBy(doc_col).orderBy("pos")
    after = rows.withColumn("__e", F.lead("embedding").over(w)).withColumn("y", F.lead(label_col).over(w))
    after = after.withColumn("pair_index", F.row_number().over(w) - 1).where(F.col("__e").isNotNull())
    near = dot(F.col("embedding"), F.col("__e")) / (norm(F.col("embedding")) * norm(F.col("__e")) + 1e-9)
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    apart = F.zip_with("embedding", "__e", lambda a, b: a.cast("double") - b.cast("double"))
    return after.select(doc_col, "pair_index", F.concat(wide("embedding"), wide("__e"), F.array(near), apart).alias("features"), F.col("y").cast("int").alias("label"))


def fit_boundaries(pairs: DataFrame, grid: tuple[float, ...] = (0.01, 0.1, 1.0), folds: int = 3, seed: int = 42, max_iter: int = 2000):
    """Balanced logistic regression on pair features; the strength that has the best F1 of label 1 over the folds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    sizes = {r["label"]: r["count"] for r in pairs.groupBy("label").count().collect()}
    total = sum(sizes.values())
    weight = F.lit(None).cast("double")
    for label, n in sizes.items():
        weight = F.when(F.col("label") == label, total / (len(sizes) * n)).otherwise(weight)
    data = pairs.select(array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"), weight.alias("weight"))
    model = LogisticRegression(maxIter=max_iter, tol=1e-4, weightCol="weight", standardization=False)
    params = ParamGridBuilder().addGrid(model.regParam, [1 / (c * total) for c in grid]).build()
    judge = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0)
    return CrossValidator(estimator=model, estimatorParamMaps=params, evaluator=judge, numFolds=folds, seed=seed, parallelism=len(grid)).fit(data)


def predict_boundaries(model, pairs: DataFrame, threshold: float = 0.5, doc_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """doc_id, pair_index, the columns to keep, and boundary: whether a segment starts after the pair's first sentence."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(pairs.withColumn("features", array_to_vector("features")))
    return scored.select(doc_col, "pair_index", *(keep or []), (vector_to_array("probability")[1] >= threshold).alias("boundary"))


def sentence_positions(rows: DataFrame, doc_col: str = "doc_id", sentence_col: str = "sentence") -> DataFrame:
    """start_pos and end_pos of each sentence in the text that joins a document's sentences by a space."""
    w = Window.partitionBy(doc_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length(sentence_col) + 1).over(w) - 1
    return rows.withColumn("end_pos", end.cast("int")).withColumn("start_pos", F.col("end_pos") - F.length(sentence_col))


def chunk_sentences(sentences: DataFrame, chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Which sentences each chunk overlaps: doc_id, chunk_no, pos. Both have start_pos and end_pos; joined by document."""
    c = chunks.select(doc_col, "chunk_no", F.col("start_pos").alias("cs"), F.col("end_pos").alias("ce"))
    return sentences.join(c, doc_col).where(F.greatest("cs", "start_pos") < F.least("ce", "end_pos")).select(doc_col, "chunk_no", "pos")
