"""Merging of assessors and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamark.session import store

CUTOFFS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RECALLS = tuple(i / 10 for i in range(11))


def panel_grades(qrel: DataFrame, panel) -> DataFrame:
    """(query_id, doc_id, grade) of one panel of assessors: the highest valid grade (0, 1, 2)."""
    ok = qrel.where("grade IN (0, 1, 2) AND query_id IS NOT NULL AND doc_id IS NOT NULL").where(panel)
    return ok.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def merge_assessors(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    """Grades of assessor ``a`` settled with those of ``b`` and ``c``, for the documents of ``a``.

    b differs: the highest of all three if c has graded and differs from a, a if c agrees, the higher of both
    without c.  No b: the higher of a and c.
    """
    key = ["query_id", "doc_id"]
    j = a.withColumnRenamed("grade", "a").join(b.withColumnRenamed("grade", "b"), key, "left").join(c.withColumnRenamed("grade", "c"), key, "left")
    A, B, C = F.col("a"), F.col("b"), F.col("c")
    grade = F.when(B.isNull(), F.greatest(A, C)).when(A == B, A).when(C.isNull(), F.greatest(A, B)).when(A == C, A).otherwise(F.greatest(A, B, C))
    return j.select(*key, grade.alias("grade"))


def binarise(qrels: DataFrame) -> DataFrame:
    """Grade 2 becomes 1; others stay."""
    return qrels.withColumn("grade", F.when(F.col("grade") == 2, 1).otherwise(F.col("grade")))


def best_run(run: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank) of a run: highest score per document, ties by document; nulls and NaN left out."""
    ok = run.where("query_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL AND NOT isnan(grade)")
    best = ok.groupBy("query_id", "doc_id").agg(F.max("grade").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with grades (0 if not judged), running counts, precision and recall; only queries with a relevant document."""
    relevant = qrels.where("grade > 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    rows = run.join(qrels, ["query_id", "doc_id"], "left").join(relevant, "query_id").fillna(0, ["grade"])
    so_far = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("hits", F.sum((F.col("grade") > 0).cast("int")).over(so_far))
    return rows.withColumn("precision", F.col("hits") / F.col("rank")).withColumn("recall", F.col("hits") / F.col("n_rel"))


def at_cutoffs(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, total: int | None = None, compat: bool = False) -> DataFrame:
    """(query_id, k, precision, recall, f1); beyond what was retrieved the hits stay, f1 is null without any hit.

    With ``total`` only so many documents of a query are looked at.  ``compat`` looks at one more, and beyond them
    gives the last precision as the recall and no f1, as older figures have it.
    """
    return _at_cutoffs(judged(run if total is None else run.where(F.col("rank") <= total + compat), qrels), cutoffs, compat)


def _at_cutoffs(rows: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS, compat: bool = False) -> DataFrame:
    last = rows.groupBy("query_id").agg(F.max("rank").alias("retrieved"), F.max("n_rel").alias("n_rel"))
    grid = last.withColumn("k", F.explode(F.array(*[F.lit(k) for k in cutoffs])))
    at = grid.withColumn("at", F.least("k", "retrieved")).join(rows.select("query_id", F.col("rank").alias("at"), "hits"), ["query_id", "at"])
    p, r = F.col("hits") / F.col("k"), F.col("hits") / F.col("n_rel")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r))
    if compat:
        beyond = F.col("k") > F.col("retrieved")
        r, f1 = F.when(beyond, F.col("hits") / F.col("retrieved")).otherwise(r), F.when(~beyond, f1)
    return at.select("query_id", "k", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def average_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, ap): grades weigh the precision at each hit, over the relevant documents."""
    return _average_precision(judged(run, qrels))


def _average_precision(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg((F.sum(F.col("grade") * F.col("precision")) / F.max("n_rel")).alias("ap"))


def r_precision(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, r_precision): hits among the first R of R relevant ones."""
    return _r_precision(judged(run, qrels))


def _r_precision(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg((F.coalesce(F.max(F.when(F.col("rank") <= F.col("n_rel"), F.col("hits"))), F.lit(0)) / F.max("n_rel")).alias("r_precision"))


def interpolated(run: DataFrame, qrels: DataFrame, recalls: tuple[float, ...] = RECALLS) -> DataFrame:
    """(query_id, recall_level, precision): best precision from the first rank that reaches the level on; 0 if none does."""
    return _interpolated(judged(run, qrels), recalls)


def _interpolated(rows: DataFrame, recalls: tuple[float, ...] = RECALLS) -> DataFrame:
    # from the last rank back: a frame that begins at each row and ends with the last one is computed anew per row
    back = W.partitionBy("query_id").orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("best", F.max("precision").over(back))
    parts = [F.struct(F.lit(r).alias("recall_level"), F.coalesce(F.min_by("best", F.when(F.col("recall") >= r, F.col("rank"))), F.lit(0.0)).alias("precision")) for r in recalls]
    return rows.groupBy("query_id").agg(F.array(*parts).alias("x")).select("query_id", F.explode("x").alias("x")).select("query_id", "x.*")


def ndcg(run: DataFrame, qrels: DataFrame, ideal: str = "run") -> DataFrame:
    """(query_id, ndcg): gain of the run over that of the ideal order; 0 without any gain.

    The ideal order is that of the run's own documents by grade, or with ``ideal`` qrels that of all judged ones, as many as the run has.
    """
    if ideal not in ("run", "qrels"):
        raise ValueError("ideal is run or qrels")
    sums = _gains(judged(run, qrels))
    if ideal == "qrels":
        order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))
        all_ = qrels.withColumn("ideal", order).join(sums.select("query_id", "size"), "query_id").where(F.col("ideal") <= F.col("size"))
        sums = sums.drop("idcg").join(all_.groupBy("query_id").agg(F.sum(_gain("ideal")).alias("idcg")), "query_id")
    return _ndcg(sums)


def _gain(at: str) -> Column:
    return F.when(F.col(at) == 1, F.col("grade").cast("double")).otherwise(F.col("grade") / F.log2(F.col(at)))


def _gains(rows: DataFrame) -> DataFrame:
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    return rows.withColumn("ideal", best).groupBy("query_id").agg(F.sum(_gain("rank")).alias("dcg"), F.sum(_gain("ideal")).alias("idcg"), F.count(F.lit(1)).alias("size"))


def _ndcg(sums: DataFrame) -> DataFrame:
    return sums.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def summary(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: queries, retrieved, relevant and hit documents, and the means of all queries."""
    rows = judged(run, qrels)
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"), F.max("n_rel").alias("n_rel"), F.max("hits").alias("hits"))
    both = per.join(average_precision(run, qrels), "query_id").join(r_precision(run, qrels), "query_id").join(ndcg(run, qrels), "query_id")
    return both.agg(
        F.count(F.lit(1)).alias("n_queries"), F.sum("retrieved").alias("retrieved"), F.sum("n_rel").alias("relevant"), F.sum("hits").alias("relevant_retrieved"),
        F.avg("ap").alias("map"), F.avg("r_precision").alias("r_precision"), F.avg("ndcg").alias("ndcg"),
    )


def means_at_cutoffs(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(k, n_queries, precision, recall, f1): means of all queries per cutoff; a null F1 counts as 0."""
    return at_cutoffs(run, qrels, cutoffs).groupBy("k").agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg(F.coalesce("f1", F.lit(0.0))).alias("f1")
    )


def pr_curve(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """Mean interpolated precision per recall level."""
    return interpolated(run, qrels).groupBy("recall_level").agg(F.avg("precision").alias("precision"))


def report(run: DataFrame, qrels: DataFrame, f1_cutoffs: tuple[int, ...] = (5, 10, 20, 50, 100), per_query: bool = False) -> DataFrame:
    """The printed report in long form: (measure, cutoff, value), and query_id if ``per_query``; means over all queries, a null F1 counting as 0.

    Measures: retrieved, relevant and relevant_retrieved documents, precision at recall levels (interpolated), ap, precision and f1 at
    cutoffs, r_precision and ndcg.  The cutoff is null where a measure has none.  The judged run is stored and read by all of them.
    """
    rows = store(judged(run, qrels))
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("retrieved"), F.max("n_rel").alias("relevant"), F.max("hits").alias("relevant_retrieved"))
    line = lambda df, measure, value, cutoff=None: df.select("query_id", F.lit(measure).alias("measure"), (F.lit(None) if cutoff is None else F.col(cutoff)).cast("double").alias("cutoff"), F.col(value).cast("double").alias("value"))
    f1 = _at_cutoffs(rows, f1_cutoffs).withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    lines = [line(per, c, c) for c in ("retrieved", "relevant", "relevant_retrieved")] + [
        line(_interpolated(rows), "interpolated", "precision", "recall_level"), line(_average_precision(rows), "ap", "ap"),
        line(_at_cutoffs(rows), "precision", "precision", "k"), line(_r_precision(rows), "r_precision", "r_precision"),
        line(f1, "f1", "f1", "k"), line(_ndcg(_gains(rows)), "ndcg", "ndcg"),
    ]
    every = lines[0]
    for x in lines[1:]:
        every = every.unionByName(x)
    if per_query:
        return every
    total = F.col("measure").isin("retrieved", "relevant", "relevant_retrieved")
    return every.groupBy("measure", "cutoff").agg(F.sum("value").alias("s"), F.avg("value").alias("m")).select("measure", "cutoff", F.when(total, F.col("s")).otherwise(F.col("m")).alias("value"))
