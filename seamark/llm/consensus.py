"""Consensus of several annotators' labels by a mean-field variational confusion model.

Every item has a hidden class, every annotator a row of label probabilities per class; classes and
rows have Dirichlet priors.  One round turns expected log probabilities (digamma) into class posteriors
per item and expected counts per annotator, both by group-bys, until the reliabilities stand still.  The votes are laid
out by item once; a round streams them past the annotator table, folds them per item where they lie and ships only
the expected counts, one row per annotator and task.  Items with very many votes are parted by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seamark.session import cut_lineage, forget, lay_out

#: Dirichlet pseudo-counts: of the classes, of an annotator's right and of each wrong label.
CLASS_PRIOR, RIGHT_PRIOR, WRONG_PRIOR = 1.0, 2.0, 1.0
#: Rounds end when no reliability changes by more than TOLERANCE, after ROUNDS at the latest.
ROUNDS, TOLERANCE = 30, 1e-3
#: Votes of one item that one task takes at most, on average; items with more are parted.  There are at most LARGE_ITEMS of them, else the limit rises.
ITEM_VOTES, LARGE_ITEMS = 100_000, 200_000
#: An annotator with a lower posterior mean share of right labels is unreliable.
RELIABLE = 0.6
#: Posterior interval of a reliability: so many standard deviations either way.
INTERVAL = 1.96
#: Annotator tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def digamma(values: str) -> str:
    """SQL: digamma of every positive number of an array, by six recurrence steps, then the asymptotic series."""
    steps = " + ".join(f"1D / (p.x + {i}D)" for i in range(6))
    series = "ln(p.x + 6D) - 0.5D / (p.x + 6D) - p.z * (1D / 12D - p.z * (1D / 120D - p.z * (1D / 252D - p.z * (1D / 240D - p.z / 132D))))"
    return f"transform(transform({values}, x -> named_struct('x', x, 'z', 1D / ((x + 6D) * (x + 6D)))), p -> {series} - ({steps}))"


def valid_votes(qrel: DataFrame, grades: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """One vote per item and annotator: the valid grade with the latest ``graded_at``.

    Rows without query, annotator or document, and grades outside ``grades``, are void.  A null time is
    the oldest; of different grades given at the same time the larger counts.
    """
    ok = qrel.where(F.col("grade").isin(*grades) & F.col("query_id").isNotNull() & F.col("assessor_id").isNotNull() & F.col("doc_id").isNotNull())
    last = ok.groupBy("query_id", "doc_id", "assessor_id").agg(F.max(F.struct("graded_at", "grade")).alias("v"))
    return last.select("query_id", "doc_id", "assessor_id", F.col("v.grade").cast("int").alias("grade"))


class Consensus:
    """The fitted model: ``items``, ``annotators`` and ``agreement`` are DataFrames.

    ``table`` has one row per annotator: expected votes n{j}_{l} of class j and label l, and the class mass p{j} of its share
    of the items.  ``turns`` is the number of rounds it took.
    """

    def __init__(self, qrel: DataFrame, grades: tuple[int, ...] = (0, 1, 2), rounds: int = ROUNDS):
        self.grades = tuple(grades)
        self.k = range(len(self.grades))
        self.turns = 0
        votes = cut_lineage(valid_votes(qrel, self.grades))
        per = votes.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("m"))
        limit = max(ITEM_VOTES, votes.count() // LARGE_ITEMS)
        self.large = cut_lineage(per.where(F.col("m") > limit))  # at most LARGE_ITEMS rows
        self.salted = not self.large.isEmpty()
        self.part = ["query_id", "doc_id"]
        if self.salted:
            votes = votes.join(F.broadcast(self.large), self.part, "left").withColumn("salt", F.pmod(F.xxhash64("assessor_id"), F.coalesce(F.ceil(F.col("m") / limit), F.lit(1))).cast("int"))
            self.part = [*self.part, "salt"]
        self.votes = lay_out(votes.select(*self.part, "assessor_id", "grade"), *self.part)
        if not rounds:
            return
        self.small = self.votes.select("assessor_id").distinct().limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        # first posterior: each item's shares of votes
        votes = self._item_sums([(F.col("grade") == g).cast("double") for g in self.grades], "q")
        self.table = cut_lineage(self._counts(votes.withColumns({f"q{j}": F.col(f"q{j}") / F.col("m") for j in self.k})))
        while self.turns < rounds:
            self.turns += 1
            before = self.table
            self.table = cut_lineage(self._counts(self._posterior()))
            moved = self.annotators.join(self._reliability(before).select("assessor_id", F.col("reliability").alias("old")), "assessor_id").agg(F.max(F.abs(F.col("reliability") - F.col("old")))).first()[0]
            forget(before)
            if moved is None or moved <= TOLERANCE:
                break

    def _item_sums(self, values: list[Column], name: str, votes: DataFrame | None = None) -> DataFrame:
        """Votes with the sums of ``values`` over their item, name0.., and its number of votes m.  No vote is moved."""
        votes = self.votes if votes is None else votes
        part = W.partitionBy(*self.part)
        sums = {f"{name}{j}": F.sum(v).over(part) for j, v in enumerate(values)} | {"m": F.count(F.lit(1)).over(part)}
        out = votes.withColumns(sums)
        if not self.salted:
            return out
        # the parts of a large item are summed up once more; there are few such items
        names = [*(f"{name}{j}" for j in range(len(values))), "m"]
        hot = out.join(F.broadcast(self.large.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_semi")
        hot = hot.groupBy("query_id", "doc_id", "salt").agg(*[F.max(x).alias(x) for x in names]).groupBy("query_id", "doc_id").agg(*[F.sum(x).alias(f"{x}_all") for x in names])
        both = out.join(F.broadcast(hot), ["query_id", "doc_id"], "left")
        return both.withColumns({x: F.coalesce(f"{x}_all", x) for x in names}).drop(*[f"{x}_all" for x in names])

    def _counts(self, votes: DataFrame) -> DataFrame:
        """Expected counts per annotator of votes with a posterior q0..; an item's class mass is divided among its votes."""
        cells = [F.sum(F.when(F.col("grade") == g, F.col(f"q{j}")).otherwise(0.0)).alias(f"n{j}_{i}") for j in self.k for i, g in enumerate(self.grades)]
        return votes.groupBy("assessor_id").agg(*cells, *[F.sum(F.col(f"q{j}") / F.col("m")).alias(f"p{j}") for j in self.k])

    def _posterior(self) -> DataFrame:
        """The votes with the class posterior q0.. of their item."""
        size = len(self.grades)
        expected = lambda row: f"transform(slice({row}, 1, {size}), x -> x - {row}[{size}])"
        whole = " + ".join(f"t{j}" for j in self.k)
        classes = self.table.agg(*[F.expr(f"sum(p{j}) + {CLASS_PRIOR}D AS t{j}") for j in self.k])
        classes = classes.select(F.expr(digamma(f"array({', '.join(f't{j}' for j in self.k)}, {whole})") + " AS c"))
        classes = F.broadcast(classes.select(*[F.expr(f"c[{j}] - c[{size}] AS c{j}") for j in self.k]))  # one row
        # per class j: digamma of the labels' counts, and last of their sum
        alpha = [[f"(n{j}_{i} + {RIGHT_PRIOR if i == j else WRONG_PRIOR}D)" for i in self.k] for j in self.k]
        logs = self.table.select("assessor_id", *[F.expr(digamma(f"array({', '.join(row)}, {' + '.join(row)})") + f" AS d{j}") for j, row in enumerate(alpha)])
        logs = logs.select("assessor_id", *[F.expr(f"{expected(f'd{j}')} AS l{j}") for j in self.k]).crossJoin(classes)
        joined = self.votes.join(F.broadcast(logs) if self.small else logs, "assessor_id")
        at = F.lit(0)
        for i, g in enumerate(self.grades):
            at = F.when(F.col("grade") == g, i).otherwise(at)
        scored = self._item_sums([F.get(f"l{j}", at) for j in self.k], "s", joined).withColumns({f"z{j}": F.col(f"c{j}") + F.col(f"s{j}") for j in self.k})
        top = F.greatest(*[F.col(f"z{j}") for j in self.k])
        e = [F.exp(F.col(f"z{j}") - top) for j in self.k]
        return scored.select(*self.part, "assessor_id", "grade", "m", *[(e[j] / sum(e[1:], e[0])).alias(f"q{j}") for j in self.k])

    @property
    def annotators(self) -> DataFrame:
        """assessor_id, n_votes, reliability (posterior mean share of right labels), its interval low, high, and reliable."""
        return self._reliability(self.table)

    def _reliability(self, table: DataFrame) -> DataFrame:
        right = sum((F.col(f"n{j}_{j}") for j in self.k), F.lit(0.0))
        votes = sum((F.col(f"n{j}_{i}") for j in self.k for i in self.k), F.lit(0.0))
        n = votes + F.lit(RIGHT_PRIOR + WRONG_PRIOR * (len(self.grades) - 1))
        mean = (right + F.lit(RIGHT_PRIOR)) / n
        dev = F.sqrt(mean * (1 - mean) / (n + 1)) * INTERVAL
        return table.select("assessor_id", F.round(votes).cast("long").alias("n_votes"), mean.alias("reliability"), F.greatest(mean - dev, F.lit(0.0)).alias("low"), F.least(mean + dev, F.lit(1.0)).alias("high"), (mean >= RELIABLE).alias("reliable"))

    @property
    def items(self) -> DataFrame:
        """query_id, doc_id, grade, posterior of that grade, the model's own grade (model_grade) and number of votes.

        The grade is the one that most reliable annotators gave; the model's posterior settles ties and
        the items that no reliable annotator judged, and equal posteriors go to the smaller grade.
        """
        who = self.annotators.select("assessor_id", "reliable")
        votes = self._posterior().join(F.broadcast(who) if self.small else who, "assessor_id")
        good = [F.sum(F.when(F.col("reliable") & (F.col("grade") == g), 1).otherwise(0)) for g in self.grades]
        best = F.array_max(F.array(*[F.struct(good[j].alias("v"), F.max(f"q{j}").alias("q"), F.lit(-g).alias("g")) for j, g in enumerate(self.grades)]))
        model = F.array_max(F.array(*[F.struct(F.max(f"q{j}").alias("q"), F.lit(-g).alias("g")) for j, g in enumerate(self.grades)]))
        item = votes.groupBy("query_id", "doc_id").agg(best.alias("b"), model.alias("model"), F.max("m").alias("n_votes"))
        return item.select("query_id", "doc_id", (-F.col("b.g")).cast("int").alias("grade"), F.col("b.q").alias("posterior"), (-F.col("model.g")).cast("int").alias("model_grade"), "n_votes")

    @property
    def agreement(self) -> DataFrame:
        """Krippendorff's alpha of the votes: n_items, n_pairable, alpha for nominal and alpha_ordinal for ordered labels.

        Only items with two votes or more count; an alpha is null if there are none or only one grade occurs.
        """
        per = self.votes.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("m"), *[F.count_if(F.col("grade") == g).alias(f"v{j}") for j, g in enumerate(self.grades)])
        pairs = [(a, b) for a in self.k for b in self.k if a < b]
        s = per.where("m >= 2").agg(
            F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum("m"), F.lit(0)).alias("n_pairable"),
            *[F.sum(2 * F.col(f"v{a}") * F.col(f"v{b}") / (F.col("m") - 1)).alias(f"o{a}_{b}") for a, b in pairs], *[F.sum(f"v{j}").cast("double").alias(f"t{j}") for j in self.k],
        )

        def alpha(far) -> Column:
            """One minus observed over expected disagreement, for labels that lie far(a, b) apart."""
            seen = sum((F.col(f"o{a}_{b}") * far(a, b) for a, b in pairs), F.lit(0.0))
            chance = sum((2 * F.col(f"t{a}") * F.col(f"t{b}") * far(a, b) for a, b in pairs), F.lit(0.0)) / (F.col("n_pairable") - 1)
            return F.when(chance > 0, 1 - seen / chance)

        steps = lambda a, b: sum((F.col(f"t{j}") for j in range(a, b + 1)), F.lit(0.0)) - (F.col(f"t{a}") + F.col(f"t{b}")) / 2
        return s.select("n_items", "n_pairable", alpha(lambda a, b: F.lit(1.0)).alias("alpha"), alpha(lambda a, b: F.pow(steps(a, b), 2)).alias("alpha_ordinal"))
