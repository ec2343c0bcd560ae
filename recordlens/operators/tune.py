"""Threshold search: candidates crossed with estimates, scored by groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.operators.score import macro_f1
from recordlens.shared import cut

#: A grid is a driver-side list of at most this many candidates.
MOST_CANDIDATES = 1024


def candidates(values: list[float]) -> Column:
    """The grid as an array column, to be exploded beside each row."""
    if len(values) > MOST_CANDIDATES:
        raise ValueError(f"{len(values)} candidates; at most {MOST_CANDIDATES}")
    return F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("value")) for k, v in enumerate(values)]))


def folds(groups: DataFrame, k: int) -> DataFrame:
    """Fold of each distinct group: every k-th in order.

    Groups are dealt into ranges and numbered within each; only the ranges' sizes meet in one task.
    """
    ranged = cut(groups.select("grp").distinct().repartitionByRange("grp").withColumn("_part", F.spark_partition_id()))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    numbered = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy("grp")) - 1)
    return numbered.join(before, "_part").select("grp", ((F.col("_row") + F.col("_before")) % k).cast("int").alias("fold"))


def grid_scores(rows: DataFrame, values: list[float], decide, *keys: str) -> DataFrame:
    """Macro F1 of ``decide(value)`` against ``truth`` for each candidate, by ``keys``.

    Rows meet the grid on the map side; truth and prediction are counted before the shuffle.
    """
    crossed = rows.select("*", candidates(values).alias("cand"))
    tried = crossed.withColumn("pred", decide(F.col("cand.value"))).withColumn("candidate", F.col("cand.value"))
    return macro_f1(tried.select(*keys, "candidate", "truth", "pred"), *keys, "candidate")


def grouped_mean(scores: DataFrame) -> DataFrame:
    """Mean over folds of each candidate's score."""
    return scores.groupBy("candidate").agg(F.avg("macro_f1").alias("mean_score"), F.count("*").alias("folds"))


def best(scores: DataFrame, by: str) -> DataFrame:
    """The best candidate; of equal ones the smallest."""
    return scores.orderBy(F.col(by).desc(), "candidate").limit(1)


# -- coordinate descent ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Search:
    """Edges on one estimate that are sought together: a value's label in a field is that of how many edges it reaches.

    ``grids[j]`` are the candidates of edge ``params[j]``; ``fields`` gives each field's labels, one more than there are edges.
    """

    name: str
    estimate: str
    params: tuple[str, ...]
    grids: tuple[tuple[float, ...], ...]
    fields: tuple[tuple[str, tuple[str, ...]], ...]

    def places(self, start: dict[str, float]) -> tuple[float, ...]:
        """All candidates and the edges at the start, in order."""
        return tuple(sorted({float(x) for grid in self.grids for x in grid} | {float(start[p]) for p in self.params}))


def binned_counts(rows: DataFrame, grids: dict[str, tuple[float, ...]], *keys: str) -> DataFrame:
    """``(keys, field, truth, bin, n)`` of rows(keys, field, truth, value): how many values reach so many places of their field's grid; null has bin -1.

    Whatever edges are taken from a grid, a decision depends on the bin alone, so this one table, a row for each
    key, field, truth and bin, stands for all rows from here on. Fields without a grid are left out.
    """
    bin_ = F.lit(None).cast("int")
    for field, grid in grids.items():
        if len(grid) > MOST_CANDIDATES:
            raise ValueError(f"{len(grid)} candidates; at most {MOST_CANDIDATES}")
        reached = F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= F.col("value")))
        bin_ = F.when(F.col("field") == field, F.when(F.col("value").isNull(), -1).otherwise(reached)).otherwise(bin_)
    return rows.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy(*keys, "field", "truth", "bin").agg(F.count("*").alias("n"))


def _macro_f1(counts: dict[tuple[str, int], int], labels: tuple[str, ...], cuts: list[int]) -> float:
    """Macro F1 over the classes in truth or prediction, from (truth, bin) counts; ``cuts`` are the edges' places in the grid."""
    hit: Counter[str] = Counter()
    true: Counter[str] = Counter()
    said: Counter[str] = Counter()
    for (truth, bin_), n in counts.items():
        label = labels[0] if bin_ < 0 else labels[sum(bin_ > c for c in cuts)]
        true[truth] += n
        said[label] += n
        hit[truth] += n if label == truth else 0
    classes = set(true) | set(said)
    return sum(2 * hit[c] / (true[c] + said[c]) for c in classes) / len(classes) if classes else 0.0


def descend(rows: DataFrame, searches: Sequence[Search], start: dict[str, float], k: int, passes: int = 2) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """Edges by coordinate descent, and each search's mean score over ``k`` folds before and after, of rows(grp, field, truth, value).

    Each pass moves one edge after another to the candidate with the best mean, over the folds and then the fields
    that have rows, of macro F1, the others held. Edges stay in order; the present edge stays where none is better, and of
    equally good ones the smallest counts. Values that are missing have the first label. The rows are scanned once for
    all searches; what comes to the driver has a row for each fold, field, class and bin. Without rows nothing moves.
    """
    grids = {field: search.places(start) for search in searches for field, _ in search.fields}
    folded = rows.join(folds(rows.select("grp"), k), "grp")
    held: dict[tuple[int, str], dict[tuple[str, int], int]] = {}
    for r in binned_counts(folded, grids, "fold").collect():
        held.setdefault((r["fold"], r["field"]), {})[r["truth"], r["bin"]] = r["n"]
    found, report = dict(start), {}
    for search in searches:
        grid = search.places(start)
        parts = sorted({fold for fold, field in held if field in dict(search.fields)})

        def score(cuts: list[int], search: Search = search, parts: list[int] = parts) -> float:
            means = []
            for fold in parts:
                own = [_macro_f1(held[fold, field], labels, cuts) for field, labels in search.fields if (fold, field) in held]
                means.append(sum(own) / len(own))
            return sum(means) / len(means) if means else 0.0

        cuts = [grid.index(float(start[p])) for p in search.params]
        before = best_score = score(cuts)
        for _ in range(passes):
            last = list(cuts)
            for j in range(len(cuts)):
                allowed = {grid.index(float(x)) for x in search.grids[j]}
                low, high = cuts[j - 1] if j else -1, cuts[j + 1] if j + 1 < len(cuts) else len(grid)
                for candidate in sorted(c for c in allowed if low < c < high):
                    tried = [*cuts[:j], candidate, *cuts[j + 1 :]]
                    if (now := score(tried)) > best_score + 1e-12:
                        best_score, cuts = now, tried
            if cuts == last:
                break
        found |= {p: grid[c] for p, c in zip(search.params, cuts)}
        report[search.name] = (before, best_score)
    return found, report
