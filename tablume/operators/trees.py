"""Tree ensembles fitted to cells of rows instead of to rows.

A tree sees a feature only through its bins. Rows are therefore counted by their bins first, and
the ensembles are fitted to these cells, weighted by their rows: at most ``maxBins`` to the power
of the number of features, however many rows there are. The splits, gains and predictions are
those of the rows, because a tree never tells rows of one cell apart.

Boosting takes the cells as they are. A forest's bootstrap draws every row by itself, so a cell of
``n`` equal rows is drawn Poisson(n) times in each tree, which is the sum of the rows' draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablume.operators.features import FEATURES, LABEL

BINS = f"{FEATURES}_bins"
#: How many rows a cell holds, and the mean and variance of their labels.
CELL_ROWS, CELL_VARIANCE = "_weight", "_variance"
#: Rows that splits are chosen from, as in Spark's trees: so many, or the square of maxBins.
SPLIT_ROWS = 10_000
#: Draws of a forest are made over so many partitions at least, and one for so many rows.
DRAW_PARTITIONS, ROWS_A_DRAW = 8, 4_000_000
#: Cells of one task of a fit, and trees of a forest fitted at the same time.
CELLS_A_TASK, TREES_AT_ONCE = 100_000, 8
#: Classes that are counted from a label which doesn't say how many it has.
MOST_INFERRED = 100

FORESTS = (RandomForestClassifier, RandomForestRegressor)


def by_cells(estimator: Estimator) -> bool:
    """Whether the estimator can be fitted to cells: a forest, or boosting that takes all rows."""
    if isinstance(estimator, (GBTClassifier, GBTRegressor)):
        return estimator.getSubsamplingRate() == 1.0
    return isinstance(estimator, FORESTS)


def thresholds(values: np.ndarray, max_bins: int) -> list[float]:
    """Where Spark's trees split a feature: between all values, or evenly where they are many."""
    value, count = np.unique(values, return_counts=True)
    middle = (value[:-1] + value[1:]) / 2
    if len(value) <= max_bins:
        return middle.tolist()
    found, stride = [], len(values) / max_bins
    target, below = stride, np.cumsum(count)
    for i in range(1, len(value)):
        if abs(below[i - 1] - target) < abs(below[i] - target):
            found.append(float(middle[i - 1]))
            target += stride
    return found


def binning(rows: DataFrame, inputs: Sequence[str], n: int, estimator: Estimator) -> list:
    """The stages that turn the input columns into the vector of their bins."""
    max_bins = min(estimator.getMaxBins(), max(n, 2))
    wanted = max(max_bins**2, SPLIT_ROWS)
    some = rows.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(inputs)])
    if wanted < n:
        some = some.sample(wanted / n, estimator.getSeed())
    taken = some.toArrow()
    splits = []
    for i in range(len(inputs)):
        values = taken.column(i).to_numpy()
        at = thresholds(values[~np.isnan(values)], max_bins) or [0.0]
        # a tree's left side holds the threshold itself
        splits.append([-np.inf, *np.unique(np.nextafter(at, np.inf)).tolist(), np.inf])
    names = [f"{BINS}_{i}" for i in range(len(inputs))]
    return [
        Bucketizer(inputCols=list(inputs), outputCols=names, splitsArray=splits),
        VectorAssembler(inputCols=names, outputCol=BINS),
    ]


def fit_cells(
    estimator: Estimator, rows: DataFrame, inputs: Sequence[str], n: int
) -> tuple[list, DataFrame]:
    """The stages of an ensemble fitted to ``n`` rows (binning and model), and its cells with label,
    weight, variance of the label and prediction, cached; the caller lets go of them."""
    stages = binning(rows, inputs, n, estimator)
    label = rows.schema[LABEL]
    binned = stages[0].transform(rows)
    bins = F.array(*[F.col(c).cast("float") for c in stages[0].getOutputCols()])
    binned = binned.select(bins.alias("bins"), F.col(LABEL).cast("double").alias(LABEL))
    regression = isinstance(estimator, (GBTRegressor, RandomForestRegressor))
    equal = binned.groupBy("bins", LABEL).agg(F.count(F.lit(1)).cast("double").alias(CELL_ROWS))
    if regression:
        cells = binned.groupBy("bins").agg(
            F.avg(LABEL).alias(LABEL),
            F.count(F.lit(1)).cast("double").alias(CELL_ROWS),
            F.var_pop(LABEL).alias(CELL_VARIANCE),
        )
    else:
        cells = equal.withColumn(CELL_VARIANCE, F.lit(0.0))
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        number = cells.count()
        about = {} if regression else _label_about(cells, label)
        estimator = estimator.copy().setFeaturesCol(BINS)
        if isinstance(estimator, FORESTS):
            drawn = _drawn(equal if regression else cells, estimator, n, len(inputs), regression)
            fitted = _forest(estimator, drawn, regression, about)
        else:
            at = (estimator.getMinInstancesPerNode() - 0.5) / n
            points = _points(cells.coalesce(_tasks(number)), LABEL, CELL_ROWS, about)
            fitted = estimator.copy(_inner(estimator, number, at)).setWeightCol(CELL_ROWS).fit(points)
            fitted = _like(estimator, fitted)
        found = cells.select(array_to_vector("bins").alias(BINS), LABEL, CELL_ROWS, CELL_VARIANCE)
        return [*stages, fitted], fitted.transform(found), cells
    except BaseException:
        cells.unpersist()
        raise


def _tasks(cells: int) -> int:
    return max(1, -(-cells // CELLS_A_TASK))


def _points(cells: DataFrame, label: str, weight: str, about: dict) -> DataFrame:
    points = cells.select(
        array_to_vector("bins").alias(BINS), F.expr(label).alias(LABEL), F.expr(weight).alias(CELL_ROWS)
    )
    return points.where(F.col(CELL_ROWS) > 0).withMetadata(LABEL, about)


def _label_about(cells: DataFrame, label) -> dict:
    """What the label's column says of its classes; else their number is that of the largest."""
    if "ml_attr" in label.metadata:
        return label.metadata
    classes = int(cells.agg(F.max(LABEL)).first()[0]) + 1
    if classes > MOST_INFERRED:
        return {}  # the estimator refuses it
    return {"ml_attr": {"name": LABEL, "type": "nominal", "num_vals": max(classes, 2)}}


def _inner(estimator: Estimator, cells: int, least: float) -> dict:
    """Parameters for weighted cells: no second choice of splits, and ``least`` as the share of the
    rows that a node must have, since its cells are not rows."""
    least = max(estimator.getMinWeightFractionPerNode(), least)
    if least >= 0.5:  # no node can be split in two such halves
        return {estimator.maxDepth: 0, estimator.minInstancesPerNode: 1}
    return {
        estimator.maxBins: max(estimator.getMaxBins(), int(np.ceil(np.sqrt(cells))) + 1),
        estimator.minInstancesPerNode: 1,
        estimator.minWeightFractionPerNode: max(least, 0.0),
    }


def _like(estimator: Estimator, fitted: Model) -> Model:
    """The model with the parameters that its estimator was given."""
    for name in ("maxBins", "maxDepth", "minInstancesPerNode", "minWeightFractionPerNode"):
        fitted.set(fitted.getParam(name), estimator.getOrDefault(name))
    fitted.clear(fitted.getParam("weightCol"))
    return fitted


def _drawn(equal: DataFrame, estimator: Estimator, n: int, width: int, regression: bool) -> DataFrame:
    """``bins, label, w, s``: how often each tree draws a cell, and the sums of the labels it draws.

    Equal rows are dealt by hash and sorted, so the draws don't depend on how the input is split.
    In regression rows of one cell have many labels: their draws are added up, first in the order
    of the draws and then over all tasks.
    """
    trees, rate, again = estimator.getNumTrees(), estimator.getSubsamplingRate(), estimator.getBootstrap()
    seed = estimator.getSeed() & 0xFFFFFFFF

    def bins_of(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def batch_of(bins: np.ndarray, label: np.ndarray, *sums: np.ndarray) -> pa.RecordBatch:
        lists = [
            pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            for x in (bins, *sums)
        ]
        return pa.RecordBatch.from_arrays(
            [lists[0], pa.array(label), *lists[1:]], names=["bins", LABEL, "w", "s"][: 2 + len(sums)]
        )

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            rows = batch.column(2).to_numpy()[:, None]
            if again:
                w = random.poisson(rows * rate, (len(rows), trees)).astype(float)
            elif rate < 1:
                w = random.binomial(rows.astype(np.int64), rate, (len(rows), trees)).astype(float)
            else:
                w = np.repeat(rows, trees, axis=1)
            label = batch.column(1).to_numpy()
            if not regression:
                yield batch_of(bins_of(batch), label, w)
                continue
            yield from together(bins_of(batch), w, w * label[:, None])

    def together(bins: np.ndarray, *sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.append(True, np.any(bins[1:] != bins[:-1], axis=1))[: len(bins)]
        begin = np.flatnonzero(new)
        if len(begin):
            sums = [np.add.reduceat(x, begin, axis=0) for x in sums]
            yield batch_of(bins[begin], np.zeros(len(begin)), *sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [batch.column(i).flatten().to_numpy().reshape(-1, trees) for i in (2, 3)]
            yield from together(bins_of(batch), *sums)

    schema = f"bins array<float>, {LABEL} double, w array<double>"
    dealt = equal.select("bins", LABEL, CELL_ROWS)
    dealt = dealt.repartition(max(DRAW_PARTITIONS, -(-n // ROWS_A_DRAW)), "bins", LABEL)
    dealt = dealt.sortWithinPartitions("bins", LABEL)
    if not regression:
        return dealt.mapInArrow(draw, schema)
    schema += ", s array<double>"
    parts = dealt.mapInArrow(draw, schema).repartition(max(DRAW_PARTITIONS, -(-n // ROWS_A_DRAW)), "bins")
    # what two batches cut apart stays two points of the same cell
    return parts.sortWithinPartitions("bins").mapInArrow(add, schema)


def _forest(estimator: Estimator, drawn: DataFrame, regression: bool, about: dict) -> Model:
    """One tree for each column of draws, put together as a forest."""
    number = estimator.getNumTrees()
    subset = estimator.getFeatureSubsetStrategy()
    if subset == "auto":
        subset = "all" if number == 1 else "onethird" if regression else "sqrt"
    drawn = drawn.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        totals = [F.sum(F.get("w", F.lit(t))).alias(f"t{t}") for t in range(number)]
        points, *drawn_rows = drawn.agg(F.count(F.lit(1)), *totals).first()
        few = drawn.coalesce(_tasks(points))
        seeds = np.random.default_rng(estimator.getSeed() & 0xFFFFFFFF).integers(0, 2**31, number)
        common = {
            estimator.numTrees: 1, estimator.bootstrap: False, estimator.subsamplingRate: 1.0,
            estimator.featureSubsetStrategy: subset,
        }

        @inheritable_thread_target(drawn.sparkSession)
        def tree(t: int) -> Model:
            label = f"try_divide(s[{t}], w[{t}])" if regression else LABEL
            least = (estimator.getMinInstancesPerNode() - 0.5) / max(drawn_rows[t] or 0.0, 1.0)
            one = estimator.copy({**common, **_inner(estimator, points, least), estimator.seed: int(seeds[t])})
            one.setWeightCol(CELL_ROWS)
            return one.fit(_points(few, label, f"w[{t}]", about)).trees[0]

        with ThreadPool(min(TREES_AT_ONCE, number)) as pool:
            single = pool.map(tree, range(number), 1)
    finally:
        drawn.unpersist()
    return _together(estimator, single)


def _together(estimator: Estimator, trees: list[Model]) -> Model:
    """The forest of some trees, with the parameters of its estimator."""
    context = SparkContext._active_spark_context
    package = context._jvm.org.apache.spark.ml
    if isinstance(estimator, RandomForestRegressor):
        one, forest = package.regression.DecisionTreeRegressionModel, package.regression.RandomForestRegressionModel
        sizes = [trees[0].numFeatures]
    else:
        one = package.classification.DecisionTreeClassificationModel
        forest = package.classification.RandomForestClassificationModel
        sizes = [trees[0].numFeatures, trees[0].numClasses]
    several = context._gateway.new_array(one, len(trees))
    for i, tree in enumerate(trees):
        several[i] = tree._java_obj
    model = estimator._create_model(forest(estimator.uid, several, *sizes))
    model._resetUid(estimator.uid)
    return estimator._copyValues(model)
