"""Feature engineering: scaling, indexing, one-hot, assembly, PCA and preparation for training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    PCA,
    MinMaxScaler,
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablume.functions.columns import (
    as_text,
    col,
    fields_of,
    is_categorical,
    is_null,
    is_numeric,
    kind_of,
    quoted,
    require_columns,
    require_plain_names,
)
from tablume.operators.clean import drop_null_labels
from tablume.operators.profile import value_counts
from tablume.sources.scratch import cut_lineage

#: Labels one string indexer may hold: its dictionary lives on the driver and in the model. Wider
#: columns are numbered by a distributed sort, and their dictionary is a table of its own.
MAX_LABELS = 1_000_000
#: Labels resolved by a broadcast lookup in :func:`string_index` on wide dictionaries.
HOT_LABELS = 1_000

RAW, FEATURES, LABEL, PREDICTION = "_features_raw", "_features", "_label", "prediction"


def assemble(
    df: DataFrame,
    columns: Sequence[str],
    output: str = "features_vector",
    handle_invalid: str = "skip",
) -> DataFrame:
    """Collect numeric columns into one vector column; ``skip`` drops rows with an absent value."""
    require_columns(df, columns)
    require_plain_names(columns)
    names = list(dict.fromkeys(columns))
    if not names:
        raise ValueError("no feature columns to assemble")
    return VectorAssembler(
        inputCols=names, outputCol=output, handleInvalid=handle_invalid
    ).transform(df)


def scale(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "standard",
    handle_invalid: str = "skip",
    output: str = "scaled_features",
) -> DataFrame:
    """Add the vector ``scaled_features``: ``standard`` (mean 0, sample std 1) or ``minmax``."""
    vector = "features_vector"
    if method == "standard":
        scaler = StandardScaler(inputCol=vector, outputCol=output, withMean=True, withStd=True)
    elif method == "minmax":
        scaler = MinMaxScaler(inputCol=vector, outputCol=output)
    else:
        raise ValueError(f"unsupported scaling method: {method!r}; use standard or minmax")
    assembled = assemble(df, columns, vector, handle_invalid)
    return scaler.fit(assembled).transform(assembled)


def label_estimates(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Approximate number of labels of each column, from one constant-size aggregate."""
    fields = fields_of(df, columns)
    if not fields:
        return {}
    row = df.agg(
        *[F.approx_count_distinct(as_text(f)).alias(f"d{i}") for i, f in enumerate(fields)]
    ).first()
    return {f.name: row[i] for i, f in enumerate(fields)}


def string_index(
    df: DataFrame, columns: Sequence[str], max_labels: int = MAX_LABELS
) -> DataFrame:
    """Add ``<c>_indexed``: 0 for the most frequent value, ties alphabetical, nulls last.

    Up to ``max_labels`` values the dictionary is a fitted indexer. Beyond that it no longer
    belongs on the driver: values are ranked by a distributed sort and joined back.
    """
    return _index(df, label_estimates(df, columns), max_labels)


def _index(df: DataFrame, estimates: dict[str, int], max_labels: int) -> DataFrame:
    local = [c for c in estimates if estimates[c] <= max_labels]
    out = df
    if local:
        texts = [f"{c}_indexed" for c in local]
        source = df.withColumns({t: as_text(df.schema[c]) for t, c in zip(texts, local)})
        model = StringIndexer(
            inputCols=texts, outputCols=[f"_{t}" for t in texts], handleInvalid="keep"
        ).fit(source)
        out = model.transform(source).drop(*texts)
        out = out.withColumnsRenamed({f"_{t}": t for t in texts})
    for name in estimates:
        if name not in local:
            out = _index_by_sort(out, name)
    return out


def ranked_values(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """``(value, index)`` with values numbered by falling frequency, and how many there are.

    A range-partitioned sort puts the distinct values in order over many tasks; each one's
    number is its place within its partition plus the sizes of the partitions before it. The
    sorted values are written out first, because those two facts must come from the same sort.
    """
    return _numbered_values(value_counts(df, [column]))


def _numbered_values(counts: DataFrame) -> tuple[DataFrame, int]:
    """:func:`ranked_values` from ``(value, count)``."""
    ordered = counts.orderBy(F.desc("count"), "value")
    placed = cut_lineage(
        ordered.select(
            "value",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"),
        )
    )
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    starts, total = [], 0
    for row in sizes:
        starts.append((row["part"], total))
        total += row["n"]
    # One row per partition of the sort, so the broadcast does not grow with the values.
    offsets = F.broadcast(counts.sparkSession.createDataFrame(starts, "part int, start bigint"))
    numbered = placed.join(offsets, "part").select(
        "value", (F.col("start") + F.col("place")).alias("index")
    )
    return numbered, total


@dataclass
class WideIndex:
    """The numbers of a column with too many labels for a model: ``value, index``, and how many.

    Absent and unknown values have the number after the last, as in a fitted indexer.
    """

    ranked: DataFrame
    size: int

    def add(self, df: DataFrame, column: str, output: str | None = None) -> DataFrame:
        """``df`` with ``<column>_indexed``; the most frequent values are not shuffled.

        The ``HOT_LABELS`` first numbers are the most frequent values, so looking those up by a
        bounded broadcast leaves only values each holding under ``1 / HOT_LABELS`` of the rows.
        With ``output`` the column is a label of that name: every value is known, and there is
        no number for others.
        """
        slots = self.size if output else self.size + 1
        output = output or f"{column}_indexed"
        unknown = F.lit(float(self.size))
        hot = F.broadcast(self.ranked.filter(F.col("index") < HOT_LABELS).limit(HOT_LABELS))
        keyed = df.withColumn("_value", as_text(df.schema[column])).join(
            hot.select(F.col("value").alias("_value"), F.col("index").alias("_hot")), "_value", "left"
        )
        settled = F.col("_value").isNull() | F.col("_hot").isNotNull()
        done = keyed.filter(settled).withColumn(
            output, F.coalesce(F.col("_hot").cast("double"), unknown)
        )
        rare = self.ranked.filter(F.col("index") >= HOT_LABELS).select(
            F.col("value").alias("_value"), F.col("index").cast("double").alias(output)
        )
        rest = keyed.filter(~settled).join(rare, "_value", "left")
        rest = rest.withColumn(output, F.coalesce(output, unknown))
        # the same description as a fitted indexer gives, without the labels themselves
        about = {"ml_attr": {"name": output, "type": "nominal", "num_vals": slots}}
        every = done.unionByName(rest).drop("_value", "_hot")
        return every.withMetadata(output, about)


def _index_by_sort(df: DataFrame, column: str) -> DataFrame:
    """Number the labels by a distributed sort and join them back."""
    return WideIndex(*ranked_values(df, column)).add(df, column)


def one_hot(df: DataFrame, columns: Sequence[str], max_labels: int = MAX_LABELS) -> DataFrame:
    """Add ``<c>_indexed`` and the sparse vector ``<c>_encoded`` with one slot per label.

    A null has no slot and encodes as all zeros. Beyond ``max_labels`` slots the vector's column
    knows their number only: an encoder would name each of them in the plan.
    """
    estimates = label_estimates(df, columns)
    out = _index(df, estimates, max_labels)
    local = [c for c in estimates if estimates[c] <= max_labels]
    if local:
        encoder = OneHotEncoder(
            inputCols=[f"{c}_indexed" for c in local], outputCols=[f"{c}_encoded" for c in local]
        )
        out = encoder.fit(out).transform(out)
    for c in estimates:
        if c not in local:
            slots = out.schema[f"{c}_indexed"].metadata["ml_attr"]["num_vals"] - 1
            out = out.withColumn(f"{c}_encoded", _one_slot(slots)(col(f"{c}_indexed")))
            about = {"ml_attr": {"num_attrs": slots}}
            out = out.withMetadata(f"{c}_encoded", about)
    return out


def _one_slot(slots: int):
    def encoded(index):
        return Vectors.sparse(slots, [int(index)] if index < slots else [], [1.0] if index < slots else [])

    return F.udf(encoded, VectorUDT())


def pca(
    df: DataFrame,
    columns: Sequence[str],
    components: int = 2,
    handle_invalid: str = "skip",
    output: str = "pca_features",
) -> tuple[DataFrame, list[float]]:
    """Add the vector ``pca_features``; also return each component's share of the variance.

    Rows are projected as they are, without centring. Only the columns' covariance, whose size
    does not depend on the rows, reaches the driver.
    """
    assembled = assemble(df, columns, "features_vector", handle_invalid)
    model = PCA(k=components, inputCol="features_vector", outputCol=output).fit(assembled)
    return model.transform(assembled), [float(v) for v in model.explainedVariance.toArray()]


@dataclass
class Prepared:
    """A table ready for training and the steps from raw columns to features.

    ``labels`` are the texts of the classes by number; more of them than a model should hold are
    the table ``classes`` instead.
    """

    df: DataFrame
    inputs: list[str]
    schema: list[dict]
    pipeline: Pipeline
    target: str | None = None
    labels: list[str] | None = None
    counts: dict[str, int] = field(default_factory=dict)
    wide: dict[str, WideIndex] = field(default_factory=dict)
    classes: WideIndex | None = None

    def indexed(self, df: DataFrame) -> DataFrame:
        """Raw rows with the numbers of the features that no model holds."""
        for name, numbers in self.wide.items():
            df = numbers.add(df, name)
        return df

    @property
    def features(self) -> list[str]:
        return [e["name"] for e in self.schema if not e["is_target"]]

    def usable(self) -> DataFrame:
        """The rows the assembler will keep: no absent numeric feature."""
        return self.df.filter(_usable(self.df, self.features))


def _usable(df: DataFrame, features: Sequence[str]):
    usable = F.lit(True)
    for f in fields_of(df, features):
        if is_numeric(f.dataType):
            usable = usable & ~is_null(f)
    return usable


def prepare(
    df: DataFrame,
    features: Sequence[str],
    target: str | None = None,
    keep: Sequence[str] = (),
    max_labels: int = MAX_LABELS,
    classes: bool = False,
) -> Prepared:
    """Check, label and narrow a table for training.

    String and boolean features are indexed, numeric ones used as they are, and all of them
    assembled and standardised by one pipeline that starts from the raw columns, so a saved
    model scores raw rows. A string or boolean target is indexed, a numeric one cast to double;
    rows without a target are dropped first. With ``classes`` a numeric target that is not
    numbered 0, 1, 2, ... is indexed too. ``counts`` tells rows in, labelled and usable.

    The counts and all dictionaries come from one read, the scaler's figures from a second. A
    column with more than ``max_labels`` labels, the target included, is numbered by a distributed
    sort and a join instead of by the model.
    """
    features = [f for f in dict.fromkeys(features) if f != target]
    if not features:
        raise ValueError("no feature columns selected")
    require_columns(df, [*features, *([target] if target else []), *keep])
    require_plain_names(features)
    for f in fields_of(df, [*features, *([target] if target else [])]):
        if kind_of(f.dataType) not in ("numeric", "categorical"):
            raise ValueError(
                f"column {f.name!r} of type {f.dataType.simpleString()} cannot be used for training; "
                "use numeric, string or boolean columns"
            )
    reserved = {RAW, FEATURES, LABEL, PREDICTION} & set(features)
    if reserved:
        raise ValueError("reserved column name(s): " + ", ".join(sorted(reserved)))

    schema = [
        {"name": n, "original_type": df.schema[n].dataType.simpleString(), "is_target": n == target}
        for n in [*features, *([target] if target else [])]
    ]
    modelled = [*features, *([target] if target else [])]
    categorical = [n for n in modelled if is_categorical(df.schema[n].dataType)]
    wanted = list(dict.fromkeys([*features, *([target] if target else []), *keep]))
    narrow = df.select(*[col(n) for n in wanted])

    found = _count_labels(narrow, features, target, categorical, max_labels, classes)
    labels, many = None, [n for n in features if n in found.wide]
    if target:
        if found.counts["labelled"] == 0:
            raise ValueError(f"no rows are left after dropping null labels in {target!r}")
        narrow = _with_label(narrow, target, found)
        labels = found.labels.get(target)
    taken = {f"{n}_indexed" for n in categorical} & set(narrow.columns)
    if taken:
        raise ValueError("column name(s) needed for indexing: " + ", ".join(sorted(taken)))
    pipeline, inputs = _feature_steps(df, features, found.labels, many)
    prepared = Prepared(narrow, inputs, schema, pipeline, target, labels, found.counts)
    prepared.wide = {n: found.wide[n] for n in many}
    prepared.classes = found.wide.get(target)
    prepared.df = prepared.indexed(narrow)
    return prepared


@dataclass
class _Dictionaries:
    """The row counts, and the labels of each column: a list, or a table where they are many."""

    counts: dict[str, int]
    labels: dict[str, list[str]]
    wide: dict[str, WideIndex]


def _count_labels(
    df: DataFrame,
    features: Sequence[str],
    target: str | None,
    categorical: Sequence[str],
    max_labels: int,
    classes: bool,
) -> _Dictionaries:
    """Rows in, labelled and usable, and the dictionaries of all columns, from one read.

    Every row is unpivoted to its values and one mark of what the row is good for, and all of
    them are counted by one grouped aggregate that combines in the tasks. Only rows with a label
    count for dictionaries. At most ``max_labels`` values of a column reach the driver.
    """
    numeric_classes = classes and target and is_numeric(df.schema[target].dataType)
    counted = [*categorical, *([target] if numeric_classes else [])]
    labelled = ~is_null(df.schema[target]) if target else F.lit(True)
    mark = F.when(~labelled, "rows").when(_usable(df, features), "used").otherwise("labelled")
    entries = [F.struct(F.lit(-1).alias("column"), mark.alias("value"))]
    for i, n in enumerate(counted):
        value = F.when(labelled, as_text(df.schema[n])).alias("value")
        entries.append(F.struct(F.lit(i).alias("column"), value))
    values = df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
    table = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        number = F.when(F.col("column") == len(categorical), F.col("value").try_cast("double"))
        sizes = {
            r["column"]: r
            for r in table.groupBy("column")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.min(number).alias("low"),
                F.max(number).alias("high"),
                F.count_if(number != F.floor(number)).alias("parts"),
            )
            .collect()
        }
        wide = [i for i in range(len(counted)) if i in sizes and sizes[i]["n"] > max_labels]
        if numeric_classes and (last := sizes.get(len(categorical))):
            # whole numbers from 0 on are labels already
            if (last["low"], last["parts"], last["high"]) == (0, 0, last["n"] - 1):
                counted = categorical
                wide = [i for i in wide if i < len(categorical)]
        held = [-1, *[i for i in range(len(counted)) if i not in wide]]
        rows = table.filter(F.col("column").isin(held)).collect()
        marks = {r["value"]: r["count"] for r in rows if r["column"] == -1}
        used = marks.get("used", 0)
        with_label = used + marks.get("labelled", 0)
        counts = {"rows": with_label + marks.get("rows", 0), "labelled": with_label, "used": used}
        labels = {counted[i]: [] for i in held if i >= 0}
        for r in sorted(rows, key=lambda r: (-r["count"], r["value"])):
            if r["column"] >= 0:
                labels[counted[r["column"]]].append(r["value"])
        tables = {
            counted[i]: WideIndex(
                *_numbered_values(table.filter(F.col("column") == i).drop("column"))
            )
            for i in wide
        }
    finally:
        table.unpersist()
    return _Dictionaries(counts, labels, tables)


def _with_label(df: DataFrame, target: str, found: _Dictionaries) -> DataFrame:
    """The rows that have a label, as a number in ``_label``."""
    kept = drop_null_labels(df, target)
    if target in found.wide:
        return found.wide[target].add(kept, target, LABEL)
    if target not in found.labels:
        return kept.withColumn(LABEL, col(target).cast("double"))
    texts = kept.withColumn("_label_text", as_text(df.schema[target]))
    model = StringIndexerModel.from_labels(
        found.labels[target], inputCol="_label_text", outputCol=LABEL, handleInvalid="error"
    )
    return model.transform(texts).drop("_label_text")


def _feature_steps(
    df: DataFrame, features: Sequence[str], labels: Mapping[str, list[str]], many: Sequence[str]
) -> tuple[Pipeline, list[str]]:
    """Steps from raw columns to the scaled vector, and the assembler's inputs in order.

    The indexers have their labels already, so only the scaler remains to be fitted.
    """
    indexers, inputs, booleans = [], [], []
    for n in features:
        dtype = df.schema[n].dataType
        if not is_categorical(dtype):
            inputs.append(n)
            continue
        inputs.append(f"{n}_indexed")
        if n in many:
            continue
        source = n
        if isinstance(dtype, T.BooleanType):
            source = f"_{n}_text"
            booleans.append(f"CAST({quoted(n)} AS STRING) AS {quoted(source)}")
        indexers.append(
            StringIndexerModel.from_labels(
                labels[n], inputCol=source, outputCol=f"{n}_indexed", handleInvalid="keep"
            )
        )
    stages = []
    if booleans:
        stages.append(SQLTransformer(statement="SELECT *, " + ", ".join(booleans) + " FROM __THIS__"))
    stages += indexers
    stages.append(VectorAssembler(inputCols=inputs, outputCol=RAW, handleInvalid="skip"))
    stages.append(StandardScaler(inputCol=RAW, outputCol=FEATURES, withMean=True, withStd=True))
    return Pipeline(stages=stages), inputs


def fit_features(prepared: Prepared) -> tuple[PipelineModel, DataFrame]:
    """Fit the feature steps once and apply them."""
    model = prepared.pipeline.fit(prepared.df)
    return model, model.transform(prepared.df)
