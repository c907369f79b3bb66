"""Impute, scale and one-hot encode, fitted with a few aggregations.

The fitted steps are stages of pyspark.ml (SQLTransformer, StringIndexerModel,
OneHotEncoderModel, VectorAssembler): they run inside the JVM and can be saved.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.operators.selection import medians
from fieldmark.session import scratch_path

MAX_CATEGORIES = 50

# Kept values are stored with a leading "=", so these two cannot clash with one.
_RARE, _UNSEEN = "~", "?"


def _clean(c: str) -> str:
    return f"CASE WHEN NOT isnan(CAST(`{c}` AS DOUBLE)) THEN CAST(`{c}` AS DOUBLE) END"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass(frozen=True)
class NumericFit:
    median: float
    mean: float
    std: float

    def sql(self, column: str, scale: bool = True) -> str:
        filled = f"coalesce({_clean(column)}, {self.median!r}D)"
        return f"({filled} - {self.mean!r}D) / {self.std!r}D" if scale else filled


def fit_numeric(df: DataFrame, columns: list[str]) -> dict[str, NumericFit]:
    """Median, and mean and population deviation after filling gaps with it.

    A constant column is scaled by 1; a column without any value is left out.
    """
    if not columns:
        return {}
    mid = medians(df, {c: F.expr(_clean(c)) for c in columns})
    used = [c for c in columns if mid[c] is not None]
    if not used:
        return {}
    filled = {c: F.coalesce(F.expr(_clean(c)), F.lit(mid[c])) for c in used}
    row = df.agg(*[f(filled[c]).alias(f"{k}_{i}") for i, c in enumerate(used)
                   for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: NumericFit(mid[c], row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, c in enumerate(used)}


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) for all the columns in one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"),
                                         F.col(c).cast("string").alias("value"))
                                for c in columns])).alias("p")
    return (df.select(pairs).select("p.*").where(F.col("value").isNotNull())
            .groupBy("column", "value").count())


def most_frequent(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value per column (equals: the smaller value)."""
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    rows = (category_counts(df, columns).withColumn("r", F.row_number().over(w))
            .where("r = 1").collect())
    return {r["column"]: r["value"] for r in rows}


@dataclass(frozen=True)
class CategoryFit:
    kept: list[str]            # own output column each, most frequent first
    rare: bool                 # one more output column for the other seen values
    seen_path: str | None      # where those other values are stored


def fit_categories(df: DataFrame, columns: list[str],
                   max_categories: int = MAX_CATEGORIES) -> dict[str, CategoryFit]:
    """The categories that get a column of their own: all, or the most frequent but one."""
    if not columns:
        return {}
    counts = category_counts(df, columns)
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    # At most max_categories + 1 values per column leave the executors.
    top = (counts.withColumn("r", F.row_number().over(w))
           .where(F.col("r") <= max_categories + 1).orderBy("column", "r").collect())
    values = {c: [r["value"] for r in top if r["column"] == c] for c in columns}
    out = {}
    for c in columns:
        if len(values[c]) <= max_categories:
            out[c] = CategoryFit(values[c], False, None)
        else:
            kept = values[c][:max_categories - 1]
            path = scratch_path(df.sparkSession, "categories")
            (counts.where((F.col("column") == c) & ~F.col("value").isin(kept))
             .select("value").write.parquet(path))
            out[c] = CategoryFit(kept, True, path)
    return out


def _filled(c: str, fit: CategoryFit) -> str:
    """The category as text; a missing one counts as the most frequent (equals: the smaller value)."""
    text = f"CAST(t.`{c}` AS STRING)"
    return f"coalesce({text}, {_text(fit.kept[0])})" if fit.kept else text


def _category_sql(c: str, fit: CategoryFit, alias: str | None) -> str:
    text = _filled(c, fit)
    whens = ""
    if fit.kept:
        whens = f"WHEN {text} IN ({', '.join(_text(v) for v in fit.kept)}) THEN concat('=', {text}) "
    if alias:
        whens += f"WHEN {alias}.value IS NOT NULL THEN '{_RARE}' "
    return f"CASE {whens}ELSE '{_UNSEEN}' END" if whens else f"'{_UNSEEN}'"


def fit_preprocess(df: DataFrame, numeric: list[str], categorical: list[str],
                   output: str = "features", max_categories: int = MAX_CATEGORIES,
                   scale: bool = True) -> PipelineModel:
    """The fitted steps from raw columns to one vector: numbers first, then categories.

    Missing categories become the most frequent one, unseen categories give zeros. Values
    seen but rare share one column; they are told from unseen ones by a join with the
    stored list. Kept values match nothing there and are spread over all partitions.
    """
    nums = fit_numeric(df, numeric)
    cats = {c: f for c, f in fit_categories(df, categorical, max_categories).items()
            if f.kept or f.rare}
    parts, joins = ["t.*"], []
    for i, (c, fit) in enumerate(nums.items()):
        parts.append(f"{fit.sql(c, scale)} AS __n{i}")
    for i, (c, fit) in enumerate(cats.items()):
        alias = None
        if fit.rare:
            alias = f"s{i}"
            text = _filled(c, fit)
            kept = ", ".join(_text(v) for v in fit.kept)
            spread = f"concat('\\u0000', CAST(xxhash64({', '.join(f't.`{x}`' for x in [*numeric, *categorical])}) AS STRING))"
            joins.append(f"LEFT JOIN parquet.`{fit.seen_path}` {alias} "
                         f"ON CASE WHEN {text} NOT IN ({kept}) THEN {text} ELSE {spread} END = {alias}.value")
        parts.append(f"{_category_sql(c, fit, alias)} AS __c{i}")
    numbered = [f"__n{i}" for i in range(len(nums))]
    stages = [SQLTransformer(
        statement=f"SELECT {', '.join(parts)} FROM __THIS__ t {' '.join(joins)}")]
    if cats:
        names = [f"__c{i}" for i in range(len(cats))]
        labels = [["=" + v for v in f.kept] + ([_RARE] if f.rare else []) for f in cats.values()]
        index = PipelineModel([StringIndexerModel.from_labels(ls, c, f"{c}_i", "keep")
                               for c, ls in zip(names, labels)])
        none = df.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in names))
        # The sizes come from the index columns' attributes; no data is read.
        hot = (OneHotEncoder(inputCols=[f"{c}_i" for c in names],
                             outputCols=[f"{c}_h" for c in names],
                             dropLast=True, handleInvalid="error")
               .fit(index.transform(none)))
        stages += [*index.stages, hot]
        numbered += [f"{c}_h" for c in names]
    stages.append(VectorAssembler(inputCols=numbered, outputCol=output))
    drop = [f"__n{i}" for i in range(len(nums))]
    drop += [f"__c{i}{s}" for i in range(len(cats)) for s in ("", "_i", "_h")]
    if drop:
        stages.append(SQLTransformer(
            statement=f"SELECT * EXCEPT ({', '.join(drop)}) FROM __THIS__"))
    return PipelineModel(stages)


def width(model_output: DataFrame, column: str = "features") -> int:
    """Length of a vector column, from its attributes if present."""
    meta = model_output.schema[column].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return model_output.select(column).first()[0].size
