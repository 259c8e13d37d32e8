"""The long feature store: unpivot, pivot, what is present, model matrices, replacing a range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.values import fill_invalid, invalid_flag, is_finite
from ..schema import FEATURES
from ..sources.scratch import delete, file_system
from ..sources.trades import in_range


def unpivot(wide: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Finite values of the named columns as rows (keys, feature_name, feature_value). No shuffle."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).cast("double").alias("feature_value")) for n in names])
    rows = wide.select(*(keys or ["symbol", "ms", "trade_id"]), F.explode(pairs).alias("kv"))
    return rows.select(*(keys or ["symbol", "ms", "trade_id"]), "kv.*").where(is_finite(F.col("feature_value")))


def pivot(store: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """One row a key with a column for each name: the largest value, null if there is none. NaN counts as none."""
    keys = keys or ["symbol", "ms"]
    value = F.when(~F.isnan("feature_value"), F.col("feature_value"))
    rows = store.where(F.col("feature_name").isin(names))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("feature_name") == n, value)).alias(n) for n in names])


def present(store: DataFrame, names: list[str]) -> DataFrame:
    """Which of the names have rows."""
    return store.where(F.col("feature_name").isin(names)).select("feature_name").distinct()


def matrix(store: DataFrame, target: str, names: list[str], keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The target's rows, repeats kept, each with the pivoted features of its key (null where there are none).

    One aggregation by key gathers both: the target's rows as a list, the features as columns; keys without the target
    go. So target and features shuffle once, together; a key is one instant of a symbol, its list short.
    """
    keys, order = keys or ["symbol", "ms"], order or []
    value = F.when(~F.isnan("feature_value"), F.col("feature_value"))
    row = F.struct(*order, F.col("feature_value").alias("target"))
    columns = [F.max(F.when(F.col("feature_name") == n, value)).alias(n) for n in names]
    rows = store.where(F.col("feature_name").isin(target, *names)).groupBy(*keys)
    both = rows.agg(F.collect_list(F.when(F.col("feature_name") == target, row)).alias("__rows"), *columns).where(F.size("__rows") > 0)
    return both.select(*keys, F.explode("__rows").alias("__row"), *names).select(*keys, "__row.*", *names)


def model_columns(wide: DataFrame, policies: dict[str, dict]) -> DataFrame:
    """Fills invalid values (``special_value``) and adds 0/1 columns that tell where they were (``onehot``)."""
    out = wide
    for name, policy in policies.items():
        if policy.get("onehot"):
            out = out.withColumn(f"{name}_invalid", invalid_flag(F.col(name)))
        if policy.get("special_value") is not None:
            out = out.withColumn(name, fill_invalid(F.col(name), policy["special_value"]))
    return out


def filled(rows: DataFrame, policies: dict[str, str], keys: list[str] | None = None, order: list[str] | None = None, bucket_ms: int = 3_600_000) -> DataFrame:
    """Gaps of wide columns by policy: "zero", "causal_ffill" (the last value before, in order), "null" and "derived"
    (left as they are). Filling forward goes by buckets of the axis: each starts from the last value before it."""
    keys, order = keys or ["symbol"], order or ["ms", "trade_id"]
    unknown = set(policies.values()) - {"zero", "causal_ffill", "null", "derived"}
    if unknown:
        raise ValueError(f"unknown fill policies: {sorted(unknown)}")
    out = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c, p in policies.items() if p == "zero"} or {keys[0]: F.col(keys[0])})
    forward = [c for c, p in policies.items() if p == "causal_ffill"]
    if not forward:
        return out
    out = out.withColumn("__b", F.floor(F.col(order[0]) / bucket_ms))
    at = F.struct(*order)
    ends = out.groupBy(*keys, "__b").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"__{c}") for c in forward])
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__b", *[F.last(f"__{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in forward])
    within = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.join(ends, [*keys, "__b"])
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(within), f"__{c}") for c in forward}).drop("__b", *[f"__{c}" for c in forward])


def invalid_counts(wide: DataFrame, names: list[str], most: int = 10) -> DataFrame:
    """The columns with the most invalid values (feature_name, n_invalid), worst first; one pass over the rows."""
    sums = wide.agg(*[F.coalesce(F.sum(invalid_flag(F.col(n))), F.lit(0)).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("feature_name"), F.col(n).alias("n_invalid")) for n in names])
    return sums.select(F.inline(pairs)).orderBy(F.desc("n_invalid"), "feature_name").limit(most)


def write(rows: DataFrame, path: str, mode: str = "append", finite_only: bool = True, rows_per_file: int = 5_000_000, extra: dict[str, str] | None = None) -> None:
    """Appends (symbol, exchange_ts, feature_name, feature_value) as Parquet by feature name and month.

    Rows without a symbol, instant or name, or (unless told otherwise) without a finite value, are left out.
    ``extra`` adds constant columns, such as a version and a contract's hash.
    """
    rows = rows.withColumns({k: F.lit(v) for k, v in (extra or {}).items()}) if extra else rows
    rows = rows.where("symbol is not null and exchange_ts is not null and feature_name is not null")
    if finite_only:
        rows = rows.where(is_finite(F.col("feature_value")))
    _by_month(rows).write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").partitionBy(*_PARTS).parquet(path)


_PARTS = ("feature_name", "month")


def _by_month(rows: DataFrame) -> DataFrame:
    """Rows with their month, a day of a feature in one task, in the order of the files."""
    dated = rows.withColumn("month", F.date_format("exchange_ts", "yyyy-MM"))
    return dated.repartition("feature_name", F.to_date("exchange_ts")).sortWithinPartitions(*_PARTS, "symbol", "exchange_ts")


def _months(start: datetime | None, end: datetime | None):
    """The months that [start, end) touches: a filter on folders."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("month") >= F.date_format(F.lit(start), "yyyy-MM"))
    if end is not None:
        out = out & (F.col("month") <= F.date_format(F.lit(end), "yyyy-MM"))
    return out


def read(spark: SparkSession, path: str, name: str | list[str] | None = None, symbol: str | None = None, start: datetime | None = None, end: datetime | None = None, ordered: bool = False) -> DataFrame:
    """The store's rows, of some names, a symbol and [start, end) if given, in time order if asked.

    Names and months choose folders, symbol and instants reach the scan. An empty store has the store's columns.
    """
    rows = _stored(spark, path)
    if name is not None:
        rows = rows.where(F.col("feature_name").isin([name] if isinstance(name, str) else name))
    rows = rows.where(_months(start, end)).where(in_range(symbol, start, end)).drop("month")
    return rows.orderBy("exchange_ts") if ordered else rows


def _stored(spark: SparkSession, path: str, merge: bool = False) -> DataFrame:
    """All rows with month. ``merge`` looks into every file for columns; else one file tells them."""
    files, at = file_system(spark, path)
    if not files.exists(at) or not any(x.isDirectory() for x in files.listStatus(at)):
        return spark.createDataFrame([], StructType([*FEATURES, StructField("month", StringType())]))
    found = spark.read.option("mergeSchema", str(merge).lower()).parquet(path)
    # Names that look like numbers are names all the same.
    texts = StructType([StructField(f.name, StringType()) if f.name in _PARTS else f for f in found.schema])
    return found if texts == found.schema else spark.read.schema(texts).parquet(path)


def fetch(rows: DataFrame) -> dict[str, list]:
    """Columns of a bounded result, by name, moved as Arrow batches."""
    return rows.toArrow().to_pydict()


def _folder(spark: SparkSession, path: str, name: str, month: str) -> str:
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"{path.rstrip('/')}/feature_name={escaped(name)}/month={escaped(month)}"


def replace_range(
    spark: SparkSession, path: str, rows: DataFrame, symbol: str, start: datetime, end: datetime, names: list[str] | None = None,
    finite_only: bool = True, extra: dict[str, str] | None = None,
) -> None:
    """Rows of a symbol in [start, end), with these names or with any, give way to ``rows``.

    Only folders (name and month) that the range touches are rewritten, with all columns of the store; columns that
    ``rows`` lack are null. The new content of the folders is written beside the store first, together with their
    names, and only then takes their place: a replacement that was broken off is finished by ``finish`` or by the
    next one. Folders are replaced one by one, so a reader meanwhile may see old and new ones.
    """
    finish(spark, path)
    store = _stored(spark, path, merge=True)
    old = store.where(_months(start, end))
    if names is not None:
        old = old.where(F.col("feature_name").isin(names))
    fresh = rows.withColumns({k: F.lit(v) for k, v in (extra or {}).items()}) if extra else rows
    fresh = fresh.where("symbol is not null and exchange_ts is not null and feature_name is not null")
    if finite_only:
        fresh = fresh.where(is_finite(F.col("feature_value")))
    gone = (F.col("symbol") == symbol) & (F.col("exchange_ts") >= F.lit(start)) & (F.col("exchange_ts") < F.lit(end))
    beside = f"{path.rstrip('/')}__staged"
    delete(spark, beside)
    # New rows of other folders (beyond the range) are added to what these hold: a row for each such folder is sent around.
    extended = store.join(F.broadcast(_by_month(fresh).select(*_PARTS).distinct()), list(_PARTS), "left_semi")
    outside = extended.where(~_months(start, end) | (~F.col("feature_name").isin(names) if names is not None else F.lit(False)))
    content = old.where(~gone).unionByName(outside).drop("month").unionByName(fresh, allowMissingColumns=True)
    touched = old.select(*_PARTS).distinct().unionByName(_by_month(fresh).select(*_PARTS)).distinct()
    _by_month(content).write.option("compression", "zstd").partitionBy(*_PARTS).parquet(f"{beside}/rows")
    touched.coalesce(1).write.json(f"{beside}/touched")
    finish(spark, path)


def finish(spark: SparkSession, path: str) -> None:
    """Puts a staged replacement in place, if there is a whole one."""
    beside = f"{path.rstrip('/')}__staged"
    files, done = file_system(spark, f"{beside}/touched/_SUCCESS")
    if not files.exists(done):
        return
    rows, folders = _stored(spark, f"{beside}/rows", merge=True), spark.read.schema("feature_name string, month string").json(f"{beside}/touched")
    left = {tuple(r) for r in rows.select(*_PARTS).distinct().collect()}
    order = [c for c in rows.columns if c not in _PARTS]
    if left:
        _by_month(rows.drop("month")).select(*order, *_PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*_PARTS).parquet(path)
    for r in folders.collect():
        if tuple(r) not in left:
            delete(spark, folder := _folder(spark, path, *r))
            files, name = file_system(spark, folder.rpartition("/")[0])
            if files.exists(name) and not files.listStatus(name):
                files.delete(name, True)
    delete(spark, beside)
