"""Reading and writing corpora, models and alignments. Everything is Parquet, JSON or text: nothing is pickled."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment, periods, ppmi
from ..operators.shift import Model
from .staging import exists, listed

RECORD = "date string, doc_name string, title string, president string, transcript string, lemmatized string"
TABLES = ("vocabulary", "ppmi", "embeddings", "params")
# slices are names, not numbers or dates
KINDS = {
    "vocabulary": "word string, rank int, n long, total long, slice string",
    "ppmi": "i int, j int, w1 string, w2 string, n long, ppmi double, slice string",
    "embeddings": "word string, rank int, vector array<double>, slice string",
}
SKIPPED = "stage string, reason string, slice string"


def read_records(spark: SparkSession, path: str, schema: str = RECORD, lines: bool = False) -> DataFrame:
    """Records from JSON files that hold one array or object each, or, as :func:`write_records` leaves them, one a line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_periods(records: DataFrame, path: str, width: int = periods.WIDTH) -> None:
    """Texts of records (date, transcript, lemmatized) by period and variant, in order of date within each file."""
    rows = periods.with_period(records, "date", width)
    variants = F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("value")) for v in ("lemmatized", "transcript")])
    rows = rows.select("period", "date", F.inline(variants)).where("value is not null")
    # by date as well: a large period is several files, each with a stretch of dates
    ordered = rows.repartitionByRange("period", "variant", "date").sortWithinPartitions("period", "variant", "date")
    ordered.select("period", "variant", "value").write.mode("overwrite").partitionBy("period", "variant").text(path)


def read_periods(spark: SparkSession, path: str, variant: str = "lemmatized") -> DataFrame:
    """Corpus (slice, doc_id, line_no, line) of one variant, read by partition."""
    rows = spark.read.text(path).where(F.col("variant") == variant).where("trim(value) != ''")
    return rows.select(F.col("period").alias("slice"), F.xxhash64("value").alias("doc_id"), F.lit(0).alias("line_no"), F.lower(F.trim("value")).alias("line"))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def save_model(model: Model, path: str) -> None:
    """Writes all tables of a model to folders of a new version, and last a manifest of it: until that is there the old model is read, whole."""
    _write(model, path, None)


def refresh_slices(model: Model, path: str) -> None:
    """Replaces the slices of ``model`` in the saved one and leaves the files of all others where they are; with the same parameters, else ValueError.

    A slice that the model has skipped takes its old tables' place as well. The manifest is written last.
    """
    spark = model.vocabulary.sparkSession
    old = load_model(spark, path)
    if old.params != model.params:
        raise ValueError("the saved model was trained with different parameters")
    _write(model, path, _manifest(spark, path))


def _manifest(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    """(table, slice, folder) of the newest version; slices are few. FileNotFoundError without one."""
    found = sorted(n for n in listed(spark, f"{path}/manifest") if exists(spark, f"{path}/manifest/{n}/_SUCCESS"))
    if not found:
        raise FileNotFoundError(f"{path}/manifest")
    return [(r.name, r.slice, r.folder) for r in spark.read.schema("name string, slice string, folder string").parquet(f"{path}/manifest/{found[-1]}").collect()]


def _write(model: Model, path: str, before: list[tuple[str, str, str]] | None) -> None:
    spark = model.vocabulary.sparkSession
    numbers = [int(n) for n in listed(spark, f"{path}/manifest")] + [int(n) for n in listed(spark, f"{path}/data")]
    version = f"{max(numbers, default=0) + 1:08d}"
    mine = [r.slice for r in model.vocabulary.select("slice").union(model.skipped.select("slice")).distinct().collect()]
    rows = [r for r in before or [] if r[1] not in mine and r[0] != "params"]
    tables = {"vocabulary": model.vocabulary, "ppmi": model.entries, "embeddings": model.embeddings, "skipped": model.skipped}
    for name, df in tables.items():
        at = f"data/{version}/{name}"
        df.write.mode("overwrite").partitionBy("slice").parquet(f"{path}/{at}")
        rows += [(name, s, at) for s in mine]
    at = f"data/{version}/params"
    spark.createDataFrame([asdict(model.params)]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{at}")
    rows.append(("params", "", at))
    spark.createDataFrame(rows, "name string, slice string, folder string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")


def load_model(spark: SparkSession, path: str) -> Model:
    """ValueError where nothing is, FileNotFoundError where a table is missing. Slices are partitions: a filter on them prunes."""
    if not _there(spark, path):
        raise ValueError(f"{path} is not a model")
    return _read(spark, [path])


def _read(spark: SparkSession, paths: list[str]) -> Model:
    manifests = {path: _manifest(spark, path) for path in paths}
    for path, rows in manifests.items():
        for folder in sorted({r[2] for r in rows}):
            if not _there(spark, f"{path}/{folder}"):
                raise FileNotFoundError(f"{path}/{folder}")

    def every(name: str, kind: str) -> DataFrame:
        """A folder has the slices of a version: those that the manifest still takes from it."""
        parts = []
        for path, rows in manifests.items():
            by_folder: dict[str, list[str]] = {}
            for _, s, folder in (r for r in rows if r[0] == name):
                by_folder.setdefault(folder, []).append(s)
            parts += [spark.read.schema(kind).parquet(f"{path}/{folder}").where(F.col("slice").isin(slices)) for folder, slices in by_folder.items()]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], kind)

    v, m, e = (every(name, KINDS[name]) for name in TABLES[:3])
    found = [ppmi.Params(**spark.read.parquet(f"{path}/{next(r[2] for r in rows if r[0] == 'params')}").first().asDict()) for path, rows in manifests.items()]
    if len(set(found)) > 1:
        raise ValueError("the models were trained with different parameters")
    return Model(found[0], v, m, e, every("skipped", SKIPPED).select("slice", "stage", "reason"))


def period_models(spark: SparkSession, base: str) -> list[str]:
    """Names of the models in folders of ``base``, in order of their first year as a number."""
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory()]
    names = [n for n in names if n.split("-")[0].isdigit() and any(exists(spark, f"{base}/{n}/manifest/{v}/_SUCCESS") for v in listed(spark, f"{base}/{n}/manifest"))]
    return sorted(names, key=lambda n: (int(n.split("-")[0]), n))


def load_models(spark: SparkSession, base: str) -> Model:
    """All models in folders of ``base`` as one, whose slices are told apart by their column. ValueError if there are none."""
    names = period_models(spark, base)
    if not names:
        raise ValueError(f"no models in {base}")
    return _read(spark, [f"{base}/{n}" for n in names])


def slices_of(model: Model) -> DataFrame:
    """Slices of a model in order of their first year."""
    return model.vocabulary.select("slice").distinct().withColumn("year", periods.period_start("slice")).orderBy("year", "slice")


def save_alignment(fitted: DataFrame, anchors: DataFrame, path: str, low: int | None = alignment.MIN_RANK, high: int | None = alignment.MAX_RANK) -> None:
    """Rotations and anchors of all pairs, and the rank window."""
    fitted.write.mode("overwrite").parquet(f"{path}/rotations")
    anchors.write.mode("overwrite").parquet(f"{path}/anchors")
    fitted.sparkSession.createDataFrame([(low, high)], "low int, high int").coalesce(1).write.mode("overwrite").parquet(f"{path}/window")


def _alignment_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    if not _there(spark, f"{path}/{name}"):
        raise FileNotFoundError(f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def load_alignment(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rotations and anchors. FileNotFoundError where a table is missing."""
    return _alignment_table(spark, path, "rotations"), _alignment_table(spark, path, "anchors")


def alignment_window(spark: SparkSession, path: str) -> tuple[int | None, int | None]:
    """The rank window that a saved alignment's anchors are from."""
    row = _alignment_table(spark, path, "window").first()
    return row.low, row.high
