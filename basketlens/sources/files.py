"""Reading table sets and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.scalars import finite_or_null
from basketlens.sources.tables import SCHEMAS, RetailTables


def missing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths that do not exist, on whatever file system they name."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def exists(path: str) -> bool:
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(conf).exists(target)

    return [p for p in paths if not exists(p)]


# nullable whole numbers; CSV writers often print them as "3.0"
_PRINTED_AS_DOUBLE = {"events": ["product_id", "qty", "cart_size"]}


def load_tables(
    spark: SparkSession, folder: str, fmt: str = "csv", *, line_breaks_in_texts: bool = False, **lookups: DataFrame
) -> RetailTables:
    """Load ``<folder>/<table>.<fmt>``, a file or a folder of files, for all seven tables.

    The schemas are declared, never inferred.  A CSV value that does not fit its
    column fails the read.  Every missing table is named in one error.

    Large files are split.  Review texts that hold line breaks fail the read unless
    ``line_breaks_in_texts`` is set; then one task reads each review file.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    names = {table: f"{table}.{fmt}" for table in SCHEMAS}
    absent = missing_paths(spark, [f"{folder}/{name}" for name in names.values()])
    if absent:
        listed = ", ".join(path.rsplit("/", 1)[-1] for path in absent)
        raise FileNotFoundError(f"Missing required files in {folder}: {listed}")

    def read(table: str) -> DataFrame:
        path = f"{folder}/{names[table]}"
        if fmt == "parquet":
            return spark.read.schema(SCHEMAS[table]).parquet(path)
        loose = _PRINTED_AS_DOUBLE.get(table, [])
        schema = T.StructType(
            [T.StructField(f.name, T.DoubleType()) if f.name in loose else f for f in SCHEMAS[table]]
        )
        rows = (
            spark.read.schema(schema)
            .option("header", True)
            .option("mode", "FAILFAST")
            .option("enforceSchema", False)
            .option("multiLine", table == "reviews" and line_breaks_in_texts)
            .option("escape", '"')
            .csv(path)
        )
        return rows.withColumns({c: F.col(c).cast("int") for c in loose}) if loose else rows

    return RetailTables(**{table: read(table) for table in SCHEMAS}, **lookups)


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite values as null, so that rows are valid JSON records."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            finite_or_null(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, floats)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def write_records(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per row; null fields are kept."""
    json_safe(df).write.mode(mode).option("ignoreNullFields", False).json(path)
