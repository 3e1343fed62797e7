"""Reading booking tables, type repair, exports and staged intermediates."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text_to_number, to_number


#: How a CSV is written and read: a header, ``NA`` for missing, quotes doubled inside quotes,
#: line breaks and padding kept.
CSV = {
    "header": "true",
    "nullValue": "NA",
    "quote": '"',
    "escape": '"',
    "multiLine": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def load_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Booking table from Parquet, or from CSV with a header and ``NA`` for missing.

    A CSV needs a schema: inferring one would read the data twice.  ``None`` in the
    data is a category, so ``NA`` is the only null marker.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV source needs an explicit schema")
        return reader.options(**CSV).csv(path)
    return reader.format(fmt).load(path)


def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn the named columns into doubles; unreadable text and NaN become null."""

    def number(name: str):
        text = isinstance(df.schema[name].dataType, T.StringType)
        return text_to_number(F.col(name)) if text else to_number(F.col(name))

    return df.withColumns({c: number(c) for c in columns})


def export_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header row and ``NA`` for missing; one file per partition.  Text stands in quotes.

    A text that equals the null marker could not be told from a missing one, so it raises.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    clash = F.lit("the text 'NA' cannot be written: it stands for missing")
    guarded = df.withColumns(
        {c: F.when(F.col(c) == CSV["nullValue"], F.raise_error(clash)).otherwise(F.col(c)) for c in text}
    )
    options = {k: v for k, v in CSV.items() if k != "multiLine"}
    guarded.write.mode(mode).options(**options, escapeQuotes="true").csv(path)


def export_parquet(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()
) -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def columns_of(spark: SparkSession, path: str, fmt: str) -> list[tuple[str, str | None]]:
    """Names and types of the columns that a written table has; a CSV header has no types."""
    if fmt == "csv":
        return [(c, None) for c in spark.read.options(**CSV).csv(path).columns]
    return [(f.name, f.dataType.simpleString()) for f in spark.read.format(fmt).load(path).schema]


def reconcile(
    source: DataFrame,
    written: DataFrame,
    amount: str,
    found: Sequence[tuple[str, str | None]] | None = None,
) -> DataFrame:
    """One row: row counts and totals of both sides, same columns, same content, all equal.

    ``found`` is what :func:`columns_of` says of the files; without it the schema of ``written``
    counts.  Content is compared by sums over a hash of each row, in any order.
    """

    def totals(df: DataFrame, side: str) -> DataFrame:
        marked = [c for f in source.columns for c in (F.col(f), F.col(f).isNull())]
        row = F.xxhash64(*marked) if set(source.columns) <= set(df.columns) else F.lit(None).cast("long")
        number = F.col(amount) if amount in df.columns else F.lit(None).cast("double")
        return df.select(number.alias("a"), row.alias("h")).agg(
            F.lit(side).alias("side"),
            F.count(F.lit(1)).alias("n"),
            F.round(F.sum("a"), 2).alias("total"),
            F.concat_ws(
                ":", F.bit_xor("h"), F.sum(F.shiftright("h", 24)), F.sum(F.col("h").bitwiseAND(0xFFFFFF))
            ).alias("content"),
        )

    def pick(side: str, column: str):
        return F.max(F.when(F.col("side") == side, F.col(column)))

    wanted = [(f.name, f.dataType.simpleString()) for f in source.schema]
    have = found if found is not None else [(f.name, f.dataType.simpleString()) for f in written.schema]
    same = [n for n, _ in wanted] == [n for n, _ in have] and all(
        b is None or a == b for (_, a), (_, b) in zip(wanted, have)
    )
    both = (
        totals(source, "source")
        .unionByName(totals(written, "written"))
        .agg(
            *[
                pick(side, column).alias(f"{name}_{side}")
                for name, column in (("rows", "n"), ("total", "total"), ("content", "content"))
                for side in ("source", "written")
            ]
        )
    )
    content = F.lit(same) & F.col("content_source").eqNullSafe(F.col("content_written"))
    return both.withColumns(
        {
            "same_columns": F.lit(same),
            "same_content": content,
            "complete": (F.col("rows_source") == F.col("rows_written"))
            & F.col("total_source").eqNullSafe(F.col("total_written"))
            & content,
        }
    ).drop("content_source", "content_written")


def work_folder(spark: SparkSession) -> str:
    """A new folder for one run's intermediate tables.

    Lies in the shared folder that the session names in ``spark.checkpoint.dir`` and goes when
    the session ends.  Only a local session may do without the setting; it gets a temporary
    folder that is removed when the process ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="valuelab-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    folder = f"{shared.rstrip('/')}/valuelab-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def staged(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    For a table several passes read: each pass then scans only its columns, no pass
    repeats the joins before it, and a lost executor costs a re-read, not a re-run.
    """
    path = folder or work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
