"""Sources (S1-S5): readings, vibration samples, alert log, dashboard sections.

Readers take an explicit schema (no inference pass over 100 TB), accept the
vendor's header names through an alias map, and turn NaN into null so that
comparisons behave like missing values, not like +inf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as SC
from ..operators import lookups as L
from ..session import cut_lineage


def number_rows(df: DataFrame, name: str = "reading_id") -> DataFrame:
    """Adds each row's 0-based number in its files' order (files by path, rows as they stand).

    ``df`` must be read directly from files. A row's number is the rows of the files and
    splits before its own, plus its place in its split, so it is the same on a retry and
    however the files are cut into splits. One narrow pass counts the splits.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_mid"))
    splits = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_rows"))  # one row a file
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = (splits.join(files.select("_file", before.alias("_before")), "_file")
               .select("_file", "_block", (inside + F.col("_before") - F.col("_first")).alias("_shift")))
    return (L.dimension_join(tagged, offsets, ["_file", "_block"])
            .withColumn(name, F.col("_shift") + F.col("_mid")).drop("_file", "_block", "_mid", "_shift"))


def normalise_readings(df: DataFrame) -> DataFrame:
    """Rename vendor headers, NaN -> null on doubles."""
    renames = {c: SC.READING_ALIASES[c] for c in df.columns if c in SC.READING_ALIASES}
    if renames:
        df = df.withColumnsRenamed(renames)
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if doubles:
        df = df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
    return df


def read_readings(spark: SparkSession, path: str, fmt: str = "parquet",
                  schema: T.StructType | None = None, timestamp_format: str | None = None) -> DataFrame:
    """Readings table. Missing paths fail fast with a clear message.

    CSV needs ``schema`` (vendor or our names); Parquet carries its own. Files without
    ``reading_id`` get the row number (``number_rows``).
    Row order is not imposed here: an operator that needs an order asks for it.
    """
    _require(spark, path)
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "csv":
        reader = spark.read.option("header", True).option("mode", "FAILFAST")
        if timestamp_format:
            reader = reader.option("timestampNTZFormat", timestamp_format)
        if schema is None:
            raise ValueError("CSV readings need an explicit schema")
        df = reader.schema(schema).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt}")
    if "reading_id" not in df.columns:
        df = number_rows(df)
    df = normalise_readings(df)
    if "event_time" in df.columns and not isinstance(df.schema["event_time"].dataType,
                                                     (T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn("event_time", F.to_timestamp_ntz("event_time"))
    return df


def vibration_renames(columns: list[str]) -> dict[str, str]:
    """S3: header -> canonical name (x, y, z, Time, Temp, Hum), case/space-insensitive."""
    out = {}
    for c in columns:
        key = str(c).strip().lower()
        if key in SC.VIBRATION_ALIASES:
            out[c] = SC.VIBRATION_ALIASES[key]
    return out


def normalise_vibration(df: DataFrame) -> DataFrame:
    """S3: rename axis/extra headers; fail when an axis is missing."""
    df = df.withColumnsRenamed(vibration_renames(df.columns))
    missing = {"x", "y", "z"} - set(df.columns)
    if missing:
        raise ValueError(f"vibration samples miss axis columns {sorted(missing)}; found {df.columns}")
    return df


#: Types of the canonical sample columns; other columns of sample files are text.
SAMPLE_TYPES = {"x": "double", "y": "double", "z": "double", "Time": "string", "Temp": "double", "Hum": "double"}


def header_catalogue(lines: DataFrame, sep: str = ",") -> DataFrame:
    """One row a file (``_file``, ``_header``, ``_names``): its first line that isn't blank, and the columns it names.

    ``lines`` are text rows with ``value``, ``_file`` and ``_block``. Only a file's first split
    counts, each task passes on one row a file, and a name is canonical where it is known.
    """
    first = (lines.withColumn("_line", F.monotonically_increasing_id()).where((F.col("_block") == 0) & (F.trim("value") != ""))
             .groupBy("_file").agg(F.min_by("value", "_line").alias("_header")))
    known = F.create_map(*[F.lit(v) for kv in SC.VIBRATION_ALIASES.items() for v in kv])

    def canonical(cell):
        plain = F.trim(F.regexp_replace(cell, "[\ufeff\"]", ""))
        return F.coalesce(F.try_element_at(known, F.lower(plain)), plain)
    return first.withColumn("_names", F.transform(F.split("_header", f"\\Q{sep}\\E", -1), canonical))


def read_sample_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """CSV samples of a folder whose files may spell and order their headers differently.

    A catalogue of the files' headers is made in one pass; a second one takes every line's
    cells by the names of its own file, so the plan is the same for one spelling or many and
    nothing is inferred. ``schema`` (any known spelling) sets types; else the canonical
    columns have ``SAMPLE_TYPES`` and others are text. A cell that is absent, empty or not of
    its type is null, a line equal to its file's header is one, blank lines don't count, and
    of two columns with one meaning the first counts. Lines hold no line breaks, names no separator.
    """
    text = (spark.read.option("recursiveFileLookup", "true").text(path)
            .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")))
    catalogue = cut_lineage(header_catalogue(text, sep))  # one row a file, read twice
    need = F.array(*[F.lit(c) for c in ("x", "y", "z")])
    bad = catalogue.where(F.size(F.array_except(need, "_names")) > 0).select("_file", "_names").limit(5).collect()
    if bad:
        raise ValueError(f"vibration samples miss axis columns in {[(r[0], r[1]) for r in bad]}")
    width, names = catalogue.agg(F.max(F.size("_names")), F.array_sort(F.flatten(F.collect_set("_names")))).first()
    if not names:
        raise ValueError(f"no samples with a header in {path}")
    types = dict(SAMPLE_TYPES)
    if schema is not None:
        renames = vibration_renames(schema.names)
        types.update({renames.get(f.name, f.name): f.dataType.simpleString() for f in schema.fields})
    columns = [c for c in SAMPLE_TYPES if c in names] + [c for c in dict.fromkeys(names) if c and c not in SAMPLE_TYPES]
    cells = ", ".join(f"_{i} string" for i in range(width))
    rows = (L.dimension_join(text.where(F.trim("value") != ""), catalogue, ["_file"]).where(F.col("value") != F.col("_header"))
            .withColumn("_row", F.from_csv("value", F.lit(cells), {"sep": sep}))
            .withColumn("_cells", F.array(*[F.col(f"_row._{i}") for i in range(width)])))

    def cell(name: str) -> Column:
        place = F.array_position("_names", F.lit(name))
        return F.when(place > 0, F.get("_cells", (place - 1).cast("int"))).try_cast(types.get(name, "string")).alias(name)
    return rows.select(*[cell(c) for c in columns], F.col("_file").alias("source_file"))


def read_vibration(spark: SparkSession, path: str, fmt: str = "parquet",
                   schema: T.StructType | None = None) -> DataFrame:
    """Accelerometer samples from one file or a folder of files, which may spell their headers differently.

    ``source_file`` records which file each sample came from (many-file reads).
    """
    _require(spark, path)
    if fmt == "csv":
        return read_sample_csv(spark, path, schema)
    if fmt != "parquet":
        raise ValueError(f"unsupported format {fmt}")
    # Any folder layout of sample files; the union of their columns, spellings of one column put together.
    df = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path)
    spellings: dict[str, list[str]] = {}
    renames = vibration_renames(df.columns)
    for c in df.columns:
        spellings.setdefault(renames.get(c, c), []).append(c)
    merged = df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(name) for name, cs in spellings.items()],
                       F.col("_metadata.file_path").alias("source_file"))
    return normalise_vibration(merged)


def read_alert_log(spark: SparkSession, path: str, schema: T.StructType,
                   fmt: str = "csv") -> DataFrame:
    """The exported alert log; an empty table with the schema when absent."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if fmt == "csv":
        return spark.read.option("header", True).schema(schema).csv(path)
    return spark.read.schema(schema).parquet(path)


def read_sections(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A dashboard section written as JSON lines (one object per row)."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def _require(spark: SparkSession, path: str) -> None:
    if not _exists(spark, path):
        raise FileNotFoundError(f"input not found: {path}")


__all__ = ["read_readings", "read_vibration", "read_sample_csv", "header_catalogue", "read_alert_log", "read_sections",
           "normalise_readings", "normalise_vibration", "vibration_renames"]
