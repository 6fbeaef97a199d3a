"""Readers for historical quotation lines.

The schema is explicit (never inferred). Two null rules are applied once at
ingest so that every later comparison follows SQL semantics:

* NaN in a double column becomes NULL (Spark orders NaN above every number,
  pandas treats it as missing);
* CSV cells holding any of the pandas default NA tokens become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import CSV_NA_TOKENS

QUOTE_FIELDS = [
    ("quote_id", T.LongType()),
    ("line_seq", T.LongType()),
    ("product", T.StringType()),
    ("kw", T.DoubleType()),
    ("qty", T.IntegerType()),
    ("unit_price", T.DoubleType()),
    ("gross_margin_rate", T.DoubleType()),
    ("energy_grant_amount", T.DoubleType()),
    ("estimated_cost", T.DoubleType()),
    ("grant_ratio_to_subtotal", T.DoubleType()),
    ("competitor_count_available", T.IntegerType()),
    ("avg_competitor_price", T.DoubleType()),
    ("min_competitor_price", T.DoubleType()),
    ("price_gap_avg_competitor_pct", T.DoubleType()),
    ("price_gap_min_competitor_pct", T.DoubleType()),
    ("competitor_a", T.DoubleType()),
    ("competitor_b", T.DoubleType()),
    ("competitor_c", T.DoubleType()),
    ("convert_to_order", T.IntegerType()),
    ("estimated_gross_profit", T.DoubleType()),
    ("is_highest_price", T.IntegerType()),
]
QUOTE_COLUMNS = [name for name, _ in QUOTE_FIELDS]
QUOTE_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in QUOTE_FIELDS])
OPTIONAL_COLUMNS = {"is_highest_price", "line_seq"}


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def conform(df: DataFrame) -> DataFrame:
    """Cast to the quote schema, NaN -> NULL; keep optional columns only if present.

    ``line_seq`` stands in for file order; a reader adds it to a source without
    one (``with_file_order``), other tables get the scan's increasing id.
    """
    cols = []
    for name, dtype in QUOTE_FIELDS:
        if name not in df.columns:
            if name == "line_seq":
                cols.append(F.monotonically_increasing_id().alias(name))
            continue
        c = F.col(name).cast(dtype)
        if isinstance(dtype, T.DoubleType):
            c = nan_to_null(c)
        cols.append(c.alias(name))
    return df.select(*cols)


def with_file_order(df: DataFrame) -> DataFrame:
    """Add ``line_seq`` to freshly read files that lack it: the rank of a row by
    (file path, block start, place in the block), as a struct folded into one number.

    Spark packs splits by size, so the scan's own id follows file order only
    inside a split.  Blocks are ranked from their few (path, start) pairs; the
    rank goes into the high bits, the place in the block into the low 40.
    """
    if "line_seq" in df.columns:
        return df
    block = ["_path", "_start"]
    marked = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_id"))
    # one row per file block, its first id and how it ranks: as many as the scan has splits
    first = marked.groupBy(*block).agg(F.min("_id").alias("_first"))
    ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(*block)).cast("long"))
    at = F.shiftleft("_rank", 40) + (F.col("_id") - F.col("_first"))
    return marked.join(F.broadcast(ranked), block).withColumn("line_seq", at).drop(*block, "_id", "_first", "_rank")


def read_quotes_parquet(spark: SparkSession, path: str) -> DataFrame:
    return conform(with_file_order(spark.read.parquet(path)))


def read_quotes_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every cell is read as text, NA tokens -> NULL, then try_cast."""
    raw = with_file_order(spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path))
    return conform(_typed(_without_na(raw)))


def _without_na(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells that hold an NA token become NULL; columns in ``keep`` stay as they are."""
    cols = [F.col(name) for name in keep]
    for name in raw.columns:
        if name in keep:
            continue
        s = F.trim(F.col(name).cast("string"))
        cols.append(F.when(~s.isin(*CSV_NA_TOKENS), F.col(name)).alias(name))   # a hash lookup
    return raw.select(*cols)


def _cast_cell(name: str, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return F.col(name)
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        # a whole number is read exactly; pandas would read "3.0" into an int column as 3
        return F.coalesce(F.col(name).try_cast(dtype), F.col(name).try_cast("double").try_cast(dtype))
    return F.col(name).try_cast(dtype)


def _typed(cells: DataFrame) -> DataFrame:
    return cells.select(*[_cast_cell(n, t).alias(n) for n, t in QUOTE_FIELDS if n in cells.columns])


NOT_A_NUMBER, NOT_WHOLE, OUT_OF_RANGE = "not a number", "not a whole number", "out of range"
CELL_COUNT = "wrong number of cells"
REJECTED_COLUMNS = ["file", "quote_id", "line_seq", "column", "value", "reason"]


def _cell_fault(name: str, dtype: T.DataType) -> Column:
    """Why a cell can't be taken as it stands; NULL for a good or missing one."""
    number = F.col(name).try_cast("double")
    fault = F.when(F.col(name).isNotNull() & number.isNull(), F.lit(NOT_A_NUMBER))
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        fault = (fault.when(number.isNotNull() & _cast_cell(name, dtype).isNull(), F.lit(OUT_OF_RANGE))
                 .when(number != F.floor(number), F.lit(NOT_WHOLE)))
    return fault


def read_quotes_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1 with a second table of what was wrong: (quotes, rejected).

    ``quotes`` is what ``read_quotes_csv`` gives, but without the rows that have
    another number of cells than the header (their cells can't be told apart).
    ``rejected`` has one row per fault, each with its file, the row's quote as
    text and ``line_seq``: a cell that isn't a number (NULL in ``quotes``), out of its type's range
    (NULL) or a fraction in a whole-number column (cut), or, with NULL as
    column, a whole row of the wrong length.  Missing cells and columns outside
    the schema are no faults.  All files must have the same header (an error
    otherwise).  Both tables are lazy and row-local.
    """
    header = spark.read.option("header", True).csv(path).columns
    corrupt = "_corrupt_record"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, corrupt]])
    # a pruned CSV scan doesn't count the cells of a row
    rows = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("columnPruning", False).option("enforceSchema", False).option("columnNameOfCorruptRecord", corrupt).csv(path))
    placed = with_file_order(rows.withColumn("_file", F.col("_metadata.file_path")))
    cells = _without_na(placed, ("_file", corrupt))
    good = cells.where(F.col(corrupt).isNull())
    return conform(_typed(good)), _rejected(cells, corrupt)


def _rejected(cells: DataFrame, corrupt: str) -> DataFrame:
    def fault(column: Column, value: Column, reason: Column) -> Column:
        return F.when(reason.isNotNull(), F.struct(column.cast("string").alias("column"), value.cast("string").alias("value"),
                                                   reason.alias("reason")))

    own = [fault(F.lit(n), F.col(n), F.when(F.col(corrupt).isNull(), _cell_fault(n, t))) for n, t in QUOTE_FIELDS
           if n in cells.columns and not isinstance(t, T.StringType)]
    length = fault(F.lit(None), F.col(corrupt), F.when(F.col(corrupt).isNotNull(), F.lit(CELL_COUNT)))
    quote = F.col("quote_id") if "quote_id" in cells.columns else F.lit(None).cast("string")
    at = cells.select(F.col("_file").alias("file"), quote.alias("quote_id"),
                      _cast_cell("line_seq", T.LongType()).alias("line_seq"),
                      F.explode(F.array_compact(F.array(*own, length))).alias("_f"))
    return at.select("file", "quote_id", "line_seq", "_f.*").select(*REJECTED_COLUMNS)


def read_quotes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Load historical quotation lines from parquet or CSV."""
    if fmt == "parquet":
        return read_quotes_parquet(spark, path)
    if fmt == "csv":
        return read_quotes_csv(spark, path)
    raise ValueError(f"unsupported format: {fmt}")
