"""Status and dashboard tables: totals, sweeps with their portals, the filter stack, option lists, wide pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.catalog import Catalog

SCHEMA_VERSION = 1
# The former name of a category and its present one.
RENAMED_CATEGORIES = {"prpgi_prppg": "prppg_inovacao"}
RUNNING = "rodando"


def totals(c: Catalog) -> DataFrame:
    """A2: the number of rows of each catalogue table, as (name, n)."""
    tables = {"instituicoes": c.institutions, "portais": c.portals, "editais": c.calls, "documentos": c.documents}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every


def count_where(rows: DataFrame, **equal) -> DataFrame:
    """A3: the number of rows, with a filter for each value that is given."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows.agg(F.count("*").alias("n"))


def sweeps(rows: DataFrame, c: Catalog, status: str | None = None) -> DataFrame:
    """Sweeps with category and institution of their portal, in order of creation."""
    portals = c.portals.select(F.col("id").alias("portal_id"), "institution_id", "category")
    inst = c.institutions.select(F.col("id").alias("institution_id"), F.col("code").alias("institution"))
    found = rows.join(portals, "portal_id").join(inst, "institution_id").drop("institution_id")
    return (found if status is None else found.where(F.col("status") == status)).orderBy("id")


def synthetic_portals(found: DataFrame) -> DataFrame:
    """For each row of sweeps() a portal of its own whose only seed is the sweep's URL."""
    return found.select(F.col("id").alias("sweep_id"), "institution", "category", "url", F.array("url").alias("seeds"))


def pipeline_flags(status: DataFrame) -> DataFrame:
    """How many candidates of pipeline_status() have passed each stage."""
    passed = {x: F.col(x) == "✔" for x in ("baixado", "textuado", "datado", "classificado")} | {"eixo3": F.col("eixo3") != "–"}
    return status.agg(*[F.count_if(cond).alias(x) for x, cond in passed.items()])


def running_recently(status: Column, started: Column, now: Column, hours: int = 2) -> Column:
    """a running sweep that began less than so many hours ago is alive; one without a start isn't."""
    return F.coalesce((status == RUNNING) & (now - started < F.expr(f"interval {hours} hours")), F.lit(False))


def text_is_current(extracted_at: Column, text_path: Column, text_found: Column, hash_: Column, hash_found: Column) -> Column:
    """a text counts if its provenance is known, its file is there and the document's bytes are those of the hash."""
    return F.coalesce(extracted_at.isNotNull() & text_path.isNotNull() & text_found & (hash_ == hash_found), F.lit(False))


def selected(rows: DataFrame, institutions: Sequence[str], categories: Sequence[str], years: tuple[int, int], kinds: Sequence[str] | None = None, axis3: Sequence[str] | None = None) -> DataFrame:
    """the filter stack over rows that aren't excluded; a null in a filtered column drops the row."""
    clause = ~F.col("excluded") & F.col("institution").isin(*institutions) & F.col("ano").between(*years) & F.col("category").isin(*categories)
    if kinds is not None:
        clause &= F.col("kind").isin(*kinds)
    if axis3 is not None:
        clause &= F.col("axis3").isin(*axis3)
    return rows.where(clause)


def excluded_selected(rows: DataFrame, institutions: Sequence[str], categories: Sequence[str]) -> DataFrame:
    """excluded rows under the filters of institution and category only."""
    return rows.where(F.col("excluded") & F.col("institution").isin(*institutions) & F.col("category").isin(*categories))


def options(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, in order."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def coded_calls(coded: DataFrame, batch_id) -> DataFrame:
    """The calls that have fields in a batch."""
    return coded.where(F.col("batch_id") == batch_id).select("call_id").distinct()


def coding_summary(coded: DataFrame, batches: DataFrame) -> DataFrame:
    """Coded calls, batches and verified fields, as one row."""
    fields = coded.agg(F.countDistinct("call_id").alias("n_calls"), F.count_if(F.col("verification") == "ok").alias("n_verified"))
    return fields.crossJoin(batches.agg(F.count("*").alias("n_batches")))  # one row each


def shared_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that both have."""
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def wide(rows: DataFrame, row: str, column: str, value: str, values: list) -> DataFrame:
    """One row a key, a column for each given value; keys are unique, missing cells are 0."""
    return rows.groupBy(row).pivot(column, values).agg(F.first(value)).na.fill(0)


def present_category(category: Column) -> Column:
    """P6."""
    for old, new in RENAMED_CATEGORIES.items():
        category = F.when(category == old, new).otherwise(category)
    return category


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict | None = None) -> DataFrame:
    """A statement over tables, written {name}, with :name parameter markers; values never become part of its text,
    and nothing stays behind in the session."""
    return spark.sql(sql, args=args or {}, **tables)


def top_pairs(pairs: DataFrame, least: int = 2, n: int = 20) -> DataFrame:
    """The most frequent unordered pairs; ties go by the words."""
    return pairs.where((F.col("t1") < F.col("t2")) & (F.col("n") >= least)).orderBy(F.desc("n"), "t1", "t2").limit(n)
