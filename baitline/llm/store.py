"""Tables kept in the shared folder, and bounded samples for fitting."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from baitline.plans.session import scratch_path

#: Steps of a sampling threshold.
_STEPS = 1 << 30


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def row_keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a private key of each row, and the key's name.

    Keys order rows by id, rows without one last, so that an operator that runs
    on the key decides as on the id, but for each row by itself.  The rest of a
    key is the row's place in its file; a table that is not read from files is
    stored first.
    """
    name = fresh("_row", docs.columns)
    try:
        place = docs.metadataColumn("_metadata")
        keyed = docs.withColumn(name, _key(id_col, place["file_path"], place["row_index"]))
    except AnalysisException:
        keyed = stored(docs.withColumn(name, _key(id_col, F.lit(""), F.monotonically_increasing_id())), "rows")
    return keyed, name


def _key(id_col: str, file: Column, row: Column) -> Column:
    known = F.col(id_col)
    return F.struct(known.isNull().alias("unknown"), known.alias("id"), file.alias("file"), row.alias("row"))


def fold(id_col: str, folds: int, held: int) -> Column:
    """Whether a row's id falls into the held-out fold; a null id never does."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False))


def bounded_sample(df: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the id.

    The share of a label follows from its count, so the sample's size does not
    grow with the table and no row is moved to draw it.  Rows without an id or
    a label are not drawn.
    """
    known = df.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    counts = known.groupBy(label_col).count().collect()
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")), F.lit(_STEPS))
    chosen = F.lit(False)
    for label, count in sorted((r[0], r[1]) for r in counts):
        share = min(_STEPS, int(_STEPS * per_label / count) + 1)
        chosen = chosen | ((F.col(label_col) == F.lit(label)) & (draw < share))
    return known.where(chosen)
