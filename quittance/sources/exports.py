"""Lines of text for cold storage, and their way back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(df: DataFrame) -> DataFrame:
    """(value) a JSON object a row, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def from_json_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def tab_lines(df: DataFrame) -> DataFrame:
    r"""(value) a row of fields between tabs: \N is null; backslash, tab, line feed and carriage return are escaped."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return df.select(F.concat_ws("\t", *(F.coalesce(text(c), F.lit("\\N")) for c in df.columns)).alias("value"))


def from_tab_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    fields = F.split("value", "\t")

    def read(i: int):
        c = F.get(fields, F.lit(i))
        # a mark stands for escaped backslashes while the others are undone
        c = F.when(c != "\\N", F.replace(c, F.lit("\\\\"), F.lit("\x00")))
        for escape, char in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
            c = F.replace(c, F.lit(escape), F.lit(char))
        return c

    return lines.select(*(read(i).cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)))


def write_batch(df: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Write df by batch; batches that it holds are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path)
