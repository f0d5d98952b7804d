"""Exact duplicates by distributed MSD radix partitioning (operator 11).

Texts are read as byte strings that begin with their length, so no text is a prefix of another and all
texts of a cell end at the same level. A level splits every open cell by the next bytes: the first digit
is the length and 32 bytes, later digits are 128 times as wide as the one before, so that a text of any
length needs a few levels. A cell of one row is closed at once; a cell whose texts have ended is a group
of equal texts. Cells are compared byte by byte, no digest decides equality (``text_sha256`` is only
reported).

Each level is one group-by of digits, summed before the shuffle, so a text that a third of all rows hold
is one row a task there, and a join of the open rows with the written cells, whose hot partitions Spark
splits (adaptive skew join): nothing in that stage needs the rows of a cell together. Cells and levels are
written to the shared checkpoint folder; only open rows carry bytes on, and only those not read yet.

Defined cases: null counts as the empty text; all empty texts are one group; of rows that share id and
text exactly one stays (the other columns never decide); a row without id counts and loses against any id;
an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dictaudit.session import materialize

WIDTH, GROWTH = 32, 128  # bytes of the first digit; how much wider each further digit is


def _part(col: str, start: int, width: int | None = None) -> Column:
    return F.substring(col, start, (1 << 31) - 1 if width is None else width)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 growth: int = GROWTH) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("rest"))
    rows = rows.withColumn("size", F.octet_length("rest"))
    cells = materialize(rows.groupBy("size", _part("rest", 1, width).alias("digit")).agg(F.count("*").alias("n")).where("n > 1")
                        .withColumnRenamed("size", "cell_size"), "radix-cells")
    # a broadcast of few cells would give way to a shuffle as the table grows: one plan at every size
    dealt = rows.join(cells.hint("merge"), (F.col("size") == F.col("cell_size")) & (_part("rest", 1, width) == F.col("digit")), "left")
    level = materialize(dealt.select(
        "doc_id", F.sha2("rest", 256).alias("text_sha256"), "size", "digit",
        F.when(F.col("n").isNotNull(), _part("rest", width + 1)).alias("rest"), F.monotonically_increasing_id().alias("rid")),
        "radix")
    alone = level.where("digit is null").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    found, cell, read = [alone], ["size", "digit"], width
    rows = level.where("digit is not null")
    while (longest := rows.agg(F.max("size")).first()[0]) is not None:
        width *= growth
        by = [F.col(c) for c in cell]
        cells = materialize(rows.groupBy(*[c.alias(f"c{i}") for i, c in enumerate(by)], _part("rest", 1, width).alias("next")).agg(
            F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("top")), "radix-cells")
        same = _part("rest", 1, width) == F.col("next")
        for i, c in enumerate(by):
            same &= c == F.col(f"c{i}")
        read += width
        ended = (F.col("n") == 1) | (F.col("size") <= read)
        level = materialize(rows.join(cells.hint("merge"), same).select(
            "doc_id", "text_sha256", "size", "rid", "n", F.col("top.rid").alias("leader"), F.col("top.doc_id").alias("keep_id"),
            F.when(~ended, _part("rest", width + 1)).alias("rest")), "radix")
        found.append(level.where("rest is null").select(
            "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("leader")).alias("kept"), "text_sha256"))
        rows, cell = level.where("rest is not null").select("doc_id", "text_sha256", "size", "rid", "leader", "rest"), ["leader"]
        if longest <= read:
            break
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out
