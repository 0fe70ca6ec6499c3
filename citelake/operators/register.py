"""Sequential ids: the next number after the highest ever given; gaps are never filled."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequential_id(prefix: str, number: Column, width: int = 4) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit(prefix + "-"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def number_of(identifier: Column) -> Column:
    return F.regexp_extract(identifier, "-([0-9]+)$", 1).try_cast("bigint")


#: Rows looked at to cut the order into ranges.
SAMPLE = 10_000


def numbered(rows: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """rows with _n, their place in order from 1.

    The order is cut into ranges at some values of a sample; rows are numbered within each range, and a range starts
    after the rows of all ranges before it, so no task holds all rows. The sample is by hash: a rerun cuts alike.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = sorted(rows.select(*order).dropna().orderBy(F.xxhash64(*order)).limit(SAMPLE).distinct().collect())
    cuts = [seen[len(seen) * i // ranges] for i in range(1, ranges)] if len(seen) >= ranges else seen[1:]
    kinds = dict(rows.dtypes)
    points = [F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in order]) for r in dict.fromkeys(cuts)]
    mine = F.struct(*[F.col(c) for c in order])
    ranged = rows.withColumn("_range", F.size(F.filter(F.array(*points), lambda p: p <= mine)) if points else F.lit(0))
    before, total = {}, 0
    for r in sorted(ranged.groupBy("_range").count().collect()):
        before[r["_range"]], total = total, total + r["count"]
    offset = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])[F.col("_range").cast("long")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_n", place + offset).drop("_range")


def allocate(existing: DataFrame, wanted: DataFrame, order: list[str], prefix: str, width: int = 4) -> DataFrame:
    """wanted with an id each, in order, after the highest id (column id) of existing."""
    highest = existing.agg(F.coalesce(F.max(number_of(F.col("id"))), F.lit(0)).alias("_top"))
    return numbered(wanted, order).crossJoin(F.broadcast(highest)).select(sequential_id(prefix, F.col("_top") + F.col("_n"), width).alias("id"), *wanted.columns)


class Register:
    """A JSON file of allocated ids; one file, one prefix."""

    def __init__(self, path: str | Path, prefix: str, width: int = 4):
        self.path, self.prefix, self.width = Path(path), prefix, width

    def entries(self) -> list[dict]:
        if not self.path.exists():
            return []
        rows = json.loads(self.path.read_text("utf-8"))
        if not isinstance(rows, list):
            raise ValueError(f"{self.path} is not a list of entries")
        return rows

    def allocate(self, **fields) -> str:
        rows, top = self.entries(), 0
        for row in rows:
            head, _, number = str(row.get("id", "")).rpartition("-")
            if head != self.prefix:
                raise ValueError(f"{self.path} holds {row.get('id')!r}, which is not a {self.prefix} id")
            top = max(top, int(number))
        new = f"{self.prefix}-{top + 1:0{self.width}d}"
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps([*rows, {"id": new, **fields}], indent=2, ensure_ascii=False) + "\n", "utf-8")
        return new
