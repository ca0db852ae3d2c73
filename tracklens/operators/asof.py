"""As-of joins of rows with a table of limits of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tracklens.scratch import stage_table

#: Limits up to which they go along with every task as one array.
FEW = 1000


def first_limit_join(rows: DataFrame, value: str, limits: DataFrame) -> DataFrame:
    """rows with entry, that of the smallest limit of limits (limit, entry) which value doesn't exceed.

    Of equal limits the smallest entry counts; a value that is null or beyond all limits
    has none. A table of FEW limits is broadcast, after it was counted; a larger one is
    merged with the rows in order of both.
    """
    limits = limits.select("limit", "entry").where("limit is not null")
    if limits.limit(FEW + 1).count() > FEW:
        return _merged(rows, value, limits)
    top = limits.agg(F.sort_array(F.collect_list(F.struct("limit", "entry"))).alias("_limits"))
    found = F.filter("_limits", lambda x: x["limit"] >= F.col(value))
    return rows.crossJoin(F.broadcast(top)).withColumn("entry", F.get(found, F.lit(0))["entry"]).drop("_limits")


def _merged(rows: DataFrame, value: str, limits: DataFrame) -> DataFrame:
    """The join by one range sort of rows and limits together.

    From the last row to the first, each takes the limit that was met last; what none of
    its own range tells comes from the nearest range behind, one limit a range. Rows of
    one value spread over ranges by a hash of their columns.
    """
    spark = rows.sparkSession
    own = [F.col(f"`{c}`") for c in rows.columns]
    plain = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, MapType)]
    asked = rows.select(F.col(f"`{value}`").alias("at"), F.lit(0).alias("kind"), F.xxhash64(*plain).alias("salt"), F.struct(*[c.alias(f"c{k}") for k, c in enumerate(own)]).alias("row"), F.lit(None).cast(limits.schema["entry"].dataType).alias("entry"))
    told = limits.select(F.col("limit").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("salt"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"), "entry")
    ranged = asked.unionByName(told).repartitionByRange("at", "kind", "salt").withColumn("part", F.spark_partition_id())
    ranged = stage_table(ranged, "limits")
    firsts = {r["part"]: r["first"]["entry"] for r in ranged.where("kind = 1").groupBy("part").agg(F.min(F.struct("at", "entry")).alias("first")).collect()}
    count, behind, after = max(firsts, default=-1) + 1, [], None
    for part in range(count - 1, -1, -1):
        behind.append((part, after))
        after = firsts.get(part, after)
    next_limits = spark.createDataFrame([(p, (e,)) for p, e in behind], f"part int, next struct<entry:{limits.schema['entry'].dataType.simpleString()}>")
    order = Window.partitionBy("part").orderBy(F.desc("at"), F.desc("kind"), F.desc("entry")).rowsBetween(Window.unboundedPreceding, 0)
    met = F.last(F.when(F.col("kind") == 1, F.struct("entry")), ignorenulls=True).over(order)
    found = ranged.withColumn("met", met).where("kind = 0").join(F.broadcast(next_limits), "part", "left")
    entry = F.when(F.col("at").isNotNull(), F.coalesce(F.col("met"), F.col("next"))["entry"])
    return found.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(rows.columns)], entry.alias("entry"))
