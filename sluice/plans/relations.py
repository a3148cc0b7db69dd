"""The relations that queries run on, from the tables at hand, and the same as DuckDB common table expressions.

opportunities are orders with their customer and nation, lines are order lines
with their part, and so on. Every query names an as-of time; none asks the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-07-01 00:00:00"
#: Status codes of orders, and the statuses of opportunities they stand for.
STATUS = {"O": "new", "P": "bidding", "F": "won"}
STATUSES = ("new", "reviewing", "awaiting_qa", "qa_qualified", "qa_rejected", "bidding", "passed", "won", "lost")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def dealt(spark: SparkSession, sf_dir: str, name: str, *key: str, each: int = 4 << 20, columns: Sequence[str] = ("*",)) -> DataFrame:
    """A table's columns, dealt by key so that a part is about each bytes of its files, however large the table is: what is grouped by the key afterwards needs no further shuffle."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-file_bytes(spark, sf_dir, name) // each))
    return table(spark, sf_dir, name).select(*columns).repartition(parts, *key)


def as_of() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    return joined.select(
        F.col("o_orderkey").alias("opp_id"),
        F.expr("case when o_orderpriority = '4-NOT SPECIFIED' and o_orderstatus = 'F' then 'lost' when o_orderpriority = '5-LOW' and o_orderstatus = 'O' then 'reviewing' when o_orderstatus = 'O' then 'new' when o_orderstatus = 'P' then 'bidding' else 'won' end").alias("status"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("created"),
        F.expr("case when o_orderpriority <> '3-MEDIUM' then o_orderdate + interval 30 days end").alias("deadline"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("agency"),
        F.col("n_name").alias("place"),
        F.col("c_mktsegment").alias("source"),
        F.col("o_orderpriority").alias("priority"),
        F.expr("concat(c_mktsegment, ' ', o_orderpriority)").alias("title"),
        F.expr("cast(floor(o_totalprice / 5000) as int)").alias("score"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lineitem.join(part, lineitem.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("opp_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("l_quantity").alias("quantity"),
        F.expr("case when l_returnflag = 'N' then 'LBS' when l_linestatus = 'O' then 'EA' else 'LF' end").alias("quantity_unit"),
        F.expr("case when p_size % 10 = 0 then null else cast(p_size as double) end").alias("unit_weight"),
        F.expr("case when p_size % 20 = 0 then null else l_quantity * 12.5 end").alias("total_weight"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("assembly"),
        F.col("p_name").alias("description"),
        F.expr("l_linenumber * 0.5D").alias("fab_hrs"),
        F.expr("l_quantity * 0.25D").alias("iron_hrs"),
        F.expr("1 - l_tax * 5").alias("confidence"),
        F.expr("case l_returnflag when 'N' then 'point' when 'A' then 'range' else 'assumed_typical' end").alias("band"),
        F.expr("case l_returnflag when 'N' then 'drawing' when 'A' then 'spec' else 'assumption' end").alias("source_kind"),
        F.expr("case when l_linestatus = 'F' then 'galvanized' when l_returnflag = 'A' then 'shop_primer' else 'none' end").alias("finish"),
        F.expr("case when l_returnflag = 'N' then null else l_quantity * 0.8D end").alias("quantity_min"),
        F.expr("case when l_returnflag = 'N' then null else l_quantity * 1.3D end").alias("quantity_max"),
        F.expr("l_discount > 0.08").alias("flagged"),
        F.col("l_extendedprice").alias("predicted"),
        F.expr("case when l_linestatus = 'F' then l_extendedprice * (1 - l_discount) * (1 + l_tax) end").alias("actual"),
        F.col("l_shipdate").alias("shipped"),
    )


_SELECT = {
    "opportunities": """
  SELECT o_orderkey AS opp_id,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'lost'
         WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN 'reviewing'
         WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderstatus = 'P' THEN 'bidding' ELSE 'won' END AS status,
    o_totalprice AS value, o_orderdate AS created,
    CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderdate + INTERVAL 30 DAY END AS deadline,
    c_custkey AS customer_id, c_name AS agency, n_name AS place, c_mktsegment AS source,
    o_orderpriority AS priority, c_mktsegment || ' ' || o_orderpriority AS title,
    CAST(floor(o_totalprice / 5000) AS INTEGER) AS score
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "lines": """
  SELECT l_orderkey AS opp_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id, l_quantity AS quantity,
    CASE WHEN l_returnflag = 'N' THEN 'LBS' WHEN l_linestatus = 'O' THEN 'EA' ELSE 'LF' END AS quantity_unit,
    CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS unit_weight,
    CASE WHEN p_size % 20 = 0 THEN NULL ELSE l_quantity * 12.5 END AS total_weight,
    p_type AS category, p_brand AS assembly, p_name AS description,
    CAST(l_linenumber AS DOUBLE) * 0.5 AS fab_hrs, l_quantity * 0.25 AS iron_hrs, 1 - l_tax * 5 AS confidence,
    CASE l_returnflag WHEN 'N' THEN 'point' WHEN 'A' THEN 'range' ELSE 'assumed_typical' END AS band,
    CASE l_returnflag WHEN 'N' THEN 'drawing' WHEN 'A' THEN 'spec' ELSE 'assumption' END AS source_kind,
    CASE WHEN l_linestatus = 'F' THEN 'galvanized' WHEN l_returnflag = 'A' THEN 'shop_primer' ELSE 'none' END AS finish,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity * 0.8 END AS quantity_min,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity * 1.3 END AS quantity_max,
    l_discount > 0.08 AS flagged, l_extendedprice AS predicted,
    CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) * (1 + l_tax) END AS actual,
    l_shipdate AS shipped
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def cte(*names: str) -> str:
    """WITH and the named relations, for the head of a DuckDB query; a trailing comma takes further ones."""
    return "WITH " + ",\n".join(f"{n} AS ({_SELECT[n]})" for n in names)


NOW = f"TIMESTAMP '{AS_OF}'"
