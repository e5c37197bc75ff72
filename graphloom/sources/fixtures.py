"""Graphs derived from the driver's tables: supplier-part edges typed by return flag, with vectors from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.preprocess import split_edges


class Fixture:
    """Lazy tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.suppliers = self.read("supplier").count()
        self.n = self.suppliers + self.read("part").count()
        self.vectors = self.read("embeddings").count()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def relations(self) -> DataFrame:
        """(flag, rel): the return flags, numbered; there are three."""
        flags = self.read("lineitem").select(F.col("l_returnflag").alias("flag")).distinct()
        return flags.withColumn("rel", (F.row_number().over(Window.orderBy("flag")) - 1).cast("long"))

    def edges(self) -> DataFrame:
        """(src, rel, dst, edge)."""
        rels = self.relations()
        rows = self.read("lineitem").select("l_suppkey", "l_returnflag", "l_partkey").distinct().join(F.broadcast(rels), F.col("flag") == F.col("l_returnflag"))
        edges = rows.select(F.col("l_suppkey").alias("src"), "rel", (F.col("l_partkey") + F.lit(self.suppliers)).alias("dst"))
        return edges.withColumn("edge", self.edge_number())

    def edge_number(self) -> Column:
        """The number of an edge (src, rel, dst)."""
        return (F.col("src") * F.lit(3) + F.col("rel")) * F.lit(self.n) + F.col("dst")

    def raw_edges(self) -> DataFrame:
        """String ids: ('S' || supplier, flag, 'P' || part)."""
        rows = self.read("lineitem").select("l_suppkey", "l_returnflag", "l_partkey").distinct()
        return rows.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.col("l_returnflag").alias("rel"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"))

    def untyped_edges(self) -> DataFrame:
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        return self.read("lineitem").select("l_orderkey", "l_partkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.lit(0).cast("long").alias("rel"), F.col("l_partkey").alias("dst")).distinct()

    def nodes(self) -> DataFrame:
        return self.spark.range(self.n)

    def embeddings(self) -> DataFrame:
        """(id, emb): the table's vectors repeated over all nodes, scaled so that repeats differ."""
        base = self.read("embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").cast("array<double>").alias("e"))
        factor = F.lit(1.0) + F.floor(F.col("id") / F.lit(self.vectors)) * F.lit(0.001)
        rows = self.nodes().withColumn("v", F.col("id") % F.lit(self.vectors)).join(base, "v")
        return rows.withColumn("f", factor).select("id", F.transform("e", lambda x: x * F.col("f")).alias("emb"))

    def vec(self, width: int) -> DataFrame:
        """(id, vec): the first columns of the node vectors, as an embedding layer takes them."""
        return self.embeddings().select("id", F.slice("emb", 1, width).alias("vec"))

    def relation_vectors(self) -> DataFrame:
        """(rel, emb, inv_emb)."""
        make = lambda a, b, c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: F.lit(0.5) + ((F.col("rel") * a + d * b + c) % 64) / F.lit(64.0))
        return self.spark.range(3).select(F.col("id").alias("rel")).select("rel", make(31, 17, 0).alias("emb"), make(37, 13, 5).alias("inv_emb"))

    def split(self) -> DataFrame:
        """Edges with the 0.9 / 0.05 / 0.05 split."""
        return split_edges(self.edges(), F.col("edge"), (0.9, 0.05, 0.05))
