"""Helpers shared by the corpus operators: held-out split, bounded samples, shared scratch space, linking."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def held_out(doc_id: str | Column, remainder: int = 2, modulus: int = 4) -> Column:
    """True where crc32 of the id's text mod ``modulus`` equals ``remainder``; a null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def learnable(doc_id: str | Column, remainder: int = 2, modulus: int = 4) -> Column:
    """True where a row may be learned from: the id is known and not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return c.isNotNull() & ~held_out(c, remainder, modulus)


def unit_hash(*cols: str | Column) -> Column:
    """A uniform number in [0, 1) that depends only on the values of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a local session gets a temporary folder; on a cluster that would be a folder of each
    machine, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="driftwright-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers in batches of at most ``rows``, unless the session says otherwise.

    Spark's default of 10,000 rows is meant for numbers; so many texts stand in a worker several times over.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


class Scratch:
    """Parquet tables below the shared folder, removed together when ``drop`` is called."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back, which cuts its lineage at a replicated or shared file."""
        path = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label the nodes of ``edges`` (a long, b long) with the smallest node that they reach.

    Alternating large-star and small-star steps: each keeps connectivity, points nodes at smaller ones and
    ends once every edge joins a node with its component's root. All steps are joins and aggregations that
    combine before they shuffle; each one's edges are written to ``scratch``. Nothing is gathered on the driver
    but whether an edge is left that does something else. ``edges`` is read several times, so it had better be a
    table. Returns (node, component); nodes without edges are absent, self loops and null ends are ignored.
    """
    e, tag, moving, step = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), uuid.uuid4().hex[:8], True, 0
    while moving:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        # large star: the larger neighbours of x move to the least node that x knows
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: x and its smaller neighbours move to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, F.col("u") == F.col("x")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = scratch.table(small.select("s.u", "s.v").where("u <> v").distinct(), f"edges-{tag}-{step}")
        # done if each node points at one other, which points at none
        ends = e.select("u", F.lit(1).alias("points"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("u").agg(F.sum("points").alias("points"), F.max("root").alias("root"))
        moving, step = bool(ends.agg(F.max((F.col("points") > 1) | ((F.col("points") > 0) & (F.col("root") > 0)))).first()[0]), step + 1
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def linked_classes(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    *,
    facts: DataFrame | None = None,
    possible: Callable[[Column, Column], Column] | None = None,
    crowd: int = 16,
    slack: float | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """Classes (node, component) of the linked rows of ``members`` (bucket, node, rank), and the verified links.

    Rows are distinct by bucket and node; a node's rank doesn't depend on the bucket. ``verify`` adds to distinct
    pairs (a, b) whether they hold (``holds``), a ``similarity`` and any columns of its own. First each bucket is
    led by its node of least rank, which all others of the bucket meet: a group of copies costs a pair for each
    member and bucket. Their links make classes. Then only buckets that hold nodes of several classes are open:
    there every pair of nodes of different classes is verified, unless ``possible`` of their ``facts`` (node,
    facts) rules it out. So the classes are those of all pairs that share a bucket, and the links returned are
    those with leaders and those found in open buckets; others join nodes that are in one class already. Buckets
    of more than ``crowd`` nodes and one leader, which hold much the same nodes, are opened as one.

    Where one less the similarity is a metric, links are at most ``slack`` apart, and two nodes whose similarities
    to their leader differ by more can't be linked. Returns None, after one job, if no bucket has two nodes.
    """
    lead = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("rank", "node")).alias("s")).where("n > 1").select("bucket", F.col("s.node").alias("a"), "n")
    lead = scratch.table(lead, "leaders")  # a table, so that the join with it can be split where a bucket is hot
    if lead.isEmpty():
        return None
    met = scratch.table(members.join(lead, "bucket").where("a <> node").select("bucket", "n", "a", F.col("node").alias("b")), "met")
    judged = scratch.table(verify(met.select("a", "b").distinct()), "judged")
    links = judged.where("holds")
    parts = connected_components(links.select("a", "b"), scratch)
    # leaders have met all others of their buckets, so two others are needed for an open pair
    place = F.when(F.col("n") > crowd, F.col("a")).otherwise(F.col("bucket")).alias("place")
    near = met.where("n > 2").select(place, "a", "b").distinct().join(judged.select("a", "b", "similarity"), ["a", "b"]).select("place", F.col("b").alias("node"), "similarity")
    near = scratch.table(near.join(parts, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"), "near")
    several = scratch.table(near.groupBy("place").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("place"), "several")
    if several.isEmpty():
        return parts, links
    rest = near.join(several, "place", "left_semi")
    rest = scratch.table(rest.withColumn("facts", F.lit(0)) if facts is None else rest.join(facts, "node"), "open")
    x, y = rest.alias("x"), rest.alias("y")
    tests = [F.col("x.place") == F.col("y.place"), F.col("x.class") != F.col("y.class"), F.col("x.node") < F.col("y.node")]
    if slack is not None:
        tests.append(F.coalesce(F.abs(F.col("x.similarity") - F.col("y.similarity")) <= slack + 1e-6, F.lit(True)))
    if possible is not None:
        tests.append(possible(F.col("x.facts"), F.col("y.facts")))
    cross = x.join(y, reduce(lambda p, q: p & q, tests)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    more = scratch.table(verify(cross.distinct()).where("holds"), "judged-open")
    if more.isEmpty():
        return parts, links
    # the classes that open pairs join
    own = rest.select("node", "class").distinct()
    joined = more.join(own.select(F.col("node").alias("a"), F.col("class").alias("p")), "a").join(own.select(F.col("node").alias("b"), F.col("class").alias("q")), "b")
    joined = connected_components(scratch.table(joined.select(F.col("p").alias("a"), F.col("q").alias("b")), "joined"), scratch)
    whole = parts.union(own.join(parts, "node", "left_anti").select("node", "class"))
    whole = whole.join(joined.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    return whole.select("node", F.coalesce("least", "component").alias("component")), links.union(more)
