"""What the operators of this subpackage share: tables, shared storage, words, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.exchange import release

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return; ``bytes.split()``
#: splits at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see (``spark.checkpoint.dir``).

    Only a local master without that setting gets a folder of this machine, which goes at exit."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        atexit.register(shutil.rmtree, found[len("file://") :], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again. Survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges that one task settles, 4 MB of them.
AT_ONCE = 1 << 18


def components(edges: DataFrame, name: str = "components", most_rounds: int = 50, at_once: int = AT_ONCE) -> DataFrame:
    """Connected components of undirected ``edges`` (a long, b long): (id, component_id), the smallest id reachable.

    Only ids that stand in an edge are returned. Each task first leaves a spanning forest of its own edges. As soon as no
    more than ``at_once`` edges are left, one task settles them: the driver plans three small queries then, whatever the
    paths' lengths. While there are more, large-star and small-star alternate until nothing changes, which takes O(log^2 n)
    rounds; each round is two aggregations with map-side combination, written to the shared folder, and no round gathers a
    node's neighbours in one row: a star's centre is only a minimum. Empty input gives an empty result."""
    star = materialize(edges.where("a <> b").select("a", "b").mapInArrow(_stars(at_once), "a long, b long"), name)
    state = (star.count(), None)
    for _ in range(most_rounds):
        if state[0] <= at_once:
            return materialize(star.coalesce(1).mapInArrow(_stars(at_once, roots=True), "id long, component_id long"), name)
        before = state
        # large star: every larger neighbour of a node links to the smallest of the node and its neighbours
        both = star.select("a", "b").union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours of a node, and the node, link to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        joined = large.join(least, F.col("a") == F.col("n"))
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        star = materialize(small, name)
        state = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    heads = star.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return star.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(heads)


def _stars(most: int, roots: bool = False):
    """Of a task's edges, each node with the least one that it reaches, if that is another; with ``roots``, all nodes. The
    forest is sent and begun anew after ``most`` edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), 0
        names = ["id", "component_id"] if roots else ["a", "b"]

        def send() -> pa.RecordBatch:
            found = [(x, root) for x in list(forest.up) if (root := forest.root(x)) != x or roots]
            return pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], pa.int64()) for k in range(2)], names=names)

        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in range(2))
            for at in range(0, len(a), most):
                for x, y in zip(a[at : at + most], b[at : at + most]):
                    forest.join(x, y)
                held += len(a[at : at + most])
                if held >= most and not roots:
                    yield send()
                    forest, held = Forest(), 0
        yield send()
        forest = Forest()
        release()

    return run


class Forest:
    """Union-find over hashable keys; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = p
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
