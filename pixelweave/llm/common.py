"""What several operators share: the folder for intermediate tables, whole-text words, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
#: Sides of a join with more rows, or more text in them, aren't broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 64 << 20
_FIXED = (T.NumericType, T.BooleanType)
#: Nodes with more edges than this are joined by a broadcast of their own, as one task couldn't hold them.
HUB_EDGES = 100_000
#: Rows and bytes that go to Python at a time. With Spark's own 10,000 rows or 64 MB, two workers of long texts and their executor's buffers take all its memory.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a local session, whose tasks all run on this machine, may
    do without."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return given or _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and there after an executor is lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on texts go to Python in batches of ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes; smaller settings stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        given = int(spark.conf.get(key).rstrip("b"))
        spark.conf.set(key, str(most if given <= 0 else min(given, most)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``doc_id`` and ``text``, with null texts as empty ones; other columns go, whatever
    their names."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def small_side(df: DataFrame) -> DataFrame:
    """The side of a join, broadcast if a count of its rows and their size allow it. ``df`` should be a written table."""
    rows = df.limit(BROADCAST_ROWS + 1).count()
    fixed = all(isinstance(f.dataType, _FIXED) for f in df.schema)
    if rows <= (BROADCAST_ROWS if fixed else 1000):
        return F.broadcast(df)
    size = None if rows > BROADCAST_ROWS else df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if size is not None and size <= BROADCAST_BYTES else df


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once. An expression used within a lambda function would be
    computed anew for every element."""
    return F.transform(F.array(value), f)[0]


def _to_least(rows: DataFrame, of: DataFrame, hubless: bool = False) -> DataFrame:
    """``rows(a, b)`` with the ``least`` of their ``a``, from ``of(a, n, least)``. Hubs, of which there are fewer than edges / ``HUB_EDGES``, go by broadcast."""
    if hubless:
        return rows.join(of.select("a", "least"), "a")
    of = written(of, "components-least")
    hubs = of.where(F.col("n") > HUB_EDGES).select("a", "least")
    plain = of.select("a", "least")
    if hubs.isEmpty():
        return rows.join(plain, "a")
    hubs = F.broadcast(hubs)
    return rows.join(hubs, "a").unionByName(rows.join(hubs.select("a"), "a", "left_anti").join(plain, "a"))


def components(edges: DataFrame, name: str = "components", hubless: bool = False) -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``, whose nodes are of any type with an order.

    Returns ``(node, root)`` for every node that has an edge; root is the smallest node of the
    component. Alternates two star contractions, large and small, until no edge moves, which takes a
    logarithmic number of rounds; every round is written, so a lost executor costs one round at most.
    Self-links and repeated links are harmless; nulls are ignored. ``hubless`` says that there are no more than ``HUB_EDGES`` edges
    in all, so no node can have more.
    """
    edges = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.count("*").alias("n"), F.least(F.min("b"), F.first("a")).alias("least"))
        large = written(_to_least(both.where("b > a"), least, hubless).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct(), name)
        least = large.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("least"))
        small = _to_least(large, least, hubless).select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = written(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    nodes = edges.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.select(F.col("a").alias("node"), "root").unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
