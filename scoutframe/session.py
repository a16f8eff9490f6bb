"""Session settings and the few physical helpers the operators share."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_SIDE_ROWS = 10_000
ROWS_PER_SALT = 20_000


def build_session(app: str = "scoutframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on.

    Nothing here is needed for right results; on a cluster pass the usual
    spark-submit settings instead and use the session they give.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # building a plan is several times faster without call-site capture
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **{k: str(v) for k, v in conf.items()},
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ships_with_tasks(module: str) -> None:
    """Send a module's functions to the workers by value, so they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def c(name: str) -> Column:
    """Column by its literal name (names such as ``Save%`` or ``Cmp%.1`` stay whole)."""
    return F.col("`" + name.replace("`", "``") + "`")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back on a temporary folder of its own. What
    lies there is removed when the application ends.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    shared = shared or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="scoutframe-")
        spark.conf.set("spark.checkpoint.dir", shared)
    root = f"{shared}/scoutframe-{sc.applicationId}"
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    Unlike a checkpoint this computes ``df`` once, keeps columns prunable and
    tells the optimizer the real size; a lost executor loses nothing.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition over every core: for small rows that fan out into much work.

    An explicit partition count is left alone by adaptive coalescing, which
    judges by bytes and would put such rows into a few tasks.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *[c(k) for k in keys])


def small_side(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> DataFrame:
    """Broadcast an aggregate, but only after its size has been checked.

    At most ``max_rows + 1`` rows are fetched.  Within the bound they become a
    local relation that is broadcast; beyond it ``df`` comes back unchanged and
    the join that follows is an ordinary shuffle join.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast.

    For rows that are many in memory though their files are small: the planner judges
    by compressed bytes and does not see what explode makes of a row, so it
    would fetch them to the driver.
    """
    return df.hint("merge")


def salted_join(
    probe: DataFrame,
    index: DataFrame,
    keys: list[str],
    condition: Column | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
    most_rows: int | None = None,
) -> DataFrame:
    """Inner equi-join whose heavy index keys are spread over several tasks.

    A key with more than ``rows_per_salt`` index rows is cut into
    ``ceil(rows / rows_per_salt)`` parts; each probe row of that key visits
    every part, so the result is that of the plain join.  The list of heavy
    keys holds at most ``index rows / rows_per_salt`` entries.  Where the caller
    knows that no key has more than ``most_rows`` rows and that is within the
    bound, the join is left plain.
    """
    if most_rows is not None and most_rows <= rows_per_salt:
        out = probe.join(shuffled(index), keys)
        return out.where(condition) if condition is not None else out
    heavy = (
        index.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > rows_per_salt)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_salt).cast("int").alias("_parts"))
    )
    heavy = small_side(heavy)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    spread = F.pmod(F.xxhash64(*[c(x) for x in index.columns]), parts).cast("int")
    left = (
        probe.join(heavy, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    right = index.join(heavy, keys, "left").withColumn("_salt", spread).drop("_parts")
    out = left.join(shuffled(right), keys + ["_salt"]).drop("_salt")
    return out.where(condition) if condition is not None else out
