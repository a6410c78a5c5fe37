"""Problem 2: duplicates hidden by formatting differences.

Method: an incremental ledger. The ledger keeps, in hash buckets, one row per canonical record key with the number
of copies and the earliest representative. A batch is aggregated by key (map-side combine first), full-outer-joined
with the buckets it touches only, counts are added and the smaller representative is kept.

Canonical key: every field without anything but letters and digits, in upper case; null, '' and values without a
letter or digit are equal; the fields named as swappable may exchange their values.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streetloom.operators.skew import join_counted
from streetloom.session import new_path, remove, staged

#: The thirteen address fields; the last four columns may stand in each other's place.
FIXED = ["type", "business_name", "predirectional", "street_suffix", "postdirectional", "secondary_designator", "secondary_number", "region", "country"]
SWAPPABLE = ["primary_number", "street_name", "city", "postal"]


def canonical_key(fixed: list[str], swappable: list[str]) -> Column:
    """ARRAY<STRING>: the cleaned fixed fields in order, then the cleaned swappable fields sorted. JVM only."""
    sep = "\u0001"

    def cleaned(cols: list[str]) -> Column:
        joined = F.concat_ws(sep, *[F.coalesce(F.translate(F.col(c).cast("string"), sep, ""), F.lit("")) for c in cols])
        return F.split(F.upper(F.regexp_replace(joined, rf"[^\p{{L}}\p{{N}}{sep}]+", "")), sep, -1)

    parts = ([cleaned(fixed)] if fixed else []) + ([F.array_sort(cleaned(swappable))] if swappable else [])
    return F.concat(*parts)


def key_hashes(key: Column) -> list[Column]:
    """128 bits as two BIGINTs; the second hash is over another text, so that both don't collide together."""
    text = F.concat_ws("\u0001", key)
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("ledger"), F.reverse(text)).alias("k2")]


class CopyLedger:
    """Bucketed counts of canonical keys in a folder all executors share; it outlives the session.

    A key's bucket is a hash of it. Every bucket is a folder that is replaced as a whole by a batch that touches it, and
    only touched buckets are read, joined and written. A manifest names the folder of each bucket and the batches that
    are in them. A new manifest is written beside the old one and then renamed, so that a failed batch leaves the old
    state whole, and a batch that is tried again changes nothing once its id is in.
    """

    SCHEMA = "k1 long, k2 long, n long, first_id long"

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark, self.path = spark, (path or new_path(spark, "ledger")).rstrip("/")
        self.where: dict[int, str] = {}
        self.batches: list[str] = []
        self.buckets, self.edition = buckets, 0
        fs, root = self._fs("")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        editions = sorted(int(n.split("-")[1]) for n in names if n.startswith("manifest-"))
        if editions:
            self.edition = editions[-1]
            state = json.loads(spark.read.text(f"{self.path}/manifest-{self.edition:09d}", wholetext=True).first()[0])
            # the number of buckets is the ledger's, whatever is asked for now
            self.where, self.batches, self.buckets = {int(k): v for k, v in state["where"].items()}, state["batches"], state["buckets"]

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _switch(self) -> None:
        """Write the next manifest under another name, rename it, and drop the one before the last."""
        text = json.dumps({"where": self.where, "batches": self.batches, "buckets": self.buckets})
        fs, hidden = self._fs(f"_next-{new_path(self.spark, '')[-12:]}")
        out = fs.create(hidden, True)
        out.write(bytearray(text.encode()))
        out.close()
        name = f"manifest-{self.edition + 1:09d}"
        if fs.exists(self._fs(name)[1]) or not fs.rename(hidden, self._fs(name)[1]):
            raise RuntimeError(f"another writer has changed the ledger at {self.path}")
        self.edition += 1
        old = self._fs(f"manifest-{self.edition - 2:09d}")[1]
        if fs.exists(old):
            fs.delete(old, False)

    def state(self, touched: list[int] | None = None) -> DataFrame:
        """(k1, k2, n, first_id, bucket) of the touched buckets, or all."""
        out = None
        for v in sorted(set(self.where.values())):
            mine = [k for k, w in self.where.items() if w == v and (touched is None or k in set(touched))]
            if mine:
                df = self.spark.read.option("basePath", f"{self.path}/{v}").schema(self.SCHEMA + ", bucket int").parquet(*[f"{self.path}/{v}/bucket={k}" for k in sorted(mine)])
                out = df if out is None else out.unionByName(df)
        return self.spark.createDataFrame([], self.SCHEMA + ", bucket int") if out is None else out

    def update(self, batch: DataFrame, id_col: str, batch_id: str) -> bool:
        """Add a batch with columns k1, k2 and id_col; whether it was new. An empty batch changes no bucket."""
        if batch_id in self.batches:
            return False
        bucket = F.pmod(F.col("k1"), F.lit(self.buckets)).cast("int")
        new = staged(batch.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).withColumn("bucket", bucket), "ledger-batch")
        # at most one small integer per bucket comes to the driver
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())
        if touched:
            known = [k for k in touched if k in self.where]
            merged = new
            if known:
                old = self.state(known).select("k1", "k2", F.col("n").alias("_n"), F.col("first_id").alias("_first"))
                merged = new.drop("bucket").join(old, ["k1", "k2"], "full_outer").select(
                    "k1", "k2", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), F.least("first_id", "_first").alias("first_id"), bucket.alias("bucket"))
            version = f"v{self.edition + 1}-{new_path(self.spark, '')[-8:]}"
            # a bucket is written by one task, whole
            merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
            self.where |= {k: version for k in touched}
        self.batches.append(batch_id)
        self._switch()
        self._sweep()
        return True

    def _sweep(self) -> None:
        """Delete versions that neither this manifest nor the one before it names."""
        fs, root = self._fs("")
        named = set(self.where.values())
        last = self._fs(f"manifest-{self.edition - 1:09d}")[1]
        if fs.exists(last):
            named |= set(json.loads(self.spark.read.text(last.toString(), wholetext=True).first()[0])["where"].values())
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("v") and name not in named and int(name[1:].split("-")[0]) < self.edition:
                remove(self.spark, f"{self.path}/{name}")


def copies(df: DataFrame, id_col: str, batch_col: Column | None = None, fixed: list[str] | None = None, swappable: list[str] | None = None, path: str | None = None, keys_per_bucket: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(ledger rows k1, k2, n, first_id; keyed rows id, k1, k2) of a table fed to a ledger batch by batch.

    batch_col splits the table into batches (a calendar year, say), whose values are their ids. With a path the ledger
    there is kept: batches it holds are skipped, others are added. A new ledger has a bucket for each keys_per_bucket
    rows, 16 at least.
    """
    spark = df.sparkSession
    keyed = df.select(F.col(id_col), *key_hashes(canonical_key(fixed or FIXED, swappable or SWAPPABLE)), (batch_col if batch_col is not None else F.lit(0)).cast("int").alias("_batch"))
    keyed = staged(keyed, "keyed")
    sizes = {r[0]: r[1] for r in keyed.groupBy("_batch").count().collect()}
    ledger = CopyLedger(spark, path, max(16, -(-sum(sizes.values()) // keys_per_bucket)))
    for b in sorted(sizes, key=lambda x: (x is None, x)):
        ledger.update(keyed.where(F.col("_batch").eqNullSafe(F.lit(b))), id_col, str(b))
    return ledger.state(), keyed.select(id_col, "k1", "k2")


def p2_ledger(addresses: DataFrame) -> DataFrame:
    """One row per record: first_addr_id, n_copies."""
    state, _ = copies(addresses, "addr_id", F.year("received_at"))
    return state.select(F.col("first_id").alias("first_addr_id"), F.col("n").alias("n_copies"))


def p2_found(addresses: DataFrame) -> DataFrame:
    """One row for each copy that isn't the earliest of its record."""
    state, keyed = copies(addresses, "addr_id", F.year("received_at"))
    several = state.where("n > 1").select("k1", "k2", "n", "first_id")
    out = join_counted(keyed, several, ["k1", "k2"], "n")
    return out.where(F.col("addr_id") != F.col("first_id")).select(F.col("first_id").alias("first_addr_id"), "addr_id")
