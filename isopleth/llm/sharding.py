"""Sharding by extendible hashing (operator 4).

A document's hash bits are the first 32 bits of the md5 of its id. The directory starts from one bucket; a
bucket whose documents exceed the byte limit splits on its next bit, until every bucket fits or holds one row. Splits are
found from byte and row counts of fine cells (a number of leading bits that follows total bytes / limit), which map
side combining has made small, so rows are read once for the counts and once for the assignment. Cells that are
still too large at that depth go on with more bits from their own rows only.

Rows with equal ids cannot be told apart by those bits. Such a bucket goes on with the bits of the md5 of the text, after a
dot. Rows that share both hashes, copies as a rule, get overflow pages, as buckets of extendible hashing do: they
are written once, and running sums within each written partition close a page before it passes the limit, so pages stay
the same whatever is recomputed, and a row that very many share is dealt by many tasks.

Defined cases: a null text has 0 bytes; a null id hashes as the empty text; a single row over the limit is a shard of its
own, marked `oversize`; an empty table gives no shard; copies of a row may be in one shard; other columns are carried
along unchanged, whatever their names, but those named like the five results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import materialize, named, table

BITS = 32
#: Directory rows up to this number are broadcast (under 4 MB); beyond, the join shuffles.
BROADCAST_CELLS = 100_000


def hash_bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def _prefix(h: Column, depth: Column | int) -> Column:
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.floor(h / F.pow(F.lit(2.0), F.lit(BITS) - d)).cast("bigint")


def _directory(cells: DataFrame, by: list[str], low: int, high: int, limit: int) -> DataFrame:
    """For each cell (`by`, then `cell`: high leading bits; `bytes`, `rows`): depth, the smallest from low to high whose bucket fits, or high; the bucket, its bytes, and whether it is full."""
    at = cells.select(*by, "cell", "bytes", "rows", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    at = at.withColumn("bucket", F.floor(F.col("cell") / F.pow(F.lit(2.0), F.lit(high) - F.col("depth"))).cast("bigint"))
    sums = at.groupBy(*by, "depth", "bucket").agg(F.sum("bytes").alias("total"), F.sum("rows").alias("n"))
    sums = sums.withColumn("full", (F.col("total") > limit) & (F.col("n") > 1)).filter(~F.col("full") | (F.col("depth") == high))
    fits = at.join(sums, [*by, "depth", "bucket"]).groupBy(*by, "cell").agg(F.min(F.struct("depth", "bucket", "total", "full")).alias("m"))
    return fits.select(*by, "cell", "m.depth", "m.bucket", "m.total", "m.full")


def _bits(bucket: str, depth: str) -> Column:
    return F.when(F.col(depth) == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col(bucket).cast("string"), 10, 2), F.col(depth), "0"))


def _counted(rows: DataFrame, *by: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with shard (its bits as text), depth (how many), n_bytes, shard_bytes, oversize."""
    if limit < 1:
        raise ValueError("the limit must be positive")
    rows = docs.select(named(docs.columns).alias("row"), hash_bits(F.col(f"`{key}`")).alias("h"), F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("bigint").alias("n_bytes"))
    total = rows.agg(F.sum("n_bytes").alias("s")).first()["s"] or 0
    # about 32 cells for each shard, so a split rarely needs more bits than the cells have
    bits = min(BITS, max(4, math.ceil(math.log2(max(1.0, total / limit))) + 5))
    directory = _directory(_counted(rows, _prefix(F.col("h"), bits).alias("cell")), [], 0, bits, limit)
    small = 2**bits <= BROADCAST_CELLS
    rows = rows.withColumn("cell", _prefix(F.col("h"), bits)).join(F.broadcast(directory) if small else directory, "cell").drop("cell")
    if bits < BITS and directory.filter("full").limit(1).count():
        more = _directory(_counted(rows.filter("full"), F.col("h").alias("cell")), [], bits, BITS, limit)
        more = more.select(F.col("cell").alias("h"), *(F.col(c).alias(f"{c}2") for c in ("depth", "bucket", "total", "full")))
        rows = rows.join(more, "h", "left").withColumns({c: F.coalesce(f"{c}2", c) for c in ("depth", "bucket", "total", "full")})
    made = ["shard", "depth", "n_bytes", "shard_bytes", "oversize"]

    def out(part: DataFrame) -> DataFrame:
        kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in made]
        return part.select(*kept, "shard", F.col("depth").cast("int").alias("depth"), "n_bytes", F.col("total").alias("shard_bytes"), (F.col("n_bytes") > limit).alias("oversize"))

    rows = rows.withColumn("shard", _bits("bucket", "depth")).select("row", "n_bytes", "shard", "depth", "total", "full")
    done = out(rows.filter(~F.col("full")))
    if not rows.filter("full").limit(1).count():
        return done
    same = materialize(rows.filter("full").select("row", "n_bytes", "shard", hash_bits(F.col(f"row.`{text}`")).alias("cell"), F.monotonically_increasing_id().alias("place")))
    finer = _directory(_counted(same, F.col("shard"), F.col("cell")), ["shard"], 0, BITS, limit)
    same = same.join(finer, ["shard", "cell"]).withColumns({"shard": F.concat("shard", F.lit("."), _bits("bucket", "depth")), "depth": F.col("depth") + BITS})
    task = F.shiftright("place", 33)
    by = Window.partitionBy("shard", task).orderBy("place")
    before = F.coalesce(F.sum("n_bytes").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = F.when(F.col("n_bytes") * 2 > limit, F.concat(F.lit("x"), F.row_number().over(by).cast("string"))).otherwise(F.floor(before * 2 / limit).cast("string"))
    paged = same.filter("full").withColumn("page", page).withColumn("shard", F.concat("shard", F.lit("+"), task.cast("string"), F.lit("."), "page"))
    sizes = paged.groupBy("shard").agg(F.sum("n_bytes").alias("total"))
    return done.unionByName(out(same.filter(~F.col("full")))).unionByName(out(paged.drop("total").join(sizes, "shard")))


def write(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> None:
    """Writes each shard as a folder shard=... under path."""
    assign(docs, limit, key, text).repartition("shard").write.partitionBy("shard").parquet(path)


#: Bytes of text in a shard of the registered query.
SHARD_BYTES = 256 << 10


def op4_extendible_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_BYTES).select("doc_id", "shard", "depth", "n_bytes", "shard_bytes", "oversize")


#: For tables in which no two rows share the hash of an id.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM documents),
lv AS (SELECT doc_id, n_bytes, depth, h >> (32 - depth) AS bucket FROM d, range(0, 33) AS g(depth)),
s AS (SELECT depth, bucket, sum(n_bytes) AS total, count(*) AS n FROM lv GROUP BY ALL),
m AS (SELECT doc_id, any_value(n_bytes) AS n_bytes, min(depth) AS depth FROM lv JOIN s USING (depth, bucket) WHERE total <= {SHARD_BYTES} OR n = 1 GROUP BY doc_id)
SELECT m.doc_id, CASE WHEN m.depth = 0 THEN '' ELSE right(lpad(bin(s.bucket), 64, '0'), CAST(m.depth AS INTEGER)) END AS shard, CAST(m.depth AS INTEGER) AS depth,
  CAST(m.n_bytes AS BIGINT) AS n_bytes, CAST(total AS BIGINT) AS shard_bytes, m.n_bytes > {SHARD_BYTES} AS oversize
FROM m JOIN lv ON lv.doc_id = m.doc_id AND lv.depth = m.depth JOIN s ON s.depth = lv.depth AND s.bucket = lv.bucket"""

QUERIES = {"op4_extendible_sharding": op4_extendible_sharding}
ORACLES = {"op4_extendible_sharding": ORACLE}
