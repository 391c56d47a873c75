"""Resharding by minimum-cost flow.

A table stands in files, each of which belongs to an old shard: the one that its folder names (shard=K), or the crc32 of its
name, modulo the number of shards. A file's rows are cut into blocks of following rows, about BLOCKS in all (with more files
than that, blocks are groups of whole files of one old shard), so the driver sees at most 2 * BLOCKS blocks and as many for
each old shard as there are, whatever the size of the table. A minimum-cost flow from the old sizes to the new capacities,
where a byte costs 1 if it changes shard, says how many bytes go from each old shard to each new one; the blocks, file after
file, fill these transfers, what stays first, so that few files are cut. Law: bytes, so that the new sizes are nearly equal.

A file all of whose blocks stay is left as it is. The rows of the other, affected files are written once, by tasks that read
them where they stand and know the plan: no text is shuffled. A row's slot is its number in its file, after the rows of the
shard's files before.

A null text has no bytes; a document's size is its text's UTF-8 bytes plus 1. Rows are placed by where they stand, so rows
with a null doc_id, repeated rows and equal texts are documents like any other. An empty table gives no rows. Rows that come
from no Parquet files, or not whole from them, are first written as such. Extra columns are carried along by the files, and
ignored otherwise.
"""

from __future__ import annotations

from collections import deque

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docloom.llm._shared import discard, new_folder, only, written

BLOCKS = 4096


def min_cost_flow(supply: list[int], capacity: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one: all supply goes, no capacity is passed, and the fewest bytes change shard (cost 1 a byte where the two numbers differ). Successive shortest paths."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold all bytes")
    n, m = len(supply), len(capacity)
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    cost = lambda i, j: int(i != j)
    while any(left):
        # shortest paths (costs may be negative on the way back) from old shards with bytes left
        reach: dict[tuple[str, int], int] = {("old", i): 0 for i in range(n) if left[i]}
        parent: dict[tuple[str, int], tuple[str, int]] = {}
        queue = deque(reach)
        while queue:
            kind, x = node = queue.popleft()
            steps = [(("new", j), cost(x, j)) for j in range(m)] if kind == "old" else [(("old", i), -cost(i, x)) for i in range(n) if flow[i][x]]
            for to, c in steps:
                if reach[node] + c < reach.get(to, 1 << 60):
                    reach[to], parent[to] = reach[node] + c, node
                    queue.append(to)
        end = min((("new", j) for j in range(m) if room[j]), key=lambda v: (reach[v], v))
        path = [end]
        while path[-1] in parent:
            path.append(parent[path[-1]])
        path.reverse()
        moved = min(left[path[0][1]], room[end[1]], *(flow[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "new"), 1 << 62)
        for a, b in zip(path, path[1:], strict=False):
            if a[0] == "old":
                flow[a[1]][b[1]] += moved
            else:
                flow[b[1]][a[1]] -= moved
        left[path[0][1]] -= moved
        room[end[1]] -= moved
    return flow


def place_blocks(blocks: list[tuple[int, int]], flow: list[list[int]], capacity: list[int]) -> list[int]:
    """The new shard of each block (old shard, size; in the order of files): an old shard's blocks fill its transfers one after the other, what stays first; then the last unevenness goes, block by block."""
    left = [list(x) for x in flow]
    load, where = [0] * len(capacity), [0] * len(blocks)
    order = [sorted((j for j in range(len(capacity)) if left[i][j]), key=lambda j: (j != i, j)) or [min(i, len(capacity) - 1)] for i in range(len(flow))]
    for k, (old, size) in enumerate(blocks):
        # a transfer takes a block whose larger part fits
        while len(order[old]) > 1 and 2 * left[old][order[old][0]] < size:
            order[old].pop(0)
        to = order[old][0]
        where[k] = to
        left[old][to] -= size
        load[to] += size
    members = [sorted((k for k in range(len(blocks)) if where[k] == j), key=lambda k: blocks[k][1]) for j in range(len(capacity))]
    for _ in range(len(blocks)):
        over = [load[j] - capacity[j] for j in range(len(capacity))]
        most, least = max(range(len(over)), key=over.__getitem__), min(range(len(over)), key=over.__getitem__)
        gap = over[most] - over[least]
        fit = [k for k in members[most] if blocks[k][1] < gap]
        if not fit:
            break
        # the block nearest to half the gap, one that goes home or is away already rather than one that stays
        k = min(fit, key=lambda k: (abs(2 * blocks[k][1] - gap), blocks[k][0] != least, k))
        members[most].remove(k)
        members[least].append(k)
        where[k] = least
        load[most] -= blocks[k][1]
        load[least] += blocks[k][1]
    return where


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def crc_of(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def name_of(path: str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def located(table: DataFrame) -> DataFrame | None:
    """The table with __file and __row, where each row stands; None if it doesn't come from Parquet files."""
    try:
        return table.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return None


class Resharding:
    """The plan of a table's resharding: which files stay, and where the blocks of the others go."""

    def __init__(self, table: DataFrame, shards: int, capacity: list[int] | None = None, old_shard: str | None = None) -> None:
        spark = self.spark = table.sparkSession
        self.table, self.rows = table, located(table)
        if self.rows is None or not self._measured(old_shard, shards):
            self.table = written(table, "unsharded")
            self.rows = located(self.table)
            self._measured(old_shard, shards)
        n_files, n_rows = self.files.agg(F.count(F.lit(1)), F.sum("n")).first()
        each = max(1, (n_rows or 0) // BLOCKS)
        few = n_files <= BLOCKS  # else a block is a group of whole files
        self.block = [F.when(F.lit(few), F.col("__file")).otherwise(F.pmod(F.xxhash64("__file"), F.lit(BLOCKS)).cast("string")).alias("__group"), F.when(F.lit(few), F.floor(F.col("__row") / each)).otherwise(F.lit(0)).cast("long").alias("__block")]
        keys = ["__old", "__group", "__block"]
        blocks = self.sizes.select("__old", *self.block, "__size").groupBy(*keys).agg(F.sum("__size").alias("b")).orderBy(*keys).collect()  # bounded: see above
        discard(self.sizes)
        olds = max([shards - 1, *(r["__old"] for r in blocks)]) + 1
        supply = [0] * olds
        for r in blocks:
            supply[r["__old"]] += r["b"]
        capacity = capacity or even(sum(supply), shards)
        capacity = capacity + [0] * (olds - len(capacity))
        where = place_blocks([(r["__old"], r["b"]) for r in blocks], min_cost_flow(supply, capacity), capacity)
        self.moved_bytes = sum(r["b"] for r, j in zip(blocks, where, strict=True) if r["__old"] != j)
        kinds = T.StructType([T.StructField("__old", T.IntegerType()), T.StructField("__group", T.StringType()), T.StructField("__block", T.LongType()), T.StructField("shard", T.IntegerType())])
        moving = {(r["__old"], r["__group"]) for r, j in zip(blocks, where, strict=True) if r["__old"] != j}
        plan = [(*(r[k] for k in keys), j) for r, j in zip(blocks, where, strict=True) if (r["__old"], r["__group"]) in moving]
        self.plan = spark.createDataFrame(plan, kinds)  # the blocks of affected files
        self.leaves = bool(plan)
        group = self.files.select("__file", "__old", "n", F.lit(0).alias("__row")).select("__file", "__old", "n", self.block[0])
        self.kept = group.join(F.broadcast(self.plan.select("__old", "__group").distinct()), ["__old", "__group"], "left_anti").select(F.col("__file"), F.col("__old").alias("shard"), "n")
        self.stays = len({(r["__old"], r["__group"]) for r in blocks}) > len(moving)

    def _measured(self, old_shard: str | None, shards: int) -> bool:
        """Write sizes and files; False if rows are missing from the files' rows."""
        old = F.col(old_shard).cast("int") if old_shard else F.pmod(F.crc32(name_of("__file").cast("binary")), F.lit(shards)).cast("int")
        self.rows = self.rows.withColumn("__old", old)
        self.sizes = written(self.rows.select("__old", "__file", "__row", size_of().alias("__size")), "row-sizes")
        files = self.sizes.groupBy("__file", "__old").agg(F.count(F.lit(1)).alias("n"), F.max("__row").alias("last"), F.countDistinct("__row").alias("different"))
        self.files = written(files, "file-sizes")
        return self.files.where("n <> last + 1 or n <> different").isEmpty()

    def rewrite(self, path: str) -> DataFrame | None:
        """Write the rows of the affected files under path, a folder for each shard; returns the written table with shard, or None if no file is affected."""
        if not self.leaves:
            return None
        rows = self.rows.select("*", *self.block).join(F.broadcast(self.plan), ["__old", "__group", "__block"])
        rows = rows.withColumn("old_shard", F.col("__old")).drop("__old", "__group", "__block", "__file", "__row")
        rows.write.partitionBy("shard").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def placed(self, path: str) -> DataFrame:
        """All rows, read from where they stand after rewrite(): those of files that stay, and of new files; with shard, old_shard and slot."""
        new, rows, manifest = self.rewrite(path), [], []
        if self.stays or new is None:
            rows.append(self.rows.join(self.kept.select("__file", "shard"), "__file").withColumn("old_shard", F.col("__old")).drop("__old"))
            manifest.append(self.kept.select("__file", "shard", "n"))
        if new is not None:
            here = located(new)
            rows.append(here)
            manifest.append(here.groupBy("__file", "shard").agg(F.count(F.lit(1)).alias("n")))
        files = manifest[0] if len(manifest) == 1 else manifest[0].unionByName(manifest[1])
        files = written(files, "shard-files")  # a row for each file
        before = F.sum("n").over(Window.partitionBy("shard").orderBy("__file")) - F.col("n")
        first = files.select("__file", before.alias("__first"))
        out = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        return out.join(first, "__file").withColumn("slot", (F.col("__first") + F.col("__row")).cast("long")).drop("__file", "__row", "__first")


def reshard_files(spark: SparkSession, old: str, new: str, capacity: list[int]) -> DataFrame:
    """Reshard a folder of shards (shard=0 and so on under old) in place: only files that lose rows are rewritten, under new. Returns shard and file: the files that make up each shard now. Files of old that aren't named can go."""
    plan = Resharding(spark.read.parquet(old).withColumnRenamed("shard", "__was"), len(capacity), capacity, "__was")
    rewritten = plan.rewrite(new)
    files = plan.kept.select("shard", F.col("__file").alias("file"))
    if rewritten is not None:
        files = files.unionByName(located(rewritten).select("shard", F.col("__file").alias("file")).distinct())
    return files


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of all documents, read from the shards' files after the resharding."""
    plan = Resharding(only(docs, "doc_id", "text"), shards)
    rows = plan.placed(new_folder(docs.sparkSession, "shards"))
    return rows.select("doc_id", size_of().alias("size"), crc_of().alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
