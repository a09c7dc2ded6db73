"""The catalog: four Parquet tables under a folder, each change written as a new snapshot that a new pointer file then names.

Pointers are numbered and never removed or replaced, the last one counts: a writer that stops halfway leaves the snapshot before it,
and of two writers one fails. Readers keep the snapshot they started with. Uses of GOPs are appended to a log beside the snapshot,
which is folded in when GOPs are written again. Paths may be of any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "logical_videos": "id long, name string, budget double",
    "physical_videos": "id long, logical_id long, height int, width int, codec string, gop_size int, mdat_offset long, filename string, headers binary, folder string",
    "gops": (
        "id long, physical_id long, filename string, start_us long, end_us long, start_byte long, end_byte long, size long, cluster_id int, joint boolean, examined int, "
        "histogram array<float>, zstandard int, original_size long, clock long, fps int, mse double, estimated_mse double, parent_id long, piece long"
    ),
    "aborted_pairs": "gop1 long, gop2 long",
}


class Catalog:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def _pointers(self) -> list[str]:
        """Names of the pointer files, the last one at the end."""
        fs, folder = self._fs()
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted(x for x in names if x.startswith("CURRENT-"))

    def _current(self) -> dict[str, str]:
        """The folder of each table, and that of the log of uses."""
        pointers = self._pointers()
        if not pointers:
            return {}
        rows = self.spark.read.text(f"{self.path}/{pointers[-1]}").collect()
        return dict(row["value"].split("=", 1) for row in rows)

    def read(self, table: str) -> DataFrame:
        current = self._current()
        if table not in current:
            return self.spark.createDataFrame([], SCHEMAS[table])
        rows = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{current[table]}")
        fs, folder = self._fs()
        if table == "gops" and "uses" in current and fs.exists(folder.suffix(f"/{current['uses']}")):
            uses = self.spark.read.schema("id long, used long").parquet(f"{self.path}/{current['uses']}").groupBy("id").agg(F.max("used").alias("used"))
            rows = rows.join(uses, "id", "left").withColumn("clock", F.greatest("clock", "used")).select(*rows.columns)
        return rows

    def used(self, ids: list[int], clock: int) -> None:
        """Notes the use of GOPs: some rows are appended, no table is written again."""
        rows = self.spark.createDataFrame([(x, clock) for x in ids], "id long, used long")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/{self._current()['uses']}")

    def write(self, **tables: DataFrame) -> None:
        """Replaces the given tables together: all are written, then the pointer moves."""
        current = self._current()
        for table, rows in tables.items():
            folder = f"{table}/{uuid.uuid4().hex}"
            columns = self.spark.createDataFrame([], SCHEMAS[table]).schema
            rows.select(*[rows[field.name].cast(field.dataType).alias(field.name) for field in columns]).write.parquet(f"{self.path}/{folder}")
            current[table] = folder
        if "gops" in tables:
            current["uses"] = f"uses/{uuid.uuid4().hex}"
        fs, folder = self._fs()
        pointers = self._pointers()
        number = int(pointers[-1].split("-")[1]) + 1 if pointers else 1
        new, pointer = folder.suffix(f"/.new-{uuid.uuid4().hex}"), folder.suffix(f"/CURRENT-{number:012d}")
        stream = fs.create(new, True)
        stream.write(bytearray("\n".join(f"{k}={v}" for k, v in sorted(current.items())).encode()))
        stream.close()
        if fs.exists(pointer) or not fs.rename(new, pointer):
            raise RuntimeError("another writer has changed the catalog")

    def append(self, table: str, rows: DataFrame) -> None:
        self.write(**{table: self.read(table).unionByName(rows, allowMissingColumns=True)})

    def next_id(self, table: str) -> int:
        return (self.read(table).agg({"id": "max"}).first()[0] or 0) + 1

    def clear(self) -> None:
        fs, folder = self._fs()
        fs.delete(folder, True)
