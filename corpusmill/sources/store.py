"""A store of samples that goes on where it stopped: ids, seen keys and counts survive any interruption.

Rows lie in folders of Parquet files. A manifest for each version lists the folders that count, the next id
and the rows by source and split; it takes its name by a rename once its rows are written. A run that
stops before that leaves a folder that no manifest lists: the next run does not see it and gives the same
ids again. Seen keys are columns of the rows and are met by joins; nothing but counts reaches the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_of_each
from ..operators.tables import number_rows, rank_in_groups, written

EMPTY = {"version": 0, "next_id": 1, "folders": [], "counts": []}


class SampleStore:
    """Samples under `path`. Rows have a document id, a hash of their text, a source and a split."""

    def __init__(self, spark: SparkSession, path: str, *, id_col: str = "sample_id", hash_col: str = "hash", document: str = "document_id", source: str = "source", split: str = "split"):
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col
        self.hash, self.document, self.source, self.split = hash_col, document, source, split
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The last version's."""
        found = self._fs.globStatus(self._at(f"{self.path}/manifests/*.json")) or []
        paths = sorted(f.getPath().toString() for f in found)
        return json.loads(self.spark.read.text(paths[-1], wholetext=True).first()[0]) if paths else dict(EMPTY)

    def read(self, version: dict | None = None) -> DataFrame | None:
        """The rows of a version, the last one's if none is given; None as long as there are none."""
        folders = (version or self.manifest())["folders"]
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else None

    def counts(self) -> dict[str, int]:
        """Rows by source, from the manifest alone."""
        out: dict[str, int] = {}
        for c in self.manifest()["counts"]:
            out[c["source"]] = out.get(c["source"], 0) + c["n"]
        return out

    def add(self, rows: DataFrame, order: Sequence[str], target: int | None = None) -> dict:
        """Adds what is new, in `order`, and returns the new manifest.

        A document that is in the store is not added to; a text that is there, or came before in `order`,
        is left out; each source is filled up to `target` rows. Ids follow on in `order`, which should
        leave no ties. Without new rows the version stays.
        """
        last = self.manifest()
        there = self.read(last)
        if there is not None:
            rows = rows.join(there.select(self.document).distinct(), self.document, "left_anti")
            rows = rows.join(there.select(self.hash).distinct(), self.hash, "left_anti")
        rows = first_of_each(rows, self.hash, order).select(*rows.columns)
        if target is not None:
            held: dict = {}
            for c in last["counts"]:
                held[c["source"]] = held.get(c["source"], 0) + c["n"]
            full = F.lit(target)
            for name, n in held.items():  # sources are few
                full = F.when(F.col(self.source).eqNullSafe(F.lit(name)), F.lit(target - n)).otherwise(full)
            rows = rank_in_groups(rows, self.source, order, "_rank").where(F.col("_rank") <= full).drop("_rank")
        folder = f"{last['version'] + 1:010d}-{uuid.uuid4().hex}"
        number_rows(rows, order, last["next_id"], self.id_col).write.parquet(f"{self.path}/data/{folder}")
        new = self.spark.read.parquet(f"{self.path}/data/{folder}")
        added = [r.asDict() for r in new.groupBy(F.col(self.source).alias("source"), F.col(self.split).alias("split")).agg(F.count(F.lit(1)).alias("n")).collect()]
        if not added:
            return last
        counts: dict = {}
        for c in [*last["counts"], *added]:
            counts[c["source"], c["split"]] = counts.get((c["source"], c["split"]), 0) + c["n"]
        manifest = {
            "version": last["version"] + 1,
            "next_id": last["next_id"] + sum(c["n"] for c in added),
            "folders": [*last["folders"], folder],
            "counts": [{"source": s, "split": p, "n": n} for (s, p), n in sorted(counts.items(), key=str)],
        }
        self._commit(manifest)
        return manifest

    def _commit(self, manifest: dict) -> None:
        """The manifest takes its name when it is whole; of two runs that write one version the second fails."""
        final = self._at(f"{self.path}/manifests/{manifest['version']:010d}.json")
        new = self._at(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(new, False)
        out.write(json.dumps(manifest, ensure_ascii=False).encode())
        out.close()
        if self._fs.exists(final) or not self._fs.rename(new, final):
            self._fs.delete(new, False)
            raise RuntimeError(f"version {manifest['version']} was written by another run; add again")
