"""A peer's change log as a stream whose offsets are its marks ``(timestamp, id)`` (R2).

A log is a folder of Parquet files that only grows. Entries are ordered by ``timestamp``, then ``id``; a mark names the last one that was
pulled, so entries that share a timestamp are neither lost nor repeated where a pull ends between them. An offset is a mark, which
Spark keeps in the checkpoint. A file is a partition, left out where its statistics say that it holds nothing new; inside, row
groups are left out likewise.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

#: Before all entries.
START = {"timestamp": -(2**63), "id": ""}


def _dataset(path: str) -> pads.Dataset:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    fs, root = (pafs.LocalFileSystem(), path) if "://" not in path else pafs.FileSystem.from_uri(path)
    return pads.dataset(root, filesystem=fs, format="parquet")


def _span(fragment: pads.ParquetFileFragment) -> tuple[int, int] | None:
    """The least and greatest timestamp of a file by its statistics; none if it is empty, all there are if it doesn't tell."""
    meta, at = fragment.metadata, fragment.physical_schema.get_field_index("timestamp")
    stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
    if not stats:
        return None
    if any(s is None or not s.has_min_max for s in stats):
        return -(2**63), 2**63 - 1
    return min(s.min for s in stats), max(s.max for s in stats)


@dataclass
class Part(InputPartition):
    file: str
    start: dict
    end: dict


class ChangeLogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.start = {"timestamp": int(options.get("timestamp", START["timestamp"])), "id": options.get("id", START["id"])}

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        spans = [(s, f) for f in _dataset(self.path).get_fragments() if (s := _span(f))]
        tops = sorted({s[1] for s, _ in spans}, reverse=True)
        for top in tops[:1]:
            best = None
            for s, f in spans:
                if s[1] >= top:
                    t = f.to_table(columns=["timestamp", "id"], filter=pc.field("timestamp").is_valid() & pc.field("id").is_valid())
                    newest = pc.max(t.column("timestamp")).as_py()
                    if newest is not None:
                        last = pc.max(t.filter(pc.equal(t.column("timestamp"), newest)).column("id")).as_py()
                        best = max(best or (newest, last), (newest, last))
            if best:
                return {"timestamp": best[0], "id": best[1]}
        return self.start

    def partitions(self, start: dict, end: dict):
        found = [(f.path, s) for f in _dataset(self.path).get_fragments() if (s := _span(f))]
        return [Part(p, start, end) for p, (low, high) in found if high >= start["timestamp"] and low <= end["timestamp"]]

    def read(self, partition: Part):
        t, i, a, b = pc.field("timestamp"), pc.field("id"), partition.start, partition.end
        after = (t > a["timestamp"]) | ((t == a["timestamp"]) & (i > a["id"]))
        upto = (t < b["timestamp"]) | ((t == b["timestamp"]) & (i <= b["id"]))
        for f in _dataset(self.path).get_fragments():
            if f.path == partition.file:
                yield from f.to_batches(filter=after & upto & i.is_valid())


class ChangeLog(DataSource):
    """Format ``changelog``. Options: ``path``, and ``timestamp`` and ``id`` of the mark to begin after."""

    @classmethod
    def name(cls):
        return "changelog"

    def schema(self):
        return from_arrow_schema(pa.schema([f for f in _dataset(self.options["path"]).schema]))

    def streamReader(self, schema):
        return ChangeLogReader(self.options)


def pull_stream(spark: SparkSession, path: str, mark: tuple[int, str] | None = None) -> DataFrame:
    """R2 as a stream: a log's entries after ``mark``, or all; ``timestamp`` is a long and ``id`` a string, and rows without either are left out."""
    spark.dataSource.register(ChangeLog)
    r = spark.readStream.format("changelog")
    return (r.option("timestamp", mark[0]).option("id", mark[1]) if mark else r).load(path)
