"""An index folder: bucketed tables and one manifest that names their parts.

Documents and chunks are split in buckets by document.  An update writes only
the buckets it touches to a new version folder; replacing the manifest file is
the single step that makes it visible, so readers and failed updates always
see a whole index.

Postings are bucketed by token, and one document has tokens of nearly every bucket.
So an update adds a segment with the postings of its new chunks, the ids of the chunks
that are gone, and what both change in the counts of tokens; totals are in the
manifest.  When there are ``MERGE_AT`` segments, or a quarter of the chunks in them
are gone, the update writes one segment of all chunks instead.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import NavigationError
from lodestone.operators.postings import Inverted, passage_totals, read_segments, write_segment
from lodestone.sources.schema import DOCUMENTS, SCHEMA_VERSION, upgraded

BUCKETS = 64
CHUNKS = (
    "collection_id string, source_id string, document_key string, display_path string, "
    "document_tags array<string>, chunk_id bigint, ordinal int, heading array<string>, "
    "start_line int, end_line int, content string, content_hash string, "
    "embedding array<float>, heading_terms array<string>, content_terms array<string>, "
    "heading_tokens array<string>, content_tokens array<string>, doc_len int"
)
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS}
MERGE_AT = 8
DEAD_SHARE = 0.25
#: Segments' folders, folders of ids of chunks that are gone, and totals of what is left.
NO_SEGMENTS = {"segments": [], "dead": [], "dead_chunks": 0, "passages": 0, "tokens": 0}


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("source_id", "document_key"), F.lit(buckets)).cast("int")


class IndexStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.manifest = self._load() or {
            "version": 0,
            "schema_version": SCHEMA_VERSION,
            "buckets": buckets,
            "next_chunk_id": 1,
            "metadata": {},
            "sources": [],
            "parts": {name: {} for name in TABLES},
            **NO_SEGMENTS,
        }
        if self.manifest["schema_version"] > SCHEMA_VERSION:
            raise NavigationError("INDEX_DATA_INVALID", "The index was made by a newer version.")

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    @property
    def exists(self) -> bool:
        return self.manifest["version"] > 0

    def _files(self):
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(os.path.join(self.path, "manifest.json"))
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _load(self) -> dict | None:
        target, files = self._files()
        if not files.exists(target):
            return None
        text = self.spark.read.text(target.toString(), wholetext=True).first()
        return json.loads(text.value)

    def _save(self, manifest: dict) -> None:
        """Write the manifest beside the old one and rename over it.

        An index that someone else published meanwhile is left as it is. Renaming is
        one step on HDFS and local disks; object stores need a committer for that.
        """
        target, files = self._files()
        current = (self._load() or {"version": 0})["version"]
        if current != self.manifest["version"]:
            raise NavigationError(
                "INDEX_DATA_INVALID", f"The index changed meanwhile, to version {current}."
            )
        jvm = self.spark._jvm
        fresh = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.{uuid.uuid4().hex}")
        stream = files.create(fresh, True)
        stream.write(bytearray(json.dumps(manifest, indent=1).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            files.getUri(), self.spark._jsc.hadoopConfiguration()
        )
        overwrite = self.spark.sparkContext._gateway.new_array(
            jvm.org.apache.hadoop.fs.Options.Rename, 1
        )
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, target, overwrite)
        self.manifest = manifest

    def table(self, name: str, only: list[int] | None = None) -> DataFrame:
        """A stored table, or some of its buckets."""
        by_folder: dict[str, list[str]] = {}
        for bucket, folder in self.manifest["parts"].get(name, {}).items():
            if only is None or int(bucket) in only:
                by_folder.setdefault(folder, []).append(bucket)
        frames = [
            self.spark.read.schema(TABLES[name]).parquet(
                *[os.path.join(self.path, folder, f"bucket={b}") for b in buckets]
            )
            for folder, buckets in by_folder.items()
        ]
        if not frames:
            return self.spark.createDataFrame([], TABLES[name])
        found = reduce(DataFrame.unionByName, frames)
        return upgraded(found, self.manifest["schema_version"]) if name == "documents" else found

    def passages(self) -> DataFrame:
        """Chunks with the current tags of their source, ready for search."""
        tags = [(s["id"], list(s["tags"])) for s in self.manifest["sources"]]
        owners = self.spark.createDataFrame(tags, "source_id string, source_tags array<string>")
        # One row per configured source.
        return self.table("chunks").join(F.broadcast(owners), "source_id")

    def inverted(self) -> Inverted | None:
        """The stored inverted index; none in an index that an older version made."""
        if "segments" not in self.manifest:
            return None
        held = self.manifest
        dead = None
        if held["dead"]:
            folders = [os.path.join(self.path, folder) for folder in held["dead"]]
            dead = self.spark.read.schema("chunk_id bigint").parquet(*folders)
        segments = [os.path.join(self.path, folder) for folder in held["segments"]]
        totals = held["passages"], held["tokens"]
        return read_segments(self.spark, segments, totals, self.table("chunks"), dead)

    def add_segment(self, fresh: DataFrame, gone: DataFrame, chunks: DataFrame) -> dict:
        """Write what ``fresh`` chunks add and ``gone`` chunks take away; manifest entries.

        ``chunks`` are all chunks after the update, which a merged segment is made of.
        """
        folder = f"postings/v{self.manifest['version'] + 1}-{uuid.uuid4().hex[:8]}"
        where = os.path.join(self.path, folder)
        old = {**NO_SEGMENTS, **self.manifest}
        added, removed = passage_totals(fresh), passage_totals(gone)
        dead_chunks = old["dead_chunks"] + removed[0]
        known = "segments" in self.manifest
        passages = old["passages"] + added[0] - removed[0]
        many = len(old["segments"]) + 1 >= MERGE_AT
        if not known or many or dead_chunks > DEAD_SHARE * (passages + dead_chunks):
            write_segment(chunks, where)
            totals = (passages, old["tokens"] + added[1] - removed[1]) if known else passage_totals(chunks)
            return {**NO_SEGMENTS, "segments": [folder], "passages": totals[0], "tokens": totals[1]}
        write_segment(fresh, where, gone)
        dead = list(old["dead"])
        if removed[0]:
            gone.select("chunk_id").write.parquet(os.path.join(where, "dead"))
            dead.append(f"{folder}/dead")
        return {
            "segments": [*old["segments"], folder],
            "dead": dead,
            "dead_chunks": dead_chunks,
            "passages": passages,
            "tokens": old["tokens"] + added[1] - removed[1],
        }

    def commit(
        self,
        frames: dict[str, DataFrame],
        touched: list[int],
        metadata: dict[str, str],
        sources: list[dict],
        new_chunks: int,
        segments: dict | None = None,
    ) -> None:
        """Replace the touched buckets of every table and publish the result.

        ``segments`` are the manifest entries of the update's postings.
        """
        version = self.manifest["version"] + 1
        # A folder of its own: another writer of this version cannot touch it.
        written_by = uuid.uuid4().hex[:8]
        parts = {}
        for name, frame in frames.items():
            folder = f"{name}/v{version}-{written_by}"
            kept = {
                b: f
                for b, f in self.manifest["parts"].get(name, {}).items()
                if int(b) not in touched
            }
            if touched:
                where = os.path.join(self.path, folder)
                rows = frame.withColumn("bucket", bucket_of(self.buckets))
                # Rebalancing gives big buckets several tasks and small ones a
                # shared task.
                rows.hint("rebalance", "bucket").sortWithinPartitions(
                    "bucket", "display_path"
                ).write.partitionBy("bucket").parquet(where)
                shape = f"{TABLES[name]}, bucket int"  # a folder without rows has none
                stored = self.spark.read.schema(shape).parquet(where)
                written = stored.select("bucket").distinct().collect()
                kept.update({str(row.bucket): folder for row in written})
            parts[name] = kept
        self._save(
            {
                **self.manifest,
                "version": version,
                "schema_version": SCHEMA_VERSION,
                "next_chunk_id": self.manifest["next_chunk_id"] + new_chunks,
                "metadata": {**self.manifest["metadata"], **metadata},
                "sources": sources,
                "parts": parts,
                **(segments or {}),
            }
        )
