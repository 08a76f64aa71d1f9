"""A store: a write-ahead log and segments as Parquet folders, under one manifest.

The manifest names every folder that counts. A commit writes its folders first
and then publishes the next manifest under a name of its own, which fails if
that name is taken; so a crash leaves the version before, and of two writers
one has to read the store again. Segment ids come from the manifest and not
from a clock. Folders that no manifest names are never read. A merge deletes
nothing, as views of older versions may still be read; ``vacuum`` does, after a
time of grace. All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tombolo.operators import changelog, replay, segments
from tombolo.schema import CHANGE, SEGMENT


class Conflict(Exception):
    """Another writer has committed since this store was read."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    flush_no: int = 0
    next_seq: int = 0
    next_segment: int = 0
    wal: tuple[str, ...] = ()
    segments: tuple[tuple[int, str], ...] = field(default=())
    #: the last batch of each stream whose changes are in the store
    batches: tuple[tuple[str, int], ...] = field(default=())


class Store:
    def __init__(self, spark: SparkSession, path: str, truncate: bool = False, flush_bytes: int = segments.FLUSH_BYTES, compact_every: int = segments.COMPACT_EVERY):
        """Open or create the store at ``path``; ``truncate`` drops the log and keeps the segments."""
        self.spark, self.path = spark, path.rstrip("/")
        self.flush_bytes, self.compact_every = flush_bytes, compact_every
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._root.getFileSystem(self._conf)
        self._fs.mkdirs(self._at("manifest"))
        self.manifest = self._newest()
        if truncate and self.manifest.wal:
            self._commit(replace(self.manifest, wal=()))

    # -- files and the manifest ---------------------------------------------------

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _newest(self) -> Manifest:
        names = [s.getPath() for s in self._fs.listStatus(self._at("manifest")) if s.getPath().getName().endswith(".json")]
        if not names:
            return Manifest()
        last = max(names, key=lambda p: p.getName())
        stream = self._fs.open(last)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        d = json.loads(text)
        return Manifest(**d | {"wal": tuple(d["wal"]), "segments": tuple((i, p) for i, p in d["segments"]), "batches": tuple((n, i) for n, i in d["batches"])})

    def _commit(self, new: Manifest) -> None:
        """Publish ``new`` as the next version; fails if that version exists."""
        new = replace(new, version=self.manifest.version + 1)
        hidden = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        try:
            out.write(bytearray(json.dumps(asdict(new)).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()).toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(hidden, self._at(f"manifest/{new.version:020d}.json"), options)
        except Exception as e:
            self._fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {new.version} of {self.path} exists") from e
            raise
        self.manifest = new

    def refresh(self) -> None:
        self.manifest = self._newest()

    def _folder(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    # -- reading ------------------------------------------------------------------

    def wal(self) -> DataFrame:
        """The changes since the last flush."""
        if not self.manifest.wal:
            return self.spark.createDataFrame([], CHANGE)
        return self.spark.read.schema(CHANGE).parquet(*[f"{self.path}/{p}" for p in self.manifest.wal])

    def segments(self) -> DataFrame:
        """All segments, with their ids."""
        parts = [self.spark.read.schema(CHANGE).parquet(f"{self.path}/{p}").withColumn("segment_id", F.lit(i).cast("long")) for i, p in self.manifest.segments]
        out = self.spark.createDataFrame([], SEGMENT)
        for p in parts:
            out = out.unionByName(p)
        return out

    def changes(self) -> DataFrame:
        """The log and all segments as one changelog; the sequence numbers give precedence."""
        paths = [f"{self.path}/{p}" for p in (*self.manifest.wal, *[p for _, p in self.manifest.segments])]
        return self.spark.read.schema(CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGE)

    def live(self) -> DataFrame:
        return changelog.live(self.changes())

    def get(self, key: str) -> str | None:
        """The value of one key. The filter is pushed to Parquet, whose statistics and bloom filters skip row groups."""
        row = changelog.get(self.changes(), key).first()
        return row["value"] if row else None

    def contains(self, key: str) -> bool:
        return self.get(key) is not None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return changelog.multi_get(self.changes(), keys)

    def as_of(self, seq: int) -> DataFrame:
        """Exact back to the last merge of segments, which drops older versions; a flush drops those inside its log."""
        return changelog.as_of(self.changes(), seq)

    def range_scan(self, low: str, high: str) -> DataFrame:
        return changelog.range_scan(self.changes(), low, high)

    def stats(self) -> dict:
        row = changelog.stats(self.changes()).first().asDict()
        return row | {"segments": len(self.manifest.segments), "flush_no": self.manifest.flush_no, "version": self.manifest.version, "wal_bytes": self.tracked_bytes()}

    def tracked_bytes(self) -> int:
        """Bytes of the log's present entries: every key once, with its last value."""
        return changelog.stats(self.wal()).first()["tracked_bytes"]

    # -- writing ------------------------------------------------------------------

    def append(self, changes: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Append changes (seq, op, key, value), whose ``seq`` orders them; they get numbers after all that are stored.

        ``batch``, a stream's name and the number of its batch, is recorded by
        the commit that publishes the changes.
        """
        base, folder = self.manifest.next_seq, self._folder("wal")
        checked = changes.select((F.col("seq") + F.lit(base)).alias("seq"), "op", "key", F.when(F.col("op") == changelog.SET, F.col("value")).alias("value"))
        checked.write.parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(CHANGE).parquet(f"{self.path}/{folder}").agg(F.max("seq").alias("last"), F.min("seq").alias("first")).first()
        new = self.manifest
        if batch:
            new = replace(new, batches=(*[b for b in new.batches if b[0] != batch[0]], batch))
        if written["last"] is not None:
            if written["first"] < base:
                raise ValueError("seq must not be negative")
            new = replace(new, wal=(*new.wal, folder), next_seq=written["last"] + 1)
        if new != self.manifest:
            self._commit(new)

    def write(self, *entries: tuple) -> None:
        """Append entries at hand: ("set", key, value) or ("delete", key), the latter also for keys that are absent."""
        rows = [(i, e[0], e[1], e[2] if len(e) > 2 else None) for i, e in enumerate(entries)]
        self.append(self.spark.createDataFrame(rows, CHANGE))

    def set(self, key: str, value: str) -> None:
        self.write((changelog.SET, key, value))

    def delete_if_present(self, key: str) -> bool:
        found = self.contains(key)
        if found:
            self.write((changelog.DELETE, key))
        return found

    def execute(self, lines: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Run a script (session, seq, line) and return its replies, which exist only once its changes are committed.

        A ``batch`` of a stream that the store has already is not run again: its
        replies are read back. Replies of a run that was not committed are
        overwritten.
        """
        folder = f"replies/{batch[0]}-{batch[1]:020d}" if batch else self._folder("replies")
        schema = replay.run_script(lines, self.live()).schema
        if not (batch and dict(self.manifest.batches).get(batch[0], -1) >= batch[1]):
            replay.run_script(lines, self.live()).write.mode("overwrite").parquet(f"{self.path}/{folder}")
            self.append(replay.effects(self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")), batch)
            self.maybe_flush()
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    # -- flush and compaction -------------------------------------------------------

    def _write_segment(self, rows: DataFrame) -> str:
        folder = self._folder("segments")
        ordered = rows.select("seq", "op", "key", "value").repartition("key").sortWithinPartitions("key")
        ordered.write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{folder}")
        return folder

    def flush(self) -> None:
        """The log's last change per key becomes a segment; every tenth flush merges all segments. An empty log counts as a flush, too."""
        m = self.manifest
        new = replace(m, flush_no=m.flush_no + 1, wal=())
        if m.wal:
            folder = self._write_segment(changelog.latest(self.wal()))
            new = replace(new, segments=(*m.segments, (m.next_segment, folder)), next_segment=m.next_segment + 1)
        self._commit(new)
        if self.manifest.flush_no % self.compact_every == 0:
            self.compact()

    def maybe_flush(self) -> bool:
        big = self.tracked_bytes() > self.flush_bytes
        if big:
            self.flush()
        return big

    def compact(self) -> None:
        """All segments become one, without tombstones; the log stays."""
        old = self.manifest.segments
        if not old:
            return
        merged = segments.compacted(self.segments())
        folder = self._write_segment(merged)
        empty = self.spark.read.schema(CHANGE).parquet(f"{self.path}/{folder}").isEmpty()
        kept = () if empty else ((self.manifest.next_segment, folder),)
        self._commit(replace(self.manifest, segments=kept, next_segment=self.manifest.next_segment + 1))

    def vacuum(self, grace_seconds: float = 24 * 3600) -> list[str]:
        """Delete the folders that the newest manifest does not name and that are older than the grace period; returns their names.

        The period has to be longer than any reader keeps a view and any writer
        takes for its commit.
        """
        self.refresh()
        named = {*self.manifest.wal, *[p for _, p in self.manifest.segments]}
        limit, gone = (time.time() - grace_seconds) * 1000, []
        for kind in ("wal", "segments"):
            if self._fs.exists(self._at(kind)):
                for status in self._fs.listStatus(self._at(kind)):
                    name = f"{kind}/{status.getPath().getName()}"
                    if name not in named and status.getModificationTime() <= limit:
                        self._fs.delete(status.getPath(), True)
                        gone.append(name)
        return gone
