"""Corpus-wide counts of hashed keys, returned to the documents that hold the keys.

A unit is a run of documents of one partition.  Each unit sends its distinct keys, sorted and coded as gaps, with its own
counts; the keys of a range meet in one task, which adds the counts and answers each unit in the order of its keys.  The
answers lie in the shared folder, sorted by partition and unit; a second pass over the same documents reads its own, unit
by unit.  Keys are counted within a unit first, so a key that all documents hold is sent once a unit.

Both passes must see the same partitions: stable() passes scans of files through and writes anything else first.  Each
answer carries the number and a checksum of its keys; a pass that sees other keys fails.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanengine.llm import textvec as tv
from scanengine.llm.shared import scratch, written
from scanengine.llm.warc import file_system

MESSAGE = "bucket int, family int, pid long, unit int, keys binary, counts array<binary>"
REPLY = "pid long, unit int, bucket int, family int, n long, sum long, counts array<binary>, stats array<long>"

#: A unit's keys of each family: sorted distinct keys and one or more arrays of counts.
Families = list[tuple[np.ndarray, list[np.ndarray]]]


def stable(docs: DataFrame, name: str) -> DataFrame:
    """docs with partitions that every pass sees alike."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = [line.strip(" +-:").split(" ")[0].split("(")[0] for line in plan.splitlines() if line.strip()]
    if all(n in ("Project", "Relation", "RelationV2") or n.startswith("Relation") for n in nodes):
        return docs
    return written(docs, name)


class _Runs:
    """Runs of documents of about unit_bytes of text, wherever batches end; a row is never cut."""

    def __init__(self, text: str, unit_bytes: int):
        self.text, self.most = text, unit_bytes
        self.held: list[pa.RecordBatch] = []
        self.size = self.given = 0

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
        if not batch.num_rows:
            return
        _, off = tv.text_bytes(batch.column(batch.schema.get_field_index(self.text)))
        ends = off[1:] + self.size
        start = 0
        while start < batch.num_rows:
            cut = int(np.searchsorted(ends, self.most))
            if cut >= batch.num_rows:
                self.held.append(batch.slice(start))
                self.size = int(ends[-1])
                return
            self.held.append(batch.slice(start, cut + 1 - start))
            ends = ends - ends[cut]
            start = cut + 1
            yield from self.rest()

    def rest(self) -> Iterator[tuple[int, pa.Table]]:
        if self.held:
            table, self.held, self.size = pa.Table.from_batches(self.held), [], 0
            self.given += 1
            yield self.given - 1, table


def units(batches: Iterator[pa.RecordBatch], text: str, unit_bytes: int, lane: str | None = None) -> Iterator[tuple[int, int, pa.Table]]:
    """(lane, unit, rows): runs of documents of each lane, numbered from 0."""
    runs = [_Runs(text, unit_bytes) for _ in range(1 if lane is None else 2)]
    for batch in batches:
        for k, run in enumerate(runs):
            some = batch if lane is None else batch.filter(pc.equal(batch.column(batch.schema.get_field_index(lane)), k))
            for u, table in run.add(some):
                yield k, u, table
    for k, run in enumerate(runs):
        for u, table in run.rest():
            yield k, u, table


def check_of(keys: np.ndarray) -> int:
    return zlib.crc32(keys.tobytes())


def cuts(keys: np.ndarray, first: int, last: int, step: int, buckets: int, bits: int) -> np.ndarray:
    """Where buckets first, first + step, ... below last begin among ascending keys, and where they end.  Bucket i of all
    `buckets` begins at the i-th of as many equal parts of the keys' range."""
    edge = (np.arange(first + step, last, step, dtype=np.float64) * (2.0**bits / buckets)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edge), [len(keys)]])


def key_bits(docs: DataFrame, text: str = "text") -> int:
    """A width at which about one key in 2^18 of the corpus meets another by chance."""
    total = docs.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
    return min(64, 18 + max(1, int(total / 6)).bit_length())


def messages(rows: list[tuple], family: int, pid: int, unit: int, keys: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
    """A message for each (bucket, from, to) of rows."""
    same = lambda x, kind: pa.array(np.full(len(rows), x), kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()),
            same(family, pa.int32()),
            same(pid, pa.int64()),
            same(unit, pa.int32()),
            pa.array([tv.pack(keys[i:j]) for _, i, j in rows], pa.binary()),
            pa.array([[tv.pack_counts(c[i:j]) for c in counts] for _, i, j in rows], pa.list_(pa.binary())),
        ],
        ["bucket", "family", "pid", "unit", "keys", "counts"],
    )


class Merged:
    """The messages of one group: their distinct keys with the sums of each count, and which of them each message holds.

    lanes: messages are of units of two lanes, the last bit of pid, and have one count; it is summed over all and over lane 1.
    """

    def __init__(self, table: pa.Table, lanes: bool):
        self.lanes = lanes
        table = table.sort_by([("pid", "ascending"), ("unit", "ascending")])
        parts = [tv.unpack(k.as_py()) for k in table["keys"]]
        self.table, self.edge = table, np.cumsum([0] + [len(k) for k in parts])
        self.checks = [check_of(k) for k in parts]
        keys = np.concatenate(parts)
        del parts
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        self.keys = keys[first]
        self.sums = []
        for k in range(len(table["counts"][0])):
            c = np.concatenate([tv.unpack_counts(row[k].as_py()) for row in table["counts"]])
            c = c[order]
            self.sums.append(np.add.reduceat(c, first) if len(first) else c)
        if lanes:
            one = np.repeat(table["pid"].to_numpy() % 2, np.diff(self.edge))[order].astype(np.uint64)
            self.sums.append(np.add.reduceat(c * one, first) if len(first) else c)
        self.back = np.empty(len(order), np.int32)
        self.back[order] = np.cumsum(new, dtype=np.int32) - 1

    def replies(self, totals: list[np.ndarray], stats: list[int] | None) -> pa.Table:
        """The totals of its own keys for each message, those of lane 1 only for messages of lane 1; with stats, a row of them
        beside."""
        t, many = self.table, self.table.num_rows
        more = 0 if stats is None else 1
        lane = t["pid"].to_numpy() % 2 if self.lanes else np.ones(many, np.int64)
        out = [[tv.pack_counts(s[self.back[i:j]]) for s in (totals if k else totals[:1])] for i, j, k in zip(self.edge, self.edge[1:], lane)]
        return pa.table(
            {
                "pid": pa.array([*t["pid"].to_pylist(), -1][: many + more], pa.int64()),
                "unit": pa.array([*t["unit"].to_pylist(), -1][: many + more], pa.int32()),
                "bucket": pa.array([*t["bucket"].to_pylist(), t["bucket"][0].as_py()][: many + more], pa.int32()),
                "family": pa.array([*t["family"].to_pylist(), t["family"][0].as_py()][: many + more], pa.int32()),
                "n": pa.array([*np.diff(self.edge).tolist(), len(self.keys)][: many + more], pa.int64()),
                "sum": pa.array([*self.checks, 0][: many + more], pa.int64()),
                "counts": pa.array([*out, None][: many + more], pa.list_(pa.binary())),
                "stats": pa.array([*[None] * many, stats][: many + more], pa.list_(pa.int64())),
            }
        )


class Exchange:
    """The counts of one set of families over docs.

    families(table) gives a unit's keys; it must depend on the table's rows alone.  bits: width of each family's keys.
    lane: a column of 0 and 1, or None; rows of lane 1 make units of their own, so that each() can read them alone.  With
    lanes there is one count, whose sums over all rows, and for units of lane 1 also over rows of that lane, come back.

    The range of keys is cut into buckets that receive about keys_a_bucket keys each (words of three bytes or more
    assumed; shorter ones at most double it).  Up to fan_out buckets, units write to them directly.  More would leave a
    message with few keys: then units write to fan_out coarse ranges, groups of partitions add up what they send to a
    range, and send on to the buckets within it; replies return the same way.  So messages keep their size, and their
    number grows with the corpus.
    """

    def __init__(
        self,
        docs: DataFrame,
        families: Callable[[pa.Table], Families],
        bits: list[int],
        text: str = "text",
        unit_bytes: int = 4 << 20,
        keys_a_bucket: int = 1_000_000,
        fan_out: int = 4096,
        lane: str | None = None,
    ):
        self.docs, self.families, self.bits, self.text, self.unit_bytes, self.lane = docs, families, bits, text, unit_bytes, lane
        total = docs.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"]
        want = max(8, int(total / 4 / keys_a_bucket) + 1)
        #: how many buckets lie in a coarse range, and all of them
        self.inner = -(-want // fan_out)
        self.buckets = self.inner * min(want, fan_out)
        self.path = scratch(docs.sparkSession, "answers")
        self._answer()

    def _answer(self) -> None:
        families, bits, text, unit_bytes, buckets, inner, lane = self.families, self.bits, self.text, self.unit_bytes, self.buckets, self.inner, self.lane

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            pid = 2 * TaskContext.get().partitionId()
            for k, u, table in units(batches, text, unit_bytes, lane):
                for f, (keys, counts) in enumerate(families(table)):
                    cut = cuts(keys, 0, buckets, inner, buckets, bits[f])
                    rows = [(b, cut[b], cut[b + 1]) for b in range(buckets // inner) if cut[b + 1] > cut[b]]
                    for at in range(0, len(rows), 256):
                        yield messages(rows[at : at + 256], f, pid + k, u, keys, counts)

        lanes, direct = lane is not None, lane is not None and inner == 1

        def add(table: pa.Table) -> pa.Table:
            m = Merged(table, direct)
            # beside the answers a row of totals: for each count its sum and how many keys have any
            return m.replies(m.sums, [int(x) for s in m.sums for x in (s.sum(), (s > 0).sum())])

        def on(table: pa.Table) -> pa.Table:
            """A group's messages to one coarse range, added up, to the buckets in it; the group takes the part of a
            partition and the range that of a unit."""
            m, coarse, f = Merged(table, lanes), table["bucket"][0].as_py(), table["family"][0].as_py()
            cut = cuts(m.keys, coarse * inner, (coarse + 1) * inner, 1, buckets, bits[f])
            rows = [(coarse * inner + b, cut[b], cut[b + 1]) for b in range(inner) if cut[b + 1] > cut[b]]
            return pa.Table.from_batches([messages(rows, f, table["group"][0].as_py(), coarse, m.keys, m.sums)])

        def back(asked: pa.Table, answers: pa.Table) -> pa.Table:
            m = Merged(asked, lanes)
            rows = answers.sort_by("bucket")["counts"]
            totals = [np.concatenate([tv.unpack_counts(r[k].as_py()) for r in rows]) for k in range(len(m.sums))]
            return m.replies(totals, None)

        asked = self.docs.mapInArrow(ask, MESSAGE)
        if inner == 1:
            answers = asked.groupBy("bucket", "family").applyInArrow(add, REPLY)
        else:
            asked = written(asked.withColumn("group", F.col("pid") % inner), "asked")
            sent = asked.groupBy("bucket", "family", "group").applyInArrow(on, MESSAGE)
            found = written(sent.groupBy("bucket", "family").applyInArrow(add, REPLY), "found")
            there = found.where("pid >= 0").select(F.col("unit").alias("range"), "family", F.col("pid").alias("group"), "bucket", "counts")
            both = asked.withColumn("range", F.col("bucket")).groupBy("range", "family", "group").cogroup(there.groupBy("range", "family", "group"))
            answers = both.applyInArrow(back, REPLY).unionByName(found.where("pid < 0"))
        # the answers of a few partitions a file, of 64 at the most, in their order, and the totals in one of their own; small
        # row groups, so that a reader skips what is not its own
        parts = self.docs._jdf.queryExecution().toRdd().getNumPartitions()
        n = max(1, min(1024, -(-parts // 4)), -(-parts // 64))
        place = F.when(F.col("pid") < 0, n).otherwise(F.shiftright("pid", 1) % n).cast("int")
        answers = answers.repartitionById(n + 1, place).sortWithinPartitions("pid", "unit", "family", "bucket")
        answers.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(self.path)
        files, base = file_system(self.path)
        found: dict[int, list[str]] = {}
        for info in files.get_file_info(fs.FileSelector(base)):
            if m := re.match(r"part-(\d+)-.*\.parquet$", info.base_name):
                found.setdefault(int(m[1]), []).append(info.path)
        self.n, self.found = n, {k: sorted(v) for k, v in found.items()}

    def totals(self, family: int, count: int) -> tuple[int, int]:
        """The sum of one count over all keys of a family, and how many keys have any."""
        spark = self.docs.sparkSession
        if self.n not in self.found:
            return 0, 0
        rows = spark.read.schema(REPLY).parquet(*[f"{self.path}/{os.path.basename(x)}" for x in self.found[self.n]]).where((F.col("pid") < 0) & (F.col("family") == family))
        got = rows.agg(F.sum(F.get("stats", F.lit(2 * count))).alias("a"), F.sum(F.get("stats", F.lit(2 * count + 1))).alias("b")).first()
        return got["a"] or 0, got["b"] or 0

    def each(self, work: Callable[[pa.Table, Families, list[list[np.ndarray]]], pa.RecordBatch | None], schema: str, only: int | None = None) -> DataFrame:
        """work(rows, own keys, corpus counts of those keys by family) for each unit, as a DataFrame of `schema`; only: of
        one lane."""
        families, text, unit_bytes, path, buckets, inner, bits, lane = self.families, self.text, self.unit_bytes, self.path, self.buckets, self.inner, self.bits, self.lane

        found, n = self.found, self.n

        def answered(pid: int) -> Iterator[dict]:
            """A partition's answers in the order of units, families and buckets, a few at a time."""
            import pyarrow.parquet as pq

            files, _ = file_system(path)

            def rows(name: str) -> Iterator[dict]:
                with files.open_input_file(name) as source:
                    f = pq.ParquetFile(source)
                    at = f.schema_arrow.get_field_index("pid")
                    for k in range(f.num_row_groups):
                        span = f.metadata.row_group(k).column(at).statistics
                        if span is None or not span.has_min_max or span.min <= pid <= span.max:
                            for batch in f.iter_batches(batch_size=64, row_groups=[k], use_threads=False):
                                yield from batch.filter(pc.equal(batch.column(at), pid)).to_pylist()

            return heapq.merge(*map(rows, found.get((pid >> 1) % n, [])), key=lambda r: (r["unit"], r["family"], r["bucket"]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            got: dict[int, Iterator[dict]] = {}
            for k, u, table in units(batches, text, unit_bytes, lane):
                if k not in got:
                    got[k] = answered(2 * TaskContext.get().partitionId() + k)
                own = families(table)
                totals = []
                for f, (keys, counts) in enumerate(own):
                    cut = cuts(keys, 0, buckets, inner, buckets, bits[f])
                    parts: list[list[np.ndarray]] = [[] for _ in range(len(counts) + (k if lane is not None else 0))]
                    for b in range(buckets // inner):
                        if cut[b + 1] > cut[b]:
                            row = next(got[k], None)
                            if row is None or (row["unit"], row["family"], row["bucket"], row["n"], row["sum"]) != (u, f, b, cut[b + 1] - cut[b], check_of(keys[cut[b] : cut[b + 1]])):
                                raise RuntimeError("the documents of this partition changed between two passes")
                            for j, c in enumerate(row["counts"]):
                                parts[j].append(tv.unpack_counts(c))
                    totals.append([np.concatenate(p) if p else np.zeros(0, np.uint64) for p in parts])
                out = work(table, own, totals)
                if out is not None and out.num_rows:
                    yield out

        rows = self.docs if only is None else self.docs.where(F.col(lane) == only)
        return rows.mapInArrow(run, schema)
