"""Lines of text files in order, whatever tasks read them: ordered fingerprints, and records whose quotes span lines.

A text file is read in splits. A task numbers the lines of each of its splits; what all splits before add, a count of
lines or a state of quotes, comes from a small table with a row for each split, so a file of any size is read by many
tasks. Work tables are below the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import Scratch

#: Children of a node of the tree of hashes, and bytes of a hash.
FAN, BYTES = 1024, 16
SPLIT = ["file", "start"]


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[str, int]]]]:
    """Batches with the split of each row. A task reads its splits one after the other."""
    for b in batches:
        yield b, list(zip(b["file"].to_pylist(), b["start"].to_pylist(), strict=True))


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=BYTES).digest()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, n = None, 0
    for b, splits in _splits(batches):
        at = []
        for own in splits:
            split, n = own, n + 1 if own == split else 0
            at.append(n)
        hashes = [_hash((v or "").encode()) for v in b["value"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["file"], b["start"], b["size"], pa.array(at, pa.int64()), pa.array(hashes, pa.binary())], ["file", "start", "size", "at", "hash"])


@F.udf(T.BinaryType(), useArrow=False)
def _node(children: list) -> bytes:
    return _hash(b"".join(bytes(c["hash"]) for c in children))


def fingerprint(spark: SparkSession, path: str) -> str:
    """Size and content of a file, or of the files of a folder in the order of their names: the root of a tree of BLAKE2b hashes over its lines.

    Equal to ``fingerprint_of`` its bytes, at any path and with any splits; any change of a line or of their order
    changes it. Each line is hashed where it is read; only hashes are shuffled, ``FAN`` at most to one row.
    """
    scratch = Scratch(spark, "lines")
    try:
        lines = scratch.table(_scan(spark, path).mapInArrow(_hashed, "file string, start long, size long, at long, hash binary"), "hashes")
        counts = lines.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.max("size").alias("size"))
        before = counts.select(*SPLIT, (F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(*SPLIT)), F.lit(0)) - F.col("n")).alias("before"))  # a row for each split
        before = scratch.table(before, "before")
        nodes, total = lines.join(before, SPLIT).select((F.col("before") + F.col("at")).alias("i"), "hash"), counts.agg(F.sum("n")).first()[0] or 0
        size = counts.groupBy("file").agg(F.max("size").alias("size")).agg(F.sum("size")).first()[0] or 0
        level = 0
        while total > 1 or not level:
            parts = nodes.groupBy(F.floor(F.col("i") / FAN).alias("p")).agg(F.sort_array(F.collect_list(F.struct("i", "hash"))).alias("c"))
            nodes = scratch.table(parts.select(F.col("p").alias("i"), _node("c").alias("hash")), f"level-{level}")
            total, level = -(-total // FAN), level + 1
        root = nodes.first()
        return f"{size:x}-{bytes(root['hash']).hex() if root else _hash(b'').hex()}"
    finally:
        scratch.drop()


def fingerprint_of(data: bytes) -> str:
    """The fingerprint of a file with this content, as of an upload."""
    own = data.split(b"\n")
    hashes = [_hash(x) for x in (own if own[-1] else own[:-1])]
    level = 0
    while len(hashes) > 1 or not level:
        hashes, level = [_hash(b"".join(hashes[i : i + FAN])) for i in range(0, len(hashes), FAN)], level + 1
        if not hashes:
            hashes = [_hash(b"")]
    return f"{len(data):x}-{hashes[0].hex()}"


def inside_after(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a quoted field is open at the end of a line, by whether one was at its beginning.

    A quote opens a field at its very beginning only; doubled quotes stand for one; what follows a closing quote
    belongs to the field up to the next delimiter.
    """
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                at = line.find(delimiter, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            q = line.find('"', at)
            if q < 0:
                return True
            if line[q + 1 : q + 2] != '"':
                break
            at = q + 2
        inside, at = False, line.find(delimiter, q + 1) + 1
        if not at:
            return False


def _states(delimiter: str):
    """For each line, if its split began outside (0) or inside (1) of quotes: whether one is open before and after it, and at which line of the split its record began."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, n, state, begun = None, 0, [False, True], [-1, -1]
        for b, splits in _splits(batches):
            rows = []
            for own, value in zip(splits, b["value"].to_pylist(), strict=True):
                if own != split:
                    split, n, state, begun = own, 0, [False, True], [-1, -1]
                before = list(state)
                begun = [begun[k] if before[k] else n for k in (0, 1)]
                if '"' in value:
                    state = [inside_after(value, s, delimiter) for s in state]
                else:
                    state = list(state)
                rows.append((n, before[0], before[1], state[0], state[1], begun[0], begun[1]))
                n += 1
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.bool_()] * 4, pa.int64(), pa.int64()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([b["file"], b["start"], b["value"], *columns], ["file", "start", "value", "at", "before0", "before1", "after0", "after1", "begun0", "begun1"])

    return run


def records(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(file, start, at, value): the records of delimited files, quoted line breaks included, by the line where they begin.

    Each split is read for both states of quotes that it may begin in. Which one it is follows from the splits before:
    a function of two states for each, composed in their order. Lines that are a record by themselves stay where they
    are; the others meet by the beginning of their record.
    """
    scratch = Scratch(spark, "records")
    lines = _scan(spark, path).mapInArrow(_states(delimiter), "file string, start long, value string, at long, before0 boolean, before1 boolean, after0 boolean, after1 boolean, begun0 long, begun1 long")
    lines = scratch.table(lines, "lines")
    last = lines.groupBy(*SPLIT).agg(F.max_by(F.struct("after0", "after1", "begun0", "begun1"), "at").alias("s"))
    ordered = last.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "s"))).alias("splits"))  # a file's splits

    def step(acc: Column, x: Column) -> Column:
        inside, s = acc["inside"], x["s"]
        begun = F.when(inside, s["begun1"]).otherwise(s["begun0"])
        own = F.struct(x["start"].alias("start"), inside.alias("inside"), acc["from"].alias("from"), acc["line"].alias("line"))
        return F.struct(
            F.when(inside, s["after1"]).otherwise(s["after0"]).alias("inside"),
            F.when(begun >= 0, x["start"]).otherwise(acc["from"]).alias("from"),
            F.when(begun >= 0, begun).otherwise(acc["line"]).alias("line"),
            F.concat(acc["out"], F.array(own)).alias("out"),
        )

    begin = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("from"), F.lit(0).cast("long").alias("line"), F.array().cast("array<struct<start: bigint, inside: boolean, from: bigint, line: bigint>>").alias("out"))
    known = scratch.table(ordered.select("file", F.inline(F.aggregate("splits", begin, step)["out"])), "splits")
    both = lines.join(known.select(*SPLIT, "inside", "from", "line"), SPLIT)
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    own = both.select(*SPLIT, "at", "value", pick("before").alias("open"), pick("after").alias("more"), pick("begun").alias("begun"), "from", "line")
    alone = own.where("not open and not more").select(*SPLIT, "at", "value")
    parts = own.where("open or more").select("file", F.when(F.col("begun") >= 0, F.col("start")).otherwise(F.col("from")).alias("first"), F.when(F.col("begun") >= 0, F.col("begun")).otherwise(F.col("line")).alias("line"), "start", "at", "value")
    joined = parts.groupBy("file", "first", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    return alone.union(joined.select("file", "first", "line", "value")).withColumn("value", F.regexp_replace("value", "\r$", ""))
