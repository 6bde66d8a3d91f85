"""Reports as folders or archives of CSV tables with metadata."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..scratch import Scratch
from . import addresses as ad
from . import archive

#: Result tables have a row for each feature, bin or pair; larger ones are written by the executors instead.
MOST_ROWS = 200_000


def _csv(df: DataFrame) -> bytes | None:
    """A table as CSV, or nothing if it has more than ``MOST_ROWS`` rows."""
    rows = archive.flat(df).limit(MOST_ROWS + 1).toArrow()
    return None if rows.num_rows > MOST_ROWS else archive.csv_text(rows, header=True)


def bundle_files(tables: Mapping[str, DataFrame], metadata: Mapping, *, title: str = "Report") -> Iterator[tuple[str, bytes]]:
    """(path, content) of a report, one table at a time."""
    listing = []
    for number, (name, df) in enumerate(tables.items(), 1):
        path = f"{number:02d}_{ad.safe_name(name)}.csv"
        content = _csv(df)
        listing.append(f"- {path}" if content is not None else f"- {ad.safe_name(name)}: too large for one file, see the folder of that name")
        if content is not None:
            yield path, content
    yield "metadata.json", json.dumps(metadata, indent=2, default=str).encode()
    yield "README.txt", ("\n".join([title, "", *listing, "- metadata.json: settings, features, notes"]) + "\n").encode()


def _members(tables: Mapping[str, DataFrame], metadata: Mapping, title: str, scratch: Scratch) -> Iterator[archive.Member]:
    listing = []
    for number, (name, df) in enumerate(tables.items(), 1):
        path = f"{number:02d}_{ad.safe_name(name)}.csv"
        listing.append(f"- {path}")
        content = _csv(df)
        yield archive.table_member(df, path, scratch) if content is None else archive.small_member(path, content)
    yield archive.small_member("metadata.json", json.dumps(metadata, indent=2, default=str).encode())
    yield archive.small_member("README.txt", ("\n".join([title, "", *listing, "- metadata.json: settings, features, notes"]) + "\n").encode())


def zip_pieces(spark: SparkSession, tables: Mapping[str, DataFrame], metadata: Mapping, *, title: str = "Report") -> Iterator[bytes]:
    """The bytes of an archive of all tables, whatever their size, in order; those of large tables are compressed by tasks."""
    scratch = Scratch(spark, "archive")
    try:
        yield from archive.archive(_members(tables, metadata, title, scratch))
    finally:
        scratch.drop()


def build_zip(tables: Mapping[str, DataFrame], metadata: Mapping, *, title: str = "Report") -> bytes:
    """An archive that fits in the driver's memory; ``write_zip`` needs no such memory."""
    return b"".join(zip_pieces(SparkSession.active(), tables, metadata, title=title))


def write_zip(spark: SparkSession, tables: Mapping[str, DataFrame], metadata: Mapping, address: str, *, title: str = "Report") -> str:
    """Write the archive to any store that Spark reaches; it appears under its name, in place of an older one, when it is whole."""
    jvm, beside = spark._jvm, f"{address}.{uuid.uuid4().hex}"
    path, whole = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(address)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        out = fs.create(path, True)
        try:
            for piece in zip_pieces(spark, tables, metadata, title=title):
                out.write(bytearray(piece))
        finally:
            out.close()
        fs.delete(whole, False)
        if not fs.rename(path, whole):
            raise OSError(f"{address} can't be written")
    finally:
        fs.delete(path, False)
    return address


def write_bytes(spark: SparkSession, address: str, content: bytes) -> str:
    """Write a small file to any store that Spark reaches, in one piece."""
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(content))
    out.close()
    return address


def write_report(spark: SparkSession, tables: Mapping[str, DataFrame], metadata: Mapping, folder: str, *, title: str = "Report") -> list[str]:
    """Write a report below ``folder``; tables that are too large for one file are written by the executors."""
    written = [write_bytes(spark, ad.join_address(folder, path), content) for path, content in bundle_files(tables, metadata, title=title)]
    done = {p.rsplit("/", 1)[-1] for p in written}
    for number, (name, df) in enumerate(tables.items(), 1):
        if f"{number:02d}_{ad.safe_name(name)}.csv" not in done:
            df.write.mode("overwrite").option("header", True).csv(at := ad.join_address(folder, ad.safe_name(name)))
            written.append(at)
    return written


def write_segmented_report(spark: SparkSession, result, folder: str) -> list[str]:
    """The tables of all segments side by side, then those of each segment in a folder of its own."""
    from ..operators.segment import SEGMENT

    tables = [t.persist() for t in result.tables.values() if not t.is_cached]  # computed once for all segments; lost parts are computed again
    try:
        written = write_report(spark, result.tables, result.metadata(), ad.join_address(folder, "00_comparison"))
        keys = [r[0] for r in result.tables["segments"].select(SEGMENT).orderBy("position", SEGMENT).collect()]
        for number, (key, name) in enumerate(zip(keys, ad.unique_names(keys), strict=True), 1):
            written += write_report(spark, result.of_segment(key), {"segment": key}, ad.join_address(folder, f"{number:02d}_{name}"))
    finally:
        for t in tables:
            t.unpersist()
    return written
