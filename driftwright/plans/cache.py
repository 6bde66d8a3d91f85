"""Results kept as tables, one for each content and settings, and results that grow with their data."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators import describe
from ..sources import readers

Tables = dict[str, DataFrame]


def result_key(token: str, settings_key: str) -> str:
    return hashlib.blake2b(f"{token}\n{settings_key}".encode(), digest_size=16).hexdigest()


def _kept(spark: SparkSession, at: str, make: Callable[[], Tables]) -> tuple[str, list[str]]:
    """The folder of the run that is kept below ``at`` and the names of its tables; made if there is none.

    Each run writes to a folder of its own, and a small file that names it is renamed into place when all is written.
    Of concurrent runs the first one stays and the others take its tables; where a store lets a later rename replace an
    earlier one, both runs are whole and stay.
    """
    jvm = spark._jvm.org.apache.hadoop.fs
    kept = jvm.Path(f"{at}/kept.json")
    fs = kept.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(kept):
        run = uuid.uuid4().hex
        folder, beside = jvm.Path(f"{at}/{run}"), jvm.Path(f"{at}/{run}.json")
        try:
            made = make()
            for name, df in made.items():
                df.write.parquet(f"{at}/{run}/{name}")
            out = fs.create(beside, True)
            out.write(bytearray(json.dumps({"run": run, "tables": list(made)}).encode()))
            out.close()
            won = not fs.exists(kept) and fs.rename(beside, kept)
        except BaseException:
            fs.delete(folder, True)
            raise
        if not won:
            fs.delete(beside, False)
            fs.delete(folder, True)
    names = json.loads(spark.read.text(f"{at}/kept.json").first()["value"])
    return f"{at}/{names['run']}", names["tables"]


def cached(spark: SparkSession, root: str, key: str, make: Callable[[], Tables]) -> Tables:
    """The tables kept below ``root`` under ``key``; made and written if they aren't there.

    Only whole runs are taken, whatever is interrupted or runs beside (``_kept``).
    """
    folder, names = _kept(spark, f"{root.rstrip('/')}/{key}", make)
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def appended(spark: SparkSession, root: str, parts: Mapping[str, Callable[[], DataFrame]], settings_key: str, states: Callable[[DataFrame], Tables]) -> Tables:
    """Unions of the states of all ``parts`` (content token: how to read it), ready to be added up.

    States are kept for each token, so only parts that are new since the last call are read.
    """
    if not parts:
        raise ValueError("no parts")
    runs = [_kept(spark, f"{root.rstrip('/')}/{result_key(token, settings_key)}", lambda read=read: states(read())) for token, read in parts.items()]
    names = list(dict.fromkeys(n for _, own in runs for n in own))
    return {n: spark.read.parquet(*[f"{folder}/{n}" for folder, own in runs if n in own]) for n in names}


def describe_files(spark: SparkSession, root: str, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """``describe.describe`` of delimited files together. A file is known by its content: after some are appended, only those are counted.

    Equal files are kept once and count once for each path.
    """
    tokens = [readers.content_token(spark, p) for p in paths]
    parts = {f"{token} {tokens[:i].count(token)}": (lambda p=p: readers.as_frame(spark, p)) for i, (token, p) in enumerate(zip(tokens, paths, strict=True))}
    own = appended(spark, root, parts, json.dumps(["describe", list(columns or [])]), lambda df: describe.states(df, columns))
    return describe.described(describe.merged(own))
