"""Fingerprints and quoted records of files in many splits, against hashlib and the csv module."""

import csv
import hashlib
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftwright.sources import lines, readers


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plain_root(data, fan):
    own = data.split(b"\n")
    level = [hashlib.blake2b(x, digest_size=16).digest() for x in (own if own[-1] else own[:-1])]
    while True:
        level = [hashlib.blake2b(b"".join(level[i : i + fan]), digest_size=16).digest() for i in range(0, len(level), fan)]
        if len(level) < 2:
            return level[0].hex()


def test_fingerprints_are_ordered_and_those_of_the_bytes(spark, tmp_path, monkeypatch, small_splits):
    r = random.Random(1)
    text = [f"line {i} é{r.random()}" for i in range(300)]
    data = "\r\n".join(text).encode()
    (tmp_path / "a.csv").write_bytes(data)
    monkeypatch.setattr(lines, "FAN", 7)
    found = lines.fingerprint(spark, str(tmp_path / "a.csv"))
    assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 5
    assert found == lines.fingerprint_of(data) == f"{len(data):x}-{plain_root(data, 7)}"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    assert lines.fingerprint(spark, str(tmp_path / "a.csv")) == found
    text[5], text[200] = text[200], text[5]  # two lines swapped
    for other in ("\r\n".join(text).encode(), data + b"\n", data.replace(b"\r", b""), b"", b"\n", b"x"):
        (tmp_path / "b.csv").write_bytes(other)
        own = lines.fingerprint(spark, str(tmp_path / "b.csv"))
        assert own == lines.fingerprint_of(other) != found


def open_at_end(text, delimiter=","):
    """By the csv module: what follows an open quote is part of the same record."""
    return len(list(csv.reader(io.StringIO(text + "\nZZZ\n", newline=""), delimiter=delimiter))) != len(list(csv.reader(io.StringIO(text + "\n", newline=""), delimiter=delimiter))) + 1


@settings(max_examples=300, deadline=None)
@given(st.text('a",', max_size=12))
def test_states_of_quotes_equal_the_csv_module(line):
    assert lines.inside_after(line, False, ",") == open_at_end(line)
    assert lines.inside_after(line, True, ",") == open_at_end('"\n' + line)


@pytest.mark.parametrize("seed", [1, 2])
def test_records_in_many_splits_equal_the_csv_module(spark, tmp_path, small_splits, seed):
    r = random.Random(seed)
    cell = lambda: r.choice(["plain", "", 'say "hi"', "two\nlines", "a,b", '5" disk', "\n\n", '"', "x" * 900 + "\n" + "y" * 900, "é\n,\"", "7"])
    rows = [[f"id{i}", cell(), cell()] for i in range(150)]
    (tmp_path / "in").mkdir()
    for k in (0, 1):
        with open(tmp_path / "in" / f"f{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\r\n" if k else "\n", quoting=csv.QUOTE_ALL if k else csv.QUOTE_MINIMAL)
            w.writerow(["id", "b.c", 'na"me'])
            w.writerows(rows[75 * k : 75 * (k + 1)])
    with open(tmp_path / "in" / "f0.csv", newline="") as f:
        assert list(csv.reader(f))[1:] == rows[:75]
    t = readers.load_table(spark, str(tmp_path / "in"), delimiter=",", optimize=False)
    assert t.columns == ["id", "b.c", 'na"me']
    assert lines._scan(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 10
    missing = lambda x: None if x.strip(" ") in readers.MISSING else x
    got = sorted(tuple(x) for x in t.frame.collect())
    assert got == sorted(((a, missing(b), missing(c)) for a, b, c in rows), key=lambda x: x[0])


def test_a_quote_that_never_closes(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b\n1,"open\n2,3\n')
    assert lines.records(spark, str(tmp_path / "x.csv"), ",").orderBy("at").collect()[1]["value"] == '1,"open\n2,3'
