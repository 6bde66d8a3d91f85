"""Audio fingerprints and sharded storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwright.llm import chroma, queries, sharding


def tune(seed, notes=40):
    r = np.random.default_rng(seed)
    return chroma.melody(r.normal(size=notes).tolist())


def pcm(samples):
    return (samples * 20000).astype("<i2").tobytes()


def test_filters_equal_plain_sums():
    samples = tune(1, 20)
    image = chroma.chroma(samples)
    own = chroma.fingerprint(samples)
    for t in (0, 3, len(own) - 1):
        bits = 0
        for patches in chroma.filters():
            a, b = (image[t + f : t + f + fs, p : p + ps].sum() for f, p, fs, ps in patches)
            level = int(np.searchsorted([-0.25, 0.0, 0.25], np.log((1 + a) / (1 + b))))
            bits = bits << 2 | level ^ level >> 1
        assert bits == own[t]
    assert all(0 <= p and p + ps <= 12 and f + fs <= chroma.WIDTH for pair in chroma.filters() for f, p, fs, ps in pair)


def test_offsets_are_found():
    whole = chroma.fingerprint(tune(2, 60))
    offset, overlap, errors = chroma.align(whole, whole[20:70])
    assert (offset, overlap, errors) == (20, 50, 0.0)
    assert chroma.align(whole[20:70], whole)[0] == -20
    other = chroma.align(whole, chroma.fingerprint(tune(3, 60)))
    assert other is None or other[2] > 0.2
    assert chroma.align(whole, whole[:0]) is None


def test_classes_of_recordings(spark):
    a, b = tune(4), tune(5)
    noisy = a + np.random.default_rng(0).normal(size=len(a)).astype(np.float32) * 0.01
    rows = [(1, pcm(a)), (2, pcm(noisy)), (3, pcm(a[chroma.HOP * 10 :])), (4, pcm(b)), (5, pcm(b)), (6, None), (7, b""), (8, pcm(a[:100])), (9, pcm(tune(6)))]
    df = spark.createDataFrame(rows, "id long, media binary").withColumn("node", F.lit("x"))
    out = {r["id"]: r for r in chroma.classes(df).collect()}
    assert [out[k]["class_id"] for k in range(1, 10)] == [1, 1, 1, 4, 4, 6, 7, 8, 9]
    assert out[3]["anchor"] in (1, 2) and out[3]["offset"] == 10 and out[5]["class_size"] == 2 and out[9]["anchor"] is None
    assert chroma.classes(df.limit(0)).count() == 0
    alone = chroma.classes(df.where("id > 5")).collect()
    assert all(r["class_id"] == r["id"] and r["class_size"] == 1 and r["anchor"] is None for r in alone) and len(alone) == 4


def test_links_are_those_of_all_pairs(spark):
    # excerpts that begin between frames, noise and both, against aligning all pairs
    r, rows = np.random.default_rng(11), []
    for k in range(40):
        whole = tune(100 + k, 60)
        rows.append((len(rows), whole))
        for _ in range(3):
            at, n = int(r.integers(0, 12 * chroma.FRAME)), int(r.integers(30, 48)) * chroma.FRAME
            part = whole[at : at + n]
            rows.append((len(rows), part + r.normal(size=len(part)).astype(np.float32) * float(r.choice([0, 0.05, 0.2, 0.3]))))
    prints = [chroma.fingerprint(chroma.pcm16(pcm(x * 0.5))) for _, x in rows]
    links = set()
    for i in range(len(rows)):
        for j in range(i):
            m = chroma.align(prints[j], prints[i])
            if m and m[1] >= chroma.LEAST_OVERLAP and m[2] <= chroma.MOST_ERRORS:
                links.add((j, i))
    met = {(j, i) for j, i in links if np.isin(chroma.keys(prints[j]), chroma.keys(prints[i])).any()}
    assert len(links) > 150 and all(j // 4 == i // 4 for j, i in links) and len(met) >= 0.9 * len(links)
    parent = list(range(len(rows)))
    for j, i in sorted(links):
        a, b = (min(x for x in range(len(rows)) if parent[x] == parent[y]) for y in (j, i))
        parent = [min(a, b) if p in (parent[j], parent[i]) else p for p in parent]
    out = chroma.classes(spark.createDataFrame([(i, pcm(x * 0.5)) for i, x in rows], "id long, media binary")).collect()
    same = sum(x["class_id"] == parent[x["id"]] for x in out)
    assert same >= 0.95 * len(rows)
    errors = [x["bit_error_rate"] for x in out if x["anchor"] is not None]
    assert len(errors) > 100 and 0.08 < max(errors) <= chroma.MOST_ERRORS


def test_vectors_as_melodies():
    v = np.random.default_rng(1).normal(size=64).tolist()
    assert np.array_equal(chroma.melody(v), chroma.melody(list(v))) and len(chroma.melody(v)) == 64 * chroma.FRAME
    assert len(chroma.melody(None)) == 0 and len(chroma.melody([None, float("nan"), 0.0])) == 3 * chroma.FRAME


def test_excerpts_align_with_what_they_were_cut_from(spark, tmp_path):
    r = np.random.default_rng(31)
    vectors = [r.normal(size=64).round(4).tolist() for _ in range(61)]
    table = [(i, v) for i, v in enumerate(vectors)] + [(80, None), (100, []), (None, vectors[3]), (120, vectors[40])]
    spark.createDataFrame(table, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    out = queries.op5_audio_fingerprints(spark, f"file://{tmp_path}").collect()
    found = {x["vec_id"]: x for x in out}
    assert len(out) == len(table) + 7 and found[120]["class_id"] == found[40]["class_id"]
    for i in (0, 20, 40, 60):
        cut, start = found[-i - 1], (8 * chroma.HOP + i * 37 % (16 * chroma.HOP)) / chroma.HOP
        assert cut["class_id"] == found[i]["class_id"] and cut["bit_error_rate"] <= chroma.MOST_ERRORS
        # by brute force: the shift that aligning the two samples by themselves finds
        whole = chroma.melody(np.float32(vectors[i]).tolist())
        own = chroma.align(chroma.fingerprint(whole), chroma.fingerprint(whole[int(start * chroma.HOP) :][: 40 * chroma.FRAME]))
        assert abs(own[0] - start) <= 1 and cut["offset"] == own[0] and round(own[2], 6) == cut["bit_error_rate"]
    assert found[-81]["class_size"] == found[-101]["class_size"] == 1 and found[1]["anchor"] is None


def store(spark, tmp_path, **options):
    return sharding.Store(spark, f"file://{tmp_path}/store", **{"target_bytes": 60_000, "base_bytes": 2_000, "fan_in": 3} | options)


def rows(spark, lo, hi):
    return spark.range(lo, hi, numPartitions=2).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("source"))


def test_arrivals_are_compacted_and_kept(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(6):
        s.append(rows(spark, 300 * k, 300 * (k + 1)))
    before = s.current()
    assert before.version == 6 and len(before.shards) == 12
    after = s.compact()
    assert after.version > 6 and len(after.shards) < 12 and not s.plan(after.shards)
    assert all(x.size <= 2 * s.target for x in after.shards)
    out = s.read()
    assert out.drop("shard").exceptAll(rows(spark, 0, 1800)).isEmpty() and out.count() == 1800
    assert {r[0] for r in out.select("shard").distinct().collect()} == {x.name for x in after.shards}
    s.vacuum()
    assert set(s.stored()) == {x.name for x in after.shards} and s.read().count() == 1800 == sum(x.rows for x in after.shards)


def test_a_task_of_a_merge_reads_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "MOST_FILES", 8)
    s = store(spark, tmp_path, target_bytes=1 << 30, base_bytes=1 << 20)
    s.append(spark.range(300).repartition(30))
    first = s._packed(list(s.current().shards), s.current().schema)
    assert first.rdd.getNumPartitions() == 4 and first.count() == 300
    assert [x.rows for x in s.compact().shards] == [300] and s.current().version == 3 and s.read().drop("shard").distinct().count() == 300


def test_vacuum_keeps_versions_and_what_is_under_way(spark, tmp_path):
    s = store(spark, tmp_path)
    for k in range(3):
        s.append(rows(spark, 10 * k, 10 * (k + 1)))
    before = s.stored()
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            s.vacuum(bad)
    assert s.stored() == before and len(s._list("manifests")) == 3
    s.vacuum(2)
    assert [n for n, _ in s._list("manifests")] == [f"{v:012d}.json" for v in (2, 3)] and s.read(2).count() == 20
    under_way = s._write(rows(spark, 30, 40), 4)
    at = s.current()
    s.vacuum()
    assert s.commit([*at.shards, *under_way], at).version == 4 and s.read().count() == 40
    late = s._write(rows(spark, 40, 50), 5)
    s.append(rows(spark, 50, 60))  # commits version 5 first
    s.vacuum()
    assert not {x.name for x in late} & set(s.stored()) and s.read().count() == 50


def test_a_version_is_committed_once(spark, tmp_path):
    s = store(spark, tmp_path)
    base = s.current()
    s.append(rows(spark, 0, 10))
    with pytest.raises(sharding.Conflict):
        s.commit([], base)
    assert s.current().version == 1 and len([n for n, _ in s._list("manifests")]) == 1


def test_empty_and_odd_rows(spark, tmp_path):
    s = store(spark, tmp_path)
    with pytest.raises(ValueError):
        s.read()
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 200_000)], "id long, text string").coalesce(1)
    s.append(odd)
    one = s.current().shards
    assert s.append(odd.limit(0)).shards == one and s.current().version == 2 and len(one) == 1 and one[0].rows == 4
    assert s.compact().version >= 2 and s.read().drop("shard").exceptAll(odd).isEmpty() and s.read().count() == 4


def test_columns_of_all_arrivals_survive_compaction(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(spark.createDataFrame([(1,), (2,)], "a int").coalesce(1))
    s.append(spark.createDataFrame([(2**40, "x", 1.5), (None, None, None)], "a long, b string, `c.d` float").coalesce(1))
    s.append(spark.createDataFrame([(2.5, "y", 7)], "`c.d` double, b string, e short").coalesce(1))
    s.append(spark.createDataFrame([(3, 4)], "e int, a int").coalesce(1))
    expected = sorted([(1, None, None, None), (2, None, None, None), (2**40, "x", 1.5, None), (None, None, None, None), (None, "y", 2.5, 7), (4, None, None, 3)], key=str)
    get = lambda df: sorted((tuple(r) for r in df.drop("shard").collect()), key=str)
    assert get(s.read()) == expected
    assert len(s.compact().shards) < 4
    s.vacuum()
    assert get(s.read()) == expected and dict(s.read().drop("shard").dtypes) == {"a": "bigint", "b": "string", "c.d": "double", "e": "int"}


def test_arrivals_that_do_not_fit_are_refused(spark, tmp_path):
    s = store(spark, tmp_path)
    s.append(spark.createDataFrame([(1, "x")], "a long, b string"))
    before = s.stored()
    for rows_, schema in (([("1",)], "a string"), ([(1.5,)], "a double"), ([("x",)], "B string"), ([(1,)], "shard int")):
        with pytest.raises(ValueError):
            s.append(spark.createDataFrame(rows_, schema))
    assert s.stored() == before and s.current().version == 1


def test_tiers_group_similar_sizes(spark, tmp_path):
    s = store(spark, tmp_path)
    assert [s.tier(x) for x in (10, 1_999, 2_000, 5_999, 6_000, 29_999, 30_000)] == [0, 0, 0, 0, 1, 2, -1]
