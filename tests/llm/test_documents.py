"""Language, toxicity, near duplicates and decontamination."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwright.llm import decontam, langid, neardup, toxicity
from driftwright.llm import textvec as tv
from driftwright.llm.common import Scratch, connected_components, held_out, learnable, linked_classes

SYLLABLES = {"en": "the of and ing er th on re st ly".split(), "es": "que de la ción os ar mente ado ez ie".split(), "de": "der die und sch ung keit ch en ge ver".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(5)
    rows = [(i, prose(r, lang, r.randint(5, 60)), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df, langid.train(df.where(learnable("doc_id")))


def test_held_out_languages_are_right(languages):
    df, model = languages
    out = langid.identify(df.withColumn("score", F.lit("old")), model).where(held_out("doc_id")).collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 < r["score"] <= 1 for r in out)


def test_languages_of_copies_are_learned_within_the_bound(spark):
    r = random.Random(9)
    rows = [(prose(r, "en", 30), "en") for _ in range(400)]
    for k in range(6):  # each has one text, which no hash of it may leave out
        rows += [(prose(r, "es", 20) + f" {k}", f"copies {k}")] * 300
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    model = langid.train(df, max_rows_per_language=50)
    assert model.languages == ["copies 0", "copies 1", "copies 2", "copies 3", "copies 4", "copies 5", "en"]
    # what a language has in the model is what 50 distinct texts at most hold
    sample = sorted({t for t, lang in rows if lang == "en"})
    most = sorted((len(langid.trigrams([t])[0]) for t in sample), reverse=True)[:50]
    p = np.exp(model.log_p[:, 6].astype(float))
    total = 0.2 / p.min() - 0.2 * len(p)
    assert 0 < total <= sum(most) * 1.001


def test_mixture_is_found_and_others_are_not(spark, languages):
    _, model = languages
    r = random.Random(6)
    mixed = prose(r, "en", 150) + " " + prose(r, "de", 150)
    rows = langid.identify(spark.createDataFrame([(mixed,), (prose(r, "es", 300),)], "text string"), model).collect()
    assert set(rows[0]["languages"]) == {"en", "de"} and 0.4 < rows[0]["score"] < 0.65
    assert rows[1]["languages"] == ["es"] and rows[1]["score"] == 1.0


def test_proportions_equal_plain_em(languages):
    _, model = languages
    r = random.Random(7)
    text = prose(r, "en", 40) + " " + prose(r, "es", 40)
    (found,), _ = langid.infer([text], model, max_set=2)
    grams, first, _ = langid.trigrams([text])
    ends = [*first[1:], len(grams)]
    like = [[float(np.exp(sum(model.log_p[g, k] for g in grams[a:b]) - max(sum(model.log_p[g, m] for g in grams[a:b]) for m in range(3)))) for k in range(3)] for a, b in zip(first, ends, strict=True)]
    used = np.flatnonzero(found)
    pi = np.full(len(used), 1 / len(used))
    for _ in range(12):
        shares = [[pi[x] * row[k] for x, k in enumerate(used)] for row in like]
        pi = np.mean([np.array(s) / sum(s) for s in shares], axis=0)
    assert np.allclose(found[used], pi, atol=1e-4)


def test_sets_are_the_best_of_all_subsets():
    # five languages that share words, in mixtures of up to five
    r, shared = random.Random(21), "za ko mi tu re pa".split()
    own = [["".join(r.choice("aeioumnrst") for _ in range(3)) for _ in range(8)] + r.sample(shared, 3) for _ in range(5)]
    say = lambda k, n: " ".join("".join(r.choice(own[k]) for _ in range(r.randint(1, 2))) for _ in range(n))
    counts = np.zeros((langid.BUCKETS, 5), np.float32)
    for k in range(5):
        counts[:, k] = np.bincount(langid.trigrams([say(k, 3000)])[0], minlength=langid.BUCKETS) + 0.2
    model = langid.LanguageModel(list("abcde"), np.log(counts / counts.sum(0)).astype(np.float32))
    texts = [" ".join(say(k, r.randint(2, 25)) for k in r.sample(range(5), r.randint(1, 5))) for _ in range(150)]
    found, same, sizes = langid.infer(texts, model)[0], 0, set()
    for text, proportions in zip(texts, found, strict=True):
        grams, first, _ = langid.trigrams([text])
        word = np.add.reduceat(model.log_p[grams].astype(float), first)
        like = np.exp(np.maximum(word - word.max(1)[:, None], -60))
        values = {}
        for members in (c for k in range(1, 6) for c in combinations(range(5), k)):
            part, pi = like[:, members], np.full(len(members), 1 / len(members))
            for _ in range(12 if len(members) > 1 else 0):
                pi = (part * pi / np.maximum((part * pi).sum(1, keepdims=True), 1e-300)).mean(0)
            values[members] = np.log(np.maximum(part @ pi, 1e-300)).sum() - 4.0 * (len(members) - 1) * np.log(len(word) + 1)
        mine = values[tuple(np.flatnonzero(proportions).tolist())]
        same += mine >= max(values.values()) - 1e-3
        sizes.add(int((proportions > 0).sum()))
    assert same == len(texts) and sizes >= {1, 2, 3}


def test_every_language_is_learned_and_sets_are_not_capped(spark):
    r = random.Random(12)
    own = {f"l{k:02d}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(9)] for k in range(70)}
    say = lambda lang, n: " ".join("".join(r.choice(own[lang]) for _ in range(2)) for _ in range(n))
    rows = [(say(lang, 60), lang) for k, lang in enumerate(own) for _ in range(2 if k < 64 else 1)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == sorted(own)
    texts = [say("l69", 50), " ".join(say(f"l{k:02d}", 60) for k in range(61, 68))]
    found = langid.identify(spark.createDataFrame(enumerate(texts), "i int, text string"), model).orderBy("i").collect()
    assert found[0]["lang_pred"] == "l69" and found[0]["score"] == 1.0
    assert set(found[1]["languages"]) == {f"l{k:02d}" for k in range(61, 68)} and found[1]["score"] < 0.25


def test_texts_without_letters_and_without_training(spark, languages):
    df, model = languages
    odd = spark.createDataFrame([(None,), ("",), ("12 34 !!",), ("the " * 300_000,)], "text string")
    assert [r["lang_pred"] for r in langid.identify(odd, model).collect()] == ["und", "und", "und", "en"]
    empty = langid.train(df.limit(0))
    assert {r["lang_pred"] for r in langid.identify(df.limit(2), empty).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


@pytest.fixture(scope="module")
def toxic(spark):
    r = random.Random(8)
    rows = []
    for i in range(1200):
        lang, bad = ("en", "de")[i % 2], i % 8 < 1 or i % 8 == 5
        words = prose(r, lang, r.randint(20, 60)).split()
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["scum", "idiot", "trash"]) if lang == "en" else "zarvol" + r.choice("aeiou") + r.choice(["x", "nt"]))
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df, toxicity.train(df.select("doc_id", "text"), df.where(learnable("doc_id")).select("doc_id", "toxic"))


def test_held_out_toxicity(toxic):
    df, model = toxic
    rows = toxicity.score(df, model).where(held_out("doc_id")).collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97
    assert "zarvol*" in model.features and "scum" in model.features


def test_scores_of_odd_texts(spark, toxic):
    df, model = toxic
    odd = spark.createDataFrame([(None,), ("",), ("fine words " * 50_000,), ("you SCUM and 1d10t, idiot",), ("you SCUM and 1d10t, idiot",)], "text string")
    s = [r["score"] for r in toxicity.score(odd.withColumn("predicted", F.lit("x")), model).collect()]
    assert s[0] == s[1] < 0.3 and s[2] < 0.3 and s[3] == s[4] > 0.3
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_without_labels_the_fixed_lists_decide(spark, toxic):
    df, _ = toxic
    model = toxicity.train(df.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    s = toxicity.score(spark.createDataFrame([("you idiot",), ("hello there",)], "text string"), model).collect()
    assert s[0]["predicted"] == 1 and s[1]["predicted"] == 0


def test_regression_equals_dense_newton_steps():
    r = np.random.default_rng(4)
    x = (r.random((400, 12)) < 0.2).astype(float)
    y = 1 / (1 + np.exp(-(x @ r.normal(0, 2, 12) - 1)))
    w, intercept = toxicity._regression(*np.nonzero(x), 12, y, ridge=0.5, rounds=50)
    full, penalty = np.hstack([x, np.ones((400, 1))]), np.append(np.full(12, 0.5), 1e-6)
    v = np.zeros(13)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ v))
        v += np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), full.T @ (y - p) - penalty * v)
    assert np.allclose(np.append(w, intercept), v, atol=1e-4)


def test_bar_of_learned_entries_follows_the_sample():
    # a thousand entries of one row each can't reach any bar, so ten others alone are tried
    assert toxicity._least_gain({1: 1000, 20: 10}, 50, 400, 0.05) == pytest.approx(2 * np.log(10 / 0.05))
    assert toxicity._least_gain({1: 1000}, 50, 400, 0.05) == np.inf
    assert toxicity._least_gain({20: 10**6}, 50, 400, 0.05) > toxicity._least_gain({20: 10}, 50, 400, 0.05)


def test_few_labels_teach_new_words(spark):
    rows = [(i, f"plain words of row {i} " + ("zarvolint here" if i % 4 == 0 else "and more"), int(i % 4 == 0)) for i in range(48)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert "zarvolint" in model.features and len(model.weights) == len(model.features) + len(toxicity.VOTERS)
    assert [r["predicted"] for r in toxicity.score(df.orderBy("doc_id"), model).collect()] == [r[2] for r in rows]


def test_label_model_finds_accuracies_and_dependent_voters():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    votes = np.stack([r.random(4000) < np.where(y, p, q) for p, q in ((0.8, 0.05), (0.7, 0.1), (0.6, 0.02))], 1)
    votes = np.hstack([votes, votes[:, :1]])  # a voter that copies another
    label = np.where(r.random(4000) < 0.9, y, ~y).astype(int)
    model = toxicity.LabelModel().fit(votes.astype(int), label)
    assert np.allclose(model.accuracy[1, :3], [0.8, 0.7, 0.6], atol=0.06) and ((model.posterior > 0.5) == y).mean() > 0.93
    assert model.parent[3] == 0 or model.parent[0] == 3


def test_words_and_shingles_equal_plain_python():
    texts = ["One two, three four five six!", "", "one TWO", "été_漢字 a1 b", "a b c d e"]
    h, doc = tv.words(texts)
    plain = [["one", "two", "three", "four", "five", "six"], [], ["one", "two"], ["été", "漢字", "a1", "b"], list("abcde")]
    assert np.bincount(doc, minlength=5).tolist() == [len(p) for p in plain]
    names = [w for p in plain for w in p]
    assert all((h[i] == h[j]) == (names[i] == names[j]) for i in range(len(h)) for j in range(len(h)))
    s, d = tv.shingles(h, doc, 5)
    assert np.bincount(d, minlength=5).tolist() == [2, 0, 1, 1, 1] and len(set(s.tolist())) == 5


def plain_similarity(a, b, idf):
    def bag(t):
        words = "".join(c if c.isalnum() else " " for c in t.lower()).split()
        out = {}
        for i in range(max(1, len(words) - 4)):
            k = tuple(words[i : i + 5])
            out[k] = out.get(k, 0) + 1
        return {k: 1 + np.log(n) for k, n in out.items()} if words else {}

    x, y = bag(a), bag(b)
    keys = x.keys() | y.keys()
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)


def test_similarity_and_sample_agreement():
    r = random.Random(3)
    base = prose(r, "en", 300).split()
    other = list(base)
    for k in range(10, 300, 60):
        other[k] = "changed"
    idf = np.ones(1 << neardup.SKETCH_BITS, np.float32)
    a, b = " ".join(base), " ".join(other)
    packed = neardup.pack_bag.func(__import__("pandas").Series([a, b]))
    exact = neardup.similarity(packed[0], packed[1], idf)
    assert abs(exact - plain_similarity(a, b, idf)) < 1e-6
    bands = neardup.Sampler(idf).bands([a, b])
    agree = sum(x == y for x, y in zip(*bands, strict=True)) / neardup.BANDS
    assert agree >= exact**neardup.ROWS - 0.4 and any(x == y for x, y in zip(*bands, strict=True))


def documents(spark):
    r = random.Random(9)
    rows = [(i, prose(r, "en", 80)) for i in range(40)]
    for g in range(4):
        words = prose(r, "de", 120).split()
        for k in range(5):
            own = list(words)
            own[7 * k] = f"edit{k}"
            rows.append((100 + 10 * g + k, " ".join(own)))
        rows.append((105 + 10 * g, rows[-1][1]))  # an exact copy
    rows += [(200, None), (201, ""), (202, ""), (203, "?!"), (None, "lone text without id"), (204, "two words"), (205, "Two words!"), (300, rows[0][1]), (300, rows[0][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("mine")).withColumn("class_id", F.lit(1))


def test_classes_equal_all_pairs(spark):
    rows, df = documents(spark)
    idf = None
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if a and b and any(c.isalnum() for c in a) and any(c.isalnum() for c in b) and plain_similarity(a, b, idf) >= 0.8:
                parent[root(i)] = root(j)
    expected = {}
    for i, (doc, _) in enumerate(rows):
        expected.setdefault(root(i), []).append(doc)
    found = {}
    for r in neardup.classes(df).collect():
        found.setdefault((r["class_id"], r["doc_id"] if r["class_size"] == 1 else None), []).append(r["doc_id"])
    key = lambda groups: sorted(sorted((-1 if d is None else d) for d in g) for g in groups)
    assert key(found.values()) == key(expected.values())


def test_one_of_each_class_stays(spark):
    rows, df = documents(spark)
    kept = neardup.keep_one(df).collect()
    assert df.columns == ["doc_id", "text", "node", "class_id"] == list(kept[0].asDict())
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept) == sorted([-1, *range(40), 100, 110, 120, 130, 200, 201, 202, 203, 204])


def test_exact_copies_without_words_are_one_class(spark):
    rows = [(7, "?!"), (3, "?!"), (5, "?!?"), (1, "\U0001f600" * 9), (2, "\U0001f600" * 9), (8, ""), (9, ""), (10, None), (11, None), (12, "-- --"), (None, "-- --")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.classes(df).collect())
    assert found == [(-1, 12, 2), (1, 1, 2), (2, 1, 2), (3, 3, 2), (5, 5, 1), (7, 3, 2), (8, 8, 1), (9, 9, 1), (10, 10, 1), (11, 11, 1), (12, 12, 2)]
    assert sorted(r["doc_id"] for r in neardup.keep_one(df).collect()) == [1, 3, 5, 8, 9, 10, 11, 12]


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.classes(df).count() == 0 and neardup.keep_one(df).count() == 0


def test_components_equal_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(30)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert found == {x: root(x) for x in parent}


def test_links_between_classes_of_a_bucket_are_not_lost(spark):
    # on a line, neighbours link: leaders alone would leave gaps
    rows = [(1, i) for i in range(60)] + [(2, 100), (3, 58), (3, 200), (4, 300), (4, 301)]
    members = spark.createDataFrame(rows, "bucket long, node long").withColumn("rank", F.lit(0.0))
    verify = lambda p: p.withColumns({"similarity": F.lit(None).cast("double"), "holds": F.abs(F.col("a") - F.col("b")) <= 3})
    parts, links = linked_classes(members, verify, Scratch(spark, "t"))
    assert {r["node"]: r["component"] for r in parts.collect()} == {i: 0 for i in range(60)} | {300: 300, 301: 300}
    assert all(abs(r["a"] - r["b"]) <= 3 for r in links.collect())
    assert linked_classes(members.where("bucket = 2"), verify, Scratch(spark, "t")) is None


def items(r):
    return [prose(r, "es", n) for n in (15, 25, 40, 59, 12)] + ["too short"]


def test_overlaps_with_substitutions_by_brute_force(spark):
    r = random.Random(4)
    tests = items(r)
    docs = []
    for i in range(60):
        words = prose(r, "en", r.randint(20, 90)).split()
        if i % 3 == 0:
            own = tests[i % 5].split()
            for k in range(4, len(own), 9):
                if i % 2:
                    own[k] = "swapped"
            at = r.randrange(len(words))
            words[at:at] = own
        docs.append((i, " ".join(words)))
    docs += [(100, None), (101, ""), (102, tests[5]), (103, tests[2][: len(tests[2]) // 4]), (104, (tests[1] + " ") * 3)]
    bench = spark.createDataFrame([*enumerate(tests), (50, None)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x for x in decontam.overlaps(df, bench).collect()}

    def aligned(doc, item):
        a, b = doc.split(), item.split()
        best = 0
        for shift in range(-len(b), len(a)):
            score = equal = 0
            for j, w in enumerate(b):
                if 0 <= shift + j < len(a):
                    score, equal = (score + 1, equal + 1) if a[shift + j] == w else (score - decontam.PRICE, equal)
                    if score <= 0:
                        score = equal = 0
                    best = max(best, equal if score > 0 else 0)
        return best

    expected = {(i, k) for i, d in docs if d for k, t in enumerate(tests) if len(t.split()) >= decontam.SPAN and aligned(d, t) >= min(decontam.ENOUGH, -(-4 * len(t.split()) // 5))}
    assert found.keys() == expected and len(expected) > 15
    blocks = {(x["doc_id"], x["item_id"]) for x in decontam.overlaps(df, bench, words_per_block=40).collect()}
    assert blocks == expected
    kept = decontam.remove(df.withColumn("item_id", F.lit("x")), bench)
    assert {x["doc_id"] for x in kept.collect()} == {i for i, _ in docs} - {i for i, _ in expected} and kept.columns == ["doc_id", "text", "item_id"]
    assert decontam.overlaps(df, bench.limit(0)).count() == 0 and decontam.overlaps(df.limit(0), bench).count() == 0


def test_joined_overlaps_are_the_broadcast_ones(spark):
    r = random.Random(21)
    words = [f"w{k}" for k in range(30)]
    tests = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate([3, 5, 6, 8, 9, 10, 14, 25, 60])]
    tests += [tests[4], (None, tests[6][1]), (77, None), (78, "")]
    docs = [(i, None if i == 3 else "") for i in range(3, 5)] + [(i, " ".join(r.choice(words) for _ in range(r.randrange(40)))) for i in range(5, 30)]
    docs += [(i, f"{docs[i % 20][1]} {r.choice(tests[:9])[1]} tail") for i in range(30, 80)] + [(40, tests[8][1])] * 2
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, found string")
    bench = spark.createDataFrame(tests, "item_id long, text string")
    both = [sorted(map(str, decontam.overlaps(df, bench, whole=True, words_per_block=n).collect())) for n in (250_000, 0)]
    assert both[0] == both[1] and len(both[0]) > 20
    both = [sorted(map(str, decontam.remove(df, bench, whole=True, words_per_block=n).collect())) for n in (250_000, 0)]
    assert both[0] == both[1] and 5 < len(both[0]) < len(docs) - 20
    kept = decontam.remove(df, bench.limit(0), words_per_block=-1)
    assert kept.columns == df.columns and kept.count() == len(docs)


def overlap_by_counting(a, b):
    """Whether some stretch of a diagonal has enough equal words, at least four fifths of it."""
    enough = len(b) if len(b) < decontam.SPAN else min(decontam.ENOUGH, -(-4 * len(b) // 5))
    for shift in range(-len(b), len(a)):
        equal = [0 <= shift + j < len(a) and a[shift + j] == w for j, w in enumerate(b)]
        if any(sum(equal[i:j]) >= max(enough, 0.8 * (j - i)) for i in range(len(b)) for j in range(i + enough, len(b) + 1)):
            return True
    return False


def found_in(item, docs):
    finder = decontam.Finder(decontam.Block.build([0], [" ".join(item)]), whole=True)
    return [bool(m) for m in finder.find([" ".join(d) for d in docs])]


def test_substitutions_at_any_place_are_found():
    r = random.Random(8)
    for size, changed in [(9, 1), (10, 2), (12, 2), (14, 2), (15, 1), (15, 2), (15, 3), (16, 1), (18, 2), (20, 2)]:
        item = [f"w{k}" for k in range(size)]
        docs = []
        for places in combinations(range(size), changed):
            own = [f"x{k}" if k in places else w for k, w in enumerate(item)]
            docs.append(["a"] * r.randrange(3) + own + ["z"] * r.randrange(3))
        assert all(found_in(item, docs)), (size, changed)


def test_overlaps_are_those_of_counting_equal_words():
    r = random.Random(9)
    hits = 0
    for size in [2, 4, 5, 7, 8, 9, 10, 11, 13, 15, 17, 22, 30, 41]:
        item = [f"w{k}" for k in range(size)]
        docs = []
        for _ in range(60):
            lo, hi = sorted((r.choice([0, 0, 1, 2, r.randrange(size)]), r.choice([size, size, size - 1, size - 2, r.randrange(size)])))
            own = [f"x{r.randrange(10**9)}" if r.random() < r.choice([0, 0.1, 0.25]) else w for w in item[lo:hi]]
            docs.append(["a"] * r.randrange(4) + own + ["z"] * r.randrange(4))
        expected = [size >= decontam.SHORT and overlap_by_counting(d, item) for d in docs]
        assert found_in(item, docs) == expected, size
        hits += sum(expected)
    assert 200 < hits < 700


def test_a_benchmark_without_white_space_is_joined(spark, monkeypatch):
    r = random.Random(10)
    words = [[f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(20)]
    bench = spark.createDataFrame([(f"id-{i}", "-".join(w)) for i, w in enumerate(words)], "item_id string, text string")
    docs = spark.createDataFrame([(i, "before " + " ".join(w[10:40]) + " after") for i, w in enumerate(words)] + [(99, "nothing of the kind"), (100, None)], "doc_id long, text string")
    called = []
    plain = decontam._broadcast
    monkeypatch.setattr(decontam, "_broadcast", lambda *a: called.append(1) or plain(*a))
    monkeypatch.setattr(decontam, "LINES", 2)
    kinds = [sorted((x["doc_id"], x["item_id"], x["length"]) for x in decontam.overlaps(docs, bench, whole=True, **limits).collect()) for limits in ({}, {"words_per_block": 1199}, {"bytes_per_block": 100})]
    assert len(called) == 1 and kinds[0] == kinds[1] == kinds[2] == sorted((i, f"id-{i}", 30) for i in range(20))
    assert [x["doc_id"] for x in decontam.remove(docs, bench, whole=True, words_per_block=0).orderBy("doc_id").collect()] == [99, 100]


def test_clashing_and_dotted_columns_pass(spark, languages):
    _, model = languages
    df = spark.createDataFrame([(1, "the of and ing", "a", "b", "c")], "doc_id long, text string, _found string, found string, `x.y` string")
    out = langid.identify(df, model).first()
    assert (out["_found"], out["found"], out["x.y"], out["lang_pred"]) == ("a", "b", "c", "en")
    kept = neardup.keep_one(df.union(df)).collect()
    assert len(kept) == 1 and kept[0]["x.y"] == "c"
