"""URL filters and main text of pages."""

import itertools
import math
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from driftwright.llm import htmltext, urlfilter

RULES = {"block": ("net/", "example.com/de/"), "allow": ("example.net/en/", "org/fr/")}


def judged(spark, urls):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    return urlfilter.apply(df, urlfilter.train(df), **RULES).orderBy("page_id").collect()


def test_host_path_and_longest_rule(spark):
    rows = judged(spark, ["HTTP://Blog.X.Example.NET/en/1?q", "https://a.net/en/1", "https://net/x", "http://a.example.com/de/", "http://a.example.com/de", "http://a.net", "http://a.org/fr/z#t", "http://xnet/y", None, "no scheme", "http://ÄB.net/"])
    found = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]
    assert found[0] == ("blog.x.example.net", "/en/1", "example.net/en/", "allow")
    assert found[1] == ("a.net", "/en/1", "net/", "block") and found[2][2] == "net/" and found[3][2] == "example.com/de/"
    assert [f[2] for f in found[4:6]] == [None, None] and found[6][2:] == ("org/fr/", "allow") and found[7][2] is None
    assert found[8] == ("", "", None, "allow") and found[9] == ("", "", None, "allow") and found[10][0] == "Äb.net"


def test_names_are_judged_by_their_words(spark):
    bad = ["casino-win.example.org", "freebets.example.com", "blog.cheap-pills.example.com", "adultx.example.com", "spamfarm.org", "ads-track.example.org"]
    good = ["thering.example.org", "essex.org", "farmersmarket.com", "winterpark.org", "freebooks.org", "xylophone.com", "onlineschool.org", "news.example.com"]
    rows = judged(spark, [f"https://{h}/en/1" for h in bad + good])
    assert [r["verdict"] for r in rows] == ["block"] * len(bad) + ["allow"] * len(good)


def cost(words):
    known = urlfilter.lexicon()
    return sum(known[w] if w in known else -6.0 - 2.6 * len(w) for w in words)


@pytest.mark.parametrize("name", ["freebets", "winterpark", "abc", "casinox", "betsbets", "theatre", ""])
def test_cut_is_the_best_of_all_cuts(name):
    @lru_cache(None)
    def best(rest):
        return max([cost([rest[:i]]) + best(rest[i:]) for i in range(1, len(rest) + 1)], default=0.0) if rest else 0.0

    words = urlfilter.segment(name)
    assert "".join(words) == name
    # neighbouring unknown runs of the search are one run
    assert math.isclose(cost(words), best(name), abs_tol=1e-9)


def test_one_strong_word_beside_others_is_enough(spark):
    bad = ["pornhub.com", "pokerstars.com", "viagrashop.com"]
    rows = judged(spark, [f"https://{h}{p}" for h in bad for p in ("/", "/a-long-slug-of-many-other-words-that-nobody-listed")])
    assert all(r["verdict"] == "block" for r in rows)
    assert urlfilter.tokens("alphabet.winterpark.sexshop", "") == ["alphabet", "winter", "park", "sex", "shop"]


def test_counts_of_both_classes_are_learned(spark):
    urls = ["https://zorblax.org/"]
    few = [f"https://{w}{i}.org/" for i in range(40) for w in ("casino-zorblax", "plain-garden")]
    more = [f"https://{w}{i}.org/" for i in range(40) for w in ("casino-only", "zorblax-garden")]
    odds = []
    for corpus in (few, more, few + more, urls):
        model = urlfilter.train(spark.createDataFrame([(u,) for u in corpus], "url string"))
        odds.append(urlfilter.apply(spark.createDataFrame([(urls[0],)], "url string"), model).first()["log_odds"])
    prior = urlfilter.Judge().prior
    assert odds[0] > odds[2] > odds[1] and odds[0] > prior + 1 and odds[1] < prior - 1 and abs(odds[3] - prior) < 1e-6
    known = urlfilter.train(spark.createDataFrame([(u,) for u in few], "url string")).known
    assert known["casino"] > known["garden"] - 1e-9 > urlfilter.lexicon()["garden"] and known["poker"] < urlfilter.lexicon()["poker"]


def test_words_are_learned_from_hosts_and_paths(spark):
    urls = [f"https://site{i}.org/daily-recipes/{p}" for i in range(3) for p in ("Sexshop", "expert/x1", "wind")] + ["https://site0.org/rarely", "https://site1.org/rarely"]
    df = spark.createDataFrame([(u,) for u in [*urls, *urls, "no scheme", None]], "url string")
    assert urlfilter.learned_words(df) == {"daily": 3, "recipes": 3, "expert": 3, "wind": 3} and urlfilter.learned_words(df, most_words=1) == {"daily": 3}
    known = urlfilter.train(df).known
    assert urlfilter.tokens("dailyrecipes.org", "/sexshop", known) == ["daily", "recipes", "sex", "shop"] and urlfilter.tokens("dailyrecipes", "") == ["dailyrecipes"]
    assert urlfilter.tokens("expertexpert", "", known) == ["expert", "expert"]  # sex isn't found across them


def test_words_of_two_senses_need_company(spark):
    good = ["windfarm.org", "farm.org", "antivirus.com", "coronavirusinfo.org", "weedscience.org", "lotteryheritage.org.uk", "torrentsriver.org"]
    assert [r["verdict"] for r in judged(spark, [f"https://{h}/en/1" for h in good])] == ["allow"] * len(good)


def plain_log_odds(hosts, host, path):
    """The verdict's number by plain dictionaries instead of hashed bins."""
    listed = {**dict.fromkeys(urlfilter.WEAK, 1.0), **dict.fromkeys(urlfilter.STRONG, 8.0)}
    total = sum(listed.values())
    rare = 0.01 / (4.0 * len(urlfilter.ORDINARY) + 1000 + 200)
    start = {w: 0.7 * n / total / rare + 0.3 for w, n in listed.items()}
    prior = math.log(0.001 / 0.999)
    seeds = urlfilter.Judge()
    bad = [seeds.log_odds(sorted(own)) > 0 for own in hosts]
    size, odds = {True: sum(bad), False: len(bad) - sum(bad)}, prior
    for w in urlfilter.tokens(host, path):
        n = {b: sum(w in own for own, mark in zip(hosts, bad, strict=True) if mark == b) for b in size}
        share = sum(n.values()) / max(1, len(hosts))
        odds += math.log((n[True] + 4.0 * start.get(w, 1.0)) / (share * size[True] + 4.0)) - math.log((n[False] + 4.0) / (share * size[False] + 4.0))
    return odds


def test_log_odds_equal_those_of_a_plain_scorer(spark):
    urls = [f"https://{w}{i}.org/{p}" for i in range(9) for w, p in (("casino-zorblax", "a"), ("plain-garden", "poker/zorblax"), ("freebets", ""), ("quiet-zorblax", "x"))]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    model = urlfilter.Model(urlfilter.lexicon(), urlfilter._counts(df.select(urlfilter.host_and_path(F.col("url"))[0].alias("host")).distinct(), None))
    hosts = [set(urlfilter.tokens(h, "")) for h in {u.split("/")[2] for u in urls}]
    for r in urlfilter.apply(df, model).collect():
        assert math.isclose(r["log_odds"], plain_log_odds(hosts, r["host"], r["path"]), abs_tol=1e-9) and r["verdict"] == ("block" if r["log_odds"] > 0 else "allow")


def test_empty_and_repeated_urls(spark):
    df = spark.createDataFrame([], "page_id int, url string")
    assert urlfilter.apply(df, urlfilter.train(df), **RULES).count() == 0
    assert len(judged(spark, ["http://a.org/"] * 3)) == 3


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul><li><a href='/x'>menu</a></li></ul></nav><!-- c --><div class='ad'>buy</div>"
    "<div class=\"cookie-notice\">cookies</div><article><h1>Title &amp; more</h1><p>One <b>bo</b>ld&nbsp;word<br>next<p>Two\n  words <a href=x>link</a>.</p><aside>side</aside><form><p>mail</p></form><ul><li>first<li>second</ul><div id='comments'><p>reader</p></div></article>"
    "<section class='related'><p>more</p></section><footer>&copy; x</footer>"
)


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("text", F.lit("old")).withColumn("x", F.lit(1))
    return {r["page_id"]: r for r in htmltext.extract(df).collect()}


def test_article_without_chrome(spark):
    r = extracted(spark, [(1, "https://a.org/1", PAGE)])[1]
    assert r["text"] == "Title & more\nOne bold word next\nTwo words link.\nfirst\nsecond" and r["n_chars"] == len(r["text"]) and r["x"] == 1


def test_names_of_wrappers_do_not_hide_the_article(spark):
    rows = ["<div class='with-sidebar'><article><p>a</p></article></div><div class='sidebar'>s</div>", "<article><div class='article-header'><h1>T</h1><p>by x</p></div><div class='post-content share-on'><p>a</p></div></article>", "<div class='comments'><article class='comment'><p>c</p></article></div><article><p>a</p></article>", "<main><p>a</p><div class='newsletter'>n</div></main><p>out</p>", "<article><p>a</p><div class='share'>s</div><p style='display: none'>h</p><div hidden>h</div></article>"]
    out = extracted(spark, [(i, "https://a.org", r) for i, r in enumerate(rows)])
    assert [out[i]["text"] for i in range(5)] == ["a", "T\na", "a", "a", "a"]


def test_nulls_cut_and_broken_pages(spark):
    out = extracted(spark, [(1, None, None), (2, "https://a.org", ""), (3, "x", "<article><p>cut &am"), (4, "x", "plain < text"), (5, "x", "<article><p>a</b></p></div>b</article>"), (6, "x", "<script>never closed")])
    assert [out[k]["text"] for k in range(1, 7)] == ["", "", "cut &am", "plain < text", "a\nb", ""]


def test_boilerplate_of_a_host_goes_and_unique_text_stays(spark):
    line = " ".join(f"welcome{k}" for k in range(20))
    rows = [(i, f"https://h.org/{i}", f"<body><div class='z'>{line}</div><div>{' '.join(f'w{i}x{k}' for k in range(20))}</div></body>") for i in range(5)]
    rows += [(9, "https://other.org/", f"<body><div>{line}</div><div>own words</div></body>")]
    out = extracted(spark, rows)
    assert all(out[i]["text"].split()[0] == f"w{i}x0" and "welcome1" not in out[i]["text"] for i in range(5))
    assert out[9]["text"].startswith("welcome0")  # once on its host
    both = extracted(spark, [(i, "https://h.org/", f"<div>{line}</div>") for i in (1, 2)])
    assert both[1]["text"] == both[2]["text"] == line  # a copy keeps its text


def test_articles_that_share_a_passage_keep_it(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    out = extracted(spark, [(i, "https://h.org/", f"<article><p>{passage}</p><p>{i}</p></article>") for i in range(4)])
    assert all(r["text"] == f"{passage}\n{i}" for i, r in out.items())


def test_passages_of_a_few_pages_and_second_versions_stay(spark):
    say = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    menu, passage = say("menu", 15), say("quoted", 30)
    page = lambda i, *texts: (i, f"https://n.org/{i}", f"<body><div>{menu}</div>{''.join(f'<div>{t}</div>' for t in texts)}</body>")
    rows = [page(i, say(f"own{i}x", 25)) for i in range(8)]
    rows += [page(20, say("story", 40), "first ending"), page(21, say("story", 40), "second ending")]
    rows += [page(30, passage, say("one", 20)), page(31, passage, say("two", 20))]
    out = extracted(spark, rows)
    assert all(out[i]["text"] == say(f"own{i}x", 25) for i in range(8))
    assert [out[i]["text"] for i in (20, 21)] == [say("story", 40) + "\nfirst ending", say("story", 40) + "\nsecond ending"]
    assert [out[i]["text"] for i in (30, 31)] == [f"{passage}\n{say('one', 20)}", f"{passage}\n{say('two', 20)}"]


def test_open_blocks_by_brute_force(spark):
    import random

    r, lines = random.Random(8), [" ".join(f"b{k}w{j}" for j in range(14)) for k in range(6)]
    rows, used = [], {}
    for i in range(40):
        host = f"h{i % 3}.org"
        own = r.sample(range(6), r.randint(0, 4))
        for k in own:
            used.setdefault((host, k), set()).add(i)
        rows.append((i, f"https://{host}/{i}", "".join(f"<div>{lines[k]}</div>" for k in own) + f"<div>{' '.join(f'p{i}w{j}' for j in range(13))}</div>"))
    out = extracted(spark, rows)
    sizes = [sum(i % 3 == h for i in range(40)) for h in range(3)]
    for i, url, _ in rows:
        host = url.split("/")[2]
        kept = [k for k in range(6) if lines[k] in out[i]["text"]]
        gone = {k for (h, k), on in used.items() if h == host and len(on) >= 3 and len(on) >= 0.3 * sizes[i % 3]}
        assert not set(kept) & gone and f"p{i}w0" in out[i]["text"]
        assert set(kept) == {k for k in range(6) if i in used.get((host, k), ())} - gone


def test_suffix_array_groups_equal_runs():
    import numpy as np

    tokens = np.array([hash(t) for t in "abcabcdabc"], np.int64)
    order, rank = htmltext.suffix_array(tokens, 3)
    runs = {}
    for i in order:
        runs.setdefault(rank[i], []).append(int(i))
    plain = {}
    for i in range(len(tokens) - 2):
        plain.setdefault("abcabcdabc"[i : i + 3], []).append(i)
    assert sorted(map(sorted, runs.values())) == sorted(plain.values())
    assert list(itertools.chain(*htmltext.suffix_array(tokens[:2], 3))) == []
