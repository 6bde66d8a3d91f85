"""Properties over random inputs."""

import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from driftwright.llm import bpe, chat, decontam, htmltext, neardup, urlfilter  # noqa: E402

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OWN = bpe.Encoder(bpe.Vocabulary(RANKS), P.PATTERN)
TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=80)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_encoding(text):
    (ids,) = OWN.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, st.one_of(TEXT, st.lists(st.sampled_from(["<", "[", "\\", "/", "s>", "INST]", "|end|>", "|turn|>", "x"]), max_size=12).map("".join))), max_size=4))
def test_chat_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns and [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200) | st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<li>", "<b", ">", "&amp;", "text ", "<!--", "-->", "<script>", "</script>"]), max_size=30).map("".join))
def test_any_markup_is_read(page):
    for _, text, state in htmltext.blocks(page):
        assert text == " ".join(text.split()) != "" and state in (htmltext.KEEP, htmltext.OPEN, htmltext.DROP)


@settings(max_examples=100, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=30))
def test_cuts_keep_the_name(name):
    assert "".join(urlfilter.segment(name)) == name


@settings(max_examples=100, deadline=None)
@given(st.lists(st.booleans(), min_size=1, max_size=20))
def test_best_stretch(equal):
    equal = np.array(equal)
    begin, end, n = decontam.stretch(equal)
    value = lambda a, b: sum(1 if e else -decontam.PRICE for e in equal[a:b])
    assert value(begin, end) == max(value(a, b) for a in range(len(equal) + 1) for b in range(a, len(equal) + 1)) and n == equal[begin:end].sum()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abc"), max_size=30))
def test_equal_texts_agree_in_all_bands_and_similarity_is_symmetric(x, y):
    import pandas as pd

    idf = np.ones(1 << neardup.SKETCH_BITS, np.float32)
    a, b = " ".join(x), " ".join(y)
    p, q = neardup.pack_bag.func(pd.Series([a, b]))
    assert neardup.similarity(p, q, idf) == neardup.similarity(q, p, idf)
    bands = neardup.Sampler(idf).bands([a, a])
    assert bands[0] == bands[1] and (not x or neardup.similarity(p, p, idf) == 1.0)
