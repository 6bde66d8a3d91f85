"""Byte-level BPE and chat formatting against the libraries and by exact round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from driftwright.llm import bpe, chat  # noqa: E402

RANKS = P.path("byte_bpe_50k.tiktoken")
MODEL = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(1)
    fixed = ["", " ", "a", "  \n\n x", "it's 123456789 été 漢字かな🙂🙂 <|endoftext|>", "a" * 3000, "abcabcdefghij" * 200 + " q", "́‍" * 700, "".join(r.choice("etaoinshrdlu") for _ in range(5000))]
    return fixed + ["".join(r.choice("abcdé ñ\n 12🙂'ts<|>") for _ in range(r.randint(0, 60))) for _ in range(300)]


def test_ids_equal_the_library(plain):
    own = bpe.Encoder(bpe.Vocabulary.load(RANKS), P.PATTERN)
    for t, ids in zip(texts(), own.encode(texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(t)
        assert own.vocabulary.decode(np.frombuffer(ids, "<u4")).tobytes() == t.encode()


def test_long_chunks_merge_alike_on_either_path():
    v = bpe.Vocabulary.load(RANKS)
    for piece in (b"abababab" * 60, bytes(random.Random(3).choices(b"thenandof", k=500))):
        (matrix,) = v.encode_chunks([piece])
        assert v.merge_long(piece).astype("<u4").tobytes() == matrix


def test_column_keeps_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello", "x", 5), (None, None, None, None), (1, "hello", "x", 5)], "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.encode(df, RANKS, P.PATTERN, keep="digests").collect()
    assert [r["n_tokens"] for r in rows] == [1, 0, 1] and rows[0]["ids"] == "x"
    assert rows[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bytes(bpe.encode(df, RANKS, P.PATTERN).first()["decoded"]) == b"hello"
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, RANKS, P.PATTERN, keep="nothing")


NASTY = ["", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|sep|>hi", "[\\INST] \\\\[INST]", "<\\s> <s>", "  lead and trail \n", "🙂é́\n\n", "<|endoftext|>", "a" * 5000]


@pytest.mark.parametrize("text", NASTY)
def test_escapes_are_reversible_and_leave_no_control_string(text):
    own = chat.escape(text)
    assert chat.unescape(own) == text and chat.escape(own) != own or own == text
    assert not any(c in own for c in (chat.TURN, chat.SEP, chat.END, chat.BEGIN, chat.CLOSE, "[INST]", "[/INST]"))


def test_rendered_turns_are_read_back():
    turns = [(r, t) for r in ("system", "user", "assistant", "<|sep|>") for t in NASTY]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns and [chat.unescape(text[a:b]) for a, b in spans] == [t for _, t in turns]


def test_mask_is_the_assistants_text_by_brute_force():
    turns = [("user", "one two"), ("assistant", " spaced\n"), ("assistant", ""), ("user", "x"), ("assistant", "🙂漢字 done")]
    (f,) = chat.Formatter(MODEL).format([turns])
    _, spans = chat.render(turns)
    wanted = {k for (role, _), (a, b) in zip(turns, spans, strict=True) if role == "assistant" for k in range(a, b)}
    assert {k for _, a, b in f.mask for k in range(a, b)} == wanted
    assert "".join(map(chat.unescape, chat.masked(f.text, f.mask[:, 1], f.mask[:, 2]))) == " spaced\n🙂漢字 done"


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", "no?"), (2, 0, None, None), (2, 0, None, None), (None, 3, "assistant", "lost"), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r["d"] for r in chat.format_conversations(df, MODEL).select("conv_id", chat.digest("formatted", "mask_start", "mask_stop").alias("d")).collect()}
    assert (out[1]["n_turns"], out[1]["loss_chars"], out[2]["n_turns"], out[None]["loss_chars"]) == (3, 3, 2, 4)
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\nno?\nassistant\nyes\nuser\n\n").hexdigest()
    assert out[1]["loss_sha256"] == hashlib.sha256(b"yes").hexdigest()
    assert chat.format_conversations(df.limit(0), MODEL).count() == 0
