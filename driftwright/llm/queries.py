"""The queries that apply the corpus operators to whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, chroma, decontam, htmltext, langid, neardup, quality, sharding, spelling, toxicity, urlfilter, veccode
from .common import held_out, learnable, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(learnable("doc_id")))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = urlfilter.apply(pages, urlfilter.train(pages), block=("net/", "example.com/de/"), allow=("example.net/en/", "org/fr/"))
    return out.select("page_id", "host", "path", "rule", "verdict", "words", "log_odds")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontam.overlaps(docs.select("doc_id", "text"), items, whole=True)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep="digests")
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_audio_fingerprints(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    """The tables hold no audio: each vector of ``embeddings`` is played as a recording, whole.

    Those whose id ``every`` divides are queries too: an excerpt of each, of 40 tones from between two frames on, is
    the recording -vec_id - 1, which aligns with the one that it was cut from.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    whole = rows.select("vec_id", F.array("embedding").alias("parts"))
    part = F.array(excerpt_start("vec_id").cast("double"), F.lit(40.0 * chroma.FRAME))
    cut = rows.where(F.col("vec_id") % every == 0).select((-F.col("vec_id") - 1).alias("vec_id"), F.array("embedding", part).alias("parts"))
    return chroma.classes(whole.union(cut), id_="vec_id", media="parts", decode=chroma.excerpt).withColumnRenamed("id", "vec_id")


def excerpt_start(vec_id: str) -> Column:
    """The sample of a recording at which its excerpt begins: 8 to 24 frames in."""
    return F.lit(8 * chroma.HOP) + F.pmod(F.col(vec_id) * 37, F.lit(16 * chroma.HOP))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(rows.unionByName(probe), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("conv_id", chat.digest("formatted", "mask_start", "mask_stop").alias("d")).select("conv_id", "d.*")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """``documents`` appended in four arrivals, compacted, and read back by the manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", target_bytes=128 << 20)
    for k in range(arrivals):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)) == k))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels.where(learnable("doc_id")).select("doc_id", "toxic"))
    out = toxicity.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = veccode.train(rows)
    return veccode.encode(rows, books).select("vec_id", "code", "error", "label_error", F.lit(veccode.digest(books)).alias("codebooks_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), every=199))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs.select("doc_id", "text"), labels.where(learnable("doc_id", 1, 3)).select("doc_id", "quality"))
    out = quality.score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out("doc_id", 1, 3).alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_filter, op3_decontamination, op4_byte_bpe, op5_audio_fingerprints, op6_chat_format, op7_near_duplicates, op8_sharding, op9_toxicity, op10_html_text, op11_vector_codes, op12_spelling_variants, op13_quality)}


_CONTROL = r"([<\[])(\\*)((?:\|turn\||\|sep\||\|end\||\|endoftext\||/?s)>|/?INST\]|<SYS>>|</SYS>>|/?TOOL\])"


def _escaped(column: str) -> str:
    return f"length(regexp_replace(coalesce({column}, ''), '{_CONTROL}', '\\1\\\\\\2\\3', 'g'))"


#: The template adds 3 + 4 characters to a conversation and 8 + 7 + 7 + 1 to each turn.
CHAT_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (7 + sum(23 + {_escaped('role')} + {_escaped('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

#: For the markup of the test pages: an article of headings and paragraphs, with the references that it uses.
PAGES_SQL = """
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|\\z)', 1, 's') AS article FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(article, '</?(?:h1|p)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM c
"""


SHARDS_SQL = "SELECT doc_id, lang, source, length(text)::BIGINT AS n_chars, md5(text) AS text_md5 FROM documents"


def _rounds(name: str, books: str) -> str:
    """The nearest entry of each part, as table ``name``."""
    return f"{name} AS (SELECT q.id, q.part, arg_min(b.entry, (list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.entry)) AS entry, min(list_sum(list_transform(list_zip(q.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS far FROM q JOIN {books} b USING (part) GROUP BY ALL)"


def _moved(name: str, of: str, books: str) -> str:
    """The codebooks after a round: floors of means, as table ``name``."""
    return f"""{name} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
        SELECT part, entry, list(x ORDER BY place) AS v FROM (SELECT part, entry, place, (sum(v[place]) - ((sum(v[place]) % count(*)) + count(*)) % count(*)) // count(*) AS x
            FROM {of} JOIN q USING (id, part), (SELECT unnest(range(1, 5)) AS place) GROUP BY ALL) GROUP BY ALL) m USING (part, entry))"""


CODES_SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::HUGEINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT id, part, w[part * 4 + 1 : part * 4 + 4] AS v FROM kept, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, id - 1 AS entry, v FROM q WHERE id <= 64),
{_rounds("a0", "b0")}, {_moved("b1", "a0", "b0")}, {_rounds("a1", "b1")}, {_moved("b2", "a1", "b1")}, {_rounds("a2", "b2")},
c AS (SELECT id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a2 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM c JOIN kept USING (id)
"""


#: CRC-32 by its table of 256 remainders, which eight shifts each make.
SPELLING_SQL = """
WITH RECURSIVE crc_step AS (
    SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8
),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{6,}')) AS w FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, w, n, list_transform(range(1, strlen(doc_id || ':' || w) + 1), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || w)), 2 * i - 1, 2))::BIGINT) AS b FROM runs),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM bytes, crc),
thin AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM thin WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
dels AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
short AS (SELECT DISTINCT word, n, s FROM dels),
pairs AS (
    SELECT a.word, b.word AS other, b.n AS m FROM dels a JOIN dels b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
    UNION ALL SELECT d.word, w.word, w.n FROM short d JOIN words w ON d.s = w.word
    UNION ALL SELECT w.word, d.word, d.n FROM short d JOIN words w ON d.s = w.word
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM pairs GROUP BY word),
forms AS (SELECT w.word, CASE WHEN m >= 5 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * n THEN m END::BIGINT AS form_n FROM words w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT up.word, f.word, f.form FROM up JOIN forms f ON f.word = up.next)
SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM forms f JOIN up USING (word) WHERE up.next IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_spelling_variants": SPELLING_SQL, "op11_vector_codes": CODES_SQL, "op8_sharding": SHARDS_SQL, "op6_chat_format": CHAT_SQL, "op10_html_text": PAGES_SQL}
