"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat, decontaminate, language, licenses, packing, pii, quality, repeats, similar, spelling, trie, urls, wavelet
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; ``RISKFRAME_TOKENIZERS`` names another folder."""
    folder = os.environ.get("RISKFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.sql("""SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
                          UNION ALL SELECT -7L, 1L, 'assistant', '</s>[INST] ok [/INST]'""")
    return chat.digests(chat.read_back(chat.format_windows(turns.unionByName(marked))))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, vocabulary("piece_bpe_32k.model"))
    scored = language.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = wavelet.new_path(spark)
    wavelet.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    return wavelet.read_documents(spark, path)


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


@query
def op8_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar.groups(table(spark, sf_dir, "documents"), similar.Rule(shingle=3, percent=90))
    return found.select("doc_id", "n_shingles", "component_id")


@query
def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.remove(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB: a fold over bytes and, per byte, eight shifts."""
    digit = "(strpos('0123456789ABCDEF', substr(hex({t}), 2 * i - {o}, 1)) - 1)"
    byte = f"({digit.format(t=text, o=1)} * 16 + {digit.format(t=text, o=0)})::BIGINT"
    steps = f"flatten(list_transform(range(1, strlen({text}) + 1), lambda i: [{byte}, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "lambda acc, e: CASE WHEN e >= 0 THEN xor(acc, e) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {fold}), 4294967295)"


SQL["op11_conversation_trie"] = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos FROM t),
 own AS (SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY pos) AS turns FROM o GROUP BY conv_id),
 head AS (SELECT *, conv_id::VARCHAR AS s FROM own), h AS (SELECT conv_id, turns, {_crc32('s')} % 6 AS h FROM head),
 re AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
 all_nodes AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM re, unnest(range(len(turns) + 1)) u(d)),
 n AS (SELECT d AS depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends) AS members
  FROM all_nodes GROUP BY d, prefix),
 k AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS c FROM n WHERE depth > 0 GROUP BY ALL),
 m AS (SELECT n.*, coalesce(c, 0) AS n_children, p.conv_id AS parent_conv_id FROM n LEFT JOIN k ON k.depth = n.depth AND k.prefix = n.prefix
  LEFT JOIN n p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
 s AS (SELECT a.depth, a.prefix, count(*) FILTER (b.n_children = 0) AS n_leaves,
  sum(CASE WHEN b.depth > 0 THEN (b.n_convs - 1) * length(b.prefix[b.depth].x) ELSE 0 END)::BIGINT AS saved_tokens
  FROM m a JOIN m b ON b.depth >= a.depth AND b.prefix[1:a.depth] = a.prefix GROUP BY ALL)
 SELECT conv_id, m.depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(members, '')) AS ends_sha256
 FROM m JOIN s ON s.depth = m.depth AND s.prefix = m.prefix"""

SQL["op12_spelling_variants"] = f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
 counted AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS told, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
 hashed AS (SELECT run, c, {_crc32('told')} AS h FROM counted),
 cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
 words AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
 gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(i)),
 near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN gaps b ON b.rest = a.word UNION SELECT b.word, a.word, a.n FROM words a JOIN gaps b ON b.rest = a.word),
 best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS best, max(other_n) AS best_n FROM near GROUP BY word),
 f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
 steps AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT s.word, f.form FROM steps s JOIN f ON f.word = s.at WHERE f.form IS NOT NULL),
 ends AS (SELECT s.word, s.at AS root FROM steps s JOIN f ON f.word = s.at WHERE f.form IS NULL)
 SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends e ON e.word = f.word"""


@query
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(trie.rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


#: The url filter's rules; what none of them fits is left to the trees.
URL_RULES = [
    urls.Rule(urls.ALLOW, "org"), urls.Rule(urls.BLOCK, "example.org", "/es/"), urls.Rule(urls.BLOCK, "example.org", "/en/1"),
    urls.Rule(urls.ALLOW, "com", "/fr/"), urls.Rule(urls.BLOCK, "com", "/de/"),
]


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
