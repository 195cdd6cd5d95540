"""Registered queries of the training-data operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potentia.llm import ann, bpe, capdedup, chat, covertree, knlm, langid, mixing, secrets, simhash, toxicity, trie, warc
from potentia.llm.textio import fold_of
from potentia.sources.tables import load


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    fold = fold_of("doc_id", 3)
    languages, model = langid.train(docs.where(fold != 1))
    return (langid.predict(docs, languages, model)
            .select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "n_langs"))


def encode_digests(docs: DataFrame, ranks_file: str = "byte_bpe_50k.tiktoken", with_ids: bool = False) -> DataFrame:
    """Encode ``docs(doc_id, text)`` by a public rank file, decode the ids, digest both."""
    ranks = bpe.read_ranks(public_tokenizers.path(ranks_file))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN, bpe.digests(with_ids))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(load(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(load(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs.where(fold_of("doc_id", 3) != 1), load(spark, sf_dir, "labels"))
    return (toxicity.score(docs, lexicon)
            .select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
                    F.size("passages").alias("n_passages")))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(load(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = knlm.train(docs.where(fold_of("doc_id", 5) != 1), order=3)
    return (knlm.score(docs, model)
            .select("doc_id", (fold_of("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                    "base_score", "score"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capdedup.near_duplicates(load(spark, sf_dir, "embeddings"), cosine=0.93)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(load(spark, sf_dir, "conversations"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(load(spark, sf_dir, "pages"), least=1000)
    return (warc.read_archives(spark, archives.folder)
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return covertree.mine(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=moved)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(load(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_byte_bpe, op3_secret_scan, op4_toxicity, op5_simhash_dedup, op6_lm_score, op7_mix_sources,
                                    op8_nearest_neighbours, op9_embedding_dedup, op10_chat_format, op11_warc, op12_hard_negatives, op13_conversation_trie)}

ORACLES: dict[str, str] = {
    # whole prefixes instead of hashes: a signature is the list of md5s of the turns so far
    "op10_chat_format": """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT conv_id, role, text,
             row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
             string_agg(md5(coalesce('r' || role, 'n') || chr(31) || coalesce('t' || text, 'n')), '')
               OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sig
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
q AS (SELECT conv_id, pos, n, md5(sig) AS sig FROM p),
whole AS (SELECT n, sig, min(conv_id) AS conv_id, count(*) AS n_copies FROM q WHERE pos = n GROUP BY n, sig),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.pos < q.n AND q.pos = w.n AND q.sig = w.sig))
SELECT p.conv_id, CAST((p.pos - 1) // 256 AS BIGINT) AS part, kept.n AS n_turns, kept.n_copies,
       string_agg('<|im_start|>' || coalesce(p.role, '') || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10), ''
                  ORDER BY p.pos) AS text
FROM p JOIN kept ON p.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY p.conv_id, (p.pos - 1) // 256, kept.n, kept.n_copies""",
    "op11_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS target,
             row_number() OVER (PARTITION BY page_id, html) - 1 AS nth FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN bytes >= 1000 AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN bytes >= 1000 AND page_id IS DISTINCT FROM target THEN target END AS refers_to,
       'urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || ':' || sha1(html) || ':' || nth AS record_id
FROM t""",
    "op12_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
             CAST(list_sum(list_transform(list_zip(a.x, v.x), lambda t: t[1] * t[2])) AS BIGINT) AS score
      FROM v a JOIN v ON (v.vec_id <> a.vec_id OR v.label <> a.label) AND len(v.x) = len(a.x) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score,
       s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10""",
    # crc32 bit by bit; nodes by the md5s of their turns; subtrees by the members' own prefixes
    "op13_conversation_trie": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS host,
             xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
               lambda acc, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END),
                                          xor(acc, b)), CAST(4294967295 AS BIGINT))) % 9 AS h
      FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.host AND t.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM r),
p AS (SELECT conv_id, depth, octet_length(encode(text)) AS bytes,
             md5(string_agg(md5('r' || role || chr(31) || text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS sig FROM d
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT depth, sig, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY depth, sig),
m AS (SELECT p.conv_id AS member, p.depth, n.conv_id FROM p JOIN n USING (depth, sig)),
up AS (SELECT n.conv_id, n.depth, n.n_convs, n.bytes, m.conv_id AS parent FROM n LEFT JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY ALL),
sums AS (SELECT m.conv_id, m.depth, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((up.n_convs - 1) * up.bytes) AS saved
         FROM up LEFT JOIN kids ON kids.conv_id = up.conv_id AND kids.depth = up.depth
         JOIN m ON m.member = up.conv_id AND m.depth <= up.depth GROUP BY ALL),
last AS (SELECT member, max(depth) AS depth FROM m GROUP BY member),
ends AS (SELECT m.conv_id, m.depth, string_agg(CAST(m.member AS VARCHAR), ',' ORDER BY m.member) AS ids
         FROM last JOIN m ON m.member = last.member AND m.depth = last.depth GROUP BY ALL)
SELECT up.conv_id, up.depth, up.parent AS parent_conv_id, up.n_convs, CAST(coalesce(kids.n_children, 0) AS BIGINT) AS n_children,
       CAST(sums.n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM up LEFT JOIN kids ON kids.conv_id = up.conv_id AND kids.depth = up.depth
JOIN sums ON sums.conv_id = up.conv_id AND sums.depth = up.depth
LEFT JOIN ends ON ends.conv_id = up.conv_id AND ends.depth = up.depth""",
}
