"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read_table
from .decontamination import contamination_digest, find_contamination
from .jaccard_join import jaccard_components
from .language_id import predict_languages
from .packing import pack_documents
from .pitman_yor import score_documents
from .quotations import build_conversations
from .sharding import assign_shards
from .token_counts import count_tokens
from .token_files import token_digests
from .tokenizing import tokenizer_path
from .topk import quantize, top_k



def op1_sharding(spark, sf_dir):
    out = assign_shards(read_table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quotation_chat(spark, sf_dir):
    return build_conversations(read_table(spark, sf_dir, "conversations"))


def op3_topk(spark, sf_dir):
    return top_k(quantize(read_table(spark, sf_dir, "embeddings"), 256), F.col("vec_id") % 50 == 0, 5)


def op4_lm_scoring(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return score_documents(read_table(spark, sf_dir, "documents"), held_out)


def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1, 4096)


def op6_token_files(spark, sf_dir):
    return token_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)


def op7_token_counts(spark, sf_dir):
    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024)


def op8_language_id(spark, sf_dir):
    return predict_languages(read_table(spark, sf_dir, "documents"))


def op9_decontamination(spark, sf_dir):
    return contamination_digest(find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 10))


def op10_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(read_table(spark, sf_dir, "documents"), 4, 85)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_quotation_chat, op3_topk, op4_lm_scoring, op5_best_fit_packing, op6_token_files, op7_token_counts, op8_language_id, op9_decontamination, op10_ngram_jaccard_join)}

_FOLD = "lower(regexp_replace(regexp_replace(line, '^([ \\t]*>)*', ''), '\\s+', ' ', 'g'))"

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL: dict[str, str] = {
    # the checksum bit by bit, lowest bit of each byte first
    "op1_sharding": """WITH sized AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, string_split(CAST(CAST(encode(coalesce(text, '')) AS BIT) AS VARCHAR), '') AS b FROM documents),
sums AS (SELECT doc_id, n + 1 AS size, sum(n + 1) OVER (ORDER BY doc_id) AS upto, sum(n + 1) OVER () AS total, CASE WHEN n = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * n), lambda k: CAST(b[(k // 8) * 8 + 8 - k % 8] AS BIGINT))), lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)))) END AS crc FROM sized),
cut AS (SELECT *, CAST(least(15, (2 * upto - size) * 16 // (2 * total)) AS INTEGER) AS shard FROM sums)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut""",
    "op2_quotation_chat": f"""WITH RECURSIVE lines AS (SELECT conv_id, turn, row_number() OVER () AS m, role, text FROM conversations),
cut AS (SELECT m, conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM lines WHERE text IS NOT NULL),
levels AS (SELECT m, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^([ \\t]*>)*'), '[^>]', '', 'g')) AS level, trim({_FOLD}) AS t, line FROM cut),
marked AS (SELECT *, CASE WHEN t = '' OR lag(t) OVER w = '' OR lag(level) OVER w <> level THEN 1 ELSE 0 END AS new FROM levels WINDOW w AS (PARTITION BY m ORDER BY i)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY m ORDER BY i) AS p FROM marked),
passages AS (SELECT m, conv_id, turn, p, min(level) AS level, string_agg(t, ' ' ORDER BY i) AS t FROM numbered GROUP BY ALL HAVING string_agg(t, ' ' ORDER BY i) <> ''),
origins AS (SELECT conv_id, t, min(turn) AS origin FROM passages WHERE level = 0 GROUP BY 1, 2),
links AS (SELECT p.conv_id, p.turn, max(origin) AS parent FROM passages p JOIN origins o ON o.conv_id = p.conv_id AND o.t = p.t WHERE level = 1 AND origin < p.turn GROUP BY 1, 2),
walk AS (SELECT conv_id, turn, parent AS up, 1 AS depth FROM links UNION ALL SELECT w.conv_id, w.turn, l.parent, w.depth + 1 FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.turn = w.up),
roots AS (SELECT conv_id, turn, min(up) AS root, CAST(max(depth) AS BIGINT) AS depth FROM walk GROUP BY 1, 2),
bodies AS (SELECT m, regexp_replace(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), '^\\s+|\\s+$', '', 'g') AS body FROM levels GROUP BY m),
quotes AS (SELECT m, count(*) AS n_quotes FROM passages WHERE level > 0 GROUP BY m),
rows_ AS (SELECT l.conv_id, l.turn, coalesce(l.role, 'user') AS role, coalesce(b.body, '') AS body, coalesce(k.parent, -1) AS parent, coalesce(r.root, l.turn) AS root, coalesce(r.depth, 0) AS depth, coalesce(q.n_quotes, 0) AS n_quotes
  FROM lines l LEFT JOIN bodies b USING (m) LEFT JOIN quotes q USING (m) LEFT JOIN links k ON k.conv_id = l.conv_id AND k.turn = l.turn LEFT JOIN roots r ON r.conv_id = l.conv_id AND r.turn = l.turn)
SELECT conv_id, turn, role, body, '<|' || role || '|>' || chr(10) || body || chr(10) AS formatted, parent, root, depth, n_quotes, row_number() OVER (PARTITION BY conv_id ORDER BY root, turn, role, body) - 1 AS position FROM rows_""",
    "op3_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op9_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
sizes AS (SELECT DISTINCT n FROM items),
grams AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, g.n, item_id FROM grams g JOIN windows USING (n, x)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
}
