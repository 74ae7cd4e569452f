"""Queries over documents, conversations, parts and events: text, vocabularies, prompts and sequences."""

from __future__ import annotations

import json

from pyspark.sql import Window, functions as F

from ..functions import prompt, sequences as seq, text as tx
from ..operators import aggregates, joins, records, splits, tokens, vocab
from .registry import query, table

# --- documents -------------------------------------------------------------------------------------------------------


@query("doc_length_bins", """
SELECT CASE WHEN length(text) < 1000 THEN '<1000' WHEN length(text) < 2560 THEN '1000<=x<2560' ELSE '>=2560' END AS bin, count(*) AS n
FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def doc_length_bins(spark, sf):
    return aggregates.length_bins(table(spark, sf, "documents"), "text")


@query("lang_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def lang_counts(spark, sf):
    return aggregates.counted(table(spark, sf, "documents"), "lang")


@query("region_members", "SELECT n_regionkey, count(*) AS n, string_agg(n_name, '|' ORDER BY n_name) AS members FROM nation GROUP BY 1")
def region_members(spark, sf):
    return aggregates.members(table(spark, sf, "nation"), "n_regionkey", "n_name").withColumn("members", F.array_join("members", "|"))


@query("doc_quality_join", "SELECT d.lang, l.quality, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1, 2")
def doc_quality_join(spark, sf):
    return joins.looked_up(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"]).groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("unlabelled_docs", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_docs(spark, sf):
    return joins.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("common_doc_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_doc_keys(spark, sf):
    return joins.common_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


_SPLIT_SQL = """
SELECT doc_id, CASE WHEN pos < v THEN 'validation' WHEN pos < v + t THEN 'test' ELSE 'train' END AS usage FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) - 1 AS pos,
         floor(count(*) OVER (PARTITION BY source) * CASE WHEN contains(source, 'book') THEN 0.025 ELSE 0.05 END::DOUBLE) AS v,
         floor(count(*) OVER (PARTITION BY source) * CASE WHEN contains(source, 'book') THEN 0.025 ELSE 0.05 END::DOUBLE) AS t
  FROM documents)"""


@query("split_assign", _SPLIT_SQL)
def split_assign(spark, sf):
    return splits.split(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "usage")


@query("split_sizes", f"SELECT usage, count(*) AS n FROM ({_SPLIT_SQL}) GROUP BY usage")
def split_sizes(spark, sf):
    return split_assign(spark, sf).groupBy("usage").agg(F.count(F.lit(1)).alias("n"))


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, sf):
    return splits.sample(table(spark, sf, "documents").select("doc_id", "lang"), 100, "doc_id")


@query("val_topup", f"""
WITH s AS ({_SPLIT_SQL}), v AS (SELECT doc_id FROM s WHERE usage = 'validation'), t AS (SELECT doc_id FROM s WHERE usage = 'test'),
n AS (SELECT count(*) AS n FROM v)
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM v) WHERE r <= 300
UNION ALL SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS r FROM t), n WHERE n <= 300 AND r <= 300 - n""")
def val_topup(spark, sf):
    rows = split_assign(spark, sf)
    val, test = (rows.filter(F.col("usage") == u).select("doc_id") for u in ("validation", "test"))
    return splits.topped_up(val, test, "doc_id")[0]


# --- vocabularies ----------------------------------------------------------------------------------------------------

_WORDS_SQL = "SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_split_to_array({t}, '\\s+')) AS word FROM {f}) WHERE word <> '' GROUP BY word"
_SYMBOLS_SQL = f"SELECT word, freq, list_append(regexp_extract_all(word, '(?s).'), '</w>') AS s FROM ({_WORDS_SQL.format(t='text', f='documents')})"
_PAIRS_SQL = f"""SELECT s[i] AS "left", s[i + 1] AS "right", CAST(sum(freq) AS BIGINT) AS freq
FROM (SELECT s, freq, unnest(range(1, len(s))) AS i FROM ({_SYMBOLS_SQL})) GROUP BY 1, 2"""


@query("word_freq", _WORDS_SQL.format(t="text", f="documents"))
def word_freq(spark, sf):
    return vocab.word_counts(table(spark, sf, "documents"), "text")


def _symbols(spark, sf):
    return vocab.symbols(word_freq(spark, sf))


@query("spelled_words", f"SELECT array_to_string(s, ' ') AS spelled, freq FROM ({_SYMBOLS_SQL})")
def spelled_words(spark, sf):
    return word_freq(spark, sf).select(tx.spelled(F.col("word")).alias("spelled"), "freq")


@query("pair_freq", _PAIRS_SQL)
def pair_freq(spark, sf):
    return vocab.pair_counts(_symbols(spark, sf))


@query("token_freq", f"SELECT token, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(s) AS token, freq FROM ({_SYMBOLS_SQL})) GROUP BY token")
def token_freq(spark, sf):
    return vocab.token_counts(_symbols(spark, sf))


@query("top_pair", f'SELECT * FROM ({_PAIRS_SQL}) ORDER BY freq DESC, "left", "right" LIMIT 1')
def top_pair(spark, sf):
    return vocab.most_frequent_pair(_symbols(spark, sf))


def _merges_sql(n: int) -> str:
    """n merges as a chain of tables: words as texts of symbols, each between the characters 2 and 3, so that replacing
    two neighbours goes from left to right without overlaps."""
    chain = [f"w0 AS (SELECT chr(2) || array_to_string(s, chr(3) || chr(2)) || chr(3) AS t, freq FROM ({_SYMBOLS_SQL}))"]
    for k in range(n):
        parts = f"SELECT string_split(t[2:-2], chr(3) || chr(2)) AS s, freq FROM w{k}"
        pairs = f'SELECT s[i] AS "left", s[i + 1] AS "right", CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT s, freq, unnest(range(1, len(s))) AS i FROM ({parts})) GROUP BY 1, 2'
        chain.append(f'm{k} AS MATERIALIZED (SELECT * FROM ({pairs}) ORDER BY freq DESC, "left", "right" LIMIT 1)')
        chain.append(f"w{k + 1} AS MATERIALIZED (SELECT replace(t, chr(2) || m.left || chr(3) || chr(2) || m.right || chr(3), chr(2) || m.left || m.right || chr(3)) AS t, w.freq FROM w{k} w, m{k} m)")
    return f"WITH {', '.join(chain)} " + " UNION ALL ".join(f'SELECT {k} AS merge_no, "left", "right", freq FROM m{k}' for k in range(n))


@query("bpe_5_merges", _merges_sql(5))
def bpe_5_merges(spark, sf):
    return vocab.merges(_symbols(spark, sf), 5)


@query("bpe_50_merges", _merges_sql(50))
def bpe_50_merges(spark, sf):
    return vocab.merges(_symbols(spark, sf), 50)


@query("unk_words", f"SELECT word, freq FROM ({_WORDS_SQL.format(t='text', f='documents')}) WHERE word NOT IN (SELECT word FROM ({_WORDS_SQL.format(t='text', f='benchmark')}))")
def unk_words(spark, sf):
    return vocab.unknown_words(word_freq(spark, sf), vocab.word_counts(table(spark, sf, "benchmark"), "text"))


@query("unk_chars", f"""
WITH v AS (SELECT word FROM ({_WORDS_SQL.format(t='text', f='benchmark')})),
u AS (SELECT word, freq FROM ({_WORDS_SQL.format(t='text', f='documents')}) WHERE word NOT IN (SELECT word FROM v))
SELECT char, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT unnest(list_distinct(regexp_extract_all(word, '(?s).'))) AS char, freq FROM u)
WHERE char NOT IN (SELECT word FROM v) GROUP BY char""")
def unk_chars(spark, sf):
    return vocab.unknown_characters(unk_words(spark, sf), vocab.word_counts(table(spark, sf, "benchmark"), "text"))


@query("vocab_map", f"""
WITH w AS (SELECT word, freq FROM ({_WORDS_SQL.format(t='text', f='benchmark')})),
old AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS id FROM w), new AS (SELECT word, row_number() OVER (ORDER BY freq DESC, word) - 1 AS id FROM w WHERE freq > 1)
SELECT new.id AS new_id, old.id AS old_id FROM new JOIN old USING (word)""")
def vocab_map(spark, sf):
    w = vocab.word_counts(table(spark, sf, "benchmark"), "text")
    old = splits.numbered(w, ["word"], out="id").select(F.col("word").alias("token"), "id")
    new = splits.numbered(w.filter("freq > 1").withColumn("rare", -F.col("freq")), ["rare", "word"], out="id").select(F.col("word").alias("token"), "id")
    return joins.vocabulary_map(new, old)


@query("embedding_gather", """
SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS new_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last, len(embedding) AS dims FROM embeddings""")
def embedding_gather(spark, sf):
    e = table(spark, sf, "embeddings")
    ids = splits.numbered(e.select(F.col("vec_id").alias("old_id"), (-F.col("vec_id")).alias("back")), ["back"], out="new_id").select("new_id", "old_id")
    v = F.col("embedding")
    return joins.gathered(ids, e.select("vec_id", "embedding"), "vec_id").select("new_id", v[0].cast("double").alias("first"), F.element_at(v, -1).cast("double").alias("last"), F.size(v).cast("bigint").alias("dims"))


@query("char_classes", f"""
SELECT regexp_full_match(word, '[\\x{{4e00}}-\\x{{9fa5}}a-zA-Z]+') AS letters, count(*) AS words, CAST(sum(freq) AS BIGINT) AS freq
FROM ({_WORDS_SQL.format(t='text', f='documents')}) GROUP BY 1""")
def char_classes(spark, sf):
    return word_freq(spark, sf).groupBy(tx.chinese_or_letters(F.col("word")).alias("letters")).agg(F.count(F.lit(1)).alias("words"), F.sum("freq").alias("freq"))


@query("keep_reject", f"""
SELECT CASE WHEN regexp_full_match(replace(word, '▁', ''), '[\\x{{4e00}}-\\x{{9fa5}}a-zA-Z]+') THEN 'keep' ELSE 'reject' END AS list, word
FROM ({_WORDS_SQL.format(t='text', f='documents')})""")
def keep_reject(spark, sf):
    keep, reject = records.quarantined(word_freq(spark, sf), ~tx.chinese_or_letters(tx.piece(F.col("word"))))
    return keep.select(F.lit("keep").alias("list"), "word").unionByName(reject.select(F.lit("reject").alias("list"), "word"))


_EXTENDED_SQL = tx.EXTENDED.replace("'", "''")


@query("extended_valid", f"SELECT word, regexp_matches(word, '{_EXTENDED_SQL}') AS valid FROM ({_WORDS_SQL.format(t='text', f='documents')})")
def extended_valid(spark, sf):
    return word_freq(spark, sf).select("word", tx.extended_valid(F.col("word")).alias("valid"))


@query("added_renumber", """
SELECT p_name AS token, p_partkey AS id, CASE WHEN p_partkey < 4 THEN p_partkey ELSE row_number() OVER (PARTITION BY p_partkey >= 4 ORDER BY p_partkey) - 1 + 5000 - 1 END AS new_id FROM part""")
def added_renumber(spark, sf):
    return vocab.renumbered_added(table(spark, sf, "part").select(F.col("p_name").alias("token"), F.col("p_partkey").alias("id")), 5000)


# --- similarities ----------------------------------------------------------------------------------------------------

_QUICK_SQL = """SELECT p_partkey, p_brand, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(regexp_extract_all(a, '.')),
  lambda c: least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))))), 0) / (length(a) + length(b)) END AS ratio
FROM (SELECT p_partkey, p_brand, p_name AS a, p_type AS b FROM part)"""


def _quick(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", tx.quick_ratio(F.col("p_name"), F.col("p_type")).alias("ratio"))


@query("quick_ratio_pairs", f"SELECT p_partkey, ratio FROM ({_QUICK_SQL})")
def quick_ratio_pairs(spark, sf):
    return _quick(spark, sf).select("p_partkey", "ratio")


@query("ned_pairs", "SELECT p_partkey, 1 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE) AS ned FROM part")
def ned_pairs(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.edit_similarity(F.col("p_name"), F.col("p_type")).alias("ned"))


@query("mean_similarity", f"SELECT round(avg(ratio), 8) AS mean FROM ({_QUICK_SQL})")
def mean_similarity(spark, sf):
    return _quick(spark, sf).agg(F.round(F.avg("ratio"), 8).alias("mean"))


@query("epoch_metric", f"SELECT p_brand, round(sum(ratio) / count(ratio), 8) AS mean, count(ratio) AS n, grouping(p_brand) = 1 AS is_total FROM ({_QUICK_SQL}) GROUP BY GROUPING SETS ((p_brand), ())")
def epoch_metric(spark, sf):
    return aggregates.with_total(_quick(spark, sf), "p_brand", "ratio").withColumn("mean", F.round("mean", 8))


@query("running_mean", """
SELECT event_id, round(sum(value) OVER w / (count(*) OVER w + 0.001), 6) AS mean_loss FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_mean(spark, sf):
    return aggregates.running_mean(table(spark, sf, "events"), "value", "user_id", ["ts", "event_id"]).select("event_id", F.round("mean_loss", 6).alias("mean_loss"))


@query("best_so_far", """
WITH a AS (SELECT event_id, user_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM events),
b AS (SELECT *, best_before IS NULL OR coalesce(value > best_before, false) AS improved FROM a),
c AS (SELECT *, sum(improved::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1 AS streak FROM c)
SELECT event_id, best_before, improved, streak, max((streak >= 3)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM d""")
def best_so_far(spark, sf):
    e = table(spark, sf, "events").withColumn("value", F.col("value"))
    return aggregates.best_so_far(e, "value", "user_id", ["ts", "event_id"]).select("event_id", "best_before", "improved", F.col("streak").cast("bigint").alias("streak"), "stopped")


@query("correction_scores", """
WITH s AS (SELECT count(*) AS n, count(*) FILTER (e > 0) AS bad, sum(e) AS errors, sum(c) AS chars FROM (
  SELECT length(text) - length(replace(text, '#', '')) AS e, length(text) AS c FROM documents))
SELECT round(1 - bad / (n + 0.001), 8) AS sentence_score, round(1 - errors / (chars + 0.001), 8) AS char_score,
       round((1 - bad / (n + 0.001) + 1 - errors / (chars + 0.001)) / 2, 8) AS score FROM s""")
def correction_scores(spark, sf):
    d = table(spark, sf, "documents")
    errors = F.char_length("text") - F.char_length(F.replace("text", F.lit("#"), F.lit("")))
    return aggregates.correction_scores(d, errors, F.char_length("text")).select(*[F.round(c, 8).alias(c) for c in ("sentence_score", "char_score", "score")])


@query("size_ratios", """
SELECT lang, round(chars / CAST(total AS DOUBLE), 4) AS ratio FROM (SELECT lang, sum(n_chars) AS chars FROM documents GROUP BY lang), (SELECT sum(n_chars) AS total FROM documents)""")
def size_ratios(spark, sf):
    by = table(spark, sf, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"))
    return by.withColumn("total", F.sum("chars").over(Window.partitionBy(F.lit(0)))).select("lang", aggregates.size_ratio(F.col("chars"), F.col("total")).alias("ratio"))


@query("decoded_text", """
SELECT doc_id, md5(replace(replace(trim(regexp_replace('<s_x>' || replace(replace(text || '</s> <pad>', '</s>', ''), '<pad>', ''), '^([^<]*)<.*?>', '\\1')), '> ', '>'), ' </s_', '</s_')) AS digest FROM documents""")
def decoded_text(spark, sf):
    made = F.concat(F.lit("<s_x>"), F.col("text"), F.lit("</s> <pad>"))
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.decoded(made)).alias("digest"))


@query("pre_token_counts", r"""
SELECT item_id, len(regexp_extract_all(text, '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+')) AS tokens FROM benchmark""")
def pre_token_counts(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(tx.pre_tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query("space_parts", "SELECT item_id, len(string_split(text, ' ')) AS parts FROM benchmark")
def space_parts(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.size(F.split("text", " ")).cast("bigint").alias("parts"))


# --- paths -----------------------------------------------------------------------------------------------------------


@query("path_parts", """
SELECT page_id, string_split(url, '/')[3] AS host, string_split(url, '/')[-1] AS last, replace(replace('J:/x\\' || url, '\\', '/'), 'J:/', '/mnt/j/') AS moved,
       nullif(lower(regexp_extract(url, '\\.[^./]*$')), '') IS NOT NULL AS has_suffix FROM pages""")
def path_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", tx.path_part(url, 3).alias("host"), tx.path_part(url, -1).alias("last"), tx.linux_path(F.concat(F.lit("J:/x\\"), url)).alias("moved"), (tx.suffix(url) != "").alias("has_suffix"))


@query("label_paths", """
SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '/pretrain/a/Label.txt' WHEN 1 THEN '/train/a/Label.txt' WHEN 2 THEN '/a/other.txt' ELSE '/a/Label.txt' END AS p FROM documents)
WHERE contains(p, 'Label.txt') AND NOT contains(replace(p, 'pretrain', ''), 'train') AND NOT contains(p, 'validation') AND NOT contains(p, 'test')""")
def label_paths(spark, sf):
    k = F.col("doc_id") % 4
    p = F.when(k == 0, "/pretrain/a/Label.txt").when(k == 1, "/train/a/Label.txt").when(k == 2, "/a/other.txt").otherwise("/a/Label.txt")
    return table(spark, sf, "documents").filter(tx.unlabelled_path(p)).select("doc_id")


@query("sibling_paths", "SELECT page_id, regexp_replace(replace('/data/images/' || page_id || '.jpg', '/images/', '/labels/'), '\\.[^./]*$', '') || '.txt' AS annotation FROM pages")
def sibling_paths(spark, sf):
    p = F.concat(F.lit("/data/images/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    return table(spark, sf, "pages").select("page_id", joins.sibling(p, "images", "labels", ".txt").alias("annotation"))


@query("wds_bucket", "SELECT page_id, printf('%05d', (row_number() OVER (ORDER BY page_id) - 1) // 1000) AS bucket FROM pages")
def wds_bucket(spark, sf):
    return splits.buckets(records.without_columns(table(spark, sf, "pages"), ["html", "phash"]), "page_id").select("page_id", "bucket")


# --- conversations ---------------------------------------------------------------------------------------------------

_TURNS_SQL = """SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  CASE WHEN role = 'user' THEN 'USER' ELSE 'ASSISTANT' END AS r FROM conversations WHERE role <> 'system'"""
_SYSTEM_SQL = "SELECT conv_id, arg_min(text, turn) AS s FROM conversations WHERE role = 'system' GROUP BY conv_id"


def _messages(spark, sf):
    return prompt.conversations(table(spark, sf, "conversations"))


#: SQL of each style: head with and without a system text, a turn, an open turn; sep is '|', sep2 is '#'.
_ALT = "CASE WHEN i % 2 = 1 THEN '#' ELSE '|' END"
_STYLE_SQL = {
    "add_colon_single": ("s || '|'", "'|'", "r || ': ' || text || '|'", "r || ':'"),
    "add_colon_two": ("s || '|'", "'|'", f"r || ': ' || text || {_ALT}", "r || ':'"),
    "add_colon_space_single": ("s || '|'", "'|'", "r || ': ' || text || '|'", "r || ': '"),
    "no_colon_single": ("s", "''", "r || text || '|'", "r"),
    "no_colon_two": ("s", "''", f"r || text || {_ALT}", "r"),
    "add_new_line_single": ("s || '|'", "''", "r || chr(10) || text || '|'", "r || chr(10)"),
    "llama2": ("s", "'[INST] '", f"CASE WHEN i = 0 THEN text || ' ' ELSE CASE WHEN i % 2 = 1 THEN 'ASSISTANT' ELSE 'USER' END || ' ' || text || {_ALT} END", "CASE WHEN i % 2 = 1 THEN 'ASSISTANT' ELSE 'USER' END"),
    "chatglm": ("s || '|'", "''", "CASE WHEN i % 2 = 0 THEN '[Round ' || (i // 2) || ']|' ELSE '' END || r || '：' || text || '|'", "CASE WHEN i % 2 = 0 THEN '[Round ' || (i // 2) || ']|' ELSE '' END || r || '：'"),
    "chatml": ("s || '|' || chr(10)", "''", "r || chr(10) || text || '|' || chr(10)", "r || chr(10)"),
    "chatintern": ("s", "''", f"r || ':' || text || {_ALT} || chr(10)", "r || ':'"),
    "dolly": ("s", "''", f"r || ':' || chr(10) || text || {_ALT} || CASE WHEN i % 2 = 1 THEN chr(10) || chr(10) ELSE '' END", "r || ':' || chr(10)"),
    "rwkv": ("s", "''", "r || ': ' || replace(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10)) || chr(10) || chr(10)", "r || ':'"),
    "phoenix": ("s", "''", "r || ': <s>' || text || '</s>'", "r || ': <s>'"),
    "robin": ("s || '|'", "'|'", "r || ':' || chr(10) || text || '|'", "r || ':' || chr(10)"),
    "falcon_chat": ("s || '|'", "''", "r || ': ' || text || '|'", "r || ':'"),
    "chatglm3": ("s", "''", "r || chr(10) || ' ' || text", "r"),
    "internvl_zh": ("s || '|'", "'|'", f"r || ': ' || text || {_ALT}", "r || ':'"),
    "mpt": ("s || '|'", "'|'", "r || text || '|'", "r"),
}


def _prompt_query(style: str) -> None:
    head, bare, said, opened = _STYLE_SQL[style]
    sql = f"""WITH t AS ({_TURNS_SQL}), y AS ({_SYSTEM_SQL}),
    b AS (SELECT conv_id, string_agg(CASE WHEN text IS NOT NULL AND text <> '' THEN {said} ELSE {opened} END, '' ORDER BY turn) AS body FROM t GROUP BY conv_id)
    SELECT c.conv_id, CASE WHEN s IS NOT NULL AND s <> '' THEN {head} ELSE {bare} END || coalesce(body, '') AS prompt
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b USING (conv_id) LEFT JOIN y USING (conv_id)"""

    @query(f"prompt_{style}", sql)
    def run(spark, sf):
        t = prompt.Template(style, style, sep="|", sep2="#")
        return _messages(spark, sf).select("conv_id", prompt.render(F.col("messages"), t, F.col("system_message")).alias("prompt"))


for _style in prompt.STYLES:
    _prompt_query(_style)


@query("openai_messages", f"""
WITH t AS ({_TURNS_SQL})
SELECT conv_id, 0 AS at, 'system' AS role, coalesce(any_value(s), '') AS content FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ({_SYSTEM_SQL}) y USING (conv_id) GROUP BY conv_id
UNION ALL SELECT conv_id, CAST(i + 1 AS INTEGER), CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END, text FROM t""")
def openai_messages(spark, sf):
    m = _messages(spark, sf).select("conv_id", F.posexplode(prompt.openai_messages(F.col("messages"), F.col("system_message"))).alias("at", "m"))
    return m.select("conv_id", "at", "m.role", "m.content")


@query("chat_pairs", f"SELECT conv_id, i // 2 AS pair, max(text) FILTER (i % 2 = 0) AS user, max(text) FILTER (i % 2 = 1) AS assistant FROM ({_TURNS_SQL}) GROUP BY 1, 2")
def chat_pairs(spark, sf):
    p = _messages(spark, sf).select("conv_id", F.posexplode(prompt.chat_pairs(F.col("messages"))).alias("pair", "p"))
    return p.select("conv_id", F.col("pair").cast("bigint").alias("pair"), "p.user", "p.assistant")


@query("glm_template", f"""
SELECT conv_id, '[gMASK]<sop>' || string_agg('<|' || role || '|>' || chr(10) || text, '' ORDER BY turn) || '<|assistant|>' AS prompt FROM conversations WHERE text <> '' GROUP BY conv_id""")
def glm_template(spark, sf):
    return _items(spark, sf).select("conv_id", prompt.glm_template(F.col("items")).alias("prompt"))


def _items(spark, sf):
    """(conv_id, items): the turns as struct(role, metadata, content, image), an image at the first user turn of every third conversation."""
    items = F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
        lambda m: F.struct(m["role"].alias("role"), F.lit("").alias("metadata"), m["text"].alias("content"), ((m["turn"] == F.get(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.col("turn")))), F.lit(0))) & (F.col("conv_id") % 3 == 0)).alias("image")),
    )
    return table(spark, sf, "conversations").groupBy("conv_id").agg(items.alias("items"))


_FIRST_TOOLS = '[{"type": "python"}, {"type": "function", "function": {"name": "find", "parameters": {"query": "文本"}}}]'
_TOOLS_SQL = "<|system|>\n" + "\n\n".join([prompt.GLM_SYSTEM, "## python\n\n" + prompt.GLM_TOOLS["python"], "## find\n\n" + json.dumps(json.loads(_FIRST_TOOLS)[1]["function"], ensure_ascii=False, indent=4) + "\n" + prompt.GLM_CALL])


@query("glm_tool_template", f"""
SELECT conv_id, '[gMASK]<sop>{_TOOLS_SQL}' || string_agg('<|' || role || '|>' || chr(10) || CASE WHEN conv_id % 3 = 0 AND turn = first THEN '{prompt.GLM_IMAGE}' ELSE '' END || text, '' ORDER BY turn) || '<|assistant|>' AS prompt
FROM (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS first FROM conversations) GROUP BY conv_id""")
def glm_tool_template(spark, sf):
    tools = F.transform("items", lambda m, i: F.when(i == 0, F.lit(_FIRST_TOOLS)))
    return _items(spark, sf).select("conv_id", prompt.glm_template(F.col("items"), tools=tools, image=True).alias("prompt"))


_PAST = "WITH t AS (SELECT *, ((n - 1) // 2) * 2 AS q FROM (" + _TURNS_SQL + "))"


@query("glm_history", f"""{_PAST}
SELECT conv_id, string_agg(CASE WHEN i % 2 = 0 THEN CASE WHEN i > 0 THEN '<|user|>' ELSE '' END || text || '<|assistant|>' WHEN i < q THEN text || '<|endoftext|>' ELSE '' END, '' ORDER BY i) AS prompt
FROM t WHERE i <= q GROUP BY conv_id""")
def glm_history(spark, sf):
    return _messages(spark, sf).filter(F.size("messages") > 0).select("conv_id", prompt.glm_history(F.col("messages")).alias("prompt"))


@query("vqa_history", f"""{_PAST}
SELECT conv_id, string_agg(CASE WHEN i % 2 = 0 THEN 'Question: ' || text || ' Short answer:' || CASE WHEN i < q THEN ' ' ELSE '' END ELSE text || chr(10) END, '' ORDER BY i) AS prompt
FROM t WHERE i <= q GROUP BY conv_id""")
def vqa_history(spark, sf):
    return _messages(spark, sf).filter(F.size("messages") > 0).select("conv_id", prompt.vqa_history(F.col("messages")).alias("prompt"))


@query("internlm_inputs", f"""{_PAST}
SELECT conv_id, coalesce('<|im_start|>system' || chr(10) || nullif(any_value(s), '') || '<|im_end|>' || chr(10), '') || string_agg('<|im_start|>' || CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) || '<|im_start|>assistant' || chr(10) AS prompt
FROM t LEFT JOIN ({_SYSTEM_SQL}) y USING (conv_id) WHERE i <= q GROUP BY conv_id""")
def internlm_inputs(spark, sf):
    return _messages(spark, sf).filter(F.size("messages") > 0).select("conv_id", prompt.internlm_inputs(F.col("messages"), F.col("system_message")).alias("prompt"))


@query("minicpm_inputs", f"""
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '<用户>' ELSE '<AI>' END || CASE WHEN i = 0 THEN '<image><unk></image>' || chr(10) ELSE '' END || text, '' ORDER BY i) || '<AI>' AS prompt FROM ({_TURNS_SQL}) GROUP BY conv_id""")
def minicpm_inputs(spark, sf):
    items = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    c = table(spark, sf, "conversations").filter("role <> 'system'").groupBy("conv_id").agg(items.alias("items"))
    return c.select("conv_id", prompt.minicpm_inputs(F.col("items"), "<image><unk></image>").alias("prompt"))


@query("image_tokens", """
SELECT conv_id, turn, length(p) AS chars, md5(p) AS digest FROM (
  SELECT conv_id, turn, t[:strpos(t, '<image>') - 1] || '<img>' || repeat('<IMG_CONTEXT>', CAST(256 * (turn % 3 + 1) AS INTEGER)) || '</img>' || t[strpos(t, '<image>') + 7:] AS p
  FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN text || '<image> and <image>' WHEN contains(text, '<image>') THEN text ELSE '<image>' || chr(10) || text END AS t FROM conversations))""")
def image_tokens(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 1, F.concat("text", F.lit("<image> and <image>"))).otherwise(F.col("text")))
    p = prompt.image_tokens(prompt.with_image(F.col("text")), F.array((F.col("turn") % 3 + 1).cast("int")))
    return c.select("conv_id", "turn", F.char_length(p).cast("bigint").alias("chars"), F.md5(p).alias("digest"))


@query("grid_placeholder", """
SELECT p_partkey, '<slice>' || array_to_string(list_transform(range(p_size % 3 + 1), lambda k: repeat('<i>u</i>', p_size % 4 + 1)), chr(10)) || '</slice>' AS text FROM part""")
def grid_placeholder(spark, sf):
    return table(spark, sf, "part").select("p_partkey", prompt.grid_placeholder((F.col("p_size") % 4 + 1).cast("int"), (F.col("p_size") % 3 + 1).cast("int"), "<i>u</i>").alias("text"))


@query("trimmed_responses", "SELECT conv_id, turn, trim(string_split(text, '.')[1]) AS response FROM conversations")
def trimmed_responses(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.trimmed_response(F.col("text"), ".").alias("response"))


@query("sft_rows", "SELECT 'Extract all fields.' AS query, text AS response, '/img/' || doc_id || '.jpg' AS image FROM documents")
def sft_rows(spark, sf):
    d = table(spark, sf, "documents")
    return records.labelled(d, "Extract all fields.", F.col("text"), F.concat(F.lit("/img/"), F.col("doc_id").cast("string"), F.lit(".jpg"))).select("query", "response", F.col("image_path")[0].alias("image"))


@query("prompt_targets", "SELECT conv_id, turn, text || '<sep/>' || '</s>' AS v1, text || '<sep/>' || role AS v2 FROM conversations")
def prompt_targets(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", prompt.prompt_and_target(F.col("text"), None).alias("v1"), prompt.prompt_and_target(F.col("text"), F.col("role")).alias("v2"))


@query("conversation_edits", """
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system' UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'Be brief.' FROM conversations),
a AS (SELECT * FROM t UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'And?' FROM t GROUP BY conv_id)
SELECT conv_id, turn, role, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN 'Why?' ELSE text END AS text FROM a""")
def conversation_edits(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    t = prompt.with_system(c, F.lit("Be brief."))
    more = t.select("conv_id").distinct().select("conv_id", F.lit("user").alias("role"), F.lit("And?").alias("text"))
    return prompt.updated_last(prompt.appended(t, more), F.lit("Why?"))


@query("replayed_turns", "SELECT conv_id, turn, string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS history FROM conversations")
def replayed_turns(spark, sf):
    return prompt.replayed(table(spark, sf, "conversations")).select("conv_id", "turn", F.array_join("history", "|").alias("history"))


# --- token sequences -------------------------------------------------------------------------------------------------

_IDS_SQL = "SELECT conv_id, turn, list_transform(list_filter(string_split(text, ' '), lambda t: t <> ''), lambda t: CAST(length(t) AS INTEGER)) AS ids FROM conversations"
_J = lambda e: f"array_to_string({e}, ',')"


def _ids(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.transform(seq.tokens(F.col("text")), lambda t: F.char_length(t)).alias("ids"))


def _text(e):
    return F.array_join(F.transform(e, lambda x: x.cast("string")), ",")


@query("label_mask", f"""
SELECT conv_id, turn, CASE WHEN pos > 0 THEN {_J("list_transform(ids, lambda x, i: CASE WHEN i <= pos THEN -100 ELSE x END)")} END AS labels
FROM (SELECT *, list_position(ids, 4) AS pos FROM ({_IDS_SQL}))""")
def label_mask(spark, sf):
    rows = _ids(spark, sf).withColumn("labels", seq.label_mask(F.col("ids"), 4))
    return rows.select("conv_id", "turn", _text(F.col("labels")).alias("labels"))


@query("label_mask_shifted", f"""
SELECT conv_id, turn, CASE WHEN pos > 0 THEN {_J("list_transform(m, lambda x, i: CASE WHEN i < pos THEN -100 ELSE x END)")} END AS labels
FROM (SELECT *, list_position(m, 4) AS pos FROM (SELECT conv_id, turn, ids[2:] AS m FROM ({_IDS_SQL})))""")
def label_mask_shifted(spark, sf):
    rows = _ids(spark, sf).withColumn("labels", seq.label_mask_shifted(F.col("ids"), 4))
    return rows.select("conv_id", "turn", _text(F.col("labels")).alias("labels"))


@query("shifted_tokens", f"""
SELECT conv_id, turn, {_J("ids[2:]")} AS next, {_J("list_prepend(0, ids[:-2])")} AS shifted, {_J("list_transform(ids[:-2], lambda x: CASE WHEN x = 2 THEN 1 ELSE x END)")} AS decoder
FROM ({_IDS_SQL})""")
def shifted_tokens(spark, sf):
    ids = F.col("ids")
    return _ids(spark, sf).select("conv_id", "turn", _text(seq.next_tokens(ids)).alias("next"), _text(seq.shifted_right(ids, 0)).alias("shifted"), _text(seq.decoder_input(ids, 2, 1)).alias("decoder"))


@query("left_padded", f"""
SELECT conv_id, turn, {_J("list_concat(list_resize([]::INTEGER[], p, -1), ids)")} AS ids, {_J("list_concat(list_resize([]::INTEGER[], p, 0), list_transform(ids, lambda x: 1))")} AS mask,
       {_J("list_concat(list_resize([]::BIGINT[], p, 0), range(len(ids)))")} AS positions
FROM (SELECT *, greatest(CAST(ceil(max(len(ids)) OVER (PARTITION BY conv_id) / 8.0) * 8 AS INTEGER) - len(ids), 0) AS p FROM ({_IDS_SQL}))""")
def left_padded(spark, sf):
    n = seq.rounded_length(F.max(F.size("ids")).over(Window.partitionBy("conv_id")), 8)
    rows = _ids(spark, sf).withColumn("n", n)
    ids, n = F.col("ids"), F.col("n")
    return rows.select("conv_id", "turn", _text(seq.left_padded(ids, n, -1)).alias("ids"), _text(seq.attention_mask(ids, n)).alias("mask"), _text(seq.position_ids(ids, n)).alias("positions"))


@query("special_tokens", f"SELECT conv_id, turn, {_J('list_append(list_prepend(101, ids), 102)')} AS ids, {_J('list_append(list_prepend(1, list_transform(ids, lambda x: 0)), 1)')} AS mask FROM ({_IDS_SQL})")
def special_tokens(spark, sf):
    ids = F.col("ids")
    return _ids(spark, sf).select("conv_id", "turn", _text(seq.with_specials(ids, 101, 102)).alias("ids"), _text(seq.special_tokens_mask(ids)).alias("mask"))


@query("image_spans", f"""
WITH a AS (SELECT conv_id, turn, list_filter(list_transform(ids, lambda x, i: CASE WHEN x = 3 THEN i - 1 END), lambda i: i IS NOT NULL) AS s,
  list_filter(list_transform(ids, lambda x, i: CASE WHEN x = 5 THEN i - 1 END), lambda i: i IS NOT NULL) AS e FROM ({_IDS_SQL}))
SELECT conv_id, turn, k AS at, s[k] + 1 AS first, e[k] AS last FROM (SELECT *, unnest(range(1, least(len(s), len(e)) + 1)) AS k FROM a)""")
def image_spans(spark, sf):
    rows = _ids(spark, sf).select("conv_id", "turn", F.posexplode(seq.spans(F.col("ids"), 3, 5)).alias("at", "s"))
    return rows.select("conv_id", "turn", (F.col("at") + 1).cast("bigint").alias("at"), F.col("s.first").cast("bigint").alias("first"), F.col("s.last").cast("bigint").alias("last"))


@query("vision_expert", f"""
SELECT conv_id, turn, {_J("list_transform(t, lambda x, i: CASE WHEN x = 1 AND coalesce(t[i + 1], 0) = 1 THEN 1 ELSE 0 END)")} AS vision
FROM (SELECT conv_id, turn, list_transform(ids, lambda x: CASE WHEN x > 3 THEN 1 ELSE 0 END) AS t FROM ({_IDS_SQL}))""")
def vision_expert(spark, sf):
    rows = _ids(spark, sf).withColumn("t", F.transform("ids", lambda x: (x > 3).cast("int")))
    return rows.select("conv_id", "turn", _text(F.transform(seq.vision_expert(F.col("t")), lambda x: x.cast("int"))).alias("vision"))


_TYPES_SQL = "SELECT event_id, user_id, ts, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS kind FROM events"


@query("shared_positions", f"""
WITH a AS (SELECT *, kind = 1 AND lag(kind) OVER w = 1 AND lead(kind) OVER w = 1 AS inn FROM ({_TYPES_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CASE WHEN coalesce(inn, false) AND coalesce(lag(inn) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) THEN 0 ELSE 1 END AS step FROM a)
SELECT event_id, CAST(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS position_id FROM b""")
def shared_positions(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").isin("view", "click").cast("int").alias("kind"))
    return tokens.shared_positions(e, "user_id", "at", "kind").select("event_id", "position_id")


@query("scattered_features", f"""
WITH t AS (SELECT *, sum(kind) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM ({_TYPES_SQL}))
SELECT event_id, CASE WHEN kind = 1 AND k <= 2 THEN 'f' || CAST(k AS INTEGER) ELSE 'event' END AS token FROM t""")
def scattered_features(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").isin("view", "click").alias("is_view"), F.lit("event").alias("token"))
    features = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).withColumn("feature", F.concat(F.lit("f"), F.col("k").cast("string")))
    return tokens.scattered(e, "user_id", "at", F.col("is_view"), "token", features, "k", "feature", "filled").select("event_id", F.col("filled").alias("token"))


@query("causal_masks", "SELECT p_partkey, list_sum(list_transform(range(p_size), lambda i: i + 1)) AS ones FROM part")
def causal_masks(spark, sf):
    m = seq.causal_mask(F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", F.aggregate(F.flatten(m), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ones"))


@query("spliced_tokens", f"""
SELECT conv_id, turn, {_J("list_concat(list_concat(ids[:2], [-1, -2, -3, -4]), ids[6:])")} AS ids, {_J("list_concat(list_concat(range(3), [3, 3]), range(4, len(ids)))")} AS positions
FROM ({_IDS_SQL}) WHERE len(ids) >= 5""")
def spliced_tokens(spark, sf):
    rows = _ids(spark, sf).filter(F.size("ids") >= 5)
    features = F.array(*[F.lit(-k) for k in range(1, 5)])
    return rows.select("conv_id", "turn", _text(seq.spliced(F.col("ids"), F.lit(2), 3, features)).alias("ids"), _text(seq.spliced_positions(F.size("ids"), F.lit(2), 3, F.lit(4))).alias("positions"))


@query("filled_placeholders", """
WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS n FROM benchmark), f AS (SELECT p_partkey - 1 AS k, '[' || p_size || ']' AS fill FROM part)
SELECT item_id, coalesce(l.fill, '<|image_pad|>') || text || coalesce(r.fill, '<|image_pad|>') AS filled FROM b LEFT JOIN f l ON l.k = 2 * n LEFT JOIN f r ON r.k = 2 * n + 1""")
def filled_placeholders(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("<|image_pad|>"), F.col("text"), F.lit("<|image_pad|>")).alias("text"))
    grids = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("k"), F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("]")).alias("fill"))
    return joins.placeholders_filled(b, grids, "item_id", "text", "item_id", "k", F.col("fill"))


@query("grid_positions", """
SELECT p_partkey, i, CAST(p_size + i // (h * w) AS INTEGER) AS t, CAST(p_size + (i // w) % h AS INTEGER) AS h, CAST(p_size + i % w AS INTEGER) AS w
FROM (SELECT *, unnest(range(2 * h * w)) AS i FROM (SELECT p_partkey, p_size, p_size % 3 + 1 AS h, p_size % 4 + 1 AS w FROM part))""")
def grid_positions(spark, sf):
    h, w = (F.col("p_size") % 3 + 1).cast("int"), (F.col("p_size") % 4 + 1).cast("int")
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(seq.grid_positions(F.lit(2), h, w, F.col("p_size"))).alias("i", "p"))
    return rows.select("p_partkey", F.col("i").cast("bigint").alias("i"), "p.t", "p.h", "p.w")


@query("merged_patch_ids", """
SELECT p_partkey, i, CAST((i // 4) // (w // 2) * 2 + (i % 4) // 2 AS INTEGER) AS h, CAST((i // 4) % (w // 2) * 2 + i % 2 AS INTEGER) AS w
FROM (SELECT *, unnest(range(h * w)) AS i FROM (SELECT p_partkey, (p_size % 3 + 1) * 2 AS h, (p_size % 4 + 1) * 2 AS w FROM part))""")
def merged_patch_ids(spark, sf):
    h, w = ((F.col("p_size") % 3 + 1) * 2).cast("int"), ((F.col("p_size") % 4 + 1) * 2).cast("int")
    rows = table(spark, sf, "part").select("p_partkey", F.posexplode(seq.merged_ids(h, w)).alias("i", "p"))
    return rows.select("p_partkey", F.col("i").cast("bigint").alias("i"), "p.h", "p.w")
