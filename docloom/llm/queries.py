"""The registered queries of the thirteen operators and their SQL.

Each applies its operator with production parameters to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, ann, line_dedup, merkle, mixing, packing, pivots, quality, simhash, substring_dedup, topk, toxicity, warc
from .common import table


#: The date that stands in records of the pages table, which has none.
CRAWLED = "2024-01-01T00:00:00Z"


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity, grade, p_toxic, toxic for every document, fitted on the grades of labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.keyed(docs), toxicity.graded(table(spark, sf_dir, "labels")))
    return toxicity.severity(docs.select("doc_id", "text"), model).drop("text")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and the conversion record of every page, whole."""
    pages = table(spark, sf_dir, "pages")
    return warc.derive(warc.responses_of(pages, "page_id", "url", "html", CRAWLED), ["page_id"])


def op3_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, removed_spans (start, end), and the length and digest of what is kept of every document."""
    found = substring_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "removed_spans", F.char_length("text").cast("bigint").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op4_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, dropped_lines, and the length and digest of what is kept of every document; source is the host."""
    found = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("source"))
    return found.select("doc_id", "dropped_lines", F.char_length("text").cast("bigint").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id: 4-word shingles, links at 4 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, position: every document's place in the mixture."""
    found = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"), prefix="")
    return found.select("doc_id", "source", "block", "release", "deadline", "slot", "position")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 highest integer inner products of each row whose vec_id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of each document in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 10 nearest found of each row whose vec_id is divisible by 100."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op10_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, fitted on labels.quality of rows not held out."""
    found = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op11_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector: links at a cosine of 0.98 or more under one label."""
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"), bound=0.98)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers' ids in every document, and how the corpus counts them."""
    import public_tokenizers

    a, b, ranks = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
    return alignment.aligned(table(spark, sf_dir, "documents"), a, b, ranks=ranks).withColumnRenamed("id", "doc_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, folded from its leaf, or from one of a text without line feeds where crc32(doc_id) is even."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    own = ["doc_id", "source", "lang", "n_chars"]
    leaf = merkle.leaf_of(*own, "text")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, merkle.leaf_of(*own, F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    return merkle.manifest(docs, "source", "doc_id", leaf, tampered).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ordinal_toxicity": op1_ordinal_toxicity,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_line_hash_dedup": op3_line_hash_dedup,
    "op4_site_line_dedup": op4_site_line_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_exact_topk": op7_exact_topk,
    "op8_order_preserving_packing": op8_order_preserving_packing,
    "op9_anisotropic_ann": op9_anisotropic_ann,
    "op10_fourier_quality": op10_fourier_quality,
    "op11_pivot_near_dedup": op11_pivot_near_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

_SITE_LINES_SQL = """
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), pages AS (
  SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source
), often AS (
  SELECT source, t, count(DISTINCT doc_id) AS n FROM lines WHERE t <> '' AND source IS NOT NULL GROUP BY source, t
), bad AS (
  SELECT source, t FROM often JOIN pages USING (source) WHERE n >= 2 AND CAST(n AS DOUBLE) / pages > 0.1
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (b.t IS NULL) AS text,
         CAST(count(b.t) AS INTEGER) AS dropped_lines
  FROM lines l LEFT JOIN bad b ON l.source = b.source AND l.t = b.t GROUP BY l.doc_id
)
SELECT doc_id, dropped_lines, CAST(length(coalesce(text, '')) AS BIGINT) AS kept_chars, md5(coalesce(text, '')) AS kept_md5 FROM kept
"""

_MIXING_SQL = """
WITH RECURSIVE c AS (
  SELECT source AS key, count(*) AS n_rows, CAST(ceil(sqrt(CAST(count(*) AS DOUBLE)) * 100) AS BIGINT) AS root FROM documents GROUP BY source
), s AS (
  SELECT key, n_rows, 16 AS br, CAST(greatest(1, (root * 512 + sum(root) OVER ()) // (2 * sum(root) OVER ())) AS BIGINT) AS q,
         CAST(row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS BIGINT) AS s
  FROM c
), n AS (
  SELECT *, CAST(ceil(CAST(n_rows AS DOUBLE) / br) AS BIGINT) AS n FROM s
), b AS (
  SELECT *, unnest(range(n)) AS j FROM n
), w AS (
  SELECT b.s, b.key, b.j, b.br, least(b.br, b.n_rows - b.j * b.br) AS size,
         CAST(sum(least(k.q * b.j, k.n * b.q)) AS BIGINT) // b.q AS release,
         (CAST(sum(least(k.q * (b.j + 1), k.n * b.q)) AS BIGINT) + b.q - 1) // b.q AS deadline
  FROM b, n k GROUP BY b.s, b.key, b.j, b.br, b.n_rows, b.q
), edf AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(NULL AS STRUCT(d BIGINT, s BIGINT, j BIGINT)) AS pick, CAST([] AS BIGINT[]) AS done
  UNION ALL
  SELECT e.t + 1, p.pick, list_append(e.done, p.pick.s * 1000000000 + p.pick.j)
  FROM edf e, LATERAL (
    SELECT min({'d': w.deadline, 's': w.s, 'j': w.j}) AS pick FROM w
    WHERE w.release <= e.t + 1 AND NOT list_contains(e.done, w.s * 1000000000 + w.j)) p
  WHERE e.t + 1 < (SELECT count(*) FROM w)
), plan AS (
  SELECT w.*, e.t AS slot, sum(w.size) OVER (ORDER BY e.t) - w.size AS first_row
  FROM edf e JOIN w ON e.pick.s = w.s AND e.pick.j = w.j
), d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM documents
)
SELECT d.doc_id, d.source, p.j AS block, p.release, p.deadline, p.slot, CAST(p.first_row + d.r % p.br AS BIGINT) AS position
FROM d JOIN plan p ON d.source IS NOT DISTINCT FROM p.key AND d.r // p.br = p.j
"""

_CRC = """(SELECT xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, c: list_reduce(list_prepend(xor(a, c), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)))"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


_MERKLE_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
         CASE WHEN {_CRC} % 2 = 0 THEN sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")))}) END AS tampered
  FROM documents
), d AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM l
), t AS (
  SELECT key, 0 AS lvl, i, n, leaf AS h FROM d
  UNION ALL
  SELECT key, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY key, lvl, i // 3, n
), r AS (
  SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS lvl, i, n, h FROM r
  UNION ALL
  SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 3, n
), s AS (
  SELECT key, lvl, i, n, string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
  FROM (SELECT 'in' || key AS key, lvl, i, n, h FROM t UNION ALL SELECT 'over', lvl, i, n, h FROM u)
  WINDOW w AS (PARTITION BY key, lvl, i // 3 ORDER BY i)
), f AS (
  SELECT d.doc_id, d.leaf, d.key, 'in' || d.key AS at, 0 AS lvl, d.i, coalesce(d.tampered, d.leaf) AS acc, '' AS proof FROM d
  UNION ALL
  SELECT f.doc_id, f.leaf, f.key,
         CASE WHEN s.n > 1 THEN f.at ELSE 'over' END, CASE WHEN s.n > 1 THEN f.lvl + 1 ELSE 0 END, CASE WHEN s.n > 1 THEN f.i // 3 ELSE r.i END,
         CASE WHEN s.n > 1 THEN sha256(coalesce(s.before, '') || f.acc || coalesce(s.after, '')) ELSE f.acc END,
         CASE WHEN s.n > 1 THEN f.proof || coalesce(s.before, '') || coalesce(s.after, '') ELSE f.proof END
  FROM f JOIN s ON f.at = s.key AND f.lvl = s.lvl AND f.i = s.i JOIN r ON f.key = r.key WHERE s.n > 1 OR f.at <> 'over'
)
SELECT f.doc_id, f.leaf, r.h AS subroot, u.h AS root, sha256(f.proof) AS proof_sha256, f.acc AS folded_root, f.acc = u.h AS verified
FROM f JOIN s ON f.at = 'over' AND s.key = 'over' AND s.lvl = f.lvl AND s.i = f.i AND s.n = 1 JOIN r ON f.key = r.key JOIN u ON u.n = 1
"""

ORACLES: dict[str, str] = {
    "op13_merkle_manifest": _MERKLE_SQL,
    "op4_site_line_dedup": _SITE_LINES_SQL,
    "op6_pfair_mixing": _MIXING_SQL,
    "op7_exact_topk": _TOPK_SQL,
}
