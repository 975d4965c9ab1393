"""Registered queries of the subpackage: one per operator, over whole tables."""

from __future__ import annotations

from . import (chat, codes, decontaminate, graph_dedup, line_dedup, ngram_join, packing, pieces, pseudonyms, quality,
               repair, secrets, sql, warc)
from .common import table

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_line_minhash(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op2_boosted_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_randomness_secrets(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_harmonic_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_feistel_pseudonyms(spark, sf_dir):
    return pseudonyms.report(table(spark, sf_dir, "documents"))


def op6_prefix_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_prefix_tree_join(spark, sf_dir):
    return ngram_join.similarity_components(table(spark, sf_dir, "documents"))


def op8_warc_boundary_chains(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_chat_role_repair(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_pruned_graph_dedup(spark, sf_dir):
    return graph_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_piece_backtracking(spark, sf_dir):
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op12_cover_tree_lloyd(spark, sf_dir):
    return codes.report(table(spark, sf_dir, "embeddings"))


def op13_deepening_repair(spark, sf_dir):
    return repair.damaged_report(table(spark, sf_dir, "conversations"))


_OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, item_id, i, pos.n FROM pos JOIN win ON pos.n = win.n AND pos.t = win.t),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
          GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, low.m) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

_OP8_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr(
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(h, 10 * (i // 8) + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

_OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS r FROM e),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM n x, n y
         WHERE x.vec_id <> y.vec_id AND x.r > 0 AND y.r > 0 AND list_dot_product(x.v, y.v) / (x.r * y.r) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY 1),
c AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, low.m) AS component_id,
       e.vec_id = least(e.vec_id, low.m) AS kept
FROM e LEFT JOIN low ON low.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""

QUERIES = {
    "op1_line_minhash": op1_line_minhash,
    "op2_boosted_quality": op2_boosted_quality,
    "op3_randomness_secrets": op3_randomness_secrets,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_feistel_pseudonyms": op5_feistel_pseudonyms,
    "op6_prefix_decontamination": op6_prefix_decontamination,
    "op7_prefix_tree_join": op7_prefix_tree_join,
    "op8_warc_boundary_chains": op8_warc_boundary_chains,
    "op9_chat_role_repair": op9_chat_role_repair,
    "op10_pruned_graph_dedup": op10_pruned_graph_dedup,
    "op11_piece_backtracking": op11_piece_backtracking,
    "op12_cover_tree_lloyd": op12_cover_tree_lloyd,
    "op13_deepening_repair": op13_deepening_repair,
}
ORACLES = {
    "op6_prefix_decontamination": _OP6_SQL,
    "op7_prefix_tree_join": _OP7_SQL,
    "op8_warc_boundary_chains": _OP8_SQL,
    "op10_pruned_graph_dedup": _OP10_SQL,
    "op12_cover_tree_lloyd": sql.OP12,
    "op13_deepening_repair": sql.OP13,
}
