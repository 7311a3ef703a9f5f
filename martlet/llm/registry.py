"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bpe, decontaminate, divergence, html_extract, passages, pii, prefix_trie, quality_crf,
               quality_rules, simhash, token_counts, token_ids, warc)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        quality_crf.op1_quality_classifier,
        simhash.op2_simhash_near_dedup,
        passages.op3_substring_dedup,
        decontaminate.op4_benchmark_decontamination,
        bpe.op5_byte_bpe,
        html_extract.op6_html_extraction,
        pii.op7_pii,
        warc.op8_warc,
        quality_rules.op9_quality_rules,
        token_counts.op10_token_counts,
        divergence.op11_source_divergence,
        token_ids.op12_token_ids,
        prefix_trie.op13_conversation_trie,
    )}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


#: Windows as joined words, compared by an equi-join; hit words are counted
#: once; a longest match is the longest run of windows that hit side by side.
OP4 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT row_number() OVER () AS t, item_id, w, least(10, len(w)) AS k
      FROM (SELECT item_id, {_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT t, item_id, k, p AS q, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT t, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM b)),
dw AS (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS g
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT dw.r, dw.p, dw.k, bw.item_id, bw.t, bw.q FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
n AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS x FROM hit) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY r),
side AS (SELECT r, p, k, p - row_number() OVER (PARTITION BY r, t, p - q ORDER BY p) AS run, t, p - q AS shift FROM hit),
m AS (SELECT r, min(p) AS p, count(*) - 1 + any_value(k) AS words FROM side GROUP BY r, t, shift, run),
l AS (SELECT r, max(words) AS words, arg_min(p, [-words, p]) AS p FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       CAST(coalesce(words, 0) AS BIGINT) AS longest_match, CAST(p - 1 AS BIGINT) AS longest_start
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN i ON d.r = i.r LEFT JOIN l ON d.r = l.r"""

_BITS = " + ".join(f"{1 << (4 - k)} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))
#: Base32 from the digest's bits, five at a time.
OP8 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
             max(page_id) OVER (PARTITION BY html) AS top FROM p),
x AS (SELECT *, CAST(CAST(from_hex(hex) AS BIT) AS VARCHAR) AS bits FROM s)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BITS}, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM x"""

#: Shares and divergences as HUGEINT, every group against every kept term.
OP11 = rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (coalesce(n.n, 0) + 2 * v.v) AS p,
             1 + 1000000000::HUGEINT * (k.total + 2) // (v.n + 2 * v.v) AS q
      FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
      LEFT JOIN n ON g.lang = n.lang AND g.source = n.source
      LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source
                    GROUP BY x.lang, x.source, y.source) s
         ON a.lang = s.lang AND a.source = s.source AND b.source = s.item),
term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE c > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
      UNION ALL SELECT lang, source, 'term' AS part, item, value FROM term),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM x WHERE part = 'pair' OR rank <= 10"""

#: CRC-32 bit by bit: a byte is added, then eight steps (-1) follow.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
  regexp_extract_all(CAST(conv_id AS VARCHAR), '.'), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""
#: Prefixes as lists of turns; every node is counted at each of its prefixes.
OP13 = f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS s
      FROM r GROUP BY conv_id),
h AS (SELECT conv_id, s, CAST({_CRC} % 6 AS INTEGER) AS h FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(o.s[1:h.h], []), h.s[h.h + 1:]) AS s
      FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
m AS (SELECT conv_id, len(s) AS l, d, s[1:d] AS p FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
g AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n,
             string_agg(CASE WHEN l = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS children FROM g WHERE d > 0 GROUP BY p[1:d - 1]),
w AS (SELECT g.p, g.d, CASE WHEN k.p IS NULL THEN 1 ELSE 0 END AS leaf,
             CASE WHEN g.d > 0 THEN (g.n - 1) * length(g.p[g.d].t) ELSE 0 END AS saved FROM g LEFT JOIN k ON g.p = k.p),
t AS (SELECT p[1:e] AS p, sum(leaf) AS leaves, sum(saved) AS saved
      FROM (SELECT p, leaf, saved, unnest(range(0, d + 1)) AS e FROM w) GROUP BY p[1:e])
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(g.n AS BIGINT) AS n_convs,
       CAST(coalesce(k.children, 0) AS BIGINT) AS n_children, CAST(t.leaves AS BIGINT) AS n_leaves,
       CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN t ON g.p = t.p LEFT JOIN k ON g.p = k.p LEFT JOIN g u ON g.d > 0 AND u.d = g.d - 1 AND u.p = g.p[1:g.d - 1]"""


def oracle_sql() -> dict[str, str]:
    """DuckDB twins, where SQL can express an operator over whole tables. The
    others are tested against brute-force versions in ``tests/llm``."""
    return {"op4_benchmark_decontamination": OP4, "op8_warc": OP8, "op11_source_divergence": OP11,
            "op13_conversation_trie": OP13}
