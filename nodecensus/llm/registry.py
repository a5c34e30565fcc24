"""The queries of this subpackage, and DuckDB SQL for those that SQL can express.

Without SQL, and held against brute force or round trips in tests/llm instead: op1 (byte windows), op2 (components over set
similarities), op4 (keyed networks), op5 (trees of pages), op6 and op7 (libraries' vocabularies), pipeline (contains op2 and op7).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nodecensus.llm.html import op5_html
from nodecensus.llm.minhash import op2_minhash
from nodecensus.llm.packing import op7_packing
from nodecensus.llm.pii import op4_pii
from nodecensus.llm.quality import FENCE, LEVELS, PRIOR, op10_quality
from nodecensus.llm.spm import op6_sentencepiece
from nodecensus.llm.substrings import op9_substrings
from nodecensus.llm.suffixes import op1_suffixes
from nodecensus.llm.topk import op3_topk
from nodecensus.llm.warc import op8_warc

SPACES = r"[\x20\x09-\x0D]+"

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, n, hex, list_transform(range(0, 8), lambda k: CAST('0x' || substr(hex, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT)) AS parts FROM p),
b32 AS (SELECT page_id, n, hex, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS digest FROM bits),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex, n) AS first FROM b32)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""

OP9 = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS words FROM documents),
spot AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM w WHERE len(words) >= 20),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS s FROM spot),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
marks AS (SELECT DISTINCT doc_id, i + k AS j FROM gone, range(20) t(k)),
word AS (SELECT doc_id, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS j FROM w),
kept AS (SELECT word.doc_id, count(*) AS n_words, count(marks.j) AS n_removed, string_agg(x, ' ' ORDER BY j) FILTER (WHERE marks.j IS NULL) AS s FROM word LEFT JOIN marks USING (doc_id, j) GROUP BY word.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def _op10() -> str:
    cells = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {k} AS bin, {v} AS top FROM m WHERE NOT base_failed" for k, v in LEVELS.items())
    q = lambda p: f"b[(n * {p} + 99) // 100]"
    level = lambda keys: f"SELECT {keys} measure, n, greatest({q('top')}, {q(75)} + {FENCE} * ({q(75)} - {q(25)})) AS own FROM (SELECT {keys} measure, top, count(*) AS n, list_sort(list(bin)) AS b FROM cells GROUP BY {keys} measure, top)"
    within = " AND ".join(f"coalesce(m.{k} <= wide.{k}, false)" for k in LEVELS)
    wide = ", ".join(f"max(u) FILTER (measure = '{k}') AS {k}" for k in LEVELS)
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '{SPACES}', '', 'g') <> '') AS lines FROM documents),
spot AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i + 4], ' ')) AS c FROM spot),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(5) t(k) WHERE c > 1 GROUP BY doc_id),
base AS (SELECT w.doc_id, lang, source, len(words) AS n_words, length(regexp_replace(t, '{SPACES}', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, least(1000, n_symbols * 1000 // greatest(word_chars, 1)) AS symbols, least(1000, n_dup_lines * 1000 // greatest(n_lines, 1)) AS dup_lines,
      least(1000, n_repeat_words * 1000 // greatest(n_words, 1)) AS repeats, least(1000, word_chars * 10 // greatest(n_words, 1)) AS word_length FROM base),
cells AS ({cells}),
own AS ({level("lang, source,")}), of_lang AS ({level("lang,")}), of_all AS ({level("")}),
pulled AS (SELECT of_lang.lang, of_lang.measure, (of_lang.n * of_lang.own + {PRIOR} * of_all.own) // (of_lang.n + {PRIOR}) AS own FROM of_lang JOIN of_all ON of_lang.measure = of_all.measure),
best AS (SELECT own.lang, own.source, own.measure, (own.n * own.own + {PRIOR} * pulled.own) // (own.n + {PRIOR}) AS u FROM own JOIN pulled ON own.lang IS NOT DISTINCT FROM pulled.lang AND own.measure = pulled.measure),
wide AS (SELECT lang, source, {wide} FROM best GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {within} AS kept FROM m LEFT JOIN wide ON wide.lang IS NOT DISTINCT FROM m.lang AND wide.source IS NOT DISTINCT FROM m.source
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffixes, op2_minhash, op3_topk, op4_pii, op5_html, op6_sentencepiece, op7_packing, op8_warc, op9_substrings, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3, "op8_warc": OP8, "op9_substrings": OP9, "op10_quality": _op10()}
