"""Registered queries of this subpackage: name -> callable(spark, sf_dir), and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalake.llm.best_two_fit import op13_query
from stratalake.llm.conversation_repair import op11_query
from stratalake.llm.decontaminate import op3_query
from stratalake.llm.language_id import op7_query
from stratalake.llm.lexical_search import op12_query
from stratalake.llm.mixing import op9_query
from stratalake.llm.ngram_join import op8_query
from stratalake.llm.packing import op4_query
from stratalake.llm.quality_rules import BOILERPLATE, op6_query
from stratalake.llm.substring_dedup import op1_query
from stratalake.llm.token_counts import op10_query
from stratalake.llm.url_filter import op2_query
from stratalake.llm.warc import op5_query

WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"


def _over(table: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


TERMS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), [])"

_CRC_BYTE = "xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(s, (k // 8 + 1)::INTEGER, 1)) ELSE 0 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(s))), lambda c, k: CASE WHEN {_CRC_BYTE} & 1 = 1 THEN xor({_CRC_BYTE} >> 1, 3988292384) ELSE {_CRC_BYTE} >> 1 END), 4294967295)"


def _more(weight: str, cost: str, letter: str) -> str:
    """SQL of a weight, eight digits of cost and then letters, after one more edit."""
    return f"(lpad((left({weight}, 8)::INTEGER + {cost})::VARCHAR, 8, '0') || substr({weight}, 9) || '{letter}')"


_STAYS = "CASE WHEN fault = 't' THEN 5 ELSE 0 END"
_EVEN = "least(w0, w1, w3)"
_KEEP = "m.r = '{}' AND fault IN ('k', 't')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": _over("documents", op1_query),
    "op2_url_filter": _over("pages", op2_query),
    "op3_decontaminate": lambda spark, sf_dir: op3_query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op4_token_packing": _over("documents", op4_query),
    "op5_warc_bundles": _over("pages", op5_query),
    "op6_quality_rules": _over("documents", op6_query),
    "op7_language_id": _over("documents", op7_query),
    "op8_ngram_join": _over("documents", op8_query),
    "op9_mixing": _over("documents", op9_query),
    "op10_token_counts": _over("documents", op10_query),
    "op11_conversation_repair": _over("conversations", op11_query),
    "op12_lexical_search": lambda spark, sf_dir: op12_query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
    "op13_best_two_fit": _over("documents", op13_query),
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM w)),
        late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM late),
        word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
        marked AS (SELECT word.doc_id, x, p, gone.p IS NOT NULL AS g FROM word LEFT JOIN gone USING (doc_id, p)),
        edges AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY p), false) AS e FROM marked),
        kept AS (SELECT doc_id, count(*) AS n, count_if(g) AS r, count_if(e) AS s, sha256(coalesce(string_agg(x, ' ' ORDER BY p) FILTER (WHERE NOT g), '')) AS h FROM edges GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, coalesce(h, sha256('')) AS kept_sha256, coalesce(s, 0)::INTEGER AS n_spans
        FROM w LEFT JOIN kept USING (doc_id)""",
    "op6_quality_rules": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS i FROM w)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
        line AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
        one AS (SELECT doc_id, x, count(*) AS c, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS ch FROM line GROUP BY doc_id, x),
        ok AS (SELECT *, NOT (
            len(regexp_extract_all(x, '\||»|·|›')) >= 3 OR len(regexp_extract_all(x, '[#*$%&|<>{{}}~^=+_\\]')) * 10 > ch OR len(regexp_extract_all(x, '[!?]{{2,}}')) * 4 > n
            OR (n < 4 AND NOT regexp_matches(x, '[.!?…:;"''”’»)\]]\s*$')) OR (n <= 20 AND regexp_matches(lower(x), '{"|".join(BOILERPLATE)}'))) AS good FROM one),
        doc AS (SELECT doc_id, sum(c)::BIGINT AS n_lines, count(*)::BIGINT AS n_distinct, count_if(good)::BIGINT AS n_good, coalesce(sum(ch) FILTER (WHERE good), 0) AS good_ch FROM ok GROUP BY doc_id),
        b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
            coalesce(n_lines - n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
            coalesce(n_lines - n_good, 0)::BIGINT AS n_lines_removed, coalesce(good_ch, 0) AS good_ch
            FROM w LEFT JOIN doc USING (doc_id) LEFT JOIN cov USING (doc_id)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND CASE WHEN word_chars > 0 THEN 1 - good_ch / word_chars <= 0.5 ELSE false END AS kept, n_lines, n_lines_removed
        FROM f""",
    # without Insert: whom an inserted message stands beside can be deleted with it for less, and a lone s as well
    "op11_conversation_repair": rf"""
        WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
        crc AS (SELECT *, {_CRC} % 20 AS f FROM keyed),
        d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE f <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
        nth AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM o),
        m AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0,
            CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'k' END AS fault FROM nth),
        way AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, repeat('0', 8) AS w0, NULL::VARCHAR AS w1, NULL::VARCHAR AS w2, NULL::VARCHAR AS w3 FROM m
            UNION ALL
            SELECT m.conv_id, m.i, {_more("w0", "2", "D")},
                least({_more("w1", "2", "D")}, CASE WHEN {_KEEP.format("s")} THEN {_more("w0", _STAYS, "K")} END),
                least({_more("w2", "2", "D")}, CASE WHEN {_KEEP.format("u")} THEN {_more(_EVEN, _STAYS, "K")} END, CASE WHEN fault IN ('k', 't') THEN {_more(_EVEN, "1 + " + _STAYS, "R")} END),
                least({_more("w3", "2", "D")}, CASE WHEN {_KEEP.format("a")} THEN {_more("w2", _STAYS, "K")} END, CASE WHEN fault IN ('k', 't') THEN {_more("w2", "1 + " + _STAYS, "R")} END)
            FROM way JOIN m ON m.conv_id IS NOT DISTINCT FROM way.conv_id AND m.i = way.i + 1),
        best AS (SELECT conv_id, left(w, 8)::BIGINT AS cost, substr(w, 9) AS audit FROM (SELECT conv_id, arg_max(least(w0, w3), i) AS w FROM way GROUP BY conv_id)),
        letter AS (SELECT m.*, substr(audit, i::INTEGER, 1) AS e FROM m JOIN best ON m.conv_id IS NOT DISTINCT FROM best.conv_id),
        placed AS (SELECT *, count(*) FILTER (e <> 'D' AND NOT (e = 'K' AND r = 's')) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM letter),
        sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate, count_if(fault = 't') AS truncated,
            count_if(r0 || r NOT IN ('su', 'ua', 'au')) AS illegal,
            sha256(coalesce(string_agg(CASE WHEN e = 'K' THEN role WHEN n % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) FILTER (e <> 'D'), '')) AS repaired_sha256
            FROM placed GROUP BY conv_id),
        ids AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM ids LEFT JOIN best ON ids.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN sums ON ids.conv_id IS NOT DISTINCT FROM sums.conv_id""",
    "op12_lexical_search": rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS ws FROM documents WHERE len({TERMS}) > 0),
        total AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS length FROM d),
        q AS (SELECT DISTINCT item_id, text FROM benchmark),
        i AS (SELECT k, item_id, t, count(*) AS qf FROM (SELECT row_number() OVER () AS k, item_id, unnest({TERMS}) AS t FROM q) GROUP BY k, item_id, t),
        o AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY r, t),
        w AS (SELECT t, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM o, total GROUP BY t),
        m AS (SELECT r, doc_id, 100 - 75 + (75 * len(ws) * docs) // length AS m FROM d, total),
        s AS (SELECT k, item_id, r, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN o USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY k, item_id, r, doc_id),
        n AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM n WHERE rank <= 10""",
    # no seeds: all alignments on which tokens are equal
    "op3_decontaminate": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT min(item_id) AS item_id, w FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\pL\pN]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 4 GROUP BY w),
        dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
        bt AS (SELECT item_id, len(w) AS n, least(len(w), 13) AS c, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM b),
        need AS (SELECT item_id, CASE WHEN c < 9 THEN c ELSE ceil(c * 0.84) END AS least_matched FROM bt GROUP BY ALL),
        eq AS (SELECT doc_id, item_id, c, p - i AS shift, i FROM dt JOIN bt USING (t)),
        near AS (SELECT doc_id, item_id, shift FROM eq JOIN need USING (item_id) GROUP BY doc_id, item_id, shift, least_matched HAVING count(*) >= least_matched),
        run AS (SELECT doc_id, item_id, c, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY i RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS matched FROM eq SEMI JOIN near USING (doc_id, item_id, shift))
        SELECT doc_id, item_id, max(matched)::BIGINT AS matched, max(c)::BIGINT AS compared FROM run JOIN need USING (item_id) WHERE matched >= least_matched GROUP BY doc_id, item_id""",
    "op8_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("text", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - 2, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS i FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s AS a JOIN s AS b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT x, y FROM o JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.c)
        SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
}
