"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .decontaminate import Seeds
from .quality_rules import BOILERPLATE, CLOSING_WIDE

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CLOSING = [".", "!", "?", ":", ";", '"', "''", ")", "]", *CLOSING_WIDE]

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
          h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x, max(page_id) OVER (PARTITION BY b) AS top FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
          array_to_string(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
            lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i * 5 + 1)::INTEGER, 5))::INTEGER >> s) & 31) + 1, 1)), 'string_agg', '')), '') AS payload_digest,
          CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
        FROM h""",
    "op2_substring_dedup": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
          s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t)),
          m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
          gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM m),
          e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
          k AS (SELECT e.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY e.i) FILTER (WHERE gone.i IS NULL) AS kept
                FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i GROUP BY 1)
        SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM t LEFT JOIN k ON k.doc_id = t.doc_id""",
    "op6_ngram_jaccard": f"""
        WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{WORD}') AS w FROM documents),
          s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
          n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
          e AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
                JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
          r AS (SELECT doc_id, doc_id AS hit FROM t UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.hit)
        SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(hit) AS component_id
        FROM t JOIN r ON r.doc_id = t.doc_id LEFT JOIN n ON n.doc_id = t.doc_id GROUP BY t.doc_id""",
    "op7_line_templates": f"""
        WITH l AS MATERIALIZED (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
          w AS (SELECT doc_id, i, list_transform(regexp_extract_all({LOWER.format('line')}, '{WORD}'), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '0' ELSE x END) AS w, regexp_extract_all({LOWER.format('line')}, '{WORD}') AS plain FROM l),
          c AS (SELECT doc_id, i, CASE WHEN len(w) = 1 THEN plain ELSE w END AS w, len(w) AS n, least(3, len(w)) AS a FROM w WHERE len(w) >= 1),
          f AS (SELECT doc_id, i, n, n || ' ' || array_to_string(w[1:a], ' ') AS path, array_to_string(w[a + 1:a + (n - a) // 3], ' ') AS x,
                  array_to_string(w[a + (n - a) // 3 + 1:a + (n - a) * 2 // 3], ' ') AS y, array_to_string(w[a + (n - a) * 2 // 3 + 1:n], ' ') AS z FROM c),
          k AS MATERIALIZED (SELECT doc_id, i, n, unnest(CASE WHEN n >= 8 THEN [[path, x, y, z, ''], [path, y, z, '0'], [path, x, z, '1'], [path, x, y, '2']] ELSE [[path, x, y, z, '']] END) AS k FROM f),
          first AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS first FROM k GROUP BY k HAVING count(DISTINCT doc_id) >= CASE WHEN bool_and(len(k.k) = 5) AND bool_and(n >= 20) THEN 3 ELSE 10 END),
          gone AS (SELECT DISTINCT k.doc_id, k.i FROM k JOIN first USING (k) WHERE struct_pack(d := k.doc_id, i := k.i) <> first)
        SELECT l.doc_id, count(*) FILTER (WHERE regexp_matches(line, '{WORD}')) AS n_lines, count(gone.i) AS n_dropped,
          sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '')) AS kept_sha256
        FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id""",
    "op9_chat_format": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
          a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                  string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss,
                  sum(length('<|turn|>') + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
                    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|end|>') + 1)::BIGINT AS formatted_chars FROM c GROUP BY 1)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM a""",
    "op8_quality_rules": f"""
        WITH t AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
          r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM (
            SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t))),
          q AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM r WHERE c > 1) GROUP BY 1),
          l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM t)),
          f AS (SELECT doc_id, i, line, regexp_extract_all(line, '{WORD}') AS w, length(regexp_replace(line, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters,
                  row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again, {LOWER.format('line')} AS low FROM l),
          g AS (SELECT doc_id, len(w) AS n, again,
                  NOT (right(w[len(w)], 1) IN ({", ".join(f"'{c}'" for c in CLOSING)}) OR (len(w) >= 8 AND len(list_filter(w, lambda x: right(x, 1) IN ('.', '!', '?'))) > 0))
                  OR len(list_filter(w, lambda x: regexp_full_match(x, '[#*$%&|<>]+'))) >= 0.2::DOUBLE * len(w) OR len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) >= 0.3::DOUBLE * len(w)
                  OR (letters >= 5 AND capitals >= 0.7::DOUBLE * letters) OR {" OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)} OR again AS fails FROM f WHERE len(w) > 0),
          d AS (SELECT doc_id, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE fails), 0) AS lost_words FROM g GROUP BY 1),
          b AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost_words, 0)::BIGINT AS lost_words
                FROM t LEFT JOIN d USING (doc_id) LEFT JOIN q USING (doc_id))
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost_words <= 50 * n_words AS kept FROM b""",
    "op5_decontaminate": f"""
        WITH b AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY item_id, w) AS rid, len(w) AS n FROM (
              SELECT DISTINCT item_id, regexp_extract_all({LOWER.format('text')}, '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) >= 8),
          d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{WORD}') AS w FROM documents),
          masks AS MATERIALIZED (SELECT m, length(m) AS size, list_filter(range(0, length(m)), lambda o: substr(m, (o + 1)::INTEGER, 1) = '1') AS open FROM (
              SELECT unnest([{", ".join(f"'{m}'" for m in Seeds().masks)}]) AS m UNION SELECT repeat('1', n::INTEGER) FROM b WHERE n < 10)),
          bs AS (SELECT rid, m, i, array_to_string(list_transform(open, lambda o: w[i + o + 1]), ' ') AS s FROM (
              SELECT rid, w, m, open, unnest(range(0, n - size + 1)) AS i FROM b JOIN masks ON size = least(n, 10))),
          ds AS (SELECT doc_id, m, i, array_to_string(list_transform(open, lambda o: w[i + o + 1]), ' ') AS s FROM (
              SELECT doc_id, w, m, open, unnest(range(0, len(w) - size + 1)) AS i FROM d JOIN masks ON size <= len(w))),
          hits AS MATERIALIZED (SELECT DISTINCT doc_id, rid, ds.i - bs.i AS shift FROM ds JOIN bs ON ds.m = bs.m AND ds.s = bs.s),
          v AS (SELECT doc_id, rid, shift, n, item_id, greatest(0, -shift) AS low, k, dw[k + shift + 1] = bw[k + 1] AS same FROM (
              SELECT h.*, b.n, b.item_id, d.w AS dw, b.w AS bw, unnest(range(greatest(0, -shift), least(b.n, len(d.w) - shift))) AS k FROM hits h JOIN b USING (rid) JOIN d USING (doc_id))),
          c AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -4 END) OVER (PARTITION BY doc_id, rid, shift ORDER BY k) AS t FROM v),
          g AS (SELECT *, t - least(0, min(t) OVER (PARTITION BY doc_id, rid, shift ORDER BY k)) AS gain FROM c),
          e AS (SELECT doc_id, rid, shift, arg_min(k + 1, struct_pack(a := -gain, b := k)) AS last FROM g GROUP BY ALL),
          f AS (SELECT g.doc_id, g.rid, g.shift, any_value(n) AS n, any_value(item_id) AS item_id, last,
                  greatest(arg_max(k + 1, struct_pack(a := -t, b := k)) FILTER (WHERE k + 1 <= last AND t <= 0), CASE WHEN min(t) FILTER (WHERE k + 1 <= last) > 0 THEN min(low) END, CASE WHEN min(t) FILTER (WHERE k + 1 <= last) IS NULL THEN min(low) END) AS first
                FROM g JOIN e USING (doc_id, rid, shift) GROUP BY ALL),
          o AS (SELECT f.doc_id, f.item_id, f.rid, f.shift, f.n, first + f.shift AS doc_word, first AS item_word, last - first AS n_words, count(*) FILTER (WHERE same) AS n_matched
                FROM f JOIN v ON v.doc_id = f.doc_id AND v.rid = f.rid AND v.shift = f.shift AND v.k >= first AND v.k < last GROUP BY ALL),
          less AS MATERIALIZED (SELECT * FROM o WHERE n_matched < least(13, ceil(0.8 * n))),
          u AS MATERIALIZED (SELECT doc_id, rid, shift, k + 1 AS at, t, sum(same::INTEGER) OVER (PARTITION BY doc_id, rid, shift ORDER BY k) AS a FROM c JOIN less USING (doc_id, rid, shift)
                UNION ALL SELECT doc_id, rid, shift, greatest(0, -shift), 0, 0 FROM less),
          i AS (SELECT y.doc_id, y.rid, y.shift, y.at AS stop, min(x.at) AS start, any_value(y.a) - arg_min(x.a, x.at) AS agree
                FROM u y JOIN u x ON x.doc_id = y.doc_id AND x.rid = y.rid AND x.shift = y.shift AND x.at < y.at AND x.t <= y.t GROUP BY 1, 2, 3, 4),
          j AS (SELECT doc_id, rid, shift, arg_min(struct_pack(a := start, b := stop), struct_pack(x := -agree, y := stop)) AS widest FROM i GROUP BY ALL),
          s AS (SELECT less.doc_id, item_id, less.rid, less.shift, less.n, min(k) FILTER (WHERE same) + less.shift AS doc_word, min(k) FILTER (WHERE same) AS item_word,
                  max(k) FILTER (WHERE same) + 1 - min(k) FILTER (WHERE same) AS n_words, count(*) FILTER (WHERE same) AS n_matched
                FROM less JOIN j USING (doc_id, rid, shift) JOIN (SELECT doc_id, rid, shift, k, same FROM v) v ON v.doc_id = less.doc_id AND v.rid = less.rid AND v.shift = less.shift AND k >= widest.a AND k < widest.b GROUP BY 1, 2, 3, 4, 5),
          p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rid ORDER BY n_matched DESC, shift) AS r FROM (SELECT * FROM o UNION ALL SELECT * FROM s) WHERE n_matched >= least(13, ceil(0.8 * n)))
        SELECT doc_id, item_id, doc_word, item_word, n_words, n_matched FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, doc_word, item_word, n_words DESC) AS q FROM p WHERE r = 1) WHERE q = 1""",
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
          t AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
          k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
          g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
          v AS (SELECT g.lang, count(term) AS v FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN k ON k.lang = g.lang GROUP BY 1),
          n AS (SELECT g.lang, g.source, k.term, count(t.term) AS c FROM g JOIN k ON k.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term GROUP BY 1, 2, 3),
          p AS MATERIALIZED (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p,
              1 + (1000000000::HUGEINT * (sum(c) OVER (PARTITION BY lang, term) + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v) AS q FROM n JOIN v USING (lang)),
          pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
          terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p WHERE c > 0 AND p > q),
          r AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
        SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 50""",
}
