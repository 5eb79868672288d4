"""The registered queries of this package as DuckDB SQL, where SQL can say them."""

from __future__ import annotations

#: Sizes, targets and taken words by running sums; positions by the quadratic of each schedule's piece.
OP1 = r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':1') AS ord
    FROM documents
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
    FROM sized GROUP BY source
),
weighed AS (
    SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sources
),
levels AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
           / CAST(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lambda_,
           cap / weight AS level
    FROM weighed
),
targets AS (
    SELECT source, source_size, (rank - 1) % 3 AS place,
           CASE WHEN lambda_ >= level THEN CAST(cap AS DOUBLE)
                ELSE (min({'level': level, 'rank': rank, 'l': lambda_}) FILTER (WHERE lambda_ < level) OVER ()).l * weight END AS target
    FROM levels
),
placed AS (
    SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, t.source_size, t.target, t.place, CAST(round(t.target) AS BIGINT) AS quota,
           CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
),
counted AS (
    SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size END AS whole FROM placed
),
taken AS (
    SELECT *, CAST(whole * size + least(greatest(quota - whole * source_size - at_, 0), size) AS BIGINT) AS taken, at_ / quota AS f FROM counted
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken = 0 THEN NULL
            WHEN f = 0 THEN 0.0
            WHEN place = 0 THEN least(2.0 * f / (1.5 + sqrt(greatest(2.25 - 2.0 * f, 0.0))), 1.0)
            WHEN place = 1 THEN least(2.0 * f / (1.0 + sqrt(1.0)), 1.0)
            WHEN f = 0.3125 / 1.0 THEN 0.5
            WHEN f < 0.3125 THEN least(2.0 * f / (0.5 + sqrt(greatest(0.25 + 1.0 * f, 0.0))), 0.5)
            ELSE 0.5 + least(2.0 * (f - 0.3125) / (0.75 + sqrt(greatest(0.5625 + 5.0 * (f - 0.3125), 0.0))), 0.5) END AS first_position
FROM taken
"""

#: A turn is rendered so that a prefix of turns is a prefix of text, and nothing else is.
OP7 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
lines AS (
    SELECT conv_id, turn, role, text,
           '<|im_start|>' || replace(replace(role, '\', '\\'), '<|', '<\|') || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|im_end|>' || chr(10) AS line
    FROM turns
),
whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(line, '' ORDER BY turn NULLS FIRST, role, text) AS body,
           first(line ORDER BY turn NULLS FIRST, role, text) AS opening
    FROM lines GROUP BY conv_id
),
kept AS (
    SELECT a.conv_id, a.n_turns FROM whole a
    WHERE NOT EXISTS (
        SELECT 1 FROM whole b WHERE b.opening = a.opening AND starts_with(b.body, a.body)
        AND (b.n_turns > a.n_turns OR b.n_turns = a.n_turns AND b.conv_id < a.conv_id))
),
parts AS (
    SELECT l.conv_id, k.n_turns, coalesce(floor(l.turn / 256), -1e18) AS piece, string_agg(line, '' ORDER BY turn NULLS FIRST, role, text) AS text
    FROM lines l JOIN kept k ON l.conv_id = k.conv_id GROUP BY ALL
)
SELECT conv_id, n_turns, row_number() OVER (PARTITION BY conv_id ORDER BY piece) - 1 AS part, text FROM parts
"""

#: Where the records of the worn pages lie in the first archive.
OP8 = r"""
WITH dealt AS (
    SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url,
           CAST('0x' || substr(md5(concat_ws('|', CAST(page_id AS VARCHAR), url, md5(html))), 1, 8) AS BIGINT)
           % greatest(1, CAST(ceil((SELECT count(*) FROM pages) / 2000.0) AS BIGINT)) AS file
    FROM pages
),
sized AS (
    SELECT file, page_id, html, url,
           strlen('WARC/1.1##WARC-Type: resource##WARC-Record-ID: <urn:page:') + strlen(coalesce(CAST(page_id AS VARCHAR), ''))
           + strlen('>##WARC-Target-URI: ') + strlen(url)
           + strlen('##WARC-Date: 2020-01-01T00:00:00Z##Content-Type: text/html##WARC-Block-Digest: sha256:') + 64
           + strlen('##Content-Length: ') + strlen(CAST(strlen(html) AS VARCHAR)) + 4 + strlen(html) + 4 AS length
    FROM dealt
),
placed AS (
    SELECT file, page_id, length, row_number() OVER w - 1 AS place, sum(length) OVER w - length AS start FROM sized
    WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST)
)
SELECT CAST(file AS BIGINT) AS file, place, page_id, CAST(start AS BIGINT) AS start, length, 'damaged' AS state FROM placed WHERE page_id % 41 = 5
"""

#: The rules by a join on the domains above a host; the rounds of both ranks written out one after the other.
OP11 = r"""
WITH rules(domain, start, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
),
cut_ AS (
    SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parsed AS MATERIALIZED (
    SELECT row_number() OVER () AS id, page_id, html,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut_
),
fits AS (
    SELECT p.id, r.domain || r.start AS rule, r.verdict,
           row_number() OVER (PARTITION BY p.id ORDER BY length(r.domain) + length(r.start) DESC, length(r.domain) DESC) AS place
    FROM parsed p JOIN rules r ON (p.host = r.domain OR ends_with(p.host, '.' || r.domain)) AND starts_with(p.path, r.start)
),
judged AS MATERIALIZED (
    SELECT p.id, p.page_id, p.host, p.path, f.rule, f.verdict FROM parsed p LEFT JOIN fits f ON f.id = p.id AND f.place = 1
),
links AS (
    SELECT DISTINCT id, host AS src,
           translate(regexp_extract(unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^<>]*?href\s*=\s*["'']?([^"''\s<>]*)', 1)),
                                    '^(?:[Hh][Tt][Tt][Pp][Ss]?:)?//([^/?#\\]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst
    FROM parsed WHERE host <> ''
),
edges AS (SELECT src, dst, count(*) AS pages FROM links WHERE dst <> '' AND dst <> src GROUP BY ALL),
both_ AS (SELECT 1 AS way, src, dst, pages FROM edges UNION ALL SELECT -1, dst, src, pages FROM edges),
shares AS MATERIALIZED (
    SELECT way, src, dst, pages / CAST(sum(pages) OVER (PARTITION BY way, src) AS DOUBLE) AS share FROM both_
),
hosts AS (
    SELECT host, floor(count(*) FILTER (WHERE verdict = 'allow') * CAST(1073741824 AS DOUBLE) / count(*)) AS allowed,
           floor(count(*) FILTER (WHERE verdict = 'block') * CAST(1073741824 AS DOUBLE) / count(*)) AS blocked
    FROM judged WHERE host <> '' GROUP BY host
),
seeds AS MATERIALIZED (
    SELECT 1 AS way, host, CAST(allowed AS BIGINT) AS mass FROM hosts WHERE allowed > 0
    UNION ALL SELECT -1, host, CAST(blocked AS BIGINT) FROM hosts WHERE blocked > 0
),
ranks0 AS MATERIALIZED (SELECT * FROM seeds),
@ROUNDS@
found AS (
    SELECT host, coalesce(sum(mass) FILTER (WHERE way = 1), 0) AS trust, coalesce(sum(mass) FILTER (WHERE way = -1), 0) AS distrust
    FROM ranks20 GROUP BY host
)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.verdict, CASE WHEN f.distrust > f.trust AND f.distrust >= 536870912 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN found f ON j.host = f.host
""".replace(
    "@ROUNDS@",
    "\n".join(
        f"""ranks{k} AS MATERIALIZED (
    SELECT way, host, CAST(sum(mass) AS BIGINT) AS mass FROM (
        SELECT r.way, s.dst AS host, floor(r.mass * CAST(0.85 AS DOUBLE) * s.share) AS mass
        FROM ranks{k - 1} r JOIN shares s ON r.way = s.way AND r.host = s.src
        UNION ALL SELECT way, host, mass FROM seeds)
    WHERE mass > 0 GROUP BY way, host
),"""
        for k in range(1, 21)
    ),
)

#: Four costs a row from the last one back, then letter by letter forward; crc32 bit by bit.
OP12 = r"""
WITH RECURSIVE raw AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                   string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ord(c)::BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20 AS kind
    FROM conversations
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM raw WHERE kind <> 0
),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n
    FROM damaged
),
shown AS (
    SELECT *, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen FROM numbered
),
rows_ AS MATERIALIZED (
    SELECT conv_id, turn, role, text, i, n, body = '' AS blank, body <> '' AND seen AS duplicate,
           body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
           left(role, 1) AS c, CASE WHEN body = '' OR seen THEN 1000000000 ELSE 0 END AS forced,
           CASE WHEN body <> '' AND NOT seen AND right(body, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS late
    FROM shown
),
back AS (
    SELECT conv_id, max(n) + 1 AS i, 0::BIGINT AS b0, 4::BIGINT AS b1, 2::BIGINT AS b2, 0::BIGINT AS b3 FROM rows_ GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i, least(c0, 2 + c2, 4 + c3), least(c1, 2 + c2, 4 + c3), least(c2, 2 + c3), least(c3, 2 + c2)
    FROM (
        SELECT r.conv_id, r.i,
               least(3 + b0, forced + late + least(2 + b2, CASE c WHEN 's' THEN b1 WHEN 'u' THEN b2 ELSE 1000000000 END)) AS c0,
               least(3 + b1, forced + late + least(2 + b2, CASE c WHEN 'u' THEN b2 ELSE 1000000000 END)) AS c1,
               least(3 + b2, forced + late + least(2 + b3, CASE c WHEN 'a' THEN b3 ELSE 1000000000 END)) AS c2,
               least(3 + b3, forced + late + least(2 + b2, CASE c WHEN 'u' THEN b2 ELSE 1000000000 END)) AS c3
        FROM back b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i - 1)
),
costs AS MATERIALIZED (SELECT conv_id, i, [b0, b1, b2, b3] AS b FROM back),
steps AS MATERIALIZED (
    SELECT a.conv_id, a.i, a.b, z.b AS after_, r.role, r.text, r.c, r.forced, r.late
    FROM costs a LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = a.i
    LEFT JOIN costs z ON z.conv_id IS NOT DISTINCT FROM a.conv_id AND z.i = a.i + 1
),
trace AS (
    SELECT conv_id, 1::BIGINT AS i, 0 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS lines, false AS done FROM rows_ GROUP BY conv_id
    UNION ALL
    SELECT conv_id, CASE WHEN letter IN ('I', '') THEN i ELSE i + 1 END,
           CASE letter WHEN 'D' THEN q WHEN '' THEN q WHEN 'K' THEN kept ELSE on_ END, audit || letter,
           CASE letter WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, said || ':' || text)
                       WHEN 'I' THEN list_append(lines, said || ':') ELSE lines END, letter = ''
    FROM (
        SELECT t.*, s.role, s.text, m.on_, m.said, m.kept,
               CASE WHEN s.c IS NULL THEN CASE WHEN s.b[q + 1] = 0 THEN '' ELSE 'I' END
                    WHEN 3 + s.after_[q + 1] = s.b[q + 1] THEN 'D'
                    WHEN 2 + s.b[m.on_ + 1] = s.b[q + 1] THEN 'I'
                    WHEN m.kept IS NOT NULL AND s.late + s.after_[m.kept + 1] = s.b[q + 1] THEN 'K' ELSE 'R' END AS letter
        FROM trace t JOIN steps s ON s.conv_id IS NOT DISTINCT FROM t.conv_id AND s.i = t.i,
        LATERAL (SELECT CASE q WHEN 2 THEN 3 ELSE 2 END AS on_, CASE q WHEN 2 THEN 'assistant' ELSE 'user' END AS said,
                        CASE WHEN q = 0 AND s.c = 's' THEN 1 WHEN q <> 2 AND s.c = 'u' THEN 2 WHEN q = 2 AND s.c = 'a' THEN 3 END AS kept) m
        WHERE NOT t.done)
),
paired AS (SELECT conv_id, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM rows_),
pairs AS (SELECT conv_id, count(*) AS illegal FROM paired WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
           count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated
    FROM rows_ GROUP BY conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(p.illegal, 0) AS illegal, coalesce(k.b[1], 0) AS cost,
       coalesce(t.audit, '') AS audit, sha256(coalesce(array_to_string(t.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN pairs p ON p.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN costs k ON k.conv_id IS NOT DISTINCT FROM a.conv_id AND k.i = 1
LEFT JOIN trace t ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.done
"""

#: Every score in full.
OP13 = r"""
WITH split_docs AS (
    SELECT row_number() OVER () AS id, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
),
held AS MATERIALIZED (SELECT id, doc_id, len(terms) AS n, terms FROM split_docs WHERE len(terms) > 0),
totals AS MATERIALIZED (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM held),
counted AS MATERIALIZED (SELECT id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT id, doc_id, n, unnest(terms) AS term FROM held) GROUP BY id, term),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals
),
asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT DISTINCT item_id, text, generate_subscripts(terms, 1) AS place, unnest(terms) AS term FROM (
            SELECT item_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM benchmark))
    GROUP BY item_id, term
),
scored AS (
    SELECT a.item_id, c.id, any_value(c.doc_id) AS doc_id,
           CAST(sum(a.times * w.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (75 + (25 * c.n * t.docs) // t.tokens)))) AS BIGINT) AS score
    FROM asked a JOIN counted c ON c.term = a.term JOIN weights w ON w.term = a.term, totals t GROUP BY a.item_id, c.id
),
ranked AS (
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

ORACLES: dict[str, str] = {
    "op1_mixing_curriculum": OP1,
    "op7_snapshot_collapse": OP7,
    "op8_merkle_fixity": OP8,
    "op11_link_graph_filter": OP11,
    "op12_conversation_repair": OP12,
    "op13_pair_bound_maxscore": OP13,
}
