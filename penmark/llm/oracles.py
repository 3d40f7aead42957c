"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, payload_digest,
         CASE WHEN octet_length(payload) >= 100
              THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM g
"""

ORACLES["op7_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(length(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
k AS (
  SELECT doc_id, n, line,
         translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.n, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

ORACLES["op6_decontaminate"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bk AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bi AS (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bi),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) ks WHERE len(w) >= k),
found AS (SELECT doc_id, item, i, di.k FROM di JOIN windows ON windows.k = di.k AND windows.s = array_to_string(w[i:i + di.k - 1], ' ')),
spots AS (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM found),
hits AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l
          FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# exact all-pairs form, for small tables: the operator finds the same links through bands
ORACLES["op4_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dk AS (SELECT doc_id, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0),
di AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dk),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS s FROM di),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b, o = x.n AND o = y.n AS same FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
         WHERE o >= 0.8 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS v, doc_id AS u FROM d UNION SELECT v, link.b FROM reach JOIN link ON link.a = reach.u),
class AS (SELECT v AS doc_id, min(u) AS class_id FROM reach GROUP BY v),
copies AS (SELECT d.doc_id, least(d.doc_id, min(b)) AS copy_id, 1 + count(b) AS n_copies
           FROM d LEFT JOIN link ON a = d.doc_id AND same GROUP BY d.doc_id),
other AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT CASE WHEN NOT same THEN copy_id END) AS n_text_links
          FROM link JOIN copies ON copies.doc_id = b GROUP BY a)
SELECT d.doc_id, class_id, coalesce(copy_id, d.doc_id) AS copy_id, n_copies::BIGINT AS n_copies,
       coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_text_links, 0)::BIGINT AS n_text_links
FROM d JOIN class USING (doc_id) JOIN copies USING (doc_id) LEFT JOIN other USING (doc_id)
"""


def _crc32(codes: str) -> str:
    """CRC-32 of a list of bytes in SQL; each byte is followed by eight -1 that stand for the bit steps."""
    return (f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) "
            "WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295::BIGINT)")


_BITS = ", -1, -1, -1, -1, -1, -1, -1, -1"
# bytes of a text of ASCII characters and of U+00C0 to U+00FF, with their bit steps
_BYTES = (f"flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT{_BITS}] "
          f"ELSE [195::BIGINT{_BITS}, unicode(x)::BIGINT - 64{_BITS}] END FOR x IN string_split({{}}, '')])")

ORACLES["op11_periodic_runs"] = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w0,
                  {_crc32(_BYTES.format("CAST(doc_id AS VARCHAR)"))} AS h FROM documents),
s AS (SELECT *, len(w0)::BIGINT AS n, CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a FROM t),
p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM s),
d AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_concat(w0[1:a], [w0[a + (i - a) % p + 1] FOR i IN range(a, n)]) ELSE w0 END AS w FROM p),
e AS (SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM d),
same AS (SELECT e.doc_id, b.i - e.i AS q, e.i FROM e JOIN e b ON b.doc_id = e.doc_id AND b.x = e.x AND b.i > e.i AND 4 * (b.i - e.i) <= e.n),
isle AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM isle GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM stretch r WHERE NOT EXISTS (
  SELECT 1 FROM stretch o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.m >= r.s + r.m)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM run),
kept AS (SELECT e.doc_id, sha256(string_agg(x, ' ' ORDER BY e.i)) AS c FROM e ANTI JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i
         GROUP BY e.doc_id),
best AS (SELECT doc_id, count(*) AS n_runs, min(struct_pack(m := -m, s := s, q := q)) AS b,
                sha256(string_agg(concat(s, ',', m, ',', q, chr(10)), '' ORDER BY s, q)) AS r FROM run GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, (-b.m)::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * -b.m // b.q)::BIGINT AS exponent_milli, coalesce(r, sha256('')) AS runs_sha256, coalesce(c, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["op13_spelling"] = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
c AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, k, {_crc32(_BYTES.format("concat(doc_id, ':', run)"))} AS h FROM c),
x AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, sum(k)::BIGINT AS n FROM x WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
skip AS (SELECT word, i, left(word, i) || chr(1) || substr(word, i + 2) AS hole, left(word, i) || substr(word, i + 2) AS less
         FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM skip a JOIN skip b ON a.hole = b.hole AND a.word <> b.word
         UNION SELECT less, word FROM skip WHERE less IN (SELECT word FROM v)
         UNION SELECT word, less FROM skip WHERE less IN (SELECT word FROM v)),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(m := -v.n, w := other)) AS b FROM near JOIN v ON v.word = other GROUP BY near.word),
f AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.m >= 10 * n THEN b.w END AS form,
             CASE WHEN -b.m >= 10 * n THEN (-b.m)::BIGINT END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, form, word AS root FROM f
          UNION ALL SELECT chain.word, f.form, f.word FROM chain JOIN f ON f.word = chain.form)
SELECT f.word, f.form, chain.root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.form IS NULL
"""
