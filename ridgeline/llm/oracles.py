"""DuckDB SQL of the corpus queries that SQL can express, over whole tables and texts.

Language prediction, media streams, token ids, cheapest edits and spans are no SQL. Tests hold those against brute force,
exact round trips and held-out rows.
"""

from __future__ import annotations

from ridgeline.llm import license_scan, mixing

SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{SPACE}'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _line_sql(table: str, key: str, host: str, text: str, share: str, columns: str) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, {key} AS key, {host} AS host, coalesce({text}, '') AS text, {_words(text)} AS words FROM {table}),
w AS (SELECT r, unnest(range(1, len(words) - 1)) AS p, words FROM d WHERE len(words) >= 3),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, words[p], words[p + 1], words[p + 2]) AS n FROM w),
c AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
a AS (SELECT r, host, line, k, len(own) AS n, lower(regexp_replace(array_to_string(own, ' '), '[0-9]', '0', 'g')) AS norm
      FROM (SELECT r, host, line, k, {_words('line')} AS own FROM (SELECT r, host, unnest(u) AS line, generate_subscripts(u, 1) AS k FROM (SELECT r, host, string_split(text, chr(10)) AS u FROM d)))),
l AS (SELECT * FROM a WHERE n > 0),
h AS (SELECT host, count(*) AS host_n FROM d GROUP BY host),
o AS (SELECT l.host, l.norm FROM l JOIN h ON h.host IS NOT DISTINCT FROM l.host GROUP BY l.host, l.norm, h.host_n HAVING count(DISTINCT l.r) > least(greatest(20e0, 0.005e0 * h.host_n), 10000e0)),
x AS (SELECT l.r, sum(l.n) AS removed FROM l JOIN o ON o.host IS NOT DISTINCT FROM l.host AND o.norm = l.norm GROUP BY l.r),
t AS (SELECT a.r, string_agg(a.line, chr(10) ORDER BY a.k) AS kept_text FROM a LEFT JOIN o ON o.host IS NOT DISTINCT FROM a.host AND o.norm = a.norm AND a.n > 0 WHERE o.norm IS NULL GROUP BY a.r),
y AS (SELECT r, count(*) - count(DISTINCT line) AS dups FROM l GROUP BY r),
z AS (SELECT d.key AS {key}, d.host AS site, CAST(len(words) AS bigint) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda v: length(v))), 0) AS bigint) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols, CAST(coalesce(y.dups, 0) AS bigint) AS n_dup_lines,
        CAST(coalesce(c.n_repeat_words, 0) AS bigint) AS n_repeat_words, CAST(coalesce(x.removed, 0) AS bigint) AS removed_words, sha256(coalesce(t.kept_text, '')) AS kept_sha256
      FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN x ON x.r = d.r LEFT JOIN y ON y.r = d.r LEFT JOIN t ON t.r = d.r)
SELECT {key}, {columns}, removed_words, kept_sha256, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= {share} * n_words AS kept FROM z
"""


OP4 = _line_sql("documents", "doc_id", "source", "text", "0.5e0", "n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words")
PAGE_LINES = _line_sql("pages", "page_id", "array_to_string(string_split(split_part(url, '/', 3), '.')[-2:], '.')", "replace(html, '>', '>' || chr(10))", "0.85e0", "site, n_words")


def _license_sql() -> str:
    sets = {name: b for name, t in sorted(license_scan.TEMPLATES.items()) if (b := license_scan.bigrams(t))}
    rows = ", ".join(f"({_quoted(name)}, [{', '.join(map(_quoted, b))}])" for name, b in sets.items())
    known, words = license_scan.known_bigrams(license_scan.TEMPLATES)
    most = 2 * (max(license_scan.size_bounds(len(b), license_scan.THRESHOLD)[1] for b in sets.values()) + 1)
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t(template, grams) AS (VALUES {rows}),
known AS (SELECT unnest([{', '.join(map(_quoted, known))}]) AS gram),
known_words AS (SELECT unnest([{', '.join(map(_quoted, words))}]) AS word),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS MATERIALIZED (SELECT r, k, string_split(trim(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM
      (SELECT r, unnest(u) AS line, generate_subscripts(u, 1) AS k FROM (SELECT r, string_split(text, chr(10)) AS u FROM d))),
lb AS MATERIALIZED (SELECT r, k, w, {pairs} AS grams FROM l),
h AS (SELECT x.r, x.k, count(*) AS n FROM (SELECT r, k, unnest(grams) AS gram FROM lb) x JOIN known USING (gram) GROUP BY ALL),
f AS (SELECT lb.r, lb.k, lb.w, CASE WHEN len(lb.w) = 1 THEN lb.w[1] = '' OR lb.w[1] IN (SELECT word FROM known_words) ELSE 2 * coalesce(h.n, 0) >= len(lb.grams) END AS alike
      FROM lb LEFT JOIN h ON h.r = lb.r AND h.k = lb.k),
j AS MATERIALIZED (SELECT r, string_agg(CASE WHEN alike THEN array_to_string(w, ' ') ELSE chr(1) END, chr(10) ORDER BY k) AS runs, count(*) AS lines, string_agg(array_to_string(w, ' '), ' ' ORDER BY k) AS whole FROM f GROUP BY r),
run AS MATERIALIZED (SELECT r, k, trim(run, chr(10)) AS run FROM (SELECT r, unnest(u) AS run, generate_subscripts(u, 1) AS k FROM (SELECT r, string_split(runs, chr(1)) AS u FROM j)) WHERE contains(trim(run, chr(10)), chr(10))),
part AS (SELECT r, k, list_filter(regexp_split_to_array(run, '[\n][\n]+'), lambda x: x <> '') AS parts FROM run),
stretch AS (SELECT r, k, i, unnest(range(i, len(parts) + 1)) AS j, parts FROM (SELECT r, k, unnest(range(1, len(parts) + 1)) AS i, parts FROM part)),
long AS (SELECT r, 'run' || k AS k, string_split(regexp_replace(run, '[ \n]+', ' ', 'g'), ' ') AS w FROM run
      UNION ALL SELECT r, 'part' || k || '-' || i || '-' || j, w FROM (SELECT *, string_split(regexp_replace(array_to_string(parts[i:j], ' '), '[ \n]+', ' ', 'g'), ' ') AS w FROM stretch
        WHERE NOT (i = 1 AND j = len(parts)) AND (j > i OR contains(parts[i], chr(10)))) WHERE len(w) <= {most}
      UNION ALL SELECT r, 'whole', string_split(trim(regexp_replace(whole, ' +', ' ', 'g')), ' ') FROM j WHERE lines > 1 AND contains(runs, chr(1))),
b AS (SELECT r, 'line' || k AS k, grams FROM lb WHERE len(w) > 1 UNION ALL SELECT r, k, {pairs} FROM long WHERE len(w) > 1),
s AS (SELECT b.r, b.k, t.template, 2e0 * len(list_intersect(b.grams, t.grams)) / (len(b.grams) + len(t.grams)) AS dice FROM b JOIN t ON len(b.grams) BETWEEN len(t.grams) * 0.6 AND len(t.grams) * 1.6),
m AS (SELECT r, k, max(struct_pack(dice := dice, template := template)) AS best FROM s WHERE dice >= {license_scan.THRESHOLD}e0 GROUP BY r, k),
a AS (SELECT r, max(best) AS best, count(*) AS n FROM m GROUP BY r)
SELECT d.doc_id, a.best.template AS license, a.best.dice AS dice, CAST(coalesce(a.n, 0) AS bigint) AS license_units FROM d LEFT JOIN a ON a.r = d.r
"""


def _hash(seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS varchar), '')), 1, 15) AS bigint)"


UNIT = mixing.UNIT
OP6 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, CAST(len({_words('text')}) AS bigint) AS size, {_hash(29)} AS h FROM documents),
s AS MATERIALIZED (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w
      FROM (SELECT source, CAST(sum(size) AS bigint) AS total, count(*) AS n FROM d GROUP BY source)),
o AS (SELECT *, row_number() OVER (ORDER BY 2 * total / w, source NULLS LAST) AS k FROM s),
u AS (SELECT *, 1.5e0 * sum(total) OVER () - coalesce(sum(2 * total) OVER p, 0) AS spare, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS weight FROM o
      WINDOW p AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min(k) AS k FROM u WHERE spare / weight * w <= 2 * total),
t AS MATERIALIZED (SELECT u.source, u.total, greatest(u.total / u.n, 1e-9) AS mean, CASE WHEN v.k IS NULL OR u.k < v.k THEN CAST(2 * u.total AS double) ELSE (SELECT x.spare / x.weight FROM u x WHERE x.k = v.k) * u.w END AS target
      FROM u CROSS JOIN v),
hist AS MATERIALIZED (SELECT source, size, count(*) AS n FROM d GROUP BY source, size),
b(i, source, lo, hi) AS (SELECT 0, source, -1000e0, 1000e0 FROM t UNION ALL
      SELECT i + 1, source, CASE WHEN got < target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN got < target THEN hi ELSE (lo + hi) / 2 END FROM
        (SELECT b.i, b.source, b.lo, b.hi, t.target, sum(hist.n * hist.size * 2e0 / (1 + exp(least(-(b.lo + b.hi) / 2 * hist.size / t.mean, 700e0)))) AS got
         FROM b JOIN t ON t.source IS NOT DISTINCT FROM b.source JOIN hist ON hist.source IS NOT DISTINCT FROM b.source WHERE b.i < 90 GROUP BY ALL)),
m AS (SELECT b.source, (b.lo + b.hi) / 2 AS m, t.target, t.mean, t.total FROM b JOIN t ON t.source IS NOT DISTINCT FROM b.source WHERE b.i = 90),
r AS (SELECT hist.source, hist.size, hist.n, m.target, m.total, CASE WHEN hist.size = 0 THEN {UNIT} WHEN m.target >= 2 * m.total THEN {2 * UNIT} WHEN m.target <= 0 THEN 0
        ELSE CAST(round(2e0 / (1 + exp(least(-m.m * hist.size / m.mean, 700e0))) * {UNIT}) AS bigint) END AS rate FROM hist JOIN m ON m.source IS NOT DISTINCT FROM hist.source),
q AS (SELECT *, coalesce(sum(n * rate) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r),
c AS (SELECT q.source, k.k * {UNIT} // {mixing.STARTS} AS u, abs(sum(q.size * ((q.start + q.n * q.rate + k.k * {UNIT} // {mixing.STARTS}) // {UNIT} - (q.start + k.k * {UNIT} // {mixing.STARTS}) // {UNIT})) - any_value(q.target)) AS miss
      FROM q CROSS JOIN range({mixing.STARTS}) k(k) GROUP BY q.source, k.k),
f AS (SELECT source, min(struct_pack(miss := miss, u := u)).u AS u FROM c GROUP BY source),
e AS (SELECT d.doc_id, d.size, q.total, q.target, q.rate, q.start + f.u AS start, row_number() OVER (PARTITION BY d.source, d.size ORDER BY d.h, d.doc_id) - 1 AS j FROM d JOIN q ON q.source IS NOT DISTINCT FROM d.source AND q.size = d.size JOIN f ON f.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, total AS source_size, target, CAST(size * ((start + (j + 1) * rate) // {UNIT} - (start + j * rate) // {UNIT}) AS bigint) AS taken FROM e
"""

OP7 = rf"""
WITH RECURSIVE k(i, c, n) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n + 1 FROM k WHERE n < 8),
tbl AS MATERIALIZED (SELECT list(CAST(c AS bigint) ORDER BY i) AS t FROM k WHERE n = 8),
d AS MATERIALIZED (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS bigint) AS size,
      CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_transform(string_split(trim(regexp_replace(hex(text), '(..)', '\1 ', 'g')), ' '), lambda x: CAST('0x' || x AS bigint)) END AS bytes FROM documents),
c0 AS MATERIALIZED (SELECT doc_id, source, size, xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, tbl),
c AS MATERIALIZED (SELECT *, CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS varchar), '') || '|' || size || '|' || text_crc32), 1, 15) AS bigint) AS h FROM c0),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) * 2 - 1) / CAST(2 * count(*) OVER (PARTITION BY source) AS double) AS frac FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY frac, source NULLS LAST, h, doc_id, size, text_crc32) - 1 AS pos, count(*) OVER () AS n FROM f)
SELECT doc_id, size, CAST(text_crc32 AS bigint) AS text_crc32, 'rows' AS law, CAST(pos * 16 // n AS int) AS shard, CAST(pos - ((pos * 16 // n) * n + 15) // 16 AS bigint) AS slot, CAST(NULL AS int) AS grown_shard FROM p
"""

OP8 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS words FROM documents),
w AS (SELECT r, unnest(range(1, len(words) - 33)) AS p, words FROM d WHERE len(words) >= 35),
g AS MATERIALIZED (SELECT r, p, md5(array_to_string(words[p : p + 34], ' ')) AS window_ FROM w),
a AS (SELECT r, p FROM g WHERE window_ IN (SELECT window_ FROM g GROUP BY window_ HAVING count(*) > 1)),
v AS (SELECT d.r, d.doc_id, unnest(d.words) AS word, generate_subscripts(d.words, 1) AS p FROM d),
x AS (SELECT v.*, max(CASE WHEN a.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY v.r ORDER BY v.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM v LEFT JOIN a ON a.r = v.r AND a.p = v.p),
y AS (SELECT r, CAST(sum(gone) AS bigint) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM x GROUP BY r)
SELECT d.doc_id, CAST(len(d.words) AS bigint) AS n_words, coalesce(y.n_removed, 0) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256 FROM d LEFT JOIN y ON y.r = d.r
"""

#: Bytes are pairs of hexadecimal digits, cut into parts first, as a place in a long text is slow to find; starts of windows that are not the first of their bytes are merged into runs.
OP9 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(coalesce(text, '')) AS h, length(hex(coalesce(text, ''))) // 2 AS n FROM documents),
c AS MATERIALIZED (SELECT doc_id, n, b * 200 AS q, substr(h, 400 * b + 1, 600) AS part FROM (SELECT doc_id, h, n, unnest(range(0, (n + 100) // 200)) AS b FROM d WHERE n >= 100)),
g AS MATERIALIZED (SELECT doc_id, q + k AS p, md5_number_lower(substr(part, 2 * k + 1, 200)) AS low, md5_number_upper(substr(part, 2 * k + 1, 200)) AS high
      FROM (SELECT doc_id, q, part, unnest(range(0, least(200, n - 99 - q))) AS k FROM c)),
f AS (SELECT low, high, min(CAST(doc_id AS hugeint) * 4294967296 + p) AS first FROM g GROUP BY low, high HAVING count(*) > 1),
a AS (SELECT g.doc_id, g.p FROM g JOIN f ON f.low = g.low AND f.high = g.high WHERE f.first <> CAST(g.doc_id AS hugeint) * 4294967296 + g.p),
i AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM a)),
r AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM i GROUP BY doc_id, run),
k AS MATERIALIZED (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS last_e FROM r),
y AS (SELECT k.doc_id, CAST(sum(k.e - k.s) AS bigint) AS n_removed, count(*) AS n_spans, string_agg(substr(d.h, 2 * k.last_e + 1, 2 * (k.s - k.last_e)), '' ORDER BY k.s) || substr(any_value(d.h), 2 * max(k.e) + 1) AS kept FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(d.n AS bigint) AS n_bytes, coalesce(y.n_removed, 0) AS n_removed, coalesce(y.n_spans, 0) AS n_spans, sha256(unhex(coalesce(y.kept, d.h))) AS kept_sha256 FROM d LEFT JOIN y ON y.doc_id = d.doc_id
"""

OP10 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words('text')} AS words FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS grams FROM d),
c AS MATERIALIZED (SELECT doc_id, CASE WHEN len(grams) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY grams) END AS copy_of, CASE WHEN len(grams) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY grams) END AS n_copies, grams FROM g),
r AS MATERIALIZED (SELECT copy_of AS rep, len(grams) AS n, unnest(grams) AS gram FROM c WHERE doc_id = copy_of AND len(grams) > 0),
p AS MATERIALIZED (SELECT x.rep AS a, y.rep AS b FROM r x JOIN r y ON x.gram = y.gram AND x.rep < y.rep GROUP BY x.rep, y.rep, x.n, y.n HAVING count(*) >= 0.8e0 * (x.n + y.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
n AS (SELECT a AS rep, count(*) AS links FROM e GROUP BY a),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
k AS (SELECT a AS rep, least(a, min(b)) AS root FROM reach GROUP BY a)
SELECT c.doc_id, coalesce(k.root, c.copy_of) AS class_id, CAST(coalesce(n.links, 0) AS bigint) AS n_links, c.copy_of, CAST(c.n_copies AS bigint) AS n_copies FROM c LEFT JOIN n ON n.rep = c.copy_of LEFT JOIN k ON k.rep = c.copy_of
"""



def _centroid_sql(k: int = 40, rounds: int = 5, width: int = 64) -> str:
    """One common table per round; floored means in whole numbers."""
    steps = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})",
        "v AS MATERIALIZED (SELECT r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS double)) AS bigint)) AS v FROM kept)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY vec_id IS NULL, h, v) - 1 AS integer) AS c, v FROM (SELECT vec_id, v, sha256('2:' || CAST(vec_id AS varchar)) AS h FROM v) ORDER BY c LIMIT {k})",
    ]
    for i in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(range(1, %d), lambda j: (v.v[j] - c.v[j]) * (v.v[j] - c.v[j]))) AS bigint)" % (width + 1)
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS distance, CAST(arg_min(c, d * {2 * k} + c) AS integer) AS cluster FROM (SELECT v.r, v.vec_id, v.v, c.c, {distance} AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            steps.append(f"m{i} AS (SELECT cluster, j, CAST(sum(v[j]) AS hugeint) AS s, CAST(count(*) AS hugeint) AS n FROM a{i}, (SELECT unnest(range(1, {width + 1})) AS j) GROUP BY cluster, j)")
            steps.append(f"n{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS bigint) ORDER BY j) AS v FROM m{i} GROUP BY cluster)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n ON n.cluster = c.c)")
    sums = "CAST(sum(distance) OVER (PARTITION BY cluster) AS bigint) AS cluster_inertia, CAST(sum(distance) OVER () AS bigint) AS inertia"
    return "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, cluster, distance, {sums}, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} c ON c.c = cluster"


ORACLES: dict[str, str] = {
    "op4_line_rules": OP4,
    "op5_license_scan": _license_sql(),
    "op6_entropy_mix": OP6,
    "op7_stratified_shards": OP7,
    "op8_substring_dedup": OP8,
    "op9_suffix_dedup": OP9,
    "op10_ngram_jaccard_join": OP10,
    "page_line_rules": PAGE_LINES,
    "op12_centroid_clusters": _centroid_sql(),
}
