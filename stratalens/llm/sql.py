"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from stratalens.llm import mixing, simplex

SOURCES = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(mixing.WEIGHTS))

#: All pairs of vectors, links and components.
EMBEDDINGS = """
WITH RECURSIVE raw AS (SELECT vec_id, cast(embedding AS double[]) v FROM embeddings),
good AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) size FROM raw
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9),
reach AS (SELECT vec_id a, vec_id b FROM raw UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) component_id FROM reach GROUP BY a),
counted AS (SELECT a, count(*) n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
FROM raw JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id"""

#: Base32 by the bits of the hexadecimal SHA-1.
WARC = """
WITH digested AS (SELECT page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) first_id FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
    lpad(bin(cast(strpos('0123456789abcdef', substr(hex, i, 1)) - 1 AS int)), 4, '0')), '') bits FROM digested)
SELECT page_id, cast(payload_bytes AS bigint) payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * cast(substr(bits, 5 * k + 1, 1) AS int) + 8 * cast(substr(bits, 5 * k + 2, 1) AS int)
    + 4 * cast(substr(bits, 5 * k + 3, 1) AS int) + 2 * cast(substr(bits, 5 * k + 4, 1) AS int)
    + cast(substr(bits, 5 * k + 5, 1) AS int), 1)), '') payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN first_id <> page_id THEN first_id END refers_to
FROM bits"""

#: Levels by all cuts between capped and open sources, then the queue of all copies.
MIXING = rf"""
WITH units AS (SELECT doc_id, source, size, count(*) n FROM (SELECT doc_id, source,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS bigint) size FROM documents) GROUP BY ALL),
sized AS (SELECT source, cast(sum(size * n) AS bigint) source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 source_no FROM units GROUP BY source),
weighed AS (SELECT *, CASE source_no % {len(mixing.WEIGHTS)} {SOURCES} END w, cast(source_size AS double) * {mixing.MOST_COPIES} cap FROM sized),
levels AS (SELECT *, (sum(source_size) OVER () * {mixing.BUDGET} - coalesce(sum(cap) OVER (ORDER BY cap / w, source_no
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lv FROM weighed),
shares AS (SELECT source, source_no, source_size, least(cap, max(lv) OVER () * w) target FROM levels),
queued AS (SELECT u.*, s.source_no, s.source_size, s.target, md5(concat('{mixing.SEED}:', u.doc_id)) k,
    sum(size * n) OVER (PARTITION BY source_no ORDER BY md5(concat('{mixing.SEED}:', u.doc_id)), size) ends
  FROM units u JOIN shares s ON u.source IS NOT DISTINCT FROM s.source),
copies AS (SELECT *, CASE WHEN target > 0 THEN cast(ends + r * source_size AS double) / target ELSE 0 END finish
  FROM queued, range({mixing.MOST_COPIES}) q(r)),
served AS (SELECT *, sum(size * n) OVER (ORDER BY finish, source_no, r, k, size) total FROM copies),
taken AS (SELECT doc_id, source, size, n, source_size, target,
    sum(CASE WHEN total <= floor({mixing.BUDGET} * (SELECT sum(source_size) FROM sized)) THEN 1 ELSE 0 END) c FROM served GROUP BY ALL)
SELECT doc_id, size, source_size, target, cast(size * c AS bigint) taken FROM taken, range(n) i(i)"""

#: All pairs of documents that share a shingle, links on whole sets, components.
MINHASH = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
sets AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) > 1
    THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE w END) s FROM words)),
sizes AS (SELECT doc_id, count(*) n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id a, doc_id b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) n_shingles, component_id, d.doc_id = component_id kept
FROM documents d JOIN least ON least.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

#: CRC-32 bit by bit: a list element of 0 or more is a byte of the id, -1 one step of the division.
CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(coalesce(cast(doc_id AS varchar), ''), ''),
    lambda d: list_concat([ascii(d)::bigint], list_transform(range(8), lambda i: -1::bigint))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

#: Words p apart whose next five words are equal; stretches of such places are runs, of equal stretches the least period counts.
PERIODIC = rf"""
WITH hashed AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, {CRC32} h FROM documents),
cut AS (SELECT *, len(w) n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END a, (h // 10) % 8 g FROM hashed),
docs AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n),
    lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g)) END]) END w FROM cut),
words AS (SELECT r, unnest(range(n)) i, unnest(w) w FROM docs),
grams AS (SELECT r, i, concat_ws(' ', w, lead(w, 1) OVER s, lead(w, 2) OVER s, lead(w, 3) OVER s, lead(w, 4) OVER s) gram,
    lead(w, 4) OVER s IS NOT NULL whole FROM words WINDOW s AS (PARTITION BY r ORDER BY i)),
pairs AS (SELECT x.r, x.i, y.i - x.i p FROM grams x JOIN grams y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i WHERE x.whole AND y.whole),
stretches AS (SELECT r, p, min(i) s, count(*) + 4 + p m FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) g FROM pairs)
  GROUP BY r, p, g HAVING count(*) + 4 >= 3 * p AND count(*) + 4 + p >= 6),
runs AS (SELECT r, s, m, min(p) p FROM stretches GROUP BY r, s, m),
listed AS (SELECT r, count(*) n_runs, string_agg(concat(s, ',', m, ',', p, chr(10)), '' ORDER BY s, p) runs,
    first(struct_pack(s := s, m := m, p := p) ORDER BY m DESC, s, p) best FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(s + p, s + m)) i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) t FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) n_runs, best.s "start", best.m length, best.p period, 1000 * best.m // best.p exponent_milli,
  sha256(coalesce(runs, '')) runs_sha256, sha256(coalesce(t, '')) collapsed_sha256
FROM docs LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)"""

#: Groups of equal normalised texts.
CONTENT = """
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) keep_id, count(*) OVER (PARTITION BY t) group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 kept, sha256(t) text_sha256 FROM norm"""


def _simplex() -> str:
    """Lloyd's rounds one after the other: distances to all centroids, the least, floors of the means."""

    def assigned(centroids: str) -> str:
        return f"""(SELECT id, v, d.d.d, d.d.c FROM (SELECT id, p.v, (SELECT min(struct_pack(d := list_sum(list_transform(list_zip(p.v, k.v),
            lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, c := k.c)) FROM {centroids} k) d FROM points p) d)"""

    steps = [
        f"""raw AS (SELECT vec_id, cast(embedding AS double[]) e FROM embeddings WHERE embedding IS NOT NULL),
points AS (SELECT row_number() OVER () id, vec_id, list_transform(e, lambda x: cast(floor({simplex.SCALE} * x) AS bigint)) v FROM raw
  WHERE len(e) = {simplex.DIMENSIONS} AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 c, v FROM (SELECT v, sha256(concat('{simplex.SEED}:', vec_id)) h FROM points
  ORDER BY h, v LIMIT {simplex.CLUSTERS}))"""
    ]
    for k in range(simplex.ROUNDS):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT c, unnest(v) x, unnest(range({simplex.DIMENSIONS})) i FROM {assigned(f"c{k}")}),
m{k} AS (SELECT c, list(f ORDER BY i) v FROM (SELECT c, i, cast(floor(cast(sum(x) AS double) / count(*)) AS bigint) f FROM a{k} GROUP BY c, i) GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m{k}.v, c{k}.v) v FROM c{k} LEFT JOIN m{k} USING (c))""")
    last = f"c{simplex.ROUNDS}"
    return f"""WITH {", ".join(steps)}, final AS MATERIALIZED {assigned(last)}
SELECT vec_id, cast(final.c AS int) cluster, d distance, cast(sum(d) OVER (PARTITION BY final.c) AS bigint) cluster_inertia,
  cast(sum(d) OVER () AS bigint) inertia, sha256(array_to_string({last}.v, ',')) centroid_sha256
FROM final JOIN points USING (id) JOIN {last} ON {last}.c = final.c"""


ORACLE = {
    "op2_embeddings": EMBEDDINGS,
    "op3_warc": WARC,
    "op7_minhash": MINHASH,
    "op10_mixing": MIXING,
    "op11_runs": PERIODIC,
    "op12_content": CONTENT,
    "op13_simplex": _simplex(),
}
ORACLE = {name: text.strip() for name, text in ORACLE.items()}
