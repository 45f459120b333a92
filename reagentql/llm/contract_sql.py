"""SQL of the manifest and the clusters, whose levels and rounds are written one after another."""

from __future__ import annotations


def _part(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _levels(name: str, source: str, levels: int) -> str:
    """Nodes {name}n0, {name}n1, ... and runs {name}r0, ... over a table of (grp, idx, n, digest)."""
    out = [f"{name}n0 AS MATERIALIZED (SELECT grp, idx, n, digest FROM {source})"]
    for k in range(levels):
        out.append(f"{name}r{k} AS MATERIALIZED (SELECT grp, idx // 16 AS run, n, list(digest ORDER BY idx) AS kids FROM {name}n{k} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{name}n{k + 1} AS MATERIALIZED (SELECT grp, run AS idx, (n + 15) // 16 AS n, sha256(array_to_string(kids, '')) AS digest FROM {name}r{k})")
    ends = " UNION ALL ".join(f"SELECT grp, digest FROM {name}n{k} WHERE n = 1" for k in range(levels + 1))
    out.append(f"{name}top AS MATERIALIZED ({ends})")
    return ",\n".join(out)


def _climb(name: str, source: str, levels: int) -> str:
    """{name}p0, {name}p1, ...: rows of (id, grp, idx, proof, folded) moved up a tree."""
    out = [f"{name}p0 AS (SELECT id, grp, idx, proof, folded FROM {source})"]
    for k in range(levels):
        side = "list_slice(r.kids, 1, p.idx % 16)", "list_slice(r.kids, p.idx % 16 + 2, 16)"
        left, right = (f"coalesce(array_to_string({x}, ''), '')" for x in side)
        out.append(
            f"{name}p{k + 1} AS (SELECT p.id, p.grp, p.idx // 16 AS idx, p.proof || {left} || {right} AS proof, "
            f"CASE WHEN r.n IS NULL THEN p.folded ELSE sha256({left} || p.folded || {right}) END AS folded "
            f"FROM {name}p{k} p LEFT JOIN {name}r{k} r ON r.grp = p.grp AND r.run = p.idx // 16)"
        )
    return ",\n".join(out)


def merkle_sql(levels: int = 6, top_levels: int = 4) -> str:
    """The manifest of documents; enough levels for 16 ** levels documents a source."""
    leaf = f"sha256({_part('doc_id')} || {_part('source')} || {_part('lang')} || {_part('n_chars')} || {_part('text')})"
    lowered = leaf.replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    crc = "xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))), lambda c, b: xor(c >> 8, crc[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT))"
    return f"""WITH
crcs AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS UBIGINT)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])),
  lambda c, x: xor(c >> 1, CAST(3988292384 AS UBIGINT) * (c & CAST(1 AS UBIGINT))))) AS crc),
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS grp, {leaf} AS digest,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {lowered} ELSE {leaf} END AS tampered FROM documents, crcs),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d),
{_levels('a', 'l', levels)},
{_climb('a', "(SELECT id, grp, idx, '' AS proof, tampered AS folded FROM l)", levels)},
g AS MATERIALIZED (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, digest, grp AS source_grp FROM atop),
{_levels('b', 'g', top_levels)},
{_climb('b', f"(SELECT p.id, '' AS grp, g.idx, p.proof, p.folded FROM ap{levels} p JOIN g ON g.source_grp = p.grp)", top_levels)}
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, t.digest AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = t.digest AS verified
FROM bp{top_levels} p JOIN l ON l.id = p.id JOIN atop s ON s.grp = l.grp, btop t"""


def centroids_sql(k: int = 8, rounds: int = 10, scale: int = 1024, dims: int = 64, seed: int = 3) -> str:
    """Clusters of embeddings after some rounds."""
    kept = f"""WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS x FROM embeddings WHERE len(embedding) = {dims}),
v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(x, lambda e: CAST(floor({scale} * e) AS BIGINT)) AS v
  FROM x WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS INTEGER) AS cluster, v AS c FROM v QUALIFY cluster < {k})"""
    distance = "CAST(list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    out = [kept]
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT id, min(struct_pack(distance := {distance}, cluster := c.cluster)) AS best FROM v, c{r} c GROUP BY id)")
        if r < rounds:
            out.append(
                f"s{r} AS (SELECT best.cluster AS cluster, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS place FROM a{r} JOIN v USING (id)), "
                f"m{r} AS (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM s{r} GROUP BY ALL), "
                f"f{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY place) AS c FROM m{r} GROUP BY cluster), "
                f"c{r + 1} AS MATERIALIZED (SELECT o.cluster, coalesce(f{r}.c, o.c) AS c FROM c{r} o LEFT JOIN f{r} USING (cluster))"
            )
    return ",\n".join(out) + f"""
SELECT v.vec_id, a.best.cluster AS cluster, a.best.distance AS distance,
  CAST(sum(a.best.distance) OVER (PARTITION BY a.best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (id) JOIN c{rounds} c ON c.cluster = a.best.cluster"""
