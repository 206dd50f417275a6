"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations


def clusters(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """Op 11: all distances in every round, one chain of tables a round."""
    out = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS INTEGER) AS c, v FROM v QUALIFY c < {k})",
    ]
    for n in range(rounds + 1):
        out.append(
            f"""a{n} AS (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c, CAST(list_sum(list_transform(list_zip(v.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{n}) GROUP BY r)"""
        )
        if n < rounds:
            out.append(
                f"""s{n} AS (SELECT c, i, CAST(floor(sum(x) / count(*)::DOUBLE) AS BIGINT) AS x FROM (SELECT a{n}.c, unnest(v.v) AS x, unnest(range({dim})) AS i FROM v JOIN a{n} ON v.r = a{n}.r) GROUP BY c, i),
c{n + 1} AS (SELECT c{n}.c, coalesce(m.v, c{n}.v) AS v FROM c{n} LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM s{n} GROUP BY c) m ON m.c = c{n}.c)"""
            )
    return f"""WITH {", ".join(out)} SELECT vec_id, CAST(a{rounds}.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM v JOIN a{rounds} ON a{rounds}.r = v.r JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
#: The last bit of the checksum of the decimal doc_id, a byte and a bit at a time.
_ODD = """list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, xor(a, b)), 4294967295) % 2 = 1"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """A relation (g, lvl, pos, h, n): level by level the nodes of the trees whose leaves are given."""
    return f"""{name}(g, lvl, pos, h, n) AS (SELECT g, 0, pos, h, n FROM {leaves} UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, lvl, pos // 3, n)"""


def _way(name: str, tree: str, leaves: str) -> str:
    """A relation (g, pos, lvl, l, r): the digests left and right of a leaf's way at each level."""
    return f"""{name} AS (SELECT x.g, x.pos, t.lvl, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos < x.pos // CAST(3 ** t.lvl AS BIGINT)), '') AS l, coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (t.pos > x.pos // CAST(3 ** t.lvl AS BIGINT)), '') AS r
 FROM {leaves} x JOIN {tree} t ON t.g = x.g AND t.n > 1 AND t.pos // 3 = x.pos // CAST(3 ** (t.lvl + 1) AS BIGINT) GROUP BY ALL)"""


def manifest() -> str:
    """Op 12: the checksum is 0 over 2 where its last bit before the final inversion is 1."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {_leaf("text")} AS h, {_leaf("CASE WHEN " + _ODD + " THEN replace(text, chr(10), '') ELSE text END")} AS altered FROM documents),
x AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY g) AS n FROM d), {_tree("t", "x")},
s AS (SELECT '' AS g, t.g AS name, h, CAST(row_number() OVER (ORDER BY t.g) - 1 AS BIGINT) AS pos, count(*) OVER () AS n FROM t WHERE n = 1), {_tree("u", "s")},
{_way("w", "t", "x")}, {_way("y", "u", "s")}, p AS (SELECT g, pos, 0 AS part, lvl, l, r FROM w UNION ALL SELECT x.g, x.pos, 1, y.lvl, y.l, y.r FROM x JOIN s ON s.name = x.g JOIN y ON y.pos = s.pos),
q AS (SELECT g, pos, string_agg(l || r, '' ORDER BY part, lvl) AS beside, list(l || '|' || r ORDER BY part, lvl) AS way FROM p GROUP BY g, pos), o AS (SELECT h AS root FROM u WHERE n = 1),
f AS (SELECT doc_id, x.h AS leaf, s.h AS subroot, root, sha256(coalesce(beside, '')) AS proof_sha256, list_reduce(coalesce(way, []), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2)), altered) AS folded_root
 FROM x JOIN s ON s.name = x.g LEFT JOIN q ON q.g = x.g AND q.pos = x.pos, o)
SELECT *, folded_root = root AS verified FROM f"""
