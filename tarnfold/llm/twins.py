"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# CRC-32 of a text's bytes, bit by bit
_CRC = """xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i::int, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::bigint * (x & 1)))))"""


def _tree(name: str, levels: int) -> str:
    """CTEs ``name0`` (g, pos, h) up to ``name{levels}``: each run of 8 is one node above, as long as a group has several.

    ``name_n{k}`` has each node of level k with what stands before and after it in its run.
    """
    steps = []
    for k in range(levels):
        steps.append(
            f"{name}_n{k} AS (SELECT *, count(*) OVER (PARTITION BY g) > 1 AS more, coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,"
            f" coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k}),\n"
            f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN bool_or(more) THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE min(h) END AS h FROM {name}_n{k} GROUP BY g, pos // 8)"
        )
    return ",\n".join(steps)


def _path(name: str, levels: int) -> str:
    """g, pos and the list of (before, after), level by level, of each leaf."""
    each = " || ".join(f"CASE WHEN n{k}.more THEN [struct_pack(b := n{k}.b, a := n{k}.a)] ELSE [] END" for k in range(levels))
    joins = " ".join(f"JOIN {name}_n{k} n{k} ON n{k}.g IS NOT DISTINCT FROM n0.g AND n{k}.pos = n0.pos // {8**k}" for k in range(1, levels))
    return f"SELECT n0.g, n0.pos, {each} AS path FROM {name}_n0 n0 {joins}"


def merkle(levels: int = 7, top: int = 3) -> str:
    """op11: trees of at most ``8 ** levels`` rows a language and ``8 ** top`` languages."""
    parts = " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
    forged = parts.replace("text::varchar", f"translate(text, '{UPPER}', '{LOWER}')")
    return f"""
WITH leaves AS (SELECT doc_id, lang AS g, sha256({parts}) AS h, CASE WHEN {_CRC.format("doc_id::varchar")} % 3 = 0 THEN sha256({forged}) END AS f FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves),
t0 AS (SELECT g, pos, h FROM placed),
{_tree("t", levels)},
subs AS (SELECT g AS lang, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM t{levels}),
u0 AS (SELECT 0 AS g, pos, h FROM subs),
{_tree("u", top)},
low AS ({_path("t", levels)}),
high AS ({_path("u", top)}),
whole AS (SELECT placed.*, subs.h AS subroot, u{top}.h AS root, low.path || high.path AS path
    FROM placed JOIN low ON low.g IS NOT DISTINCT FROM placed.g AND low.pos = placed.pos JOIN subs ON subs.lang IS NOT DISTINCT FROM placed.g JOIN high ON high.pos = subs.pos, u{top}),
done AS (SELECT *, sha256(array_to_string(list_transform(path, lambda s: s.b || s.a), '')) AS proof,
    list_reduce(list_prepend(struct_pack(b := coalesce(f, h), a := ''), path), lambda x, s: struct_pack(b := sha256(s.b || x.b || s.a), a := '')).b AS folded FROM whole)
SELECT doc_id, h AS leaf, subroot, root, proof AS proof_sha256, folded AS folded_root, folded = root AS verified FROM done
"""


def ranked(limit: int = 10) -> str:
    """op13: every document scored for every item."""

    def terms(table: str, key: str) -> str:
        cut = r"regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
        return f"SELECT {key}, translate(unnest({cut}), '{UPPER}', '{LOWER}') AS term FROM {table}"

    return f"""
WITH words AS ({terms("documents", "doc_id")}),
held AS (SELECT doc_id, term, count(*)::bigint AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::bigint AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*)::bigint AS total_docs, sum(n)::bigint AS total_terms FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * total_docs + 2) / (2 * count(*) + 1)))::bigint AS w FROM held, whole GROUP BY term, total_docs),
asked AS (SELECT DISTINCT * FROM ({terms("benchmark", "item_id")})),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * total_docs) // total_terms)))) AS impact
    FROM held JOIN sizes USING (doc_id) JOIN weights USING (term), whole),
scored AS (SELECT item_id, doc_id, sum(impact)::bigint AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0),
placed AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::int AS rank, doc_id, score FROM scored)
SELECT * FROM placed WHERE rank <= {limit}
"""
