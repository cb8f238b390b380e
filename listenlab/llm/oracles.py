"""DuckDB SQL for the Merkle manifest and the conversation trie."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII string, bit by bit."""
    bit = "lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END"
    byte = f"lambda s, c: list_reduce(range(8)::BIGINT[], {bit}, xor(s, c))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")) + ")"


MERKLE = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS changed
  FROM documents),
placed AS (
  SELECT *, coalesce('=' || lang, '-') AS grp, coalesce(changed, leaf) AS tried,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
up(grp, l, pos, digest, n) AS (
  SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM placed
  UNION ALL
  SELECT grp, l + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM up WHERE n > 1 GROUP BY grp, l, pos // 2),
subroots AS (
  SELECT grp, l AS height, digest AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS place FROM up WHERE n = 1),
over(l, pos, digest, n) AS (
  SELECT 0, place, subroot, (SELECT count(*) FROM subroots) FROM subroots
  UNION ALL
  SELECT l + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 1) // 2
  FROM over WHERE n > 1 GROUP BY l, pos // 2),
top AS (SELECT digest AS root, l AS height FROM over WHERE n = 1),
fold(grp, start, l, pos, folded, siblings) AS (
  SELECT grp, pos, 0, pos, tried, '' FROM placed
  UNION ALL
  SELECT f.grp, f.start, f.l + 1, f.pos // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN s.digest || f.folded ELSE f.folded || coalesce(s.digest, '') END),
    f.siblings || coalesce(s.digest, '')
  FROM fold f JOIN subroots r ON r.grp = f.grp AND f.l < r.height
  LEFT JOIN up s ON s.grp = f.grp AND s.l = f.l AND s.pos = xor(f.pos, 1)),
fold2(grp, start, l, pos, folded, siblings) AS (
  SELECT f.grp, f.start, 0, r.place, f.folded, f.siblings FROM fold f JOIN subroots r ON r.grp = f.grp AND f.l = r.height
  UNION ALL
  SELECT f.grp, f.start, f.l + 1, f.pos // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN s.digest || f.folded ELSE f.folded || coalesce(s.digest, '') END),
    f.siblings || coalesce(s.digest, '')
  FROM fold2 f JOIN top t ON f.l < t.height LEFT JOIN over s ON s.l = f.l AND s.pos = xor(f.pos, 1))
SELECT p.doc_id, p.leaf, r.subroot, t.root, sha256(f.siblings) AS proof_sha256, f.folded AS folded_root, f.folded = t.root AS verified
FROM fold2 f JOIN top t ON f.l = t.height JOIN placed p ON p.grp = f.grp AND p.pos = f.start JOIN subroots r ON r.grp = f.grp
"""

TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id AS c, {crc32("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS b FROM turns),
rebuilt AS (
  SELECT c, 0 AS part, pos, role, text FROM convs JOIN turns ON conv_id = b AND pos < h
  UNION ALL
  SELECT c, 1, pos, role, text FROM convs JOIN turns ON conv_id = c AND pos >= h),
paths AS (
  SELECT c, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (part IS NOT NULL), []) AS path
  FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c),
prefixes AS (SELECT c, d, list_slice(path, 1, d) AS prefix, len(path) AS n FROM paths, unnest(range(0, len(path) + 1)) AS t(d)),
members AS (SELECT c, d, n, min(c) OVER (PARTITION BY prefix, d) AS rep, coalesce(length(prefix[d].text), 0) AS chars FROM prefixes),
nodes AS (SELECT rep, d, count(*) AS n_convs, any_value(chars) AS chars,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends FROM members GROUP BY rep, d),
edges AS (SELECT k.rep, k.d, u.rep AS parent FROM nodes k JOIN members u ON u.c = k.rep AND u.d = k.d - 1),
counts AS (SELECT parent AS rep, d - 1 AS d, count(*) AS n_children FROM edges GROUP BY ALL),
worth AS (SELECT k.rep, k.d, (n_convs - 1) * chars AS worth, coalesce(n_children, 0) AS n_children FROM nodes k LEFT JOIN counts USING (rep, d)),
below AS (
  SELECT u.rep, u.d, sum(w.worth)::BIGINT AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
  FROM worth w JOIN members u ON u.c = w.rep AND u.d <= w.d GROUP BY u.rep, u.d)
SELECT k.rep AS conv_id, k.d AS depth, e.parent AS parent_conv_id, k.n_convs, w.n_children, b.n_leaves, b.saved_tokens, sha256(k.ends) AS ends_sha256
FROM nodes k JOIN worth w USING (rep, d) JOIN below b USING (rep, d) LEFT JOIN edges e ON e.rep = k.rep AND e.d = k.d
"""
