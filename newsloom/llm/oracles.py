"""SQL that must agree with the queries that SQL can express."""

from __future__ import annotations

# CRC-32 of a text whose characters are below U+0800, as an unsigned number
_BYTES = "flatten(list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END))"


def crc32(x: str) -> str:
    eight = "[CAST(0 AS BIGINT) FOR z IN range(8)]"
    bits = f"list_reduce(list_prepend(xor(c, b), {eight}), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform({_BYTES.format(x=x)}, lambda b: CAST(b AS BIGINT))), "
            f"lambda c, b: {bits}), 4294967295)")


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"


LEVELS = 16  # enough for 43 million leaves a group


def _climb(name: str, leaves: str) -> str:
    """CTEs <name>0 .. <name>LEVELS: nodes (tree, place, size, hash) level by level, and the slots of their runs."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT tree, place, count(*) OVER (PARTITION BY tree) AS size, hash FROM {leaves})"]
    for k in range(LEVELS):
        slots = ", ".join(f"max(CASE WHEN place % 3 = {i} THEN hash END) AS s{i}" for i in range(3))
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT tree, place // 3 AS place, any_value((size + 2) // 3) AS size,
  CASE WHEN any_value(size) = 1 THEN max(hash) ELSE sha256(concat_ws('', {', '.join(f"max(CASE WHEN place % 3 = {i} THEN hash END)" for i in range(3))})) END AS hash,
  any_value(size) AS under, {slots} FROM {name}{k} GROUP BY tree, place // 3)""")
    return ",\n".join(parts)


def _ways(name: str) -> str:
    """Per leaf the list of (left, right) up to its root."""
    joins, steps = [], []
    for k in range(LEVELS):
        a = f"u{k + 1}"
        joins.append(f"JOIN {name}{k + 1} {a} ON {a}.tree = n.tree AND {a}.place = n.place // {3 ** (k + 1)}")
        slot = f"(n.place // {3 ** k}) % 3"
        left = f"concat_ws('', CASE WHEN {slot} > 0 THEN {a}.s0 END, CASE WHEN {slot} > 1 THEN {a}.s1 END)"
        right = f"concat_ws('', CASE WHEN {slot} < 1 THEN {a}.s1 END, CASE WHEN {slot} < 2 THEN {a}.s2 END)"
        steps.append(f"CASE WHEN {a}.under > 1 THEN {{'l': {left}, 'r': {right}}} END")
    return (f"(SELECT n.tree, n.place, u{LEVELS}.hash AS root, list_filter([{', '.join(steps)}], lambda s: s IS NOT NULL) AS way "
            f"FROM {name}0 n {' '.join(joins)})")


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
_CHANGED = "sha256(" + " || ".join([*(_field(c) for c in ("doc_id", "source", "lang", "n_chars")), _field("replace(text, chr(10), '')")]) + ")"
_LEAVES = f"""leaves AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, {_LEAF} AS hash,
  CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_CHANGED} ELSE {_LEAF} END AS start,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents)"""

MANIFEST = f"""
WITH {_LEAVES}, {_climb('a', 'leaves')},
tops AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, hash, tree AS name FROM a{LEVELS}), {_climb('b', 'tops')},
ways AS MATERIALIZED (SELECT l.doc_id, l.hash AS leaf, w.root AS subroot, t.root, l.start, list_concat(w.way, t.way) AS way
  FROM leaves l JOIN {_ways('a')} w ON w.tree = l.tree AND w.place = l.place
  JOIN tops p ON p.name = l.tree JOIN {_ways('b')} t ON t.place = p.place),
folded AS (SELECT *, list_reduce(list_prepend(start, list_transform(way, lambda s: s.l || ',' || s.r)),
  lambda h, s: sha256(string_split(s, ',')[1] || h || string_split(s, ',')[2])) AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded"""

_RUN = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPELLING = f"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
hashed AS MATERIALIZED (SELECT word, n, {crc32("doc_id || ':' || word")} AS h FROM (SELECT doc_id, {_RUN} AS word, count(*) AS n FROM runs GROUP BY 1, 2)),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 97 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.rest UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.rest),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN
  (SELECT min(other) FROM near x WHERE x.word = w.word AND x.n = b.top) END AS form, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
ups AS (SELECT word, word AS at, form FROM formed UNION ALL SELECT u.word, f.word, f.form FROM ups u JOIN formed f ON f.word = u.form)
SELECT f.word, f.form, u.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN ups u ON u.word = f.word AND u.form IS NULL"""
