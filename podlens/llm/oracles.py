"""SQL for the queries whose rows SQL can express."""

from __future__ import annotations

from podlens.llm.license_scan import EQUIVALENT_WORDS, KNOWN_LICENSES

ORACLES: dict[str, str] = {}

# Words are runs of other than the six ASCII white-space characters. A window is known by its words.
ORACLES["op5_fm_index_dedup"] = r"""
WITH words AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), starts AS (
    SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM words WHERE len(w) >= 13
), windows AS (
    SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM starts
), firsts AS (
    SELECT k, min(doc_id) AS first_doc FROM windows GROUP BY k HAVING count(*) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
    FROM windows JOIN firsts USING (k) WHERE first_doc < doc_id
), lost AS (
    SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
    sha256(array_to_string(CASE WHEN places IS NULL THEN w
        ELSE [x FOR x, i IN w IF NOT list_contains(places, i)] END, ' ')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelled(form: str) -> str:
    for variant, usual in EQUIVALENT_WORDS.items():
        form = f"replace({form}, ' {variant} ', ' {usual} ')"
    return form


# Licences and documents are brought to the canonical form side by side.
ORACLES["op8_license_digests"] = rf"""
WITH raw AS (
    SELECT doc_id, NULL AS license_id, coalesce(text, '') AS text FROM documents
    UNION ALL
    SELECT NULL, * FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in KNOWN_LICENSES.items())})
), plain AS (
    SELECT doc_id, license_id, regexp_replace(regexp_replace(lower(text),
        '(^|\n)[ \t]*(copyright|©|\(c\))[^\n]*', chr(10), 'g'),
        '(^|\n)[ \t]*all rights reserved\.?[ \t]*(\n|$)', chr(10), 'g') AS t FROM raw
), forms AS (
    SELECT doc_id, license_id, ' ' || regexp_replace(regexp_replace(t,
        '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), ' ?\n[ \n]*', ' ' || chr(10) || ' ', 'g') || ' ' AS f FROM plain
), spelled AS (
    SELECT doc_id, license_id, {_spelled("f")} AS f FROM forms
), digests AS (
    SELECT doc_id, license_id, sha256(trim(replace(f, ' ' || chr(10) || ' ', ' '))) AS digest,
        [sha256(trim(x)) FOR x IN string_split(f, chr(10)) IF trim(x) <> ''] AS lines FROM spelled
), known AS (
    SELECT digest, min(license_id) AS license_id FROM digests
    WHERE license_id IS NOT NULL AND digest <> sha256('') GROUP BY digest
)
SELECT d.doc_id, d.digest, k.license_id,
    (SELECT coalesce(list_sort(list(DISTINCT known.license_id)), []) FROM known WHERE list_contains(d.lines, known.digest))
        AS line_licenses
FROM digests d LEFT JOIN known k USING (digest) WHERE d.license_id IS NULL
"""

# The checksum of the decimal id, bit by bit; the tree and the way up as recursions over the levels.
ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE checks AS (
    SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1]
        FOR c IN string_split(doc_id::VARCHAR, '')])),
        lambda acc, x: xor(xor(acc, greatest(x, 0)) >> 1,
            CASE WHEN xor(acc, greatest(x, 0)) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS flipped FROM documents
), sized AS (
    SELECT *, CASE WHEN xor(flipped, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_tampered,
        coalesce('+' || lang, '') AS tree FROM checks
), parts AS (
    SELECT doc_id, tree, FIELD(doc_id) || FIELD(source) || FIELD(lang) AS head,
        FIELD(n_chars) AS own, FIELD(n_tampered) AS other, FIELD(text) AS tail FROM sized
), leaves AS (
    SELECT doc_id, tree, sha256(head || own || tail) AS leaf, sha256(head || other || tail) AS tampered FROM parts
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
), nodes AS (
    SELECT tree, 0 AS level, place, leaf AS digest FROM numbered
    UNION ALL
    SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, place // 2
), heights AS (
    SELECT tree, max(level) AS height, arg_max(digest, level) AS subroot FROM nodes GROUP BY tree
), tops AS (
    SELECT 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS place, subroot AS digest FROM heights
    UNION ALL
    SELECT level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, place // 2
), top AS (
    SELECT max(level) AS height, arg_max(digest, level) AS root FROM tops
), tree_places AS (
    SELECT tree, height, subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM heights
), steps AS (
    SELECT n.doc_id, n.tree, n.place AS leaf_place, x.level, x.place AS at, xor(n.place >> x.level, 1) AS beside
    FROM numbered n JOIN heights h USING (tree), (SELECT DISTINCT level, 0 AS place FROM nodes) x WHERE x.level < h.height
), beside AS (
    SELECT s.tree, s.leaf_place, s.level, n.digest,
        (s.leaf_place >> s.level) & 1 = 1 AS is_right
    FROM steps s LEFT JOIN nodes n ON n.tree = s.tree AND n.level = s.level AND n.place = s.beside
    UNION ALL
    SELECT n.tree, n.place, h.height + x.level, t.digest, (h.place >> x.level) & 1 = 1
    FROM numbered n JOIN tree_places h USING (tree), (SELECT DISTINCT level FROM tops) x, top
    LEFT JOIN tops t ON t.level = x.level AND t.place = xor(h.place >> x.level, 1)
    WHERE x.level < top.height
), paths AS (
    SELECT tree, leaf_place, list({'digest': coalesce(digest, ''), 'is_right': is_right} ORDER BY level) AS path
    FROM beside GROUP BY tree, leaf_place
), folded AS (
    SELECT tree, place, 0 AS level, tampered AS known FROM numbered
    UNION ALL
    SELECT f.tree, f.place, f.level + 1, sha256(CASE WHEN p.path[f.level + 1].is_right
        THEN p.path[f.level + 1].digest || known ELSE known || p.path[f.level + 1].digest END)
    FROM folded f JOIN paths p ON p.tree = f.tree AND p.leaf_place = f.place WHERE f.level < len(p.path)
), ends AS (
    SELECT tree, place, arg_max(known, level) AS folded_root FROM folded GROUP BY tree, place
)
SELECT n.doc_id, n.leaf, h.subroot, top.root,
    sha256(coalesce(array_to_string([s.digest FOR s IN p.path], ''), '')) AS proof_sha256,
    e.folded_root, e.folded_root = top.root AS verified
FROM numbered n JOIN heights h USING (tree) JOIN ends e ON e.tree = n.tree AND e.place = n.place
LEFT JOIN paths p ON p.tree = n.tree AND p.leaf_place = n.place, top
"""
for _name in ("doc_id", "source", "lang", "n_chars", "n_tampered", "text"):
    ORACLES["op12_merkle_manifest"] = ORACLES["op12_merkle_manifest"].replace(
        f"FIELD({_name})", f"coalesce(strlen({_name}::VARCHAR) || ':' || {_name}, '-')"
    )

_SECRETS = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
        r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 1),
    ("forge_token", "gh[opsru]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat_token", "xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("cloud_key", "AIza[0-9A-Za-z_-]{35}", 0, 1),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("url_password", r"[a-z]{2,12}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{1,64}@", 0, 1),
)


def _found(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches lie behind the pieces of a split, so sums of lengths tell where each is."""
    re = _quoted(pattern)
    return f"""SELECT doc, {place} AS place, '{kind}' AS kind, gap + len AS step, len, named, i FROM (
        SELECT doc, unnest(range(1, len(w) + 1)) AS i, length(p[i]) AS gap, length(w[i]) AS len, length(g[i]) >= {least} AS named
        FROM (SELECT doc, string_split_regex(t, {re}) AS p, regexp_extract_all(t, {re}) AS w,
            regexp_extract_all(t, {re}, {group}) AS g FROM docs))"""


ORACLES["op13_blob_ledger"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents
), matches AS (
    {" UNION ALL ".join(_found(i, *rule) for i, rule in enumerate(_SECRETS))}
), placed AS (
    SELECT *, sum(step) OVER (PARTITION BY doc, place ORDER BY i) AS stop FROM matches
), spans AS (
    SELECT doc, place, kind, (stop - len)::BIGINT AS start, kind || ':' || (stop - len)::BIGINT || ':' || stop::BIGINT AS span
    FROM placed WHERE named
), found AS (
    SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base,
        string_agg(span, ',' ORDER BY start, place) AS spans FROM spans GROUP BY doc
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN found USING (doc)
"""
