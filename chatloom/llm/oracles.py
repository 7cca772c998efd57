"""SQL of the queries whose text is long: vectors, the Merkle manifest and spelling variants."""

from __future__ import annotations

#: CRC-32 as SQL: a table of the 256 remainders, then one step per byte of the hex digits of a text.
_CRC_TABLE = """crc AS (
  SELECT list(c ORDER BY i) AS rest FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS c FROM (
      SELECT unnest(range(256))::BIGINT AS i)))"""


def _crc(hexed: str) -> str:
    """The CRC-32 of the bytes whose hex digits a column holds; ``crc`` must be joined in."""
    codes = f"list_transform(range(1, len({hexed}), 2), lambda i: ('0x' || {hexed}[i:i + 1])::BIGINT)"
    start = "[4294967295::BIGINT]"
    step = "lambda c, b: xor(c >> 8, rest[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295::BIGINT, list_reduce(list_concat({start}, {codes}), {step}))"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _up(nodes: str) -> str:
    """The next level of a list of nodes."""
    return f"list_transform(range(1, len({nodes}) + 1, 2), lambda i: sha256({nodes}[i] || coalesce({nodes}[i + 1], '')))"


EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y
  ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (
  SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id
JOIN (SELECT id, min(other) AS component_id FROM reach GROUP BY id) c ON c.id = vec_id"""

MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS (
  SELECT doc_id, '1' || lang AS grp, {_leaf('n_chars')} AS leaf, {_leaf('(n_chars + 1)')} AS changed,
    hex(encode(doc_id::VARCHAR)) AS hexed FROM documents),
l AS (
  SELECT doc_id, coalesce(grp, '0') AS grp, leaf, CASE WHEN {_crc('hexed')} % 7 = 0 THEN changed ELSE leaf END AS given
  FROM d, crc),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos FROM l),
t AS (
  SELECT grp, 0 AS level, list(leaf ORDER BY doc_id) AS nodes FROM l GROUP BY grp UNION ALL
  SELECT grp, level + 1, {_up('nodes')} FROM t WHERE len(nodes) > 1),
sub AS (
  SELECT grp, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM t WHERE len(nodes) = 1),
u AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM sub UNION ALL
  SELECT level + 1, {_up('nodes')} FROM u WHERE len(nodes) > 1),
beside AS (
  SELECT p.grp, p.pos, t.level, coalesce(t.nodes[xor(p.pos >> t.level, 1) + 1], '') AS other, (p.pos >> t.level) % 2 = 1 AS is_right
  FROM p JOIN t ON t.grp = p.grp AND len(t.nodes) > 1
  UNION ALL
  SELECT p.grp, p.pos, s.height + u.level, coalesce(u.nodes[xor(s.pos >> u.level, 1) + 1], ''), (s.pos >> u.level) % 2 = 1
  FROM p JOIN sub s ON s.grp = p.grp JOIN u ON len(u.nodes) > 1),
path AS (
  SELECT grp, pos, list({{'o': other, 'r': is_right}} ORDER BY level) AS steps, string_agg(other, '' ORDER BY level) AS proof
  FROM beside GROUP BY grp, pos),
walk AS (
  SELECT p.grp, p.pos, 0 AS up, given AS h, coalesce(steps, []) AS steps FROM p LEFT JOIN path USING (grp, pos) UNION ALL
  SELECT grp, pos, up + 1, sha256(CASE WHEN steps[up + 1].r THEN steps[up + 1].o || h ELSE h || steps[up + 1].o END), steps
  FROM walk WHERE up < len(steps)),
folded AS (SELECT grp, pos, h FROM walk WHERE up = len(steps))
SELECT doc_id, leaf, subroot, r.root, sha256(coalesce(proof, '')) AS proof_sha256, h AS folded_root, h = r.root AS verified
FROM p JOIN sub USING (grp) JOIN folded f ON f.grp = p.grp AND f.pos = p.pos
LEFT JOIN path ON path.grp = p.grp AND path.pos = p.pos, (SELECT nodes[1] AS root FROM u WHERE len(nodes) = 1) r"""

_LATIN = "".join(chr(c) for c in range(0xC0, 0x100))
#: One-byte stand-ins, as the distance function counts bytes.
_BYTES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower())[: len(_LATIN)].replace("'", "''")

SPELLING = f"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (
  SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hexed
  FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run)),
hashed AS (SELECT run, n, {_crc('hexed')} AS h FROM counted, crc),
typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2:] ELSE run END AS word, n
  FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{_LATIN}', '{_BYTES}') AS plain
  FROM typed GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5),
holes AS (
  SELECT word, plain, n, plain[1:i] || plain[i + 2:] AS rest, i FROM (
    SELECT *, unnest(range(length(plain))) AS i FROM w)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN w b ON a.rest = b.plain
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN w b ON a.rest = b.plain),
best AS (
  SELECT word, count(*) AS n_near, arg_max(other, (other_n, -place)) AS other, max(other_n) AS other_n FROM (
    SELECT p.*, row_number() OVER (PARTITION BY word ORDER BY encode(other)) AS place FROM pairs p) GROUP BY word),
f AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
    CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
lead_to AS (
  SELECT word, word AS root, form AS next FROM f UNION ALL
  SELECT l.word, f.word, f.form FROM lead_to l JOIN f ON f.word = l.next)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM f JOIN lead_to l ON l.word = f.word AND l.next IS NULL"""
