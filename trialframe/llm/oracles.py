"""SQL that says the whole result of an operator's query, for DuckDB."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

EMBEDDINGS = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
 reach(v, w) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT v, b FROM reach JOIN links ON w = a),
 root AS (SELECT v, min(w) AS component_id FROM reach GROUP BY v), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN root ON vec_id = v LEFT JOIN n ON vec_id = a"""

WARC = """WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
 f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM d JOIN f USING (payload_digest)"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

LEXICAL = f"""WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents WHERE text IS NOT NULL),
 p AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS word FROM d) GROUP BY doc_id, word),
 lengths AS (SELECT doc_id, len(words) AS n FROM d WHERE len(words) > 0),
 whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
 weights AS (SELECT word, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, whole GROUP BY word, docs),
 i AS (SELECT DISTINCT item_id, unnest({WORDS}) AS word FROM benchmark),
 s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM i JOIN p USING (word) JOIN weights USING (word) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""


def _best(*ways: str) -> str:
    """The way of the least cost, then of the least letters."""
    return f"list_sort([{', '.join(ways)}])[1]"


def _edit(state: str, cost: str, letter: str, line: str | None, when: str = "true") -> str:
    """A way that goes on from a state's best one: its cost, its letters and the lines it leaves."""
    lines = f"{state}.t" if line is None else f"list_append({state}.t, {line})"
    return f"{{'c': {state}.c + CASE WHEN {when} THEN {cost} ELSE 1000000 END, 'a': {state}.a || '{letter}', 't': {lines}}}"


def _repair() -> str:
    # states: 0 nothing yet, 1 after s, 2 after u, 3 after a; the best way to each is kept, row by row
    own, keep, rerole, stays = "d.role || ':' || d.text", "d.cut", "3 + d.cut", "NOT d.gone"
    drop = lambda q: _edit(f"p.s{q}", "4", "D", None)
    kept = lambda q, letter: _edit(f"p.s{q}", keep, "K", own, f"{stays} AND d.i = '{letter}'")
    given = lambda q, role: _edit(f"p.s{q}", rerole, "R", f"'{role}:' || d.text", stays)
    before_u = (0, 1, 3)
    n2 = _best(drop(2), *(kept(q, "u") for q in before_u), *(given(q, "user") for q in before_u))
    n3 = _best(drop(3), kept(2, "a"), given(2, "assistant"))
    into = lambda x, role: _edit(x, "3", "I", f"'{role}:'")
    return rf"""WITH RECURSIVE known AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT),
   lambda crc, b: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, b)), 4294967295) AS crc FROM conversations),
 cases AS (SELECT *, xor(crc, 4294967295) % 20 AS k FROM known),
 rows_ AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM cases WHERE k <> 0),
 marked AS (SELECT *, left(role, 1) AS i, row_number() OVER o AS pos, count(*) OVER (PARTITION BY conv_id) AS n, lag(left(role, 1)) OVER o AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open_ FROM rows_
  WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
 d AS (SELECT *, blank OR again AS gone, CASE WHEN NOT blank AND NOT again AND open_ THEN 3 ELSE 0 END AS cut FROM marked),
 p(conv_id, pos, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}}, {{'c': 1000000::BIGINT, 'a': '', 't': []::VARCHAR[]}}, {{'c': 3::BIGINT, 'a': 'I', 't': ['user:']}}, {{'c': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} FROM d
  UNION ALL SELECT conv_id, pos, s0, s1, s2, {_best('s3', into('s2', 'assistant'))} FROM (SELECT conv_id, pos, s0, s1, s3, {_best('s2', into('s0', 'user'), into('s1', 'user'), into('s3', 'user'))} AS s2 FROM (
   SELECT p.conv_id, d.pos, {drop(0)} AS s0, {_best(drop(1), kept(0, 's'))} AS s1, {n2} AS s2, {n3} AS s3 FROM p JOIN d ON d.conv_id IS NOT DISTINCT FROM p.conv_id AND d.pos = p.pos + 1))),
 ends AS (SELECT p.conv_id, {_best('s0', 's3')} AS e FROM p JOIN (SELECT conv_id, max(pos) AS n FROM d GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND p.pos = m.n),
 counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE cut = 3) AS truncated, count(*) FILTER (WHERE pos > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM d GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


#: By query; the other operators are held against brute force in tests/llm.
ORACLES: dict[str, str] = {"op4_embeddings": EMBEDDINGS, "op10_warc": WARC, "op11_repair": _repair(), "op12_top_k": TOP_K, "op13_lexical": LEXICAL}
