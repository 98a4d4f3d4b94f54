"""SQL (DuckDB) of the queries that SQL can express: substring dedup, near-duplicates, mixing,
conversation repair and hard negatives."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM windows GROUP BY k),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (k) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, range(50) AS r(j)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(k) AS n FROM d LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingles AS a JOIN shingles AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM met JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.doc_id)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(concat_ws('|', '7', doc_id)) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
weighed AS (
  SELECT source, source_size, (2 * source_size)::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5::DOUBLE WHEN 1 THEN 2::DOUBLE ELSE 1::DOUBLE END AS weight
  FROM s),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
leveled AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS common FROM levels),
targets AS (SELECT source, source_size, least(cap, coalesce(common * weight, cap)) AS target FROM leveled),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT d.*, r.source_size, r.target, r.epochs, floor(r.target + 0.5)::BIGINT - r.epochs * r.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN rates AS r ON r.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM placed
"""

_STATE = "STRUCT(c BIGINT, e VARCHAR, t VARCHAR[])"


def _edit(state: str, cost: str, letter: str, line: str) -> str:
    """``state`` after one more edit; null where it cannot be reached."""
    lines = f"{state}.t" if not line else f"list_append({state}.t, {line})"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'e': {state}.e || '{letter}', 't': {lines}}} END"


def _inserted(s: str) -> str:
    """States u0 to u3 after insertions before a row, or at the end."""
    user = [_edit(f"{s}{i}", "2", "I", "'user:'") for i in (0, 1, 3)]
    again = [f"CASE WHEN {s}{i} IS NOT NULL THEN {{'c': {s}{i}.c + 4, 'e': {s}{i}.e || 'II', "
             f"'t': list_concat({s}{i}.t, ['user:', 'assistant:'])}} END" for i in (0, 1)]
    return (f"{s}0 AS u0, {s}1 AS u1, least({s}2, {', '.join(user)}) AS u2, "
            f"least({s}3, {_edit(f'{s}2', '2', 'I', repr('assistant:'))}, {', '.join(again)}) AS u3")


def _moved() -> str:
    """States s0 to s3 after a row."""
    gone = [_edit(f"u{i}", "3", "D", "") for i in range(4)]
    kept = {i: _edit(f"u{i}", "(fault = 't')::BIGINT", "K", "role || ':' || text") for i in range(4)}
    other = {i: _edit(f"u{i}", "2 + (fault = 't')::BIGINT", "R", f"'{'assistant' if i == 2 else 'user'}:' || text") for i in range(4)}

    def may(ways: dict[int, str], at: tuple[int, ...], test: str) -> list[str]:
        return [f"CASE WHEN fault IN ('k', 't') AND {test} THEN {ways[i]} END" for i in at]

    return ", ".join([
        f"{gone[0]} AS s0",
        f"least({gone[1]}, {', '.join(may(kept, (0,), "role LIKE 's%'"))}) AS s1",
        f"least({gone[2]}, {', '.join(may(kept, (0, 1, 3), "role LIKE 'u%'") + may(other, (0, 1, 3), 'true'))}) AS s2",
        f"least({gone[3]}, {', '.join(may(kept, (2,), "role LIKE 'a%'") + may(other, (2,), 'true'))}) AS s3"])


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
sums AS (
  SELECT k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
      string_split(k, ''), lambda ch: [ord(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384) ELSE xor(c, b) // 2 END)) % 20 AS kind
  FROM (SELECT DISTINCT k FROM keyed)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM keyed JOIN sums USING (k) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM damaged)),
rows AS (
  SELECT conv_id, turn, role, text, i, CASE
      WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
      WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE 'k' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (i > 1 AND before[1] || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id),
ways(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0, 'e': '', 't': []}}::{_STATE}, NULL::{_STATE}, NULL::{_STATE}, NULL::{_STATE} FROM counts
  UNION ALL
  SELECT conv_id, i, {_moved()}
  FROM (SELECT w.conv_id, r.i, r.role, r.text, r.fault, {_inserted("w.s")}
        FROM ways AS w JOIN rows AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)),
ended AS (
  SELECT conv_id, i, least(u0, u3) AS best FROM (SELECT w.conv_id, w.i, {_inserted("w.s")} FROM ways AS w)),
solved AS (
  SELECT counts.*, best FROM ended JOIN counts ON ended.conv_id IS NOT DISTINCT FROM counts.conv_id AND ended.i = counts.n)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM c.conv_id
"""

HARD_NEGATIVES = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r AS a JOIN r AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10
"""

ORACLES: dict[str, str] = {
    "op4_substring_dedup": SUBSTRING_DEDUP,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op9_mixing": MIXING,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op13_hard_negatives": HARD_NEGATIVES,
}
