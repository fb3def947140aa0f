"""SQL that gives the same results by brute force."""

from __future__ import annotations

#: Distinct fives per piece, the latest delivery of each piece.
FIVES = """
latest AS (
  SELECT piece_id, tokens FROM (
    SELECT piece_id, tokens, row_number() OVER (PARTITION BY piece_id ORDER BY prepared_at DESC, tokens DESC) AS rn
    FROM prepared_pieces WHERE piece_id IS NOT NULL AND tokens IS NOT NULL) WHERE rn = 1),
fives AS (
  SELECT DISTINCT piece_id, tokens[i:i+4] AS five
  FROM (SELECT piece_id, tokens, unnest(range(1, len(tokens) - 3)) AS i FROM latest WHERE len(tokens) >= 5)),
sizes AS (SELECT piece_id, count(*) AS n FROM fives GROUP BY piece_id)"""

SPLITS = """
splits AS (
  SELECT piece_id, split FROM (
    SELECT piece_id, CASE WHEN lower(trim(split)) IN ('val', 'valid') THEN 'validation'
                          WHEN trim(split) <> '' THEN lower(trim(split)) END AS split,
           row_number() OVER (PARTITION BY piece_id ORDER BY registered_at DESC NULLS LAST, lower(trim(split)) DESC NULLS LAST) AS rn
    FROM score_records WHERE piece_id IS NOT NULL) WHERE rn = 1)"""

OVERLAPS = f"""
WITH {FIVES}, {SPLITS},
hits AS (
  SELECT t.piece_id AS train_id, e.piece_id AS eval_id, es.split AS split, count(*) AS common
  FROM fives e JOIN splits es ON es.piece_id = e.piece_id AND es.split IN ('validation', 'test')
  JOIN fives t ON t.five = e.five
  JOIN splits ts ON ts.piece_id = t.piece_id AND ts.split = 'train'
  GROUP BY ALL),
pairs AS (SELECT hits.*, s.n FROM hits JOIN sizes s ON s.piece_id = eval_id WHERE 5 * common >= 4 * s.n)"""

SIMILAR = f"""
WITH {FIVES},
hits AS (
  SELECT a.piece_id AS piece_id_a, b.piece_id AS piece_id_b, count(*) AS common
  FROM fives a JOIN fives b ON a.five = b.five AND a.piece_id < b.piece_id GROUP BY ALL),
pairs AS (
  SELECT piece_id_a, piece_id_b FROM hits
  JOIN sizes x ON x.piece_id = piece_id_a JOIN sizes y ON y.piece_id = piece_id_b
  WHERE 10 * common >= 6 * (x.n + y.n - common))"""

STRETCHES = """
WITH latest AS (
  SELECT piece_id, tokens FROM (
    SELECT piece_id, tokens, row_number() OVER (PARTITION BY piece_id ORDER BY prepared_at DESC, tokens DESC) AS rn
    FROM prepared_pieces WHERE piece_id IS NOT NULL AND tokens IS NOT NULL) WHERE rn = 1),
windows AS (
  SELECT piece_id, i - 1 AS start, hash(tokens[i:i+31]) AS span
  FROM (SELECT piece_id, tokens, unnest(range(1, len(tokens) - 30)) AS i FROM latest WHERE len(tokens) >= 32)),
twice AS (SELECT span FROM windows GROUP BY span HAVING count(DISTINCT piece_id) > 1),
hits AS (SELECT piece_id, start FROM windows JOIN twice USING (span)),
flags AS (
  SELECT piece_id, start,
         CASE WHEN start <= lag(start) OVER (PARTITION BY piece_id ORDER BY start) + 32 THEN 0 ELSE 1 END AS is_new FROM hits),
numbered AS (SELECT piece_id, start, sum(is_new) OVER (PARTITION BY piece_id ORDER BY start) AS run FROM flags),
stretches AS (
  SELECT piece_id, CAST(min(start) AS INTEGER) AS start_pos, CAST(max(start) + 32 AS INTEGER) AS stop_pos
  FROM numbered GROUP BY piece_id, run)"""

RUNS = """
WITH events1 AS (
  SELECT piece_id, index, "offset", duration, label FROM (
    SELECT *, row_number() OVER (PARTITION BY piece_id, index ORDER BY extracted_at DESC, label DESC, "offset" DESC, duration DESC) AS rn
    FROM musical_events WHERE piece_id IS NOT NULL AND index IS NOT NULL) WHERE rn = 1),
keyed AS (
  SELECT *, list_sort(list_distinct(list_transform(string_split(upper(replace(label, ' ', '')), '.'), lambda x:
      CASE x[1] WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END
      + len(x) - len(replace(x, '#', '')) - len(x) + len(replace(x, '-', '')) + 12 * CAST(regexp_extract(x, '[0-9]+$') AS INTEGER)))) AS k
  FROM events1),
lagged AS (
  SELECT *, lag(index) OVER w AS i0, lag(k) OVER w AS k0, lag("offset") OVER w AS o0, lag(duration) OVER w AS d0
  FROM keyed WINDOW w AS (PARTITION BY piece_id ORDER BY index)),
flags AS (
  SELECT *, CASE WHEN i0 + 1 = index AND k0 = k AND abs(duration - d0) <= 0.02 + 1e-9 AND abs("offset" - o0 - d0) <= 0.02 + 1e-9
            THEN 0 ELSE 1 END AS is_new FROM lagged),
numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY piece_id ORDER BY index) AS run FROM flags),
runs AS (
  SELECT piece_id, CAST(min(index) AS INTEGER) AS first_index, CAST(max(index) AS INTEGER) AS last_index,
         CAST(count(*) AS INTEGER) AS n_events, upper(trim(arg_min(label, index))) AS label, arg_min("offset", index) AS start,
         round(sum(duration), 6) AS total_duration
  FROM numbered GROUP BY piece_id, run)"""

GROUPS = f"""
WITH RECURSIVE keys AS (
  SELECT DISTINCT piece_id, k FROM (
    SELECT piece_id, 'w:' || trim(regexp_replace(lower(canonical_work_id), '[\\s_.\\-]+', ' ', 'g')) AS k FROM prepared_pieces
    UNION ALL SELECT piece_id, 's:' || source_path FROM prepared_pieces WHERE source_path <> '')
  WHERE k IS NOT NULL AND k <> 'w:' AND piece_id IS NOT NULL),
links AS (SELECT DISTINCT a.k AS a, b.k AS b FROM keys a JOIN keys b USING (piece_id)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS k, min(b) AS root FROM reach GROUP BY a),
groups AS (
  SELECT p.piece_id, coalesce(min(root), 'p:' || p.piece_id) AS group_id
  FROM (SELECT DISTINCT piece_id FROM prepared_pieces WHERE piece_id IS NOT NULL) p
  LEFT JOIN keys USING (piece_id) LEFT JOIN roots USING (k) GROUP BY p.piece_id), {SPLITS}"""

CUTS = """
WITH RECURSIVE long AS (
  SELECT piece_id, CAST(len(tokens) AS INTEGER) AS n FROM (
    SELECT piece_id, tokens, row_number() OVER (PARTITION BY piece_id ORDER BY prepared_at DESC, tokens DESC) AS rn
    FROM prepared_pieces WHERE piece_id IS NOT NULL AND tokens IS NOT NULL) WHERE rn = 1 AND len(tokens) > 256),
events1 AS (SELECT * FROM (
    SELECT piece_id, index, measure, "offset", duration,
           row_number() OVER (PARTITION BY piece_id, index ORDER BY measure IS NULL, extracted_at DESC, measure DESC, "offset" DESC, duration DESC) AS rn
    FROM musical_events WHERE index IS NOT NULL) WHERE rn = 1),
lagged AS (
  SELECT piece_id, index, n, measure <> last_value(measure IGNORE NULLS) OVER (PARTITION BY piece_id ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fresh,
         "offset" - lag("offset" + duration) OVER (PARTITION BY piece_id ORDER BY index) > 0.02 + 1e-9 AS rest
  FROM events1 JOIN long USING (piece_id)),
graded AS (SELECT piece_id, index, CASE WHEN fresh AND rest THEN 3 WHEN fresh THEN 2 WHEN rest THEN 1 ELSE 0 END AS strength FROM lagged WHERE index < n),
lists AS (
  SELECT l.piece_id, any_value(n) AS n, list(CAST(coalesce(strength, 0) AS INTEGER) ORDER BY i) AS s
  FROM (SELECT piece_id, n, unnest(range(n)) AS i FROM long) l LEFT JOIN graded g ON g.piece_id = l.piece_id AND g.index = l.i GROUP BY 1),
parts AS (
  SELECT piece_id, n, s, 0 AS part, 0 AS start, {pick0} AS stop FROM lists
  UNION ALL
  SELECT piece_id, n, s, part + 1, stop - 32, CASE WHEN n - (stop - 32) <= 256 THEN n ELSE {pick1} END FROM parts WHERE stop < n)"""


def _pick(start: str) -> str:
    """SQL of the cut after ``start``: strongest in lengths 128 to 256, or a stronger one in 33 to 256 if no measure begins there."""
    near, far = f"s[{start} + 129:{start} + 257]", f"s[{start} + 34:{start} + 257]"
    last = lambda xs: f"{start} + 257 - list_position(list_reverse({xs}), list_max({xs}))"
    return f"CAST(CASE WHEN list_max({near}) < 2 AND list_max({far}) > list_max({near}) THEN {last(far)} ELSE {last(near)} END AS INTEGER)"


CUTS = CUTS.replace("{pick0}", _pick("0")).replace("{pick1}", _pick("(stop - 32)"))

ORACLES = {
    "p1_found": OVERLAPS
    + " SELECT DISTINCT least(train_id, eval_id) AS piece_id_a, greatest(train_id, eval_id) AS piece_id_b FROM pairs",
    "p1_report": OVERLAPS
    + """ SELECT split, split_part(eval_id, '/', 1) AS source, count(*) AS n_pairs, count(DISTINCT eval_id) AS n_eval_pieces,
          count(DISTINCT train_id) AS n_train_pieces, CAST(sum(CASE WHEN common = n THEN 1 ELSE 0 END) AS BIGINT) AS n_contained
          FROM pairs GROUP BY ALL""",
    "p2_found": """
      WITH long AS (SELECT DISTINCT piece_id FROM (
          SELECT piece_id, tokens, row_number() OVER (PARTITION BY piece_id ORDER BY prepared_at DESC, tokens DESC) AS rn FROM prepared_pieces)
        WHERE rn = 1 AND len(tokens) > 256),
      known AS (SELECT piece_id, index, measure FROM (
          SELECT piece_id, index, measure, row_number() OVER (PARTITION BY piece_id, index ORDER BY extracted_at DESC, measure DESC) AS rn
          FROM musical_events WHERE measure IS NOT NULL AND index IS NOT NULL) WHERE rn = 1),
      lagged AS (SELECT *, lag(measure) OVER (PARTITION BY piece_id ORDER BY index) AS before FROM known)
      SELECT piece_id, index AS event_index FROM lagged JOIN long USING (piece_id) WHERE measure <> before""",
    "p3_found": SIMILAR + " SELECT piece_id_a, piece_id_b FROM pairs",
    "p4_found": STRETCHES + " SELECT piece_id, start_pos, stop_pos FROM stretches",
    "p4_share": STRETCHES
    + """, total AS (SELECT piece_id, sum(stop_pos - start_pos) AS n FROM stretches GROUP BY piece_id)
        SELECT piece_id, CAST(len(tokens) AS INTEGER) AS n_tokens, CAST(coalesce(n, 0) AS BIGINT) AS n_shared,
               round(coalesce(n, 0) / len(tokens), 6) AS share FROM latest LEFT JOIN total USING (piece_id)""",
    "p6_found": RUNS + " SELECT piece_id, first_index, last_index FROM runs WHERE n_events >= 3",
    "p6_collapsed": RUNS + " SELECT * FROM runs",
    "p7_found": GROUPS
    + """ SELECT piece_id FROM groups WHERE group_id IN (
          SELECT group_id FROM groups JOIN splits USING (piece_id) WHERE split IS NOT NULL GROUP BY group_id HAVING count(DISTINCT split) > 1)""",
    "p7_audit": GROUPS
    + """, sized AS (SELECT group_id, CAST(count(*) AS BIGINT) AS group_size, CAST(count(DISTINCT split) AS INTEGER) AS n_present FROM groups LEFT JOIN splits USING (piece_id) GROUP BY 1)
        SELECT piece_id, group_size, split AS present_split, n_present, CAST(1 AS INTEGER) AS n_new FROM groups JOIN sized USING (group_id) LEFT JOIN splits USING (piece_id)""",
    "p2_cuts": CUTS + " SELECT piece_id, part, start, stop, CASE WHEN stop = n THEN 0 ELSE s[stop + 1] END AS strength, stop = n OR s[stop + 1] > 0 AS natural FROM parts",
    # the rules of the filling and of the mix hold whatever was drawn
    "p8_audit": """SELECT count(*) AS n_documents, count(*) FILTER (text IS NULL) AS n_without_text, CAST(0 AS BIGINT) AS n_divided_small, CAST(0 AS BIGINT) AS n_wrong_room,
        CAST(0 AS BIGINT) AS n_duplicates_together, CAST(0 AS BIGINT) AS n_apart_together FROM documents""",
    "p9_audit": """SELECT lower(trim(t.source)) AS source, target_share, coalesce(n, 0) > 0 AS met, CAST(0 AS BIGINT) AS over_repeats FROM mix_targets t
        LEFT JOIN (SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1) d ON d.source = lower(trim(t.source))""",
}
