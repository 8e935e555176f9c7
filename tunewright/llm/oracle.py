"""DuckDB SQL with the same results as this package's queries, where SQL can do it on whole tables.

DuckDB's edit distance counts bytes, and events have more values than a byte, so p2 and p3 are tested against brute force.
"""

SQUEEZE = r"regexp_replace(lower({0}), '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{3000}}\x{{85}}]+', '', 'g')"

EV = """
ev AS (
  SELECT rec_no, source, split, batch_no, bpm, i - 1 AS pos, e.pitch AS pitch, e.duration AS duration, coalesce(e.dotted, false) AS dotted,
         CAST(floor(floor(128 / e.duration) * (CASE WHEN e.dotted THEN 3 ELSE 2 END) / 2) AS INT) AS ticks
  FROM (SELECT rec_no, source, split, batch_no, bpm, unnest(events) AS e, generate_subscripts(events, 1) AS i FROM songs)),
me AS (
  SELECT rec_no, any_value(source) AS source, any_value(split) AS split, any_value(batch_no) AS batch_no, any_value(bpm) AS bpm, count(*) AS n,
         string_agg(chr(CAST(20000 + (coalesce(pitch - 59, 0) * 6 + log2(duration)) * 2 + CAST(dotted AS INT) AS INT)), '' ORDER BY pos) AS mel
  FROM ev GROUP BY rec_no)"""

RECORDS = rf"""
re AS (
  SELECT rec_no, string_split(raw, ':') AS p FROM manifest WHERE kind = 'rtttl' AND raw LIKE '%:%:%'),
fo AS (
  SELECT rec_no, regexp_replace(lower(array_to_string(p[:-3], '')), '[^\p{{L}}\p{{N}}]', '', 'g') AS name,
         list_sort(list_filter(string_split({SQUEEZE.format("p[-2]")}, ','), lambda x: x <> '')) AS settings,
         regexp_replace({SQUEEZE.format("p[-1]")}, ',+$', '') AS notes FROM re),
ke AS (
  SELECT rec_no, concat_ws(chr(31), name, array_to_string(settings, chr(30)),
         array_to_string(list_transform(string_split(notes, ','), lambda x: replace(x, '.', '') || repeat('.', len(x) - len(replace(x, '.', '')))), ',')) AS k FROM fo WHERE notes <> ''),
gr AS (SELECT rec_no, min(rec_no) OVER (PARTITION BY k) AS keep_no, count(*) OVER (PARTITION BY k) AS copies FROM ke)"""

WINDOWS = """
wi AS (SELECT DISTINCT rec_no, substr(mel, CAST(pl AS BIGINT), 24) AS w FROM (SELECT rec_no, mel, unnest(range(1, n - 22)) AS pl FROM me WHERE n >= 24))"""

WORDS = r"""
wo AS (SELECT id, side, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (
  SELECT doc_id AS id, 'd' AS side, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents UNION ALL SELECT item_id, 'e', regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items)),
gr AS (SELECT id, side, i, string_agg(w, ' ') OVER (PARTITION BY side, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS g, count(*) OVER (PARTITION BY side, id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS k FROM wo),
di AS (SELECT DISTINCT id, side, g FROM gr WHERE k = 12)"""

COVERAGE = """
pw AS (SELECT rec_no, pl, substr(mel, CAST(pl AS BIGINT), 24) AS w FROM (SELECT rec_no, mel, unnest(range(1, n - 22)) AS pl FROM me WHERE n >= 24)),
sh AS (SELECT w FROM pw GROUP BY w HAVING count(DISTINCT rec_no) > 1),
co AS (SELECT rec_no, count(DISTINCT p) AS shared FROM (SELECT rec_no, unnest(range(pl, pl + 24)) AS p FROM pw WHERE w IN (SELECT w FROM sh)) GROUP BY rec_no)
SELECT rec_no, CASE WHEN n >= 24 THEN min(rec_no) OVER (PARTITION BY mel) ELSE rec_no END AS same_as, n AS events, coalesce(shared, 0) AS shared, coalesce(shared, 0) / n AS share FROM me LEFT JOIN co USING (rec_no)"""

SPANS = """
re AS (SELECT min(rec_no) AS rec, mel, any_value(n) AS n FROM me WHERE n >= 24 GROUP BY mel),
pw AS (SELECT rec, pl, substr(mel, CAST(pl AS BIGINT), 24) AS w FROM (SELECT rec, mel, unnest(range(1, n - 22)) AS pl FROM re)),
pr AS (SELECT a.rec AS a, b.rec AS b, a.pl AS x, b.pl AS y, a.pl - row_number() OVER (PARTITION BY a.rec, b.rec, a.pl - b.pl ORDER BY a.pl) AS island FROM pw a JOIN pw b ON a.w = b.w AND a.rec < b.rec)
SELECT a AS rec_a, CAST(min(x) - 1 AS INT) AS at_a, b AS rec_b, CAST(min(y) - 1 AS INT) AS at_b, count(*) + 23 AS span FROM pr GROUP BY a, b, x - y, island"""

LEAKED = """
hi AS (SELECT DISTINCT d.id AS doc, e.id AS item, d.i FROM gr d JOIN di e USING (g) WHERE d.side = 'd' AND d.k = 12 AND e.side = 'e'),
rn AS (SELECT doc, item, count(*) + 11 AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc, item ORDER BY i) AS island FROM hi) GROUP BY doc, item, island),
pe AS (SELECT doc, item, max(words) AS longest, sum(words) AS words FROM rn GROUP BY doc, item),
si AS (SELECT id, count(*) AS doc_words FROM wo WHERE side = 'd' GROUP BY id)
SELECT item AS item_id, split, count(*) AS documents, max(longest) AS longest, max(words / doc_words) AS coverage FROM pe JOIN si ON si.id = doc JOIN eval_items ON item_id = item GROUP BY item, split"""

GROUPS = """
nf AS (
  SELECT rec_no, any_value(source) AS source, string_agg(coalesce(CAST(pitch - f AS VARCHAR), 'r') || '/' || (ticks // u), ',' ORDER BY pos) AS k
  FROM ev JOIN (SELECT rec_no, arg_min(pitch, pos) FILTER (WHERE pitch IS NOT NULL) AS f, min(ticks & -ticks) * (CASE WHEN bool_and(ticks % 3 = 0) THEN 3 ELSE 1 END) AS u FROM ev GROUP BY rec_no) USING (rec_no) GROUP BY rec_no),
he AS (SELECT source, min(rec_no) AS head FROM songs GROUP BY source),
li AS (SELECT DISTINCT a.source AS s, b.source AS t FROM (SELECT DISTINCT source, k FROM nf) a JOIN (SELECT DISTINCT source, k FROM nf) b USING (k)),
cl(s, t) AS (SELECT s, t FROM li UNION SELECT cl.s, li.t FROM cl JOIN li ON cl.t = li.s),
co AS (SELECT s AS source, min(head) AS group_no, count(DISTINCT t) AS sources FROM cl JOIN he ON he.source = t GROUP BY s)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {RECORDS} SELECT keep_no, rec_no FROM gr WHERE rec_no <> keep_no",
        "p1_records": f"WITH {RECORDS} SELECT rec_no, copies FROM gr WHERE rec_no = keep_no",
        "p4_found": f"WITH {EV}, {WINDOWS} SELECT DISTINCT a.rec_no AS rec_a, b.rec_no AS rec_b FROM wi a JOIN wi b ON a.w = b.w AND a.rec_no < b.rec_no",
        "p4_coverage": f"WITH {EV}, {COVERAGE}",
        "p4_spans": f"WITH {EV}, {SPANS}",
        "p8_items": f"WITH {WORDS}, {LEAKED}",
        "p5_found": f"WITH RECURSIVE {EV}, {GROUPS} SELECT rec_no, group_no FROM songs JOIN co USING (source) WHERE sources > 1",
        "p8_found": f"WITH {WORDS} SELECT DISTINCT a.id AS doc_id, b.id AS item_id FROM di a JOIN di b USING (g) WHERE a.side = 'd' AND b.side = 'e'",
    }
