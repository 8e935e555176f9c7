"""Queries on duplicates, families, splits and nearest songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.functions import music
from tunewright.functions.transitions import spelled, with_transitions
from tunewright.operators import dedup, similarity
from tunewright.plans.corpus import Query, on, table
from tunewright.plans.melodies import EV
from tunewright.shared import materialize

TR = f"""{EV},
sp AS (SELECT *, last_value(pitch IGNORE NULLS) OVER (PARTITION BY rec_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
              coalesce(lag(ticks) OVER (PARTITION BY rec_no ORDER BY pos), ticks) AS before FROM ev),
tr AS (SELECT rec_no, bpm, split, pos, CASE WHEN pitch IS NULL THEN 'REST' WHEN prev IS NULL THEN 'START' ELSE CAST(pitch - prev AS VARCHAR) END AS iv,
              (ticks // gcd(ticks, before)) || '/' || (before // gcd(ticks, before)) AS ra FROM sp),
tk AS (SELECT *, iv || '/' || ra AS tok FROM tr),
nf AS (
  SELECT rec_no, sha256('[' || string_agg('[' || coalesce(CAST(pitch - first AS VARCHAR), 'null') || ',' || CAST(ticks // unit AS VARCHAR) || ']', ',' ORDER BY pos) || ']') AS family,
         md5(string_agg(concat_ws('/', coalesce(CAST(pitch AS VARCHAR), 'r'), duration, dotted), ',' ORDER BY pos)) AS melody, min(bpm) AS bpm, min(split) AS split
  FROM ev JOIN (SELECT rec_no, arg_min(pitch, pos) FILTER (WHERE pitch IS NOT NULL) AS first, min(ticks & -ticks) * (CASE WHEN bool_and(ticks % 3 = 0) THEN 3 ELSE 1 END) AS unit FROM ev GROUP BY rec_no) USING (rec_no)
  GROUP BY rec_no)"""


def _transitions(songs: DataFrame) -> DataFrame:
    made = with_transitions(songs, "rec_no")
    return made.select("rec_no", F.array_join(F.transform("tokens", spelled), " ").alias("tokens"))


def _exact(songs: DataFrame) -> DataFrame:
    return dedup.exact_duplicates(songs)


def _exact_docs(documents: DataFrame) -> DataFrame:
    """Copies of whole texts, the smallest doc_id kept. Null texts are no copies of each other and don't appear."""
    keyed = documents.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("ka"), F.xxhash64(F.lit(1), "text").alias("kb"))
    several = keyed.groupBy("ka", "kb").agg(F.min("doc_id").alias("retained"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return keyed.join(materialize(several, "doc_copies"), ["ka", "kb"]).select("doc_id", "retained", "copies")


def _pairs(songs: DataFrame) -> DataFrame:
    return dedup.near_candidates(dedup.representatives(songs))


def _verified(songs: DataFrame) -> DataFrame:
    return dedup.near_verified(dedup.representatives(songs))


_PAIRS = f"""
    WITH {TR}, rp AS (SELECT family, min(rec_no) AS rec_no FROM nf GROUP BY family),
    el AS (SELECT rp.rec_no, any_value(family) AS family, count(*) AS n FROM rp JOIN tk USING (rec_no) GROUP BY rp.rec_no HAVING count(*) >= 12 AND count(DISTINCT tok) >= 4),
    sh AS (SELECT DISTINCT rec_no, g FROM (SELECT rec_no, tok || ' ' || lead(tok, 1) OVER w || ' ' || lead(tok, 2) OVER w || ' ' || lead(tok, 3) OVER w AS g FROM tk WHERE rec_no IN (SELECT rec_no FROM el) WINDOW w AS (PARTITION BY rec_no ORDER BY pos)) WHERE g IS NOT NULL),
    sz AS (SELECT rec_no, count(*) AS k FROM sh GROUP BY rec_no),
    ov AS (SELECT x.rec_no AS a, y.rec_no AS b, count(*) AS common FROM sh x JOIN sh y ON x.g = y.g JOIN el ea ON ea.rec_no = x.rec_no JOIN el eb ON eb.rec_no = y.rec_no WHERE ea.family < eb.family GROUP BY x.rec_no, y.rec_no)
    SELECT a, b, common, common / (sa.k + sb.k - common) AS jaccard FROM ov JOIN sz sa ON sa.rec_no = a JOIN sz sb ON sb.rec_no = b JOIN el ea ON ea.rec_no = a JOIN el eb ON eb.rec_no = b
    WHERE least(ea.n, eb.n) / greatest(ea.n, eb.n) >= 0.65 AND common / (sa.k + sb.k - common) >= 0.45"""


def _by_fingerprint(songs: DataFrame) -> DataFrame:
    return songs.select("rec_no", music.family_fingerprint(F.col("events")).alias("family_id"))


def _invariant_split(songs: DataFrame) -> DataFrame:
    """The split by fingerprint alone, which SQL can follow."""
    return dedup.family_split(_by_fingerprint(songs))


_INVARIANT_SPLIT = f"""
    WITH {TR}, f AS (SELECT family AS family_id, count(*) AS size FROM nf GROUP BY family),
    c AS (SELECT *, coalesce(sum(size) OVER (ORDER BY md5('42:' || family_id), family_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS mid, sum(size) OVER () AS total FROM f)
    SELECT family_id, size, CASE WHEN mid < total * 0.8 THEN 'train' WHEN mid < total * 0.8 + total * 0.1 THEN 'validation' ELSE 'test' END AS split FROM c"""


def _family_split(songs: DataFrame) -> DataFrame:
    placed = dedup.family_split(dedup.families(songs))
    return placed.groupBy("split").agg(F.count(F.lit(1)).alias("families"), F.sum("size").alias("songs"))


def _leakage(songs: DataFrame, near: bool = False) -> DataFrame:
    return dedup.leakage(songs, near).groupBy("kind", "splits").agg(F.count(F.lit(1)).alias("keys"), F.sum("songs").alias("songs"))


_LEAKAGE = f"""
    WITH {TR}, k AS (SELECT 'exact' AS kind, melody AS key, split FROM nf WHERE split IS NOT NULL UNION ALL SELECT 'invariant', family, split FROM nf WHERE split IS NOT NULL),
    g AS (SELECT kind, key, count(DISTINCT split) AS splits, count(*) AS songs FROM k GROUP BY kind, key HAVING count(DISTINCT split) > 1)
    SELECT kind, splits, count(*) AS keys, CAST(sum(songs) AS BIGINT) AS songs FROM g GROUP BY kind, splits"""


def _family_leakage(songs: DataFrame) -> DataFrame:
    """All three keys: exact, invariant and family."""
    return _leakage(songs, True)


def _nearest_training(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth number asks for its nearest song among all training songs but itself."""
    songs = table(spark, folder, "songs")
    made = similarity.nearest(songs.where("rec_no % 20 = 0"), songs.where("split = 'train'"), own=False)
    return made.drop("closest_name", "same_bpm")


_NEAREST = f"""
    WITH {TR},
    w3 AS (SELECT rec_no, pos, count(*) OVER (PARTITION BY rec_no) AS n, tok || ' ' || lead(tok, 1) OVER w || ' ' || lead(tok, 2) OVER w AS j, iv || ' ' || lead(iv, 1) OVER w || ' ' || lead(iv, 2) OVER w AS p, ra || ' ' || lead(ra, 1) OVER w || ' ' || lead(ra, 2) OVER w AS r FROM tk WINDOW w AS (PARTITION BY rec_no ORDER BY pos)),
    ft AS (SELECT DISTINCT rec_no, 'joint' AS kind, j AS g FROM w3 WHERE j IS NOT NULL UNION SELECT rec_no, 'pitch', p FROM w3 WHERE p IS NOT NULL UNION SELECT rec_no, 'rhythm', r FROM w3 WHERE r IS NOT NULL),
    sz AS (SELECT rec_no, count(*) FILTER (WHERE kind = 'joint') AS j, count(*) FILTER (WHERE kind = 'pitch') AS p, count(*) FILTER (WHERE kind = 'rhythm') AS r FROM ft GROUP BY rec_no),
    q AS (SELECT * FROM nf WHERE rec_no % 20 = 0), t AS (SELECT * FROM nf WHERE split = 'train' AND rec_no % 20 <> 0),
    ov AS (SELECT a.rec_no AS q, b.rec_no AS t, count(*) FILTER (WHERE kind = 'joint') AS j, count(*) FILTER (WHERE kind = 'pitch') AS p, count(*) FILTER (WHERE kind = 'rhythm') AS r
           FROM (SELECT * FROM ft WHERE rec_no IN (SELECT rec_no FROM q)) a JOIN (SELECT * FROM ft WHERE rec_no IN (SELECT rec_no FROM t)) b USING (kind, g) GROUP BY a.rec_no, b.rec_no),
    sc AS (SELECT q, t, ov.j / (x.j + y.j - ov.j) AS joint, ov.p / (x.p + y.p - ov.p) AS pitch, ov.r / (x.r + y.r - ov.r) AS rhythm FROM ov JOIN sz x ON x.rec_no = q JOIN sz y ON y.rec_no = t),
    best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY 0.0 + joint * 0.55 + pitch * 0.30 + rhythm * 0.15 DESC, t) AS rn FROM sc),
    ex AS (SELECT q.rec_no AS q, min(t.rec_no) AS e FROM q JOIN t USING (melody) GROUP BY q.rec_no), fa AS (SELECT q.rec_no AS q, min(t.rec_no) AS f FROM q JOIN t USING (family) GROUP BY q.rec_no),
    ch AS (SELECT q.rec_no, e, f, coalesce(e, f, best.t, (SELECT min(rec_no) FROM t)) AS closest_no FROM q LEFT JOIN ex ON ex.q = q.rec_no LEFT JOIN fa ON fa.q = q.rec_no LEFT JOIN best ON best.q = q.rec_no AND rn = 1),
    fin AS (SELECT ch.*, coalesce(joint, 0.0) AS joint, coalesce(pitch, 0.0) AS pitch, coalesce(rhythm, 0.0) AS rhythm, CASE WHEN coalesce(e, f) IS NOT NULL THEN 1.0 ELSE coalesce(0.0 + joint * 0.55 + pitch * 0.30 + rhythm * 0.15, 0.0) END AS score
            FROM ch LEFT JOIN sc ON sc.q = ch.rec_no AND sc.t = ch.closest_no)
    SELECT rec_no, closest_no, score, CASE WHEN e IS NOT NULL THEN 'exact training match' WHEN f IS NOT NULL OR score >= 0.9 THEN 'near match' WHEN score >= 0.7 THEN 'high similarity' WHEN score >= 0.4 THEN 'moderate similarity' ELSE 'low similarity' END AS label,
      e IS NOT NULL AS exact_match, f IS NOT NULL AS invariant_match, joint, pitch, rhythm FROM fin"""


#: As _NEAREST, over all training songs and without the query itself.
_NEAREST_TRAINING = (
    _NEAREST.replace("WHERE split = 'train' AND rec_no % 20 <> 0", "WHERE split = 'train'").replace("USING (kind, g) GROUP BY", "USING (kind, g) WHERE a.rec_no <> b.rec_no GROUP BY")
    .replace("q JOIN t USING (melody)", "q JOIN t ON q.melody = t.melody AND q.rec_no <> t.rec_no").replace("q JOIN t USING (family)", "q JOIN t ON q.family = t.family AND q.rec_no <> t.rec_no")
    .replace("(SELECT min(rec_no) FROM t)", "(SELECT min(t.rec_no) FROM t WHERE t.rec_no <> q.rec_no)")
)
for _name in ("tk", "nf", "ft", "sz", "ov", "sc"):  # each is read several times
    _NEAREST_TRAINING = _NEAREST_TRAINING.replace(f"{_name} AS (", f"{_name} AS MATERIALIZED (", 1)


def _sampled(songs: DataFrame) -> DataFrame:
    return dedup.sampled(songs, {"train": 64, "val": 16, "test": 16})


def _families(songs: DataFrame) -> DataFrame:
    return dedup.families(songs)


def queries() -> dict[str, Query]:
    return {
        "transition_tokens": on("songs", _transitions),
        "exact_dedup_songs": on("songs", _exact),
        "exact_dedup_docs": on("documents", _exact_docs),
        "dedup_report": on("songs", dedup.dedup_report),
        "shingle_pairs": on("songs", _pairs),
        "near_dup_verify": on("songs", _verified),
        "families": on("songs", _families),
        "family_split": on("songs", _family_split),
        "invariant_split": on("songs", _invariant_split),
        "leakage_check": on("songs", _leakage),
        "leakage_three_keys": on("songs", _family_leakage),
        "nearest_reference": _nearest_training,
        "sample_per_split": on("songs", _sampled),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "transition_tokens": f"WITH {TR} SELECT rec_no, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM tk GROUP BY rec_no",
        "exact_dedup_songs": f"WITH {TR} SELECT rec_no, min(rec_no) OVER w AS retained, rec_no <> min(rec_no) OVER w AS is_copy FROM nf WINDOW w AS (PARTITION BY melody, bpm)",
        "exact_dedup_docs": "SELECT doc_id, retained, copies FROM (SELECT doc_id, min(doc_id) OVER w AS retained, count(*) OVER w AS copies FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text)) WHERE copies > 1",
        "dedup_report": f"""WITH {TR}, x AS (SELECT count(*) AS n FROM nf GROUP BY melody, bpm), f AS (SELECT count(*) AS n FROM nf GROUP BY family)
            SELECT (SELECT CAST(sum(n) AS BIGINT) FROM x) AS songs, (SELECT count(*) FROM x) AS unique_exact, (SELECT CAST(sum(n) - count(*) AS BIGINT) FROM x) AS copies, (SELECT count(*) FROM x WHERE n > 1) AS copy_groups,
                   (SELECT count(*) FROM f) AS unique_invariant, (SELECT count(*) FROM f WHERE n > 1) AS invariant_groups, (SELECT max(n) FROM f) AS largest_invariant""",
        "shingle_pairs": _PAIRS,
        "invariant_split": _INVARIANT_SPLIT,
        "leakage_check": _LEAKAGE,
        "nearest_reference": _NEAREST_TRAINING,
        "sample_per_split": """SELECT rec_no, split FROM (SELECT rec_no, split, row_number() OVER (PARTITION BY split ORDER BY md5('42:' || rec_no), rec_no) AS r FROM songs WHERE split IS NOT NULL)
            WHERE r <= CASE split WHEN 'train' THEN 64 WHEN 'val' THEN 16 WHEN 'test' THEN 16 ELSE 0 END""",
    }
