"""Queries on tokens, windows and the n-gram model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.functions import music
from tunewright.operators import tokens
from tunewright.plans.corpus import Query, on
from tunewright.plans.melodies import EV

CONTEXT, ORDER = 34, 3
#: Least and most events of a sampled song.
LIMITS = (8, 128)

IDS = f"""{EV},
    body AS (SELECT rec_no, 2 * pos + 3 AS i, coalesce(pitch - 60 + 879, 927) AS tok FROM ev UNION ALL SELECT rec_no, 2 * pos + 4, 928 + 2 * CAST(log2(duration) AS INT) + CAST(dotted AS INT) FROM ev),
    ids AS (SELECT * FROM body UNION ALL SELECT rec_no, 1, 1 FROM songs UNION ALL SELECT rec_no, 2, 3 + bpm - 25 FROM songs UNION ALL SELECT rec_no, 2 * len(events) + 3, 2 FROM songs)"""


def _text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def _ids(songs: DataFrame) -> DataFrame:
    return songs.select("rec_no", tokens.token_ids(F.col("bpm"), F.col("events")).alias("ids"))


def _tokenize(songs: DataFrame) -> DataFrame:
    return _ids(songs).select("rec_no", _text("ids").alias("ids"), _text(tokens.sliding_context(F.col("ids"), 20)).alias("context"))


_TOKENIZE = f"""
    WITH {IDS}, n AS (SELECT rec_no, count(*) AS n FROM ids GROUP BY rec_no), s AS (SELECT *, CASE WHEN n <= 20 THEN 0 ELSE (n - 2 - 18) + (n - 2 - 18) % 2 END AS skip FROM n)
    SELECT rec_no, string_agg(CAST(tok AS VARCHAR), ' ' ORDER BY i) AS ids, string_agg(CASE WHEN i <= 2 OR i > 2 + skip THEN CAST(tok AS VARCHAR) END, ' ' ORDER BY i) AS context FROM ids JOIN s USING (rec_no) GROUP BY rec_no"""


def _detokenize(songs: DataFrame) -> DataFrame:
    """Every song through its tokens, padded, and back."""
    padded = F.concat("ids", F.array_repeat(F.lit(tokens.PAD), F.lit(3)))
    made = _ids(songs).select("rec_no", tokens.decoded(padded).alias("s"))
    return made.select("rec_no", F.col("s.bpm").cast("bigint").alias("bpm"), music.json_events(F.col("s.events")).alias("events"))


_DETOKENIZE = f"""WITH {EV} SELECT rec_no, CAST(min(bpm) AS BIGINT) AS bpm,
    '[' || string_agg('[' || coalesce(CAST(pitch AS VARCHAR), 'null') || ',' || duration || ',' || (CASE WHEN dotted THEN 'true' ELSE 'false' END) || ']', ',' ORDER BY pos) || ']' AS events FROM ev GROUP BY rec_no"""


def _windows(songs: DataFrame) -> DataFrame:
    made = tokens.windows(tokens.sequences(songs), CONTEXT)
    return made.select("rec_no", F.col("chunk").cast("bigint").alias("chunk"), _text("inputs").alias("inputs"), _text("targets").alias("targets"))


_WIN = f"""{IDS}, per AS (SELECT rec_no, len(events) AS n, unnest(range(0, (len(events) - 1) // 16 + 1)) AS chunk FROM songs),
    sq AS (SELECT rec_no, chunk, i, tok, row_number() OVER (PARTITION BY rec_no, chunk ORDER BY i) AS k, count(*) OVER (PARTITION BY rec_no, chunk) AS m FROM per JOIN ids USING (rec_no)
           WHERE i <= 2 OR (i BETWEEN 3 + 32 * chunk AND 2 + 2 * least(16 * chunk + 16, n)) OR (i = 2 * n + 3 AND 16 * chunk + 16 >= n)),
    wi AS (SELECT rec_no, chunk, k, tok AS x, CASE WHEN k = 1 AND chunk > 0 THEN 0 ELSE lead(tok) OVER (PARTITION BY rec_no, chunk ORDER BY k) END AS y, m FROM sq)"""

_WINDOWS = f"""
    WITH {_WIN}, a AS (SELECT rec_no, chunk, m, string_agg(CAST(x AS VARCHAR), ' ' ORDER BY k) AS x, string_agg(CAST(y AS VARCHAR), ' ' ORDER BY k) AS y FROM wi WHERE k < m GROUP BY rec_no, chunk, m)
    SELECT rec_no, CAST(chunk AS BIGINT) AS chunk, x || repeat(' 0', CAST(34 - m + 1 AS BIGINT)) AS inputs, y || repeat(' 0', CAST(34 - m + 1 AS BIGINT)) AS targets FROM a"""


def _train(songs: DataFrame) -> DataFrame:
    return tokens.ngram_counts(tokens.sequences(songs.where("split = 'train'")), ORDER)


def _counts(songs: DataFrame) -> DataFrame:
    return _train(songs).select(_text("context").alias("context"), F.col("target").cast("bigint").alias("target"), "n")


_NG = f"""ng AS (
      SELECT context, target, count(*) AS n FROM (
        SELECT i, tok AS target, unnest([CAST('' AS VARCHAR), CAST(a AS VARCHAR), CASE WHEN i > 2 THEN b || ' ' || a END]) AS context FROM (
          SELECT i, tok, lag(tok, 1) OVER (PARTITION BY rec_no ORDER BY i) AS a, lag(tok, 2) OVER (PARTITION BY rec_no ORDER BY i) AS b FROM ids WHERE rec_no IN (SELECT rec_no FROM songs WHERE split = 'train')) WHERE i > 1)
      WHERE context IS NOT NULL GROUP BY context, target)"""


def _perplexity(songs: DataFrame) -> DataFrame:
    held = tokens.windows(tokens.sequences(songs.where("split IN ('val', 'test')")), CONTEXT)
    return tokens.cross_entropy(tokens.log_probabilities(tokens.scored_targets(held, ORDER), _train(songs), ORDER))


_PERPLEXITY = f"""
    WITH {_WIN}, {_NG}, tot AS (SELECT context, sum(n) AS total, count(*) AS kinds FROM ng GROUP BY context),
    tg AS (SELECT c1, c2, y, count(*) AS n FROM (SELECT CAST(x AS VARCHAR) AS c1, lag(x) OVER (PARTITION BY rec_no, chunk ORDER BY k) || ' ' || x AS c2, y, k, m FROM wi WHERE rec_no IN (SELECT rec_no FROM songs WHERE split IN ('val', 'test'))) WHERE k < m AND y <> 0 GROUP BY c1, c2, y),
    p0 AS (SELECT tg.*, (coalesce(ng.n, 0) + 0.1) / ((SELECT total FROM tot WHERE context = '') + 0.1 * 940) AS p FROM tg LEFT JOIN ng ON ng.context = '' AND ng.target = y),
    p1 AS (SELECT p0.* EXCLUDE (p), CASE WHEN t.total IS NULL THEN p ELSE (coalesce(g.n, 0) + kinds * p) / (total + kinds) END AS p FROM p0 LEFT JOIN tot t ON t.context = c1 LEFT JOIN ng g ON g.context = c1 AND g.target = y),
    p2 AS (SELECT p1.* EXCLUDE (p), CASE WHEN t.total IS NULL THEN p ELSE (coalesce(g.n, 0) + kinds * p) / (total + kinds) END AS p FROM p1 LEFT JOIN tot t ON t.context = c2 LEFT JOIN ng g ON g.context = c2 AND g.target = y)
    SELECT CAST(sum(n) AS BIGINT) AS targets, -sum(n * ln(p)) / sum(n) AS nats, exp(-sum(n * ln(p)) / sum(n)) AS perplexity FROM p2"""


def _topk(songs: DataFrame) -> DataFrame:
    one = _train(songs).where(F.size("context") == 1).select(F.element_at("context", 1).cast("bigint").alias("previous"), F.col("target").cast("bigint").alias("target"), "n")
    return tokens.top_filter(one, "previous", "target", "n", 20, 0.95).withColumn("rank", F.col("rank").cast("bigint"))


_TOPK = f"""
    WITH {IDS}, {_NG}, r AS (SELECT CAST(context AS BIGINT) AS previous, CAST(target AS BIGINT) AS target, n, row_number() OVER (PARTITION BY context ORDER BY n DESC, target) AS rank FROM ng WHERE context <> '' AND context NOT LIKE '% %'),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY previous) AS share, coalesce(sum(n) OVER (PARTITION BY previous ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER (PARTITION BY previous) AS before FROM r WHERE rank <= 20)
    SELECT previous, target, n, rank, share FROM s WHERE rank = 1 OR before <= 0.95"""


def _legal_whole(songs: DataFrame) -> DataFrame:
    """Legal next tokens after every prefix of every song, by its length and last token, under the limits of sampling."""
    each = _ids(songs).where("ids IS NOT NULL").select("rec_no", F.posexplode(F.concat(F.array(F.lit(None).cast("int")), "ids")).alias("k", "last"))
    a = tokens.allowed_after(F.col("k"), F.col("last"), *LIMITS)
    return each.select("rec_no", F.col("k").cast("bigint").alias("k"), a["low"].cast("bigint").alias("low"), a["high"].cast("bigint").alias("high"), a["eos"].alias("eos"))


_LEGAL_WHOLE = f"""
    SELECT rec_no, k, CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN 3 WHEN k = 2 * n + 3 THEN NULL WHEN k % 2 = 1 THEN 928 WHEN k // 2 - 1 >= {LIMITS[1]} THEN 2 ELSE 879 END AS low,
      CASE WHEN k = 0 THEN 1 WHEN k = 1 THEN 878 WHEN k = 2 * n + 3 THEN NULL WHEN k % 2 = 1 THEN 939 WHEN k // 2 - 1 >= {LIMITS[1]} THEN 2 ELSE 927 END AS high,
      CASE WHEN k = 2 * n + 3 THEN NULL ELSE k >= 2 AND k % 2 = 0 AND k // 2 - 1 >= {LIMITS[0]} END AS eos
    FROM (SELECT rec_no, len(events) AS n, unnest(range(0, 2 * len(events) + 4)) AS k FROM songs WHERE len(events) > 0)"""


def queries() -> dict[str, Query]:
    return {
        "tokenize": on("songs", _tokenize),
        "detokenize": on("songs", _detokenize),
        "allowed_next": on("songs", _legal_whole),
        "train_windows": on("songs", _windows),
        "ngram_counts": on("songs", _counts),
        "witten_bell_perplexity": on("songs", _perplexity),
        "topk_topp_filter": on("songs", _topk),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize": _TOKENIZE,
        "detokenize": _DETOKENIZE,
        "allowed_next": _LEGAL_WHOLE,
        "train_windows": _WINDOWS,
        "ngram_counts": f"WITH {IDS}, {_NG} SELECT context, CAST(target AS BIGINT) AS target, n FROM ng",
        "witten_bell_perplexity": _PERPLEXITY,
        "topk_topp_filter": _TOPK,
    }
