"""Registered queries of groups by beam shift, and their SQL twins: Ward's hierarchy by a recursive CTE, silhouettes by all pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grouping as G
from ..operators import jobs
from ..operators import joins as J
from ..operators import selection as S
from ..streaming.best import best_of
from .views import SEG, read, segments

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Places and their rows, rounds of merges of reciprocal nearest neighbours, cuts, clusters that are large enough, silhouettes of the cuts, the best one.
_WARD = """WITH RECURSIVE place AS (SELECT {x} AS x, {y} AS y, CAST(count(*) AS DOUBLE) AS n, CAST(row_number() OVER (ORDER BY {x}, {y}) AS BIGINT) AS id FROM {table} GROUP BY 1, 2),
  step(r, id, x, y, n, h, gone) AS (
    SELECT 0, id, x, y, n, CAST(0 AS DOUBLE), CAST(NULL AS BIGINT) FROM place
    UNION ALL
    (WITH live AS (SELECT * FROM step WHERE gone IS NULL),
      near AS (SELECT a.id, min({{'d': a.n * b.n / (a.n + b.n) * ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 'near': b.id}}) AS best FROM live a JOIN live b ON a.id <> b.id GROUP BY a.id),
      pair AS (SELECT p.id AS kept, q.id AS gone, p.best.d AS d FROM near p JOIN near q ON p.best.near = q.id AND q.best.near = p.id WHERE p.id < q.id)
    SELECT l.r + 1, l.id, CASE WHEN k.kept IS NULL THEN l.x ELSE (l.n * l.x + b.n * b.x) / (l.n + b.n) END, CASE WHEN k.kept IS NULL THEN l.y ELSE (l.n * l.y + b.n * b.y) / (l.n + b.n) END,
           CASE WHEN k.kept IS NULL THEN l.n ELSE l.n + b.n END, CASE WHEN g.gone IS NOT NULL THEN greatest(g.d, l.h, c.h) WHEN k.kept IS NULL THEN l.h ELSE greatest(k.d, l.h, b.h) END, g.kept
    FROM live l LEFT JOIN pair k ON k.kept = l.id LEFT JOIN live b ON b.id = k.gone LEFT JOIN pair g ON g.gone = l.id LEFT JOIN live c ON c.id = g.kept
    WHERE (SELECT count(*) FROM live) > 1)),
  merge AS (SELECT gone AS kept, id AS gone, h, row_number() OVER (ORDER BY h DESC, r DESC, gone DESC, id DESC) AS k FROM step WHERE gone IS NOT NULL)
  , cut AS (SELECT CAST(range AS BIGINT) AS k FROM range(2, (SELECT least({stop}, count(*)) FROM place)))
  , walk(k, id, c) AS (SELECT k, id, id FROM cut, place UNION ALL SELECT w.k, w.id, m.kept FROM walk w JOIN merge m ON m.gone = w.c AND m.k >= w.k)
  , own AS (SELECT k, id, c FROM walk w WHERE NOT EXISTS (SELECT 1 FROM merge m WHERE m.gone = w.c AND m.k >= w.k))
  , size AS (SELECT k, c, sum(n) AS n FROM own JOIN place USING (id) GROUP BY 1, 2)
  , big AS (SELECT o.k, o.id, o.c, p.x, p.y FROM own o JOIN place p USING (id) JOIN size s ON s.k = o.k AND s.c = o.c WHERE s.n >= {least})
  , moved AS (SELECT o.k, o.id, arg_min(b.c, {{'d': sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)), 'id': b.id}}) AS c FROM own o JOIN place p USING (id) JOIN size s ON s.k = o.k AND s.c = o.c JOIN big b ON b.k = o.k WHERE s.n < {least} GROUP BY 1, 2)
  , label AS (SELECT k, id, c FROM big UNION ALL SELECT * FROM moved)
  , total AS (SELECT k, c, sum(n) AS n FROM label JOIN place USING (id) GROUP BY 1, 2)
  , apart AS (SELECT a.id, b.id AS other, b.n * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM place a, place b)
  , mean AS (SELECT l.k, a.id, l.c, sum(a.d) AS s FROM apart a JOIN label l ON l.id = a.other GROUP BY 1, 2, 3)
  , sil AS (SELECT m.k, m.id, max(CASE WHEN m.c = l.c THEN m.s / greatest(t.n - 1, 1) END) AS a, min(CASE WHEN m.c <> l.c THEN m.s / t.n END) AS b, max(CASE WHEN m.c = l.c THEN t.n END) AS n FROM mean m JOIN label l ON l.k = m.k AND l.id = m.id JOIN total t ON t.k = m.k AND t.c = m.c GROUP BY 1, 2)
  , score AS (SELECT k, round(sum(p.n * CASE WHEN s.n > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) / sum(p.n), 9) AS score FROM sil s JOIN place p USING (id) WHERE b IS NOT NULL GROUP BY 1)
  , best AS (SELECT k FROM score ORDER BY score DESC, k LIMIT 1)
  , named AS (SELECT c, row_number() OVER (ORDER BY min(id)) AS cluster FROM label WHERE k = (SELECT k FROM best) GROUP BY 1)
  , clustered AS (SELECT p.x, p.y, CAST(n.cluster AS INTEGER) AS cluster FROM label l JOIN best USING (k) JOIN named n USING (c) JOIN place p USING (id))
"""


def _ward(table: str, x: str, y: str, stop: int, least: int) -> str:
    return _WARD.format(table=table, x=x, y=y, stop=stop, least=least)


def _customers(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("rid"), F.col("c_name").alias("image"), (F.col("c_nationkey") % 3 + 1).alias("rlnOpticsGroup"), ((k % 7) * 10 + F.col("c_acctbal") / 10000).alias("x"), ((k % 5) * 10 + (k % 11) / 10.0).alias("y"))


def optics_by_shift(spark, sf_dir):
    """Customers as micrographs with a beam shift each: optics groups split by its cluster, with the optics row of each."""
    optics = read(spark, sf_dir, "nation").where("n_nationkey < 3").select((F.col("n_nationkey") + 1).alias("rlnOpticsGroup"), F.col("n_name").alias("rlnOpticsGroupName"), F.lit(300.0).alias("voltage"))
    rows, optics = G.optics_by_shift(_customers(spark, sf_dir), optics, "image", "x", "y", clusters=range(2, 50))
    return rows.join(optics, "rlnOpticsGroup").select("rid", F.col("rlnOpticsGroup").cast("int").alias("optics"), F.col("rlnOpticsGroupName").alias("name"), "voltage")


QUERIES["optics_by_shift"] = optics_by_shift
SQL["optics_by_shift"] = _ward("customer", "(c_custkey % 7) * 10 + c_acctbal / 10000", "(c_custkey % 5) * 10 + (c_custkey % 11) / 10.0", 50, 4) + """
  , placed AS (SELECT c_custkey, c_nationkey % 3 + 1 AS g, cluster FROM customer JOIN clustered ON x = (c_custkey % 7) * 10 + c_acctbal / 10000 AND y = (c_custkey % 5) * 10 + (c_custkey % 11) / 10.0)
  , numbered AS (SELECT c_custkey AS rid, CAST(dense_rank() OVER (ORDER BY g, cluster) AS INTEGER) AS optics FROM placed)
  SELECT rid, optics, 'opticsGroup' || optics AS name, CAST(300 AS DOUBLE) AS voltage FROM numbered"""


def exposure_groups_by_shift(spark, sf_dir):
    """Suppliers as micrographs: exposure groups split by clusters of beam shifts, synchronised, and the medians of a column of each."""
    k = F.col("s_suppkey")
    d = read(spark, sf_dir, "supplier").select(k.alias("rid"), F.col("s_name").alias("image"), (F.col("s_nationkey") % 2 + 1).alias("ctf_exp_group_id"), F.lit(0).alias("mscope_exp_group_id"), F.col("s_acctbal").alias("tilt"), ((k % 2) * 10 + F.col("s_acctbal") / 10000).alias("x"), ((k % 11) / 10.0).alias("y"))
    out = G.exposure_groups_by_shift(d, "ctf_exp_group_id", "image", "x", "y", ["tilt"])
    return out.select("rid", *[F.col(c).cast("int").alias(c) for c in ("ctf_exp_group_id", "mscope_exp_group_id")], "tilt")


QUERIES["exposure_groups_by_shift"] = exposure_groups_by_shift
SQL["exposure_groups_by_shift"] = _ward("supplier", "(s_suppkey % 2) * 10 + s_acctbal / 10000", "(s_suppkey % 11) / 10.0", 200, 4) + """
  , placed AS (SELECT s_suppkey, s_acctbal, s_nationkey % 2 + 1 AS g, cluster FROM supplier JOIN clustered ON x = (s_suppkey % 2) * 10 + s_acctbal / 10000 AND y = (s_suppkey % 11) / 10.0)
  , numbered AS (SELECT s_suppkey AS rid, s_acctbal, CAST(dense_rank() OVER (ORDER BY g, cluster) AS INTEGER) AS id FROM placed)
  SELECT rid, id AS ctf_exp_group_id, id AS mscope_exp_group_id, median(s_acctbal) OVER (PARTITION BY id) AS tilt FROM numbered"""


def split_halves_sizes(spark, sf_dir):
    """How even the halves of the events by user are: rows of either subset and their difference."""
    out = S.split_in_halves(read(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], "event_id")
    counts = out.agg(F.count_if(F.col("subset") == 1).alias("smaller"), F.count_if(F.col("subset") == 2).alias("larger"))
    return counts.select("smaller", "larger", (F.col("larger") - F.col("smaller")).alias("difference"))


QUERIES["split_halves_sizes"] = split_halves_sizes
SQL["split_halves_sizes"] = """WITH RECURSIVE g AS (SELECT n, row_number() OVER (ORDER BY n) AS k FROM (SELECT count(*) AS n FROM events GROUP BY user_id)),
  t AS (SELECT sum(n) AS total, count(*) AS groups FROM g),
  s(k, sum) AS (SELECT 0::BIGINT, 0::HUGEINT UNION SELECT s.k + 1, s.sum + take * g.n FROM s JOIN g ON g.k = s.k + 1, range(2) x(take), t WHERE s.sum + take * g.n <= total // 2),
  b AS (SELECT max(sum) AS smaller FROM s, t WHERE k = groups) SELECT CAST(smaller AS BIGINT) AS smaller, CAST(total - smaller AS BIGINT) AS larger, CAST(total - 2 * smaller AS BIGINT) AS difference FROM b, t"""


def _orders_as_jobs(spark, sf_dir):
    """Orders as jobs: the input of each is the order before it of the same customer, and priorities and states stand for kinds."""
    o = read(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Extract").when(F.col("o_orderpriority") == "2-HIGH", "Polish").when(F.col("o_orderpriority") == "3-MEDIUM", "AutoPick").otherwise("Class2D")
    name = F.concat(kind, F.lit("/job"), F.col("o_orderkey").cast("string"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    named = o.select("o_custkey", "o_orderkey", "o_orderstatus", name.alias("job"))
    earlier = lambda k: F.lag("job", k).over(w)
    return named.select("job", earlier(1).alias("input"), F.when(F.col("o_orderstatus") != "P", earlier(1)).alias("coordinates"), F.when(F.col("o_orderstatus") == "O", earlier(2)).alias("reextract"))


_JOBS = """WITH RECURSIVE named AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'Extract' WHEN '2-HIGH' THEN 'Polish' WHEN '3-MEDIUM' THEN 'AutoPick' ELSE 'Class2D' END || '/job' || o_orderkey AS job FROM orders),
  jobs AS (SELECT job, lag(job) OVER w AS input, CASE WHEN o_orderstatus <> 'P' THEN lag(job) OVER w END AS coordinates, CASE WHEN o_orderstatus = 'O' THEN lag(job, 2) OVER w END AS reextract FROM named WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
"""
QUERIES["traced_jobs"] = lambda spark, sf_dir: (lambda j: jobs.traced(j, j.select("job")))(_orders_as_jobs(spark, sf_dir))
SQL["traced_jobs"] = _JOBS + """  walk(job, place, n, found) AS (SELECT job, job, 0, false FROM jobs UNION ALL SELECT w.job, j.input, w.n + 1, j.input LIKE '%Extract%' OR j.input LIKE '%Polish%' FROM walk w JOIN jobs j ON j.job = w.place WHERE NOT w.found AND j.input IS NOT NULL)
  SELECT job, CASE WHEN max(n) > 0 THEN arg_max(place, n) END AS source, bool_or(found) AS found, CAST(max(n) AS BIGINT) AS steps FROM walk GROUP BY job"""
QUERIES["traced_jobs_to_picks"] = lambda spark, sf_dir: (lambda j: jobs.traced(j, j.select("job"), True))(_orders_as_jobs(spark, sf_dir))
SQL["traced_jobs_to_picks"] = _JOBS + """  step AS (SELECT j.job, j.input, i.coordinates, i.reextract, (j.input LIKE '%Extract%' OR j.input LIKE '%Polish%') AS made FROM jobs j JOIN jobs i ON i.job = j.input),
  next AS (SELECT job, made AND coalesce(coordinates LIKE '%Pick%', false) AS found, CASE WHEN made AND NOT coalesce(coordinates LIKE '%Pick%', false) AND reextract IS NOT NULL THEN reextract ELSE input END AS to_, CASE WHEN made AND NOT coalesce(coordinates LIKE '%Pick%', false) AND reextract IS NOT NULL THEN 2 ELSE 1 END AS n FROM step),
  walk(job, place, n, found) AS (SELECT job, job, 0, false FROM jobs UNION ALL SELECT w.job, x.to_, w.n + x.n, x.found FROM walk w JOIN next x ON x.job = w.place WHERE NOT w.found)
  SELECT job, CASE WHEN max(n) > 0 THEN arg_max(place, n) END AS source, bool_or(found) AS found, CAST(max(n) AS BIGINT) AS steps FROM walk GROUP BY job"""


def recover_by_share(spark, sf_dir):
    """Full filaments of the segments of a score, with the share that is found."""
    d = segments(spark, sf_dir)
    return J.recover_filaments(d.where("score > 60"), d, ["mic", "tube"]).select("rid")


QUERIES["recover_by_found_share"] = recover_by_share
SQL["recover_by_found_share"] = f"WITH {SEG}, f AS (SELECT mic, tube, count(*) FILTER (WHERE score > 60) AS n, count(*) AS a FROM seg GROUP BY 1, 2), t AS (SELECT sum(n) / sum(a) AS share FROM f WHERE n > 0) SELECT rid FROM seg JOIN f USING (mic, tube), t WHERE n > 0 AND n / a >= CASE WHEN share >= 0.5 THEN 0 ELSE share END"


#: The five best segments of each micrograph, as a running job would have told last.
QUERIES["best_results"] = lambda spark, sf_dir: best_of(segments(spark, sf_dir).select("mic", "rid", F.floor("score").cast("double").alias("score")), "mic", "score", "rid", 5)
SQL["best_results"] = f'WITH {SEG} SELECT mic, rank, rid, score FROM (SELECT mic, rid, floor(score) AS score, row_number() OVER (PARTITION BY mic ORDER BY floor(score) DESC, rid) AS rank FROM seg) WHERE rank <= 5'
