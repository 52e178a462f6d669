"""Graph queries. Steps between the lines of an order are references between parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import graphs as G
from ledgerline.plans.catalog import _EDGES, _SHARES, _edges, _links
from ledgerline.plans.registry import cents, query, table

_SPARSE = """sparse AS (SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS dst FROM lineitem WHERE l_quantity > 40) WHERE dst IS NOT NULL AND src <> dst)"""


def _sparse(spark, d) -> DataFrame:
    """References between large lines only: a graph with a core and fringes."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    steps = table(spark, d, "lineitem").filter("l_quantity > 40").withColumn("dst", F.lead("l_partkey").over(order)).select(F.col("l_partkey").alias("src"), "dst")
    return steps.filter("dst is not null and src <> dst").distinct()


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("own"))


_KATZ = f"""{_SHARES.replace("shares AS", "unused AS")}, kz AS (SELECT 0 AS k, p_partkey AS id, CAST(p_retailprice AS DOUBLE) AS own, CAST(p_retailprice AS DOUBLE) AS value, CAST(1e300 AS DOUBLE) AS delta FROM part
UNION ALL SELECT k + 1, id, own, fresh, max(abs(fresh - value)) OVER () FROM (SELECT v.k, v.id, v.own, v.value, v.own + 0.01 * coalesce(gain, 0) AS fresh
  FROM kz v LEFT JOIN (SELECT dst, sum(x.value * n) AS gain FROM kz x JOIN w ON src = x.id GROUP BY dst) ON dst = v.id WHERE v.delta >= 1 AND v.k < 30)),
katz AS (SELECT id, value FROM kz WHERE k = (SELECT max(k) FROM kz))"""


@query(f"WITH RECURSIVE {_KATZ} SELECT id, round(value, 3) AS value FROM katz")
def katz_k(spark, d):
    """Katz centrality until it settles; alpha is below one over this graph's spectral radius (about 30)."""
    return G.katz(_parts(spark, d), _links(spark, d), alpha=0.01).select("id", F.round("value", 3).alias("value"))


@query(f"""WITH RECURSIVE {_SHARES.replace("shares AS", "unused AS")}, u AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, n FROM w UNION ALL SELECT dst, src, n FROM w) GROUP BY 1, 2),
us AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM u), ids AS (SELECT DISTINCT src AS id FROM u),
v AS (SELECT 0 AS k, id, CAST(1.0 / count(*) OVER () AS DOUBLE) AS rank, count(*) OVER () AS n, CAST(1e300 AS DOUBLE) AS delta FROM ids
UNION ALL SELECT k + 1, id, fresh, n, sum(abs(fresh - rank)) OVER () FROM (SELECT v.k, v.id, v.rank, v.n, CAST(0.15 AS DOUBLE) / v.n + 0.85 * coalesce(gain, 0) AS fresh
  FROM v LEFT JOIN (SELECT dst, sum(x.rank * share) AS gain FROM v x JOIN us ON src = x.id GROUP BY dst) ON dst = v.id WHERE v.delta >= 1e-8 AND v.k < 100))
SELECT id, round(rank / max(rank) OVER (), 6) AS rank FROM v WHERE k = (SELECT max(k) FROM v)""")
def pagerank_undirected(spark, d):
    links = _links(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return G.pagerank_undirected(links, "n").select("id", F.round("rank", 6).alias("rank"))


@query(f"""WITH RECURSIVE {_SPARSE}, r AS (SELECT DISTINCT src AS repealer, dst AS repealed FROM sparse JOIN part ON p_partkey = dst WHERE p_size % 5 = 0),
succ AS (SELECT repealed AS id, min(repealer) AS successor FROM r WHERE repealer IN (SELECT repealer FROM r GROUP BY 1 HAVING count(*) <= 5) GROUP BY 1),
f AS (SELECT DISTINCT dst AS id, dst AS here, [dst] AS seen, false AS met FROM sparse UNION ALL SELECT f.id, successor, list_append(seen, successor), list_contains(seen, successor) FROM f JOIN succ ON succ.id = f.here WHERE NOT met),
ends AS (SELECT id, max_by(here, len(seen)) AS last FROM f GROUP BY 1)
SELECT src, dst, last FROM sparse JOIN ends ON ends.id = dst""")
def successor_chain(spark, d):
    """References redirected to the last successor of what they cite; cycles end where a vertex comes again."""
    sparse = _sparse(spark, d)
    old = table(spark, d, "part").filter("p_size % 5 = 0").select(F.col("p_partkey").alias("dst"))
    repeals = sparse.join(old, "dst", "left_semi").select(F.col("src").alias("repealer"), F.col("dst").alias("repealed"))
    ends = G.followed(sparse.select(F.col("dst").alias("id")), G.successors(repeals))
    return sparse.join(ends.select(F.col("id").alias("dst"), "last"), "dst").select("src", "dst", "last")


_CLOSURE = f"""{_SPARSE}, reach AS (SELECT src, dst FROM sparse UNION SELECT r.src, e.dst FROM reach r JOIN sparse e ON e.src = r.dst), ids AS (SELECT src AS id FROM sparse UNION SELECT dst FROM sparse),
comp AS (SELECT id, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src = id), id) AS component FROM ids),
core AS (SELECT component FROM comp GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), inner_ids AS (SELECT id FROM comp SEMI JOIN core USING (component)),
aft AS (SELECT DISTINCT dst AS id FROM reach WHERE src IN (FROM inner_ids) UNION FROM inner_ids), bef AS (SELECT DISTINCT src AS id FROM reach WHERE dst IN (FROM inner_ids) UNION FROM inner_ids)"""


@query(f"""WITH RECURSIVE {_CLOSURE} SELECT id, least(component, id) AS component, CASE WHEN id IN (FROM aft) AND id IN (FROM bef) THEN 'CORE' WHEN id IN (FROM bef) THEN 'IN' WHEN id IN (FROM aft) THEN 'OUT' ELSE 'TENDRIL' END AS zone FROM comp""")
def scc_bowtie(spark, d):
    return G.bow_tie(_sparse(spark, d))


@query(f"""WITH {_EDGES}, k AS (SELECT dst AS id, count(*) AS n_in FROM edges GROUP BY 1),
t AS (SELECT ab.v AS id, count(*) AS n FROM (SELECT a.src AS a, b.src AS b, a.dst AS v FROM edges a JOIN edges b ON a.dst = b.dst AND a.src <> b.src) ab SEMI JOIN edges e ON e.src = ab.a AND e.dst = ab.b GROUP BY 1),
c AS (SELECT p_partkey AS id, coalesce(n_in, 0) AS n_in, CASE WHEN coalesce(n_in, 0) < 2 THEN 0 WHEN n_in < 10 THEN -1 ELSE coalesce(n, 0) / (n_in * (n_in - 1)) END AS clustering FROM part LEFT JOIN k ON k.id = p_partkey LEFT JOIN t ON t.id = p_partkey)
SELECT id, n_in, round(clustering, 6) AS clustering, CASE WHEN n_in >= 20 AND clustering >= 0 AND clustering < 0.05 THEN 'DEFINITIONAL' WHEN n_in >= 20 AND clustering > 0.15 THEN 'FUNCTIONAL' END AS hub FROM c""")
def clustering_in(spark, d):
    found = G.clustering_in(_parts(spark, d), _edges(spark, d))
    return found.select("id", "n_in", F.round("clustering", 6).alias("clustering"), G.hub_class(F.col("n_in"), F.col("clustering"), least=20).alias("hub"))


def _debts(spark, d) -> DataFrame:
    links = _sparse(spark, d).join(_parts(spark, d).select(F.col("id").alias("dst"), "own"), "dst")
    share = F.col("own") / F.sum("own").over(Window.partitionBy("src"))
    return links.select("src", "dst", share.alias("share"))


@query(None)
def debtrank_topk(spark, d):
    """What fails with each of the 500 dearest parts, by level, and that against the part's own value."""
    values = _parts(spark, d).select("id", F.col("own").alias("value"))
    found = G.debtrank(values, _debts(spark, d))
    both = found.join(values, F.col("id") == F.col("seed"))
    return both.select("seed", F.round("debtrank", 3).alias("debtrank"), "n_hit", F.round(F.col("debtrank") / F.col("value"), 6).alias("ratio"))


@query(f"""WITH {_EDGES}, k AS (SELECT dst AS id, count(*) AS n_in FROM edges GROUP BY 1), a AS (SELECT l_partkey AS id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') / count(*) AS ignored FROM lineitem GROUP BY 1),
r AS (SELECT p_partkey AS id, sqrt(30000 + p_retailprice) * pow(1 + coalesce(n_in, 0), 0.6) * greatest(3.0, log2(2 + coalesce(n, 0))) * (1 + 0.5 * least(coalesce(ignored, 0), 1)) AS risk
FROM part LEFT JOIN k ON k.id = p_partkey LEFT JOIN a ON a.id = p_partkey WHERE p_size % 5 <> 0)
SELECT id, round(1000 * risk / max(risk) OVER (), 6) AS risk FROM r""")
def risk_index(spark, d):
    """Systemic risk of the parts in force, scaled to 1000 at most; the maximum is an aggregate, not a window."""
    n_in = G.degrees(_edges(spark, d)).select("id", "n_in")
    flag = F.count(F.when(F.col("l_returnflag") == "R", 1)) / F.count("*")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"), flag.alias("ignored"))
    rows = table(spark, d, "part").filter("p_size % 5 <> 0").select(F.col("p_partkey").alias("id"), "p_retailprice").join(n_in, "id", "left").join(lines, "id", "left").na.fill(0, ["n_in", "n"])
    risk = rows.select("id", G.systemic_risk(F.col("p_retailprice"), F.col("n_in"), F.col("n"), F.col("ignored")).alias("risk"))
    top = risk.agg(F.max("risk").alias("top"))  # one row
    return risk.crossJoin(F.broadcast(top)).select("id", F.round(1000 * F.col("risk") / F.col("top"), 6).alias("risk"))


@query("""WITH p AS (SELECT l_partkey AS src, l_suppkey AS dst, CAST(round(l_extendedprice * 100) AS BIGINT) AS w FROM lineitem WHERE l_partkey <> l_suppkey),
u AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(w) AS w FROM p GROUP BY 1, 2) SELECT id, CAST(sum(w) AS BIGINT) AS weight, count(*) AS n_partners FROM (SELECT a AS id, w FROM u UNION ALL SELECT b, w FROM u) GROUP BY 1""")
def weighted_degree_undirected(spark, d):
    edges = table(spark, d, "lineitem").filter("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), cents("l_extendedprice").alias("w"))
    return G.weighted_degrees(edges, "w")
