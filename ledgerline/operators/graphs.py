"""Citation-graph metrics by iterated joins with map-side sums; each round's table is written to the shared folder.

Edges point from the citing to the cited vertex. Loops end by their own rule: an aggregate of the round just written.
Where values are handed on, the edges lie in buckets by source, so a round shuffles no edges, and no table goes through the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.scratch import bucketed, saved, spread

#: Rows of a round's table up to which Spark may send it to all tasks through the driver.
SMALL = 1 << 17


def propagation(vertices: DataFrame, edges: DataFrame, *, rounds: int = 3, alpha: float = 0.3) -> DataFrame:
    """``id, own, value`` after a fixed number of rounds of ``propagation_converged``."""
    return propagation_converged(vertices, edges, alpha=alpha, least=-1.0, rounds=rounds)


def pagerank(vertices: DataFrame, edges: DataFrame, *, rounds: int = 3, damping: float = 0.85) -> DataFrame:
    """Directed PageRank after a fixed number of rounds from a uniform start, repeated edges counted; the rank of vertices
    without targets is not handed on."""
    n, dealt = vertices.count(), _shares(edges)
    now = _cut(vertices.select("id", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(rounds):
        gained = _along(dealt, now).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        now = _cut(now.select("id").join(gained.hint("merge"), "id", "left").select("id", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("gain", F.lit(0.0))).alias("rank")))
    return now


def reachable(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``id, hops`` of all vertices within ``hops`` edges of ``starts`` (id), with the least number of them."""
    seen = frontier = _cut(starts.select("id", F.lit(0).alias("hops")).distinct())
    for k in range(1, hops + 1):
        new = edges.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = _cut(new.join(seen.select("id"), "id", "left_anti").select("id", F.lit(k).alias("hops")))
        seen = seen.union(frontier)
    return seen


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: the loops look at each round's table before the next, and no plan grows."""
    return saved(df, "round")


def _by_source(edges: DataFrame, n: int) -> DataFrame:
    """``edges``, ``n`` rows, in buckets by ``src`` of about a million rows, a file each."""
    dealt = spread(edges, n, "src")
    return bucketed(dealt, ["src"], max(-(-n // (1 << 20)), edges.sparkSession.sparkContext.defaultParallelism), "edges")


def _beside(table: DataFrame, n: int) -> DataFrame:
    """``table``, which has ``n`` rows, as one side of a join: beyond SMALL rows it is shuffled and not sent through the driver. Loops
    with many rounds would else send what grows with the graph in each."""
    return table.hint("merge") if n > SMALL else table


def _dealt(edges: DataFrame, n: int) -> DataFrame:
    """``edges`` as rounds read them: in buckets by source if there are more than SMALL."""
    return _by_source(edges, n) if n > SMALL else edges


def _along(edges: DataFrame, state: DataFrame) -> DataFrame:
    """``edges`` with the columns of ``state`` (id, ...) of their source; the state is hashed to the edges' buckets."""
    return edges.join(state.withColumnRenamed("id", "src").hint("shuffle_hash"), "src")


def _shares(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``src, dst, share`` of the distinct edges; each row of ``edges`` (src, dst) is one unit of weight (or ``weight``), a source's shares
    sum to one."""
    rows = _cut(edges.select("src", "dst", (F.col(weight) if weight else F.lit(1)).alias("w")))
    n = rows.count()
    weights = spread(rows, n, "src", each=1 << 18).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return _by_source(weights.select("src", "dst", (F.col("w") / F.sum("w").over(Window.partitionBy("src"))).alias("share")), n)


def propagation_converged(vertices: DataFrame, edges: DataFrame, *, alpha: float = 0.3, least: float = 1.0, rounds: int = 20) -> DataFrame:
    """``id, own, value``: value = own + alpha * sum over edges (src, dst) of the source's value by its out-degree, repeated edges
    counted, until no value changes by ``least`` (at most ``rounds`` times). Ends of edges that are no vertices own nothing."""
    dealt = _shares(edges)
    ends = dealt.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(vertices, "id", "left_anti")
    now = _cut(vertices.select("id", F.col("own").cast("double").alias("own")).union(ends.select("id", F.lit(0.0))).withColumn("value", F.col("own")))
    for _ in range(rounds):
        gained = _along(dealt, now.select("id", "value")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") * F.col("share")).alias("gain"))
        value = F.col("own") + alpha * F.coalesce("gain", F.lit(0.0))
        now = _cut(now.join(gained.hint("merge"), "id", "left").select("id", "own", value.alias("value"), F.abs(value - F.col("value")).alias("delta")))
        if (now.agg(F.max("delta")).first()[0] or 0.0) < least:
            break
    return now.select("id", "own", "value")


def pagerank_converged(vertices: DataFrame, edges: DataFrame, *, damping: float = 0.85, least: float = 1e-8, rounds: int = 100) -> DataFrame:
    """``id, rank``: weighted PageRank over the edges between vertices, repeated edges counted, until the ranks' changes sum to
    less than ``least`` (at most ``rounds`` times), as shares of the largest. Ranks of vertices without targets aren't handed on."""
    known = vertices.select("id").distinct()
    inside = edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    dealt, n = _shares(inside.select("src", "dst")), known.count()
    now = _cut(known.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        gained = _along(dealt, now).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        rank = F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("gain", F.lit(0.0))
        now = _cut(now.join(gained.hint("merge"), "id", "left").select("id", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("delta")))
        if (now.agg(F.sum("delta")).first()[0] or 0.0) < least:
            break
    top = now.agg(F.max("rank")).first()[0]
    return now.select("id", (F.col("rank") / F.lit(top)).alias("rank"))


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, hops`` of all vertices that can be reached from ``starts`` (id): rounds go on until one finds nothing new."""
    once = _cut(edges.select("src", "dst").distinct())
    dealt = _dealt(once, once.count())
    frontier = seen = _cut(starts.select("id", F.lit(0).alias("hops")).distinct())
    k, n_all = 0, 0
    while n := frontier.count():
        k, n_all = k + 1, n_all + n
        new = dealt.join(_beside(frontier.select(F.col("id").alias("src")), n), "src").select(F.col("dst").alias("id")).distinct()
        frontier = _cut(new.join(_beside(seen.select("id"), n_all), "id", "left_anti").select("id", F.lit(k).alias("hops")))
        seen = _cut(seen.union(frontier))
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree of each vertex; each row of ``edges`` counts once."""
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in")).withColumn("degree", F.col("n_out") + F.col("n_in"))


def weighted_degrees(edges: DataFrame, weight: str) -> DataFrame:
    """``id, weight, n_partners`` of the undirected graph in which each row of ``edges`` adds its weight to both ends."""
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight).groupBy("a", "b").agg(F.sum(weight).alias("w"))
    both = ends.select(F.explode(F.array("a", "b")).alias("id"), "w")
    return both.groupBy("id").agg(F.sum("w").alias("weight"), F.count("*").alias("n_partners"))


def katz(vertices: DataFrame, edges: DataFrame, *, alpha: float = 0.031, least: float = 1.0, rounds: int = 30) -> DataFrame:
    """``id, own, value``: value = own + alpha * sum over edges (src, dst) of the source's value, repeated edges counted, until
    no value changes by ``least`` (at most ``rounds`` times). Settles where alpha is below 1 / the graph's spectral radius."""
    rows = _cut(edges.select("src", "dst"))
    weights = _by_source(spread(rows, n := rows.count(), "src").groupBy("src", "dst").agg(F.count("*").alias("w")), n)
    ends = weights.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(vertices, "id", "left_anti")
    now = _cut(vertices.select("id", F.col("own").cast("double").alias("own")).union(ends.select("id", F.lit(0.0))).withColumn("value", F.col("own")))
    for _ in range(rounds):
        gained = _along(weights, now.select("id", "value")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("value") * F.col("w")).alias("gain"))
        value = F.col("own") + alpha * F.coalesce("gain", F.lit(0.0))
        now = _cut(now.join(gained.hint("merge"), "id", "left").select("id", "own", value.alias("value"), F.abs(value - F.col("value")).alias("delta")))
        if (now.agg(F.max("delta")).first()[0] or 0.0) < least:
            break
    return now.select("id", "own", "value")


def pagerank_undirected(edges: DataFrame, weight: str, *, damping: float = 0.85, least: float = 1e-8, rounds: int = 100) -> DataFrame:
    """``id, rank`` over the vertices of the undirected weighted ``edges`` (src, dst, weight; repeats add up), as shares of the
    largest: a vertex hands its rank on by weight. Rounds end when the ranks' changes sum to less than ``least``."""
    once = _cut(edges.select("src", "dst", weight))
    dealt = _shares(once.union(once.select("dst", "src", weight)), weight)
    ids = dealt.select(F.col("src").alias("id")).distinct()
    n = ids.count()
    now = _cut(ids.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        gained = _along(dealt, now).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("gain"))
        rank = F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("gain", F.lit(0.0))
        now = _cut(now.join(gained.hint("merge"), "id", "left").select("id", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("delta")))
        if (now.agg(F.sum("delta")).first()[0] or 0.0) < least:
            break
    top = now.agg(F.max("rank")).first()[0]
    return now.select("id", (F.col("rank") / F.lit(top)).alias("rank"))


def successors(repeals: DataFrame, *, most: int = 5) -> DataFrame:
    """``id, successor`` from ``repeals`` (repealer, repealed): the smallest repealer of each repealed vertex, without those
    that repeal more than ``most`` (they only clean up)."""
    rows = repeals.select("repealer", "repealed").distinct()
    functional = rows.groupBy("repealer").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("repealer")
    return rows.join(functional, "repealer", "left_semi").groupBy(F.col("repealed").alias("id")).agg(F.min("repealer").alias("successor"))


def followed(starts: DataFrame, chain: DataFrame) -> DataFrame:
    """``id, last, steps`` of ``starts`` (id): where its chain of successors ends; on a cycle, the vertex first met twice."""
    chain = _cut(chain.select(F.col("id").alias("at"), "successor"))
    done, now = [], _cut(starts.select("id").distinct().select("id", F.col("id").alias("at"), F.array("id").alias("seen")))
    while now.limit(1).count():
        moved = _cut(now.join(chain, "at", "left"))
        again = F.array_contains("seen", F.col("successor"))
        done.append(moved.filter(F.col("successor").isNull() | again).select("id", F.coalesce("successor", "at").alias("last"), (F.size("seen") - F.when(again, 0).otherwise(1)).alias("steps")))
        now = _cut(moved.filter(~again).select("id", F.col("successor").alias("at"), F.concat("seen", F.array("successor")).alias("seen")))
    return reduce(DataFrame.union, done) if done else starts.select("id", F.col("id").alias("last"), F.lit(0).alias("steps")).limit(0)


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every end of ``edges``: the smallest vertex of its strongly connected component.

    Vertices without edges in or out are trimmed until none is left; the others take the smallest vertex that reaches them
    as colour, and what reaches that vertex within its colour is its component; then the rest goes on. Rounds grow with the
    longest shortest path, not with the vertices."""
    left = _cut(edges.filter("src <> dst").select("src", "dst").distinct())
    ids, found = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), []
    while True:
        size = -1
        while size != (size := left.count()):  # trim
            ends = left.select(F.col("src").alias("id")).distinct().intersect(left.select(F.col("dst").alias("id")).distinct())
            inner = left.join(_beside(ends.withColumnRenamed("id", "src"), size), "src", "left_semi").join(_beside(ends.withColumnRenamed("id", "dst"), size), "dst", "left_semi")
            left = _cut(inner.select("src", "dst"))
        if not size:
            break
        colour = _cut(left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("c", F.col("id")))
        dealt, n = _dealt(left, size), colour.count()
        while True:
            seen = dealt.join(_beside(colour.withColumnRenamed("id", "src"), n), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("m"))
            new = _cut(colour.join(_beside(seen, n), "id", "left").select("id", F.least("c", "m").alias("c"), (F.coalesce("m", "c") < F.col("c")).alias("changed")))
            colour = new.select("id", "c")
            if not new.filter("changed").limit(1).count():
                break
        of = lambda end, name: _beside(colour.select(F.col("id").alias(end), F.col("c").alias(name)), n)
        same = dealt.join(of("src", "cs"), "src").join(of("dst", "cd"), "dst").filter("cs = cd")
        back = reached(colour.filter("id = c").select("id"), same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found.append(_cut(back.select("id").join(_beside(colour, n), "id").select("id", F.col("c").alias("component"))))
        gone = found[-1].select("id")
        left = _cut(left.join(_beside(gone.withColumnRenamed("id", "src"), n), "src", "left_anti").join(_beside(gone.withColumnRenamed("id", "dst"), n), "dst", "left_anti").select("src", "dst"))
    if not found:
        return ids.select("id", F.col("id").alias("component"))
    return ids.join(reduce(DataFrame.union, found), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def bow_tie(edges: DataFrame) -> DataFrame:
    """``id, component, zone``: CORE (the largest strong component, the smallest vertex deciding ties, and what lies on ways
    from it to it), IN (reaches it), OUT (is reached), TENDRIL."""
    parts = _cut(strong_components(edges))
    core = parts.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    starts = parts.join(F.broadcast(core.select("component")), "component", "left_semi").select("id")  # one row
    after = reached(starts, edges).select("id", F.lit(True).alias("after"))
    before = reached(starts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("id", F.lit(True).alias("before"))
    a, b = F.col("after").isNotNull(), F.col("before").isNotNull()
    zone = F.when(a & b, "CORE").when(b, "IN").when(a, "OUT").otherwise("TENDRIL")
    return parts.join(after, "id", "left").join(before, "id", "left").select("id", "component", zone.alias("zone"))


def clustering_in(vertices: DataFrame, edges: DataFrame, *, least: int = 10) -> DataFrame:
    """``id, n_in, clustering``: the share of ordered pairs of a vertex's distinct sources that are edges themselves; 0 for
    fewer than two sources, -1 for fewer than ``least``. Exact for every vertex (none is sampled): paths a -> b -> v whose
    a -> v is an edge are counted, each middle vertex's targets being the probe side of an equi-join. Paths are many more than edges:
    they are hashed to tasks of about 260,000 edges and looked up there, and aren't sorted."""
    links = _cut(edges.select("src", "dst").filter("src <> dst").distinct())
    n_in = links.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    wanted = _cut(links.join(n_in.filter(F.col("n_in") >= least).select(F.col("id").alias("dst")), "dst", "left_semi"))
    paths = links.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(wanted.select(F.col("src").alias("b"), F.col("dst").alias("v")), "b")
    ends = spread(wanted.select(F.col("src").alias("a"), F.col("dst").alias("v")), wanted.count(), "a", "v", each=1 << 18)
    closed = paths.join(ends.hint("shuffle_hash"), ["a", "v"], "left_semi").groupBy(F.col("v").alias("id")).agg(F.count("*").alias("n"))
    k = F.coalesce("n_in", F.lit(0))
    share = F.when(k < 2, 0.0).when(k < least, -1.0).otherwise(F.coalesce("n", F.lit(0)) / (k * (k - 1)))
    return vertices.select("id").distinct().join(n_in, "id", "left").join(closed, "id", "left").select("id", k.alias("n_in"), share.alias("clustering"))


def hub_class(n_in: Column, clustering: Column, *, least: int = 50) -> Column:
    """DEFINITIONAL (much cited, sources unrelated) or FUNCTIONAL (sources cite each other) hubs; null for others."""
    big = (n_in >= least) & (clustering >= 0)
    return F.when(big & (clustering < 0.05), "DEFINITIONAL").when(big & (clustering > 0.15), "FUNCTIONAL")


def debtrank(values: DataFrame, depends: DataFrame, *, seeds: int = 500, threshold: float = 0.01) -> DataFrame:
    """``seed, debtrank, n_hit``: how much value is hit when each of the ``seeds`` vertices of the largest positive value fails.

    ``depends`` (src, dst, share): src depends on dst to that share. Distress goes level by level; what a level hands to a
    vertex that isn't distressed yet is summed and clipped at 1, above ``threshold`` the vertex is distressed and hands on,
    once. debtrank is the sum of distress * value without the seed."""
    links = _cut(depends.select(F.col("dst").alias("id"), F.col("src").alias("dep"), "share"))
    top = values.filter("value > 0").orderBy(F.desc("value"), "id").limit(seeds)
    state = _cut(top.select(F.col("id").alias("seed"), "id", F.lit(1.0).alias("h"), F.lit(0).alias("level")))  # level: when it became distressed
    level = 0
    while state.filter(F.col("level") == level).limit(1).count():
        handed = state.filter(F.col("level") == level).join(links, "id").groupBy("seed", F.col("dep").alias("id")).agg(F.sum(F.col("h") * F.col("share")).alias("more"))
        level += 1
        both = state.join(handed, ["seed", "id"], "full_outer")
        h = F.when(F.col("level").isNotNull(), F.col("h")).otherwise(F.least(F.coalesce("h", F.lit(0.0)) + F.coalesce("more", F.lit(0.0)), F.lit(1.0)))
        state = _cut(both.select("seed", "id", h.alias("h"), F.coalesce("level", F.when((h > threshold) & F.col("more").isNotNull(), level)).alias("level")))
    hit = state.filter("seed <> id").join(values.select("id", "value"), "id", "left").groupBy("seed").agg(F.sum(F.col("h") * F.coalesce("value", F.lit(0.0))).alias("debtrank"), F.count("*").alias("n_hit"))
    return top.select(F.col("id").alias("seed")).join(hit, "seed", "left").select("seed", F.coalesce("debtrank", F.lit(0.0)).alias("debtrank"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"))


def systemic_risk(budget: Column, n_in: Column, amendments: Column, ignored: Column) -> Column:
    """The unscaled risk of a statute in force: a floor of 30,000 for any law, its citations to the power of 0.6, the logarithm of
    its amendments (3 at least), and up to half more for ignored concerns."""
    churn = F.greatest(F.lit(3.0), F.log2(2 + amendments))
    return F.sqrt(30_000 + budget) * F.pow(1 + n_in, F.lit(0.6)) * churn * (1 + 0.5 * F.least(F.coalesce(ignored, F.lit(0.0)), F.lit(1.0)))


def ranks(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``rows`` with their place (from 1) in the order, which must be total: rows are dealt by range, numbered within each
    range, and moved up by the sizes of the ranges before; so no task sees more than its own range."""
    dealt = _cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
