"""Graph loops that run to their end, against plain Python."""

from ledgerline.operators import graphs as G


def test_reached_goes_to_the_end(spark):
    chain = [(k, k + 1) for k in range(30)] + [(30, 5), (40, 3), (50, 51)]
    edges = spark.createDataFrame(chain, "src long, dst long")
    starts = spark.createDataFrame([(2,)], "id long")
    assert {r["id"]: r["hops"] for r in G.reached(starts, edges).collect()} == {k: k - 2 for k in range(2, 31)}
    back = G.reached(starts, edges.selectExpr("dst AS src", "src AS dst"))
    assert {r["id"]: r["hops"] for r in back.collect()} == {2: 0, 1: 1, 0: 2}
    assert G.reached(starts.limit(0), edges).count() == 0


EDGES = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (4, 4), (5, 9), (6, 1), (7, 6), (8, 7), (2, 8)]
OWN = {1: 1000.0, 2: 50.0, 3: 0.0, 4: 700.0, 5: 10.0, 6: 0.0, 7: 900.0, 8: 5.0, 10: 3.0}


def plain_propagation(own, edges, alpha=0.3):
    out = {s: sum(a == s for a, _ in edges) for s, _ in edges}
    ids = set(own) | {x for e in edges for x in e}
    now, rounds = {v: own.get(v, 0.0) for v in ids}, 0
    while rounds < 20:
        new = {v: own.get(v, 0.0) + alpha * sum(now[s] / out[s] for s, t in edges if t == v) for v in ids}
        most, now, rounds = max(abs(new[v] - now[v]) for v in ids), new, rounds + 1
        if most < 1:
            break
    return now, rounds


def plain_pagerank(ids, edges):
    edges = [e for e in edges if e[0] in ids and e[1] in ids]
    out = {s: sum(a == s for a, _ in edges) for s, _ in edges}
    now, rounds = dict.fromkeys(ids, 1 / len(ids)), 0
    while rounds < 100:
        new = {v: 0.15 / len(ids) + 0.85 * sum(now[s] / out[s] for s, t in edges if t == v) for v in ids}
        change, now, rounds = sum(abs(new[v] - now[v]) for v in ids), new, rounds + 1
        if change < 1e-8:
            break
    return {v: r / max(now.values()) for v, r in now.items()}, rounds


def test_propagation_and_pagerank_run_until_they_settle(spark):
    vertices, edges = spark.createDataFrame(list(OWN.items()), "id long, own double"), spark.createDataFrame(EDGES, "src long, dst long")
    want, rounds = plain_propagation(OWN, EDGES)
    got = {r["id"]: r["value"] for r in G.propagation_converged(vertices, edges).collect()}
    assert rounds > 3 and got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    want, rounds = plain_pagerank(set(OWN), EDGES)
    got = {r["id"]: r["rank"] for r in G.pagerank_converged(vertices, edges).collect()}
    assert rounds > 3 and got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_one_round_by_hand(spark):
    # 1 cites 2 twice and 3 once; 2 cites 3: mass goes to the cited, split by the citing one's references
    vertices = frame(spark, [(1, 300.0), (2, 30.0), (3, 3.0), (4, 4.0)], "id long, own double")
    edges = frame(spark, [(1, 2), (1, 2), (1, 3), (2, 3)], "src long, dst long")
    got = {r["id"]: round(r["value"], 9) for r in G.propagation(vertices, edges, rounds=1).collect()}
    assert got == {1: 300.0, 2: 30 + 0.3 * 200, 3: 3 + 0.3 * (100 + 30), 4: 4.0}
    got = {r["id"]: round(r["value"], 9) for r in G.katz(vertices, edges, alpha=0.1, rounds=1).collect()}
    assert got == {1: 300.0, 2: 30 + 0.1 * 600, 3: 3 + 0.1 * (300 + 30), 4: 4.0}


def test_successors_end_at_cycles_and_skip_mass_repealers(spark):
    repeals = [(2, 1), (3, 2), (9, 2), (5, 4), (4, 5), (6, 7), *((10, k) for k in range(20, 27)), (11, 20)]
    chain = G.successors(frame(spark, repeals, "repealer long, repealed long"))
    assert {r["id"]: r["successor"] for r in chain.collect()} == {1: 2, 2: 3, 4: 5, 5: 4, 7: 6, 20: 11}
    ends = G.followed(frame(spark, [(1,), (4,), (5,), (7,), (20,), (99,)], "id long"), chain)
    assert {r["id"]: r["last"] for r in ends.collect()} == {1: 3, 4: 4, 5: 5, 7: 6, 20: 11, 99: 99}


def test_components_and_zones(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 6), (8, 9), (7, 8), (2, 2)]
    got = {r["id"]: (r["component"], r["zone"]) for r in G.bow_tie(frame(spark, edges, "src long, dst long")).collect()}
    assert got == {1: (1, "CORE"), 2: (1, "CORE"), 3: (1, "CORE"), 4: (4, "OUT"), 5: (4, "OUT"), 6: (6, "IN"), 7: (7, "IN"), 8: (8, "TENDRIL"), 9: (9, "TENDRIL")}
    chain = frame(spark, [(1, 2), (2, 3)], "src long, dst long")
    assert {r["id"]: r["component"] for r in G.strong_components(chain).collect()} == {1: 1, 2: 2, 3: 3}
    assert G.strong_components(chain.limit(0)).count() == 0


def test_clustering_counts_edges_between_sources(spark):
    edges = [(1, 9), (2, 9), (3, 9), (1, 2), (2, 1), (2, 3), (3, 8), (1, 8), (4, 7)]
    found = G.clustering_in(frame(spark, [(9,), (8,), (7,), (6,)], "id long"), frame(spark, edges, "src long, dst long"), least=3)
    assert {r["id"]: (r["n_in"], round(r["clustering"], 6)) for r in found.collect()} == {9: (3, 0.5), 8: (2, -1.0), 7: (1, 0.0), 6: (0, 0.0)}


def plain_debtrank(values, links, seed, threshold=0.01):
    h, done, active = {seed: 1.0}, {seed}, [seed]
    while active:
        more = {}
        for s, t, w in links:
            if t in active and s not in done:
                more[s] = more.get(s, 0.0) + h[t] * w
        active = []
        for s, m in more.items():
            h[s] = min(1.0, h.get(s, 0.0) + m)
            if h[s] > threshold:
                done.add(s)
                active.append(s)
    return sum(v * values.get(k, 0.0) for k, v in h.items() if k != seed), len(h) - 1


def test_debtrank_against_plain_python(spark):
    links = [(2, 1, 0.5), (3, 1, 0.004), (3, 2, 0.9), (4, 3, 1.0), (1, 4, 0.3), (5, 2, 0.01), (5, 4, 0.002), (6, 7, 1.0)]
    values = {1: 100.0, 2: 50.0, 3: 20.0, 4: 10.0, 5: 5.0, 7: 1.0, 8: 0.0}
    found = G.debtrank(frame(spark, list(values.items()), "id long, value double"), frame(spark, links, "src long, dst long, share double"), seeds=6)
    got = {r["seed"]: (round(r["debtrank"], 9), r["n_hit"]) for r in found.collect()}
    want = {s: plain_debtrank(values, links, s) for s in (1, 2, 3, 4, 5, 7)}
    assert got == {s: (round(v, 9), n) for s, (v, n) in want.items()}


def test_ranks_are_the_sorted_places(spark):
    rows = [((k * 7919) % 1000, k) for k in range(1000)]
    got = {(r["a"], r["b"]): r["rank"] for r in G.ranks(frame(spark, rows, "a long, b long"), "a", "b").collect()}
    assert got == {r: k + 1 for k, r in enumerate(sorted(rows))}
