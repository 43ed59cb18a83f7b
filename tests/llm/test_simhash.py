from beadframe.llm import simhash
from collections import defaultdict

import xxhash


def plain_fingerprint(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    names = sorted({f for _, f in fp})
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    low = defaultdict(lambda: None)
    for i, f in fp:
        if i is not None:
            r = find(f)
            low[r] = i if low[r] is None else min(low[r], i)
    return sorted(((i, f, low[find(f)]) for i, f in fp), key=str)


def got(df):
    return sorted(((r.id, r.fp % 2**64, r.component_id) for r in df.collect()), key=str)


ROWS = [
    (7, "the same words are here in this text"), (3, "The SAME words are here in this text"), (9, None), (4, ""), (5, " \n\t "),
    (None, "the same words are here in this text"), (8, "one two"), (8, "one two"), (11, "longer " * 3000 + "end"), (2, "a b c d e"),
    (12, "é ü ñ \U0001f600 x y z"),
]


def test_edge_rows(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in ROWS], "doc_id long, text string, fp string, root int")
    assert got(simhash.near_duplicates(df)) == brute(ROWS)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 8, 11, 12]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.deduplicate(df).count() == 0


def test_against_brute_force(spark):
    import duckdb

    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.01/documents.parquet'").fetchall()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.near_duplicates(df)) == brute(rows)


def test_links_are_exact_for_random_fingerprints(spark):
    import random

    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for x in base:
        for n in range(1, 8):
            y = x
            for b in rnd.sample(range(64), n):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    want = {(min(s), max(s)) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4 for s in [[x - (x >> 63 << 64) for x in (a, b)]]}
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    found = [(r.u, r.v) for r in simhash.links(df).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_crowded_variants_give_a_forest(spark):
    import random

    rnd = random.Random(9)
    centre = [rnd.getrandbits(64) for _ in range(3)]
    fps = {x ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))) for x in centre for _ in range(60)}
    fps = sorted(x - (x >> 63 << 64) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")

    def classes(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(y for y in fps if find(y) == find(x)) for x in fps}

    plain = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    found = [(r.u, r.v) for r in simhash.links(df, dense=20).collect()]
    assert classes(found) == classes(plain)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in found)


def near_copies(n, most, seed=4):
    """Distinct fingerprints (signed) that differ from one in up to ``most`` bits."""
    import random

    rnd, centre, out = random.Random(seed), random.Random(1).getrandbits(64), set()
    while len(out) < n:
        out.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(most + 1))))
    return sorted(x - (x >> 63 << 64) for x in out)


def test_near_copies_of_one_text_give_few_links(spark):
    fps = near_copies(230, 2)  # every two of them link, and no variant is shared by over 256
    found = simhash.connecting(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    assert len(found) <= 4 * len(fps)
    assert all(r.u in fps and r.v in fps for r in found)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        root[find(r.u)] = find(r.v)
    assert len({find(x) for x in fps}) == 1


def test_crowded_variants_are_bucketed_in_few_rows(spark, monkeypatch):
    seen = []
    real = simhash.stars
    monkeypatch.setattr(simhash, "stars", lambda buckets, *rest: seen.append(buckets.count()) or real(buckets, *rest))
    fps = near_copies(120, 3)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    parts = simhash.connected_components(simhash.links(df, dense=10))
    assert parts.select("root").distinct().count() == 1 and parts.count() == len(fps)
    assert 0 < sum(seen) <= 15 * len(fps)


def test_connecting_keeps_the_classes_of_brute_force(spark):
    fps = near_copies(150, 7, seed=11) + [x ^ 1 << 40 for x in near_copies(20, 7, seed=12)]
    fps = sorted(set(fps))
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                root[find(b)] = find(a)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {frozenset(y for y in fps if find(y) == find(x)) for x in fps}
    for dense in (5, 256):
        parts = {r.node: r.root for r in simhash.connected_components(simhash.connecting(df, dense=dense)).collect()}
        assert {frozenset(y for y in fps if parts.get(y, y) == parts.get(x, x)) for x in fps} == want
