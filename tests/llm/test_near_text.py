from collections import defaultdict

import corpus_pipeline
from beadframe.llm import near_text
from test_simhash import plain_fingerprint


def plain_set(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({b" ".join(w)} if w else set())


def brute(rows):
    """Ids that stay: the smallest of each class under five-word Jaccard of 0.8 or more, or op5's links."""
    sets, root = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}
    having = defaultdict(list)
    for i, s in sets.items():
        for x in s or {b""}:
            having[x].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    shared = defaultdict(int)
    for ids in having.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] += 1
    pairs = [(a, b) for (a, b), n in shared.items() if not sets[a] or 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n)]
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    pairs += [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 4]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i for i in root if find(i) == i}


def test_stage_against_brute_force_jaccard(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()} == brute(rows)


def test_few_changed_words(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(100, " ".join(words)), (8, ""), (9, None), (10, "One two"), (11, "one TWO"), (12, "one two three")]
    for k in range(1, 40):  # a chain: each is like its neighbours, few are like the first
        words = words.copy()
        words[k * 7] = f"x{k}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, " ".join(f"y{i}" if i % 12 or k == 0 else f"z{i}" for i in range(300))) for k in range(2)]  # 0.4: no copies
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, node string")
    kept = near_text.deduplicate(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == brute(rows) == {8, 10, 12, 100, 200, 201}


def test_crowded_buckets(spark):
    """Many texts around a long common passage, and many near copies of one text: no pairs of all."""
    import random

    rnd, rows = random.Random(6), []
    passage = " ".join(f"p{i}" for i in range(150))
    for i in range(90):  # 0.55 in common: no copies of each other
        own = " ".join(f"o{i}x{k}" for k in range(60))
        rows.append((i, f"{own} {passage} {own[::-1]}"))
    base = [f"b{i}" for i in range(400)]
    rows.append((1000, " ".join(base)))
    for i in range(120):  # each is like the first text, few are like each other
        words = base.copy()
        for k in range(rnd.randrange(3, 9)):
            words[rnd.randrange(400)] = f"c{i}x{k}"
        rows.append((1001 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_text.deduplicate(df).collect()} == brute(rows)
    sets = spark.createDataFrame([(i, sorted(hash(x) for x in plain_set(t))) for i, t in rows], "node long, shingles array<long>")
    rare = near_text.rare_shingles(sets)
    a, b = rare.alias("a"), rare.alias("b")
    met = a.join(b, "key").where("a.node < b.node").where(near_text.may_share_enough("a", "b")).select("a.node", "b.node").distinct().collect()
    plain = {i: plain_set(t) for i, t in rows}
    want = {(x, y) for x in plain for y in plain if x < y and 10 * len(plain[x] & plain[y]) >= 8 * len(plain[x] | plain[y])}
    assert want <= {tuple(r) for r in met} and not any(r[0] < 90 for r in met)
