import random

from beadframe.llm import decontam as d

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x.decode() for x in (text or "").translate(LOW).encode().split()]
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({" ".join(w)} if w else set())


def brute(docs, items):
    out = set()
    for i, t in docs:
        s = shingles(t)
        for j, x in items:
            n = shingles(x)
            if n and len(n & s) / len(n) >= 0.8:
                out.add((i, j, len(n & s), len(n)))
    return out


def got(spark, docs, items):
    a = spark.createDataFrame([(*r, "z", 2) for r in docs], "doc_id long, text string, mark string, item_id int")
    b = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, shingle string")
    return {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in d.contained_items(a, b).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choices(words, k=n))) for i, n in enumerate([5, 6, 7, 9, 14, 20, 33, 60, 120, 400])]
    docs = []
    for i in range(150):
        body = rnd.choices(words, k=rnd.choice([0, 3, 50, 2000]))
        if i % 2:
            piece = rnd.choice(items)[1].split()
            for _ in range(rnd.randrange(3) if len(piece) > 30 else 0):
                piece[rnd.randrange(len(piece))] = "changed"
            at = rnd.randrange(len(body) + 1)
            body[at:at] = [w.upper() if rnd.random() < 0.2 else w for w in piece]
        docs.append((i, rnd.choice([" ", "\n", " \t "]).join(body)))
    docs += [(None, items[3][1]), (7, items[4][1]), (7, items[4][1]), (900, None), (901, " ".join(["x y"] * 40000) + " " + items[7][1])]
    want = brute(docs, items)
    assert len(want) > 50 and got(spark, docs, items) == want


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "two words"), (4, "a b c d e f"), (5, "b c d e f")]
    items = [(1, ""), (2, None), (3, "Two  Words"), (4, "a b c d e"), (4, "a b c d e"), (None, "b c d e f")]
    assert got(spark, docs, items) == {(3, 3, 1, 1), (4, 4, 1, 1), (4, None, 1, 1), (5, None, 1, 1)}
    assert got(spark, [], items) == set() and got(spark, docs, []) == set()


def test_phrase_of_all_items_and_documents(spark):
    phrase = "choose the one best answer to this question"
    items = [(i, f"{phrase} " + " ".join(f"i{i}w{k}" for k in range(20))) for i in range(60)]
    docs = [(i, f"{phrase} d{i} " + " ".join(f"x{i}y{k}" for k in range(i % 9))) for i in range(200)]
    docs += [(1000 + i, "before " + items[i][1] + " after") for i in range(0, 60, 7)] + [(2000, " ".join(x for _, x in items))]
    assert got(spark, docs, items) == brute(docs, items) != set()


def test_filters_of_any_size_hold_their_values():
    import numpy as np

    x = d.scrambled(np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64))
    for width in (d.LEAST_BITS, 25, d.MOST_BITS):
        bits = np.zeros(1 << width, bool)
        bits[d.all_slots(x[:2000], width)] = True
        found = d.present(np.packbits(bits, bitorder="little"), np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64))
        assert set(range(2000)) <= set(found.tolist()) and len(found) < 2020
    assert d.filter_bits(0) == d.LEAST_BITS and d.filter_bits(10**9) == d.MOST_BITS and 2 ** d.filter_bits(10**6) >= 64 * 10**6


def test_removal(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1), (1, "other text that is clean", 2), (None, "x a b c d e", 3), (None, None, 4)], "doc_id long, text string, mark int")
    items = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    kept = d.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.mark for r in kept.collect()) == [2, 4]
