import math
import random

import pytest
import xxhash
from beadframe.llm import page_diff as p

SCHEMA = "page_id long, url string, html string, key int, lines string"


def plain_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rnd = random.Random(2)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randrange(25))] for _ in "ab")
        for cells in (5, 10**8):
            c = p.common_lines(a, b, cells)
            assert all(a[i] == b[j] for i, j in c) and c == sorted(c) and len(c) == plain_lcs(a, b)
            assert len({i for i, _ in c}) == len({j for _, j in c}) == len(c)


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("just text &amp; more&nbsp;x", "just text & more x"), ("<p>a<p>b <b>c</b>\n d<br>e", "a\n\nb c d e"),
        ("<nav>menu</nav><article><h1>T</h1><p>x</p><div class='comments'><p>me too</p></div></article><footer>f</footer>", "T\n\nx"),
        ("<script>var t='</p>'</script><style>p{}</style><!-- no --><p>yes", "yes"), ("<p>cut off <a href='x", "cut off"),
        ("<div class='ad-slot'>buy</div><div class='sidebar'>s</div><p>text</p><form>q</form>", "text"),
        ("<div class='has-sidebar'><p>kept</p></div><div style='display:none'>no</div><aside>no</aside><header>no</header>", "kept"),
        ("<div class=cookie-notice><article><p>real</p></article>", "real"), ("<ul><li>one<li>two</ul>", "one\n\ntwo"), ("<!-- never closed <p>x", ""),
    ],
)
def test_markup(page, text):
    lines, kinds = p.lines_of(page)
    assert p.main_text(lines, kinds) == text


def brute(rows):
    """A host at a time, in plain loops; parsing and alignment, which have tests of their own, are shared."""
    both = {r: p.lines_of(r[2]) for r in set(rows)}
    first = {}
    for r, (lines, kinds) in both.items():
        host, path = p.place_of(r[1])
        if host:
            page, place = (host, tuple(lines), tuple(kinds)), (path.replace("/", "\x01"), r[0] is not None, r[0] or 0)
            if page not in first or place < first[page][0]:
                first[page] = (place, path.split("/"))
    gone = {}
    for host in {k[0] for k in first}:
        pages = [k for _, k in sorted((v[0], k) for k, v in first.items() if k[0] == host)]
        having = {}
        for _, lines, _ in pages:
            for x in set(lines):
                having[x] = having.get(x, 0) + 1

        def look(i, j):
            """(near copy, deleted places) of page i beside page j."""
            (_, a, ka), (_, b, kb) = pages[i], pages[j]
            pairs = p.common_lines(list(a), list(b))
            kind = 1 if 1 in ka else 2
            near = True
            for weight in (len, lambda x: len(x) * math.log((len(pages) + 1) / having[x])):
                whole = sum(weight(x) for x, k in zip(a, ka) if k == kind)
                near = near and bool(whole) and sum(weight(a[x]) for x, _ in pairs if ka[x] == kind) / whole >= 0.8
            return near, {x for x, y in pairs if not ka[x] == kb[y] == 1}

        def order(i, those):
            def far(j):
                a, b = first[pages[i]][1], first[pages[j]][1]
                leading = 0
                while leading < min(len(a), len(b)) and a[leading] == b[leading]:
                    leading += 1
                return -leading, abs(i - j), j - i

            return sorted((j for j in those if 0 <= j < len(pages)), key=far)

        def settled(i, those):
            for j in order(i, those):
                near, places = look(i, j)
                if not near:
                    return places

        n = len(pages)
        met = [settled(i, (i - 2, i - 1, i + 1, i + 2)) for i in range(n)]
        # Pages that a raw look settles at once have no near copies beside them.
        raw = [any(sum(len(pages[i][1][x]) for x, _ in p.common_lines(list(pages[i][1]), list(pages[j][1])) if pages[i][2][x] == (1 if 1 in pages[i][2] else 2)) >= 0.8 * sum(len(x) for x, k in zip(*pages[i][1:]) if k == (1 if 1 in pages[i][2] else 2)) > 0 for j in order(i, (i - 2, i - 1, i + 1, i + 2))[:1]) for i in range(n)]
        linked = [(raw[i] and look(i, i + 1)[0]) or (raw[i + 1] and look(i + 1, i)[0]) for i in range(n - 1)]
        for i in range(n):
            low = high = i
            while low and linked[low - 1]:
                low -= 1
            while high < n - 1 and linked[high]:
                high += 1
            reach = 0
            while met[i] is None and (low - reach > 0 or high + reach < n - 1):
                met[i] = settled(i, [x for k in range(reach + 1, reach + 5) for x in (low - k, high + k)])
                reach += 4
            gone[pages[i]] = met[i] or set()
    out = []
    for r in rows:
        lines, kinds = both[r]
        kind = 1 if 1 in kinds else 2
        drop = gone.get((p.place_of(r[1])[0], tuple(lines), tuple(kinds)), ())
        out.append((r[0], r[1], "\n\n".join(x for i, x in enumerate(lines) if kinds[i] == kind and i not in drop)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(None, None, None), (1, "no host", "<p>alone"), (2, "http://h/a", ""), (2, "http://h/a", "")]
    for i in range(3, 90):
        host = rnd.choice(["one.example", "one.example", "two.example", "Three.example"])
        body = "".join(f"<p>text {rnd.randrange(10**6)} of page {i}</p>" for _ in range(rnd.randrange(6)))
        extra = f"<p>all about {host.lower()}</p><div>menu of {host.lower()}</div>"
        rows.append((i, f"https://{host}/s{rnd.randrange(3)}/{rnd.randrange(999)}?x=1", extra + body + f"<p>contact {host.lower()}</p>"))
    rows += [(200 + i, f"http://one.example/s1/{i}", rows[9][2]) for i in range(5)]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA)
    got = sorted(((r.page_id, r.url, r.text) for r in p.extract(df).collect()), key=str)
    assert got == brute(rows)
    long = ["all about" in t for i, _, t in got if i and 3 <= i < 90 and t.count("text ") > 4]
    assert not any(long)  # what the pages of a host share goes


def test_pages_without_containers_or_telling_names(spark):
    """Differencing alone, the expected text written out; copies and near copies lie between."""
    rows, want = [], {}
    for i in range(40):
        own = [f"Article {i} says {k} things that no other page says." for k in range(2 + i % 3)]
        body = "".join(f"<div>{x}</div>" for x in own)
        html = f"<div>Home</div><div>Contact us</div>{body}<div>Made by us</div><div>All rights kept</div>"
        rows.append((i, f"http://plain.example/a/{i:03}", html))
        want[i] = "\n\n".join(own)
    base = [f"Line {k} of the article with many copies." for k in range(30)]
    for i in range(100, 140):  # near copies side by side: each has one line of its own
        own = [*base[:15], f"Edition {i}.", *base[15:]]
        rows.append((i, f"http://plain.example/b/{i:03}", "<div>Home</div><div>Contact us</div>" + "".join(f"<div>{x}</div>" for x in own) + "<div>Made by us</div><div>All rights kept</div>"))
        want[i] = "\n\n".join(own)
    for i in range(200, 220):  # copies under other addresses
        rows.append((i, f"http://plain.example/a/007?page={i}", rows[7][2]))
        want[i] = want[7]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA).repartition(3)
    assert {r.page_id: r.text for r in p.extract(df).collect()} == want


@pytest.mark.parametrize("n", [3, 20])
def test_furniture_that_is_most_of_every_page(spark, n):
    """Twelve unmarked lines on every page and one of its own: only that one stays."""
    furniture = [f"<div>Menu entry number {k}</div>" for k in range(12)]
    rows = [(i, f"http://shop.example/{i:02}", "".join([*furniture[:6], f"<div>Item {i} costs {i * 7} crowns.</div>", *furniture[6:]])) for i in range(n)]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA).repartition(3)
    assert {r.page_id: r.text for r in p.extract(df).collect()} == {i: f"Item {i} costs {i * 7} crowns." for i in range(n)}
    assert sorted(((i, u, f"Item {i} costs {i * 7} crowns.") for i, u, _ in rows), key=str) == brute(rows)


@pytest.mark.parametrize("other", [0, 3, 6, 11])
def test_a_different_page_at_any_distance(spark, other):
    """Near copies but for one page, wherever it lies: all are compared with it."""
    rows, want = [], {}
    for i in range(12):
        own = ["A page of its own.", "It has nothing of the others."] if i == other else [f"Edition {i}.", *(f"Line {k} of an article with many editions." for k in range(20))]
        rows.append((i, f"http://press.example/{i:02}", "<div>Home</div><div>Contact us</div>" + "".join(f"<div>{x}</div>" for x in own) + "<div>Made by us</div>"))
        want[i] = "\n\n".join(own)
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA).repartition(2)
    assert {r.page_id: r.text for r in p.extract(df).collect()} == want
    assert {i: t for i, _, t in brute(rows)} == want


def test_very_long_pages(spark):
    body = "".join(f"<p>sentence {k} of a very long page</p>" for k in range(30_000))
    rows = [(1, "http://l.example/1", f"<div>Home</div>{body}"), (2, "http://l.example/2", "<div>Home</div><p>short</p>")]
    got = {r.page_id: r.text for r in p.extract(spark.createDataFrame([(*r, 7, "z") for r in rows], SCHEMA)).collect()}
    assert got[2] == "short" and got[1].count("\n\n") == 29_999 and not got[1].startswith("Home")


def test_markup_protects_and_drops(spark):
    page = "<div>Home</div><article><p>Quoted in both.</p><p>Own {0}.</p></article><div class='comments'><p>Reader {0}</p></div><div>Made by us</div>"
    df = spark.createDataFrame([(i, f"http://q.example/{i}", page.format(i), 1, "") for i in range(3)] + [(9, "http://q.example/9", "<div>Home</div><p>Only this.</p><div>Made by us</div>", 1, "")], SCHEMA)
    got = {r.page_id: r.text for r in p.extract(df).collect()}
    assert got == {0: "Quoted in both.\n\nOwn 0.", 1: "Quoted in both.\n\nOwn 1.", 2: "Quoted in both.\n\nOwn 2.", 9: "Only this."}


def test_given_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted(((r.page_id, r.url, r.text) for r in p.extract(spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert p.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hash_fits():
    assert -(1 << 63) <= xxhash.xxh64_intdigest("x") - (1 << 63) < 1 << 63
