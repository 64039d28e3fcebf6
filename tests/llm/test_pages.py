import html as entities
import itertools
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from cellweave.llm import pages as module
from cellweave.llm.pages import Node, Wrapper, main_texts, match, op7_main_text, page_text, parse, set_shapes, signature

SF = "/root/testdata/sf0.01"


def tree(spec):
    node = Node(spec[0])
    node.children = [tree(s) for s in spec[1:]]
    set_shapes(node)
    return node


def best_matching(a, b):
    """The largest simple tree matching, over all ordered pairings of the children."""
    if a.tag != b.tag:
        return 0
    best = 0
    for k in range(min(len(a.children), len(b.children)) + 1):
        for x in itertools.combinations(a.children, k):
            for y in itertools.combinations(b.children, k):
                each = [best_matching(u, v) for u, v in zip(x, y, strict=True)]
                if all(each):
                    best = max(best, sum(each))
    return best + 1


def test_matching_is_the_largest():
    r = random.Random(8)

    def grow(depth):
        return [r.choice("pd"), *(grow(depth - 1) for _ in range(r.randrange(4) if depth else 0))]

    for _ in range(150):
        a, b = tree(["d", *grow(2)[1:]]), tree(["d", *grow(2)[1:]])
        pairs = []
        assert match(a, b, pairs) == best_matching(a, b) == len(pairs) == match(b, a, [])
        assert all(u.tag == v.tag for u, v in pairs) and len({id(u) for u, _ in pairs}) == len(pairs)


def test_wide_matching_is_the_same(monkeypatch):
    r = random.Random(3)
    kind = lambda: r.choice([["p"], ["d"], ["d", ["p"]], ["d", ["p"], ["d", ["p"]]], ["p", ["d"], ["d"]]])
    for n, m in ((1, 40), (37, 40), (60, 25)):
        a, b = tree(["d", *(kind() for _ in range(n))]), tree(["d", *(kind() for _ in range(m))])
        plain, wide = [], []
        size = match(a, b, plain)
        with monkeypatch.context() as patch:
            patch.setattr(module, "WIDE", 0)
            assert match(a, b, wide) == size == len(wide)
        assert [(id(u), id(v)) for u, v in wide] == [(id(u), id(v)) for u, v in plain] or sorted((id(u), id(v)) for u, v in wide) == sorted((id(u), id(v)) for u, v in plain)


def test_a_page_of_twenty_thousand_siblings():
    page = lambda seed: "<body>" + "".join(random.Random(seed * 7 + k).choice(["<p>a", "<div>b</div>", "<ul><li>c</ul>"]) for k in range(20_000))
    pairs = module.Pivot(page(1)).align(parse(page(2))[0])
    assert 13_000 < len(pairs) < 60_000


SLUGS = [
    '<section id="discussion"><p>kept</p></section>', '<section id="related-work"><p>kept</p></section>', '<h2 id="Search">kept</h2>', '<h2 id="footer-design">kept</h2>', '<p class="notice">kept</p>', '<div class="navigation-systems">kept</div>',
    '<div class="alert alert-info">kept</div>', '<ul><li id="reply-1">kept</li></ul>', '<table class="widget"><tr><td>kept</table>', "<p>k<math><mi>e</mi><mo>p</mo><annotation>no</annotation></math></p><p>t</p>", "<xmp>ke<b>pt</xmp>",
]


@pytest.mark.parametrize("slug", SLUGS)
def test_names_of_text_in_the_article_are_no_furniture(slug):
    root, blocks, owners = parse(f"<body><nav>no</nav><article><h1>one</h1>{slug}<p>two</p></article><div class=ad-slot>no</div></body>")
    got = " ".join(blocks[k] for k in page_text(owners, module.furniture(root, blocks, owners), set()))
    assert got in ("one kept two", "one kep t two", "one ke<b>pt two")


def test_varying_text_under_slugs_stays(spark):
    page = lambda k: f"<body><nav><a>Menu</a></nav><div><h1>story {k}</h1><h2 id=search>{k} looks</h2><section id=discussion><p>{k} talks of it</p></section><p>and ends {k}</p></div><footer>c</footer>"
    got = extract(spark, [(k, f"https://www.one.org/{k}", page(k)) for k in range(12)])
    assert got[3, "https://www.one.org/3"][0] == "story 3 3 looks 3 talks of it and ends 3"


def extract(spark, pages):
    df = spark.createDataFrame([(i, u, h, "clash") for i, u, h in pages], "page_id long, url string, html string, host string")
    return {(r.page_id, r.url): (r.text, r.n_chars) for r in main_texts(df).collect()}


FURNITURE = [
    "<nav><ul><li>Home<li>Menu</ul></nav>", "<header><h1>The site</h1></header>", "<aside>aside</aside>", '<div class="ad-slot">Buy</div>', "<div id=cookieNotice>We use</div>",
    "<form><p>Your mail<input></form>", "<script>var x='<p>no</p>'</script>", "<style>p{}</style>", "<!-- a <p>comment</p> -->", '<section class="comments"><article class="comment"><p>First!</p></article></section>',
    '<div role="contentinfo">c</div>', "<footer>&copy; x</footer>", '<div style="display: none">hid</div>', "<p hidden>hid</p>", "<noscript>Enable</noscript>", "<button>Go</button>",
]


def test_furniture_goes_and_the_article_stays(spark):
    article = '<h1>T &amp; &lt;b&gt;&#39;s</h1><p>one <b>two</b>th<i>ree</i>\n\t four<br>five&nbsp;six<p><b>open seven<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><div class="ad">x</div>tail &am'
    pages = [(k, f"http://h{k}.x/", f"<html><head><title>no</title></head><body>{f}<article>{article}</article>{f}</body></html>") for k, f in enumerate(FURNITURE)]
    want = "T & <b>'s one twothree four five six open seven a b c d tail &am"
    got = extract(spark, pages)
    assert set(got.values()) == {(want, len(want))}
    plain = [(k, f"http://h{k}.x/", f"<body>{f}<div><p>only this</div>{f}") for k, f in enumerate(FURNITURE)]
    assert set(extract(spark, plain).values()) == {("only this", 9)}


def test_wrapper_without_marks(spark):
    page = lambda k: f"<body><div>Welcome to our place</div><div><p>story {k} begins<p>the same line<p>and ends {k}</div><div>All rights</div>"
    got = extract(spark, [(k, f"https://www.one.org/{k}", page(k)) for k in range(8)] + [(9, "https://two.org/", page(9))])
    assert got[3, "https://www.one.org/3"][0] == "story 3 begins and ends 3"
    assert got[9, "https://two.org/"][0] == "Welcome to our place story 9 begins the same line and ends 9 All rights"


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><article><p>A copied story.<p>Twice told.</article>"
    got = extract(spark, [(k, f"http://a.b/{k}", page) for k in range(9)])
    assert {t for t, _ in got.values()} == {"A copied story. Twice told."}


def test_odd_rows(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after"
    pages = [(1, None, None), (2, "", ""), (3, "http://a.b", "plain < text > & more"), (None, "http://a.b/", "<p>x"), (4, "http://c", deep), (4, "http://c", deep), (5, "http://d.e", "<article><p>" + "long " * 100000), (6, "http://d.e/6", '<p title="unclosed>never</p>' * 300), (7, "nonsense", "<script>never closed <p>x")]
    got = extract(spark, pages)
    assert got[1, None] == ("", 0) and got[2, ""] == ("", 0) and got[7, "nonsense"] == ("", 0)
    assert got[3, "http://a.b"][0] == "plain < text > & more" and got[None, "http://a.b/"][0] == "x"
    assert got[4, "http://c"][0] == "deep after" and got[5, "http://d.e"][1] == 499999
    assert extract(spark, []) == {}
    assert parse("")[1] == []


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")
def test_pages_of_the_test_tables(spark):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op7_main_text(spark, SF).collect()}
    for k, page in source.items():
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        body = re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body).replace("<b>", "").replace("</b>", "")
        assert got[k] == " ".join(entities.unescape(body).split())


@pytest.mark.parametrize("hidden", ["<svg class=x />", "<math/>", "<svg><path d='m'/><title/><text>no</text></svg>", "<div><noscript>no</div>", "<div><select><option>no<option>no</div>", "<div><object>no</div>", "<p>a<noscript><div>no</div></noscript></p>", "<div>" * 250 + "<svg><text>no</text></svg>" + "</div>" * 250])
def test_hidden_elements_end_with_themselves_or_their_parent(hidden):
    root, blocks, owners = parse(f"<body>{hidden}<article><p>one{hidden}<p>two</article>{hidden}</body>")
    assert [blocks[k] for k in page_text(owners, module.furniture(root, blocks, owners), set()) if blocks[k] != "a"] == ["one", "two"]


@pytest.mark.skipif(not __import__("os").path.isdir(SF), reason="needs the test tables")
def test_the_wrapper_alone_finds_the_articles_of_the_test_tables(spark):
    """The given pages with all names, roles and telling tags removed: only what varies says where the article is."""
    bare = F.regexp_replace(F.regexp_replace("html", r"<(/?)(article|nav|footer|aside|header|main|section|form)\b[^>]*>", "<$1div>"), r'\s(class|id|role)="[^"]*"', "")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: r.text.split() for r in main_texts(pages).collect()}
    got = {r.page_id: r.text.split() for r in main_texts(pages.withColumn("html", bare)).collect()}
    common = sum((Counter(want[k]) & Counter(got[k])).total() for k in want)
    assert common / sum(map(len, got.values())) > 0.95 and common / sum(map(len, want.values())) > 0.95
    alone = {k: " ".join(t) for k, t in want.items()}
    assert sum(" ".join(got[k]) == alone[k] for k in got) > 0.9 * len(got)


@pytest.mark.parametrize("page", [
    '<div class="wrap no-sidebar"><article><p>the article</article></div>', '<div class="content has-banner"><p>the article</div>', '<form id="aspnetForm"><article><p>the article</article></form>',
    '<body><div class="page-with-menu"><div class="menu">x</div><p>the article</div>', '<div class="banner">x</div><form><div><p>the article</div><input></form>',
])
def test_a_doubtful_name_does_not_take_the_article(spark, page):
    assert extract(spark, [(1, "http://a.b/", page)])[1, "http://a.b/"][0] == "the article"


def test_text_is_joined_as_the_page_shows_it(spark):
    page = "<article><p>super<wbr>cali<img src=x>fragi <ruby>k<rp>(</rp><rt>an</rt></ruby> a<br>b</article>"
    assert extract(spark, [(1, None, page)])[1, None][0] == "supercalifragi k(an a b"


def test_depth_and_number_of_blocks_do_not_matter(spark):
    deep = lambda x: "<div>" * 300 + x + "</div>" * 300
    assert extract(spark, [(1, None, deep("<nav>menu</nav><p>the text")), (2, None, deep("<nav><div><p>menu</div></nav>the text"))]) == {(1, None): ("the text", 8), (2, None): ("the text", 8)}
    many = lambda k: "<body><div>" + "".join(f"menu {i}<br>" for i in range(1500)) + f"</div><div><p>words of story {k}<p>more of it {k * k}</div>"
    got = extract(spark, [(k, f"http://a.b/{k}", many(k)) for k in range(6)])
    assert all(text == f"words of story {k} more of it {k * k}" for (k, _), (text, _) in got.items())


def brute_force(pages):
    """What `main_texts` does, with dicts: every page of a host against both pivots, all texts of all slots counted."""
    hosts = {}
    for _, url, html in pages:
        hosts.setdefault(url.split("/")[2], []).append(html)
    wrappers = {}
    for host, all_html in hosts.items():
        usual = [h for h in all_html if len(h.encode()) <= 2 * sum(len(h.encode()) for h in all_html) / len(all_html)]
        ordered = sorted(set(usual), key=HASHES.get)
        pivots = sorted({ordered[0], ordered[-1]})
        rows = []
        for j, p in enumerate(pivots):
            pivot, seen, loose, prints = module.Pivot(p), {}, Counter(), set()
            for html in all_html:
                root, blocks, owners = parse(html)
                page = signature([blocks[k] for k in page_text(owners, module.furniture(root, blocks, owners), set())])
                prints.add(page)
                named, met = module.furniture(root, blocks, owners), Counter()
                own = Counter()
                for k, owner in enumerate(owners):
                    rank, met[id(owner)] = met[id(owner)], met[id(owner)] + 1
                    mass = (0.1 if named[k] else 3.0 if owner.main else 1.0) * len(blocks[k])
                    elem, rank = next(pivot.places([owner], [rank], pivot.align(root)))
                    if rank < 0:
                        own[elem] += mass
                    else:
                        seen.setdefault((elem, rank, blocks[k]), {}).setdefault(page, []).append(mass)
                for elem, m in own.items():
                    loose[elem, page] = max(loose[elem, page], m)
            if len(prints) < 2:
                continue
            mass, every, again = Counter(), Counter(), Counter()
            for (elem, _), m in loose.items():
                mass[elem] += m
            for (elem, rank, text), found in seen.items():
                n = len(found)
                mass[elem] += max(map(max, found.values())) if n == 1 else 0
                every[elem, rank] += n
                again[elem, rank] += n if n > 1 else 0
                for kind, share, least in ((module.TEXT, 0.5, 3), (module.STRICT, 0.8, 5)):
                    if rank >= 0 and n >= least and n >= share * len(prints):
                        rows.append({"pivot": j, "elem": elem, "rank": rank, "kind": kind, "text": module.digest(text), "mass": 0.0})
            rows += [{"pivot": j, "elem": e, "rank": -1, "kind": module.MASS, "text": 0, "mass": m} for e, m in mass.items() if m]
            rows += [{"pivot": j, "elem": e, "rank": r, "kind": module.SLOT, "text": 0, "mass": 0.0} for (e, r), n in again.items() if r >= 0 and n >= 3 and n > 0.22 * every[e, r]]
        wrappers[host] = Wrapper(pivots, rows) if rows else None
    out = {}
    for k, url, html in pages:
        root, blocks, owners = parse(html)
        wrapper = wrappers[url.split("/")[2]]
        kept = wrapper.extract(root, blocks, owners) if wrapper else page_text(owners, module.furniture(root, blocks, owners), set())
        out[k] = " ".join(blocks[i] for i in kept)
    return out


HASHES = {}


def test_same_as_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    pages = []
    for host in range(5):
        menus, wrap = [[line(2) for _ in range(4)] for _ in range(3)], r.choice(["div", "article", "section"])
        articles = ["".join(f"<p>{line(r.randrange(3, 20))}" for _ in range(r.randrange(1, 6))) for _ in range(9)]
        for k in range(r.choice([1, 4, 14])):
            menu = "".join(f"<li>{x}" for x in r.choice(menus)[: r.randrange(2, 5)])
            extra = r.choice(["", f"<div class=ad>{line(3)}</div>", f"<div class='comments'><p>{line(9)}</div>"])
            pages.append((len(pages), f"http://h{host}.x/{k}", f"<body><div><ul>{menu}</ul></div>{extra}<{wrap}><h1>{line(3)}</h1>{r.choice(articles)}</{wrap}><div>the end of all</div>"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    HASHES.update({x.html: x.k for x in df.select("html", F.xxhash64("html").alias("k")).collect()})
    got = {x.page_id: x.text for x in main_texts(df).collect()}
    assert got == brute_force(pages)
