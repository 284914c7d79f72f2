import collections
import math
import random
import time

import pytest

from corpusloom.llm import style_tree
from corpusloom.llm.style_tree import importances, main_text, scan, text_of, tree_of, with_hosts

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<main class="with-sidebar"><article><p>kept</p></article></main>', "kept"),
        ('<article class="post has-related"><p>kept</p></article>', "kept"),
        ('<article><div class="section-header"><p>kept</p></div></article>', "kept"),
        ('<article><h2 id="related-work">Related</h2><h2 id="search-algorithms">Search</h2><p class="notice-period">Two weeks</p></article>', "Related Search Two weeks"),
        ("<p>a<iframe>q</iframe>b</p>", "a b"),
        ("<p>m <math><mi>x</mi></math> e</p>", "m x e"),
        ('<div class="cookie-notice">c</div><div id="site-header">h</div><div class=content><p>kept</p></div><div class="related-posts">r</div>', "kept"),
        ('<form><div class="content-sidebar-wrap"><p>kept</p></div></form>', "kept"),
        ('<div class="article"><p>kept</p></div><div class="menu">m</div><div class="main-nav">n</div>', "kept"),
        ("<article>kept<form>Sign<input></form><div id=comments>c</div><aside>s</aside></article>", "kept"),
        ("<nav>n</nav><footer>f</footer>", ""),
        ("<article>a &lt; b &amp;c 1 < 2 <3</article>", "a < b &c 1 < 2 <3"),
        ("<p title='a > b'>kept</p><p don't>too</p>", "kept too"),
        ("<svg><title>x</title></svg><p>kept", "kept"),
        ("kept <a", "kept <a"),
        ("", ""),
    ],
)
def test_layouts(page, text):
    assert text_of(page, set()) == text


@pytest.mark.parametrize("junk", ['<a "' * 250_000, '<a href="' * 100_000 + ">", "<script " * 100_000, "<div>" * 200_000, "<!--" * 200_000, "<div>x" * 100_000, "<a b='" * 150_000 + ">", "</p " * 200_000 + ">"])
def test_a_megabyte_of_junk_ends_in_seconds(junk):
    began = time.time()
    text_of(junk, set())
    assert time.time() - began < 20


def test_scan_gives_back_all_text():
    rng = random.Random(0)
    parts = ["<p>", "</p>", "<div class='a'>", "</div>", "text", " ", "< ", ">", "<!-- c -->", "&amp;", "<br/>", '"', "'", "=", "<b x='>'>"]
    for _ in range(300):
        page = "".join(rng.choice(parts) for _ in range(30))
        assert "".join(t for t, *_ in scan(page)).count("text") == page.count("text")
        tree_of(page)


def site(host, k, rng):
    """A page whose furniture has no telling name."""
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    return f"<body><div class='xa'><ul><li>Home {host}</li><li>All</li></ul></div><div class='xb'><h1>{say(3)}</h1><p>{say(20)}</p>{'<p>more</p>' * (k % 3)}</div><div class='xc'>About {host} and its rules</div></body>"


@pytest.fixture(scope="module")
def sites(spark):
    rng = random.Random(2)
    rows = [(100 * h + k, f"https://h{h}.example/{k}", site(h, k, rng)) for h in range(5) for k in range(12)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_the_tree_removes_what_no_name_tells(sites):
    on = {r.page_id: r.text for r in main_text(sites).collect()}
    off = {r.page_id: r.text for r in main_text(sites, least_pages=10**6).collect()}
    assert len(on) == 60
    assert all("About" in t and "Home" in t for t in off.values())
    assert not any("About" in t or "Home" in t for t in on.values()) and all(t.startswith("w") for t in on.values())


def test_importances_are_normalised_entropies(sites):
    pages = {}
    for r in with_hosts(sites).collect():
        here = pages.setdefault(r.host, {}).setdefault(r.page, {})
        for node in tree_of(r.html)[1]:
            if node.contents:
                content, layout = here.setdefault(style_tree.signed(node.path), ([], []))
                content += node.contents
                layout.append(tuple(node.kids))
    expected = {}
    for host, shown in pages.items():
        for path in {p for h in shown.values() for p in h}:
            both = [h[path] for h in shown.values() if path in h]
            if len(both) >= 8:
                entropy = lambda k: -sum(c / len(both) * math.log(c / len(both)) for c in collections.Counter(tuple(b[k]) for b in both).values()) / math.log(len(both))
                expected[host, path] = (len(both), entropy(0), entropy(1))
    got = {(r.host, r.path): (r.n, r.content, r.layout) for r in importances(with_hosts(sites), 8).collect()}
    assert set(got) == set(expected) and expected
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)


def test_copies_of_a_page_count_once(spark):
    rng = random.Random(3)
    rows = [(k, f"http://a.example/{k}", "<body><div class='q'>" + ("the same text" if k < 90 else f"text {rng.random()}") + f"</div><i>{k % 90 if k >= 90 else 0}</i></body>") for k in range(100)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all("text" in got[k] for k in range(100))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "<p>a</p>", "z"), (1, None, "<p>a</p>", "z"), (None, "x", None, "y")], SCHEMA + ", low string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in main_text(docs).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert main_text(docs.limit(0)).count() == 0
