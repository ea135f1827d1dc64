import numpy as np
from pyspark.sql import functions as F

from paperloom.llm import wrapper

from .helpers import prose

SCHEMA = "page_id long, url string, html string"


def page(title, paragraphs, extra="", notice="<p>Subscribe to our weekly letter today</p>"):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy now</div><article><h1>{title}</h1>{notice}{body}</article>{extra}<aside>More</aside><div id=comments><article class=comment><p>nice</p></article></div><footer>&copy; x</footer>"


def test_constant_blocks_are_template(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for i in range(12):
        ps = [prose(rng, 20) for _ in range(int(rng.integers(1, 6)))]
        rows.append((i, f"http://one.example/{i}", page(f"Title {i}", ps)))
        want[i] = "\n\n".join([f"Title {i}", *ps])
    rows.append((50, "https://two.example:8080/x", page("Alone", ["only page"])))
    want[50] = "Alone\n\nSubscribe to our weekly letter today\n\nonly page"
    rows += [(60, None, None), (61, "no host", ""), (62, "http://three.example", "plain &amp; text <b>bold</b>\n\t x")]
    want |= {60: "", 61: "", 62: "plain & text bold x"}
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"text": F.lit(1), "host": F.lit(2), "skeleton": F.lit(3)})
    got = {r.page_id: r for r in wrapper.extract_main_text(df).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_on_one_host_keep_their_text(spark):
    text = [prose(np.random.default_rng(1), 30) for _ in range(4)]
    rows = [(i, "http://copies.example/a", page("Same", text, notice="")) for i in range(9)] + [(20, "http://copies.example/b", page("Same", [*text[:3], "changed"], notice=""))]
    got = wrapper.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 10 and all(text[0] in r.text and text[2] in r.text for r in got)


def test_template_is_what_most_pages_have_not_one(spark):
    rng = np.random.default_rng(2)
    bodies = [[prose(rng, 20) for _ in range(4)] for _ in range(20)]
    # The shortest page is the reference and lacks the notice; cells may repeat.
    table = "<table><tr>" + "<td>1</td>" * 3 + "<tr><td>2</td></table>"
    rows = [(i, f"http://hot.example/{i}", page(f"T{i}", [*ps, *([] if i % 10 else [prose(rng, 5)])], notice="<p>Prices may change</p>" if i > 1 else "", extra="" if i else "<!-- x -->")) for i, ps in enumerate(bodies)]
    rows[0] = (0, "http://hot.example/0", page("T0", [prose(rng, 3)], notice=""))
    rows += [(100 + i, f"http://few.example/{i}", page(f"F{i}", bodies[i], notice=f"<p>Prices may change</p>{table[: -10 * i] if i else table}")) for i in range(3)]
    # Near copies that are not copies of the reference keep their text.
    rows += [(200 + i, f"http://near.example/{i}", page(f"N{i}", [*bodies[5], prose(rng, 4)], notice="")) for i in range(8)]
    rows += [(300 + i, f"http://near.example/x{i}", page(f"X{i}", [prose(rng, 6)], notice="")) for i in range(3)]
    got = {r.page_id: r.text for r in wrapper.extract_main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not [i for i, t in got.items() if "Prices" in t]
    assert all(p in got[i] for i in range(1, 20) for p in bodies[i])
    assert all(p in got[100 + i] for i in range(3) for p in bodies[i])
    assert all(p in got[200 + i] for i in range(8) for p in bodies[5])


def test_broken_markup():
    text = "<article><p>one<b>two<p>three &lt;x&gt; &#233;<script>var a='</p>'</script><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><form><input><p>no</p></form><!-- c --> tail<br>end"
    root = wrapper.parse(text)
    assert wrapper.extract(root, set()) == "onetwo\n\nthree <x> é\n\na\n\nb\n\nc\n\nd\n\ntail end"
    deep = wrapper.parse("<div>" * 5000 + "deep")
    assert wrapper.extract(deep, set()) == "deep"


def test_all_content_blocks_are_the_article():
    read = lambda body: wrapper.extract(wrapper.parse(f"<html><body>{body}</body></html>"), set())
    assert read("<div class=entry-title>T</div><div class=entry-content><p>one<p>two</div>") == "T\n\none\n\ntwo"
    assert read("<div class=content><p>one</div><div class=ad>buy</div><div class=content><div class=content>two</div></div>") == "one\n\ntwo"
    assert read("<main><p>one</main><main><p>two</main><p>by") == "one\n\ntwo"
    assert read("<div class=main-image>x</div><div class=c7><p>the text of the page</div>") == "x\n\nthe text of the page"
    assert read("<main><p>-</main><div class=content><p>the text of the page</div><p>by") == "the text of the page"


def test_matching_is_a_maximum():
    a, b = wrapper.parse("<body><p>x</p><div>k</div><p>y</p></body>"), wrapper.parse("<body><p>x</p><p>z</p><p>y</p></body>")
    wrapper.outline(a), wrapper.outline(b)
    pairs = wrapper.align(a, b)
    assert sum(1 for x, y in pairs if x.own and x.own == y.own) == 2


def nameless(i, rng, paragraphs):
    """A page whose elements tell nothing: links, a varying notice, the text, a varying advert and readers' words."""
    links = "".join(f"<div><a href=/{w}>{w}</a></div>" for w in prose(rng, int(rng.integers(2, 6))).split())
    body = "".join(f"<div>{p}</div>" for p in paragraphs)
    return f"<html><title>Head {i} - Site</title><body><div class=a1>{links}</div><div class=a2>{prose(rng, 4)}</div><div class=a3>Head {i}</div><div class=x{i} id=n{i}><div>Prices may change</div>{body}</div><div class=a4><div>{prose(rng, 3)}</div><div>{prose(rng, 5)}</div></div></body></html>"


def test_the_template_alone_finds_the_text(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(15):
        ps = [prose(rng, 25) for _ in range(int(rng.integers(2, 6)))]
        rows.append((i, f"http://plain.example/{i}", nameless(i, rng, ps)))
        want[i] = "\n\n".join([f"Head {i}", *ps])
    df = spark.createDataFrame(rows, SCHEMA)
    for names in (False, True):
        got = {r.page_id: r.text for r in wrapper.extract_main_text(df, names=names).collect()}
        assert got == want
    # The same pages with telling names elsewhere: the slot wins over an article element beside it.
    df = spark.createDataFrame([(i, u, h.replace("<div class=a2>", "<article class=a2>").replace("</div><div class=a3>", "</article><div class=a3>")) for i, u, h in rows], SCHEMA)
    assert {r.page_id: r.text for r in wrapper.extract_main_text(df).collect()} == want


def test_articles_are_found_without_names(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"http://one.example/{i}", page(f"Title {i}", [prose(rng, 20) for _ in range(4)])) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    read = lambda names: {r.page_id: r.text for r in wrapper.extract_main_text(df, names=names).collect()}
    assert read(False) == read(True)


def tree_matching(a, b):
    """Simple tree matching by trying every way to pair the first kids."""
    if a.label != b.label:
        return 0

    def lists(xs, ys):
        if not xs or not ys:
            return 0
        return max(lists(xs[1:], ys), lists(xs, ys[1:]), lists(xs[1:], ys[1:]) + tree_matching(xs[0], ys[0]))

    return 1 + (a.own == b.own != 0) + lists(a.kids, b.kids)


def random_page(rng, depth=0):
    kids = "".join(random_page(rng, depth + 1) for _ in range(int(rng.integers(0, 4)))) if depth < 3 else ""
    tag = ("div", "section", "ul")[int(rng.integers(0, 3))]
    return f"<{tag}>{('', 'x', 'y')[int(rng.integers(0, 3))]}{kids}</{tag}>"


def test_alignment_weighs_what_brute_force_finds(monkeypatch):
    rng = np.random.default_rng(7)
    for small, large in ((1 << 10, 1 << 22), (0, 1 << 22), (0, 2)):
        monkeypatch.setattr(wrapper, "SMALL_TABLE", small), monkeypatch.setattr(wrapper, "LARGE_TABLE", large)
        for _ in range(40):
            a, b = wrapper.parse(random_page(rng)), wrapper.parse(random_page(rng))
            wrapper.outline(a), wrapper.outline(b)
            b = wrapper.Reference(wrapper.skeleton(b)).root
            pairs = wrapper.align(a, b)
            assert sum(1 + (x.own == y.own != 0) for x, y in pairs) == wrapper._weigh(a, b, {}) == tree_matching(a, b)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)


def test_hostile_markup_takes_linear_time():
    import time

    start = time.perf_counter()
    for markup in ("<a b ", "<a \"'>", "<b>", "<!--", "< ", "<li>a", "<div>", "<script>", "</script ", "<b></x>", "<i>x</i>", "<p><i>"):
        root = wrapper.parse(markup * (1_000_000 // len(markup)))
        wrapper.outline(root)
        wrapper.extract(root, set())
    a, b = ("<div>" + "<p>x</p>" * n + "</div>" for n in (3000, 2500))
    a, b = wrapper.parse(a), wrapper.parse(b)
    wrapper.outline(a), wrapper.outline(b)
    assert len(wrapper.align(a, b)) == 2502
    assert time.perf_counter() - start < 60


def test_deep_elements_close_where_they_end():
    shown = wrapper.parse("<div>" * 125 + "<aside>advert<div>inner</div></aside>text" + "</div>" * 125 + "<p>after")
    assert wrapper.extract(shown, set()) == "text\n\nafter"


def test_unclosed_tag_is_no_text():
    assert wrapper.extract(wrapper.parse("<p>text</p><a href='x"), set()) == "text"


def test_empty_table(spark):
    assert wrapper.extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0
