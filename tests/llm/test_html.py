import re

from pyspark.sql import functions as F

from plumbline.llm import html
from tests.llm.conftest import prose

PAGES = "page_id long, url string, html string"


def page(i, menu=3, author=True, paragraphs=2):
    by = f"<span class=by>author {i}</span>" if author else ""
    body = "".join(f"<p>{prose(100 * i + k, 6)}</p>" for k in range(paragraphs))
    items = "".join(f"<li><a href=/{k}>{prose(i * 7 + k, 1)}</a></li>" for k in range(menu))
    return f"<html><head><title>title {i}</title><script>var x = '<p>no</p>';</script></head><!-- c --><body><h2>Site Name</h2><ul>{items}</ul><h1>head {i} &amp; co</h1>{by}{body}<footer>All of it &copy; Site</footer></body></html>"


def run(spark, rows):
    return {x.page_id: x for x in html.extracted(spark.createDataFrame(rows, PAGES)).collect()}


def test_template_goes_content_stays(spark):
    rows = [(i, f"http://a.example/{i}", page(i, 1 + i % 4, i % 3 > 0, 1 + i % 5)) for i in range(24)]
    got = run(spark, rows)
    for i in range(24):
        text = got[i].text.split("\n")
        assert "Site Name" not in text and not any("All of it" in t for t in text)
        assert f"title {i}" in text and f"head {i} & co" in text
        assert (f"author {i}" in text) == (i % 3 > 0)
        assert [t for t in text if t in {prose(100 * i + k, 6) for k in range(5)}] == [prose(100 * i + k, 6) for k in range(1 + i % 5)]
        assert got[i].pages == 24


def test_the_wrapper(spark):
    rows = [(i, "http://a.example/", page(i, 1 + i % 4, i % 3 > 0, 1 + i % 5)) for i in range(24)]
    wrapper = html.wrappers(html.parsed(spark.createDataFrame(rows, PAGES))).first().wrapper
    assert wrapper == "<html><head><title>#PCDATA</title></head><body><h2>=</h2><ul>(<li><a>#PCDATA</a></li>)+</ul><h1>#PCDATA</h1>(<span.by>#PCDATA</span>)?(<p>#PCDATA</p>)+<footer>=</footer></body></html>"


def test_a_wrapper_matches_every_page_it_is_made_of():
    """As a pattern over symbols, with optional and repeated groups but no unions."""
    streams = []
    for i in range(30):
        stream, _ = html.tokens(page(i, i % 4, i % 3 > 0, i % 5) + ("<div><b>ad</b></div>" if i % 7 == 0 else ""))
        streams.append("".join(html.Folder().folded(stream)[0]))
    unique = list(dict.fromkeys(streams))
    wrapper, masks, _ = html.inferred([(html.parts(s), {}) for s in unique])
    pattern, k = "", 0
    written = lambda x: f"(?:{re.escape(x.symbol[1:-2])})+" if x.symbol.startswith("(") else re.escape(x.symbol)
    while k < len(wrapper):
        end = k + 1
        while end < len(wrapper) and wrapper[end].option and wrapper[end].option == wrapper[k].option:
            end += 1
        run_ = "".join(map(written, wrapper[k:end]))
        pattern += f"(?:{run_})?" if wrapper[k].option else run_
        k = end
    for s in unique:
        plain = "".join(2 * t[1:-2] if t.startswith("(") else t for t in html.parts(s))
        assert re.fullmatch(pattern, plain)
    assert [len(m) for m in masks] == [len(html.parts(s)) for s in unique]


def brute_fold(stream):
    """Elements that follow an equal one, put together until none is left, by strings."""
    element = re.compile(r"<([a-z]+)>(?:#|<[a-z]+/>|\((?:[^()]|\((?:[^()]|\([^()]*\)\+)*\)\+)*\)\+)*</\1>")
    names, s = {}, stream
    while True:
        for m in element.finditer(s):
            mark = f"<e{'abcdefghij'[len(names) // 10]}{'abcdefghij'[len(names) % 10]}/>"
            mark = names.setdefault(m.group(), mark)
            s = s[: m.start()] + mark + s[m.end() :]
            break
        else:
            break
        for x in names.values():
            while f"{x}{x}" in s or f"({x})+{x}" in s:
                s = s.replace(f"({x})+{x}", f"({x})+").replace(f"{x}{x}", f"({x})+")
    for m, x in reversed(names.items()):
        s = s.replace(x, m)
    return s


def test_groups_of_any_size_and_depth():
    cells = "".join(f"<td><b>{k}</b></td><td><i>{k}</i></td>" for k in range(20))
    row, three = f"<tr>{cells}</tr>", "<tr><td>x</td></tr>"
    fold = lambda t: "".join(html.Folder().folded(html.tokens(t)[0])[0])
    assert fold(f"<table>{row * 3}</table>") == "<table>(" + re.sub(r">\d+<", ">#<", row) + ")+</table>"
    assert fold(f"<table>{row}</table>").count("(") == 0
    deep = "".join("<ul>" + "<li>x</li>" * k + "</ul>" for k in (2, 3, 5))
    assert fold(deep) == "(<ul>(<li>#</li>)+</ul>)+"
    assert fold("<p>a<p>b</div></p><br><br>" + three) == "<p>#<p>#</div></p><br/><br/><tr><td>#</td></tr>"
    stream, place = html.Folder().folded(html.tokens("<div>" + deep + "y</div>")[0])
    assert stream == ["<div>", "(<ul>(<li>#</li>)+</ul>)+", "#", "</div>"] and place == [0] + [1] * 36 + [2, 3]


def test_folding_against_brute_force():
    import random

    r = random.Random(3)

    def made(depth):
        return "".join(r.choice(["<p>x</p>", "<li>x</li>", "<br>"]) * r.choice([1, 1, 2, 3]) if depth == 0 or r.random() < 0.5 else f"<div>{made(depth - 1)}</div>" * r.choice([1, 2]) for _ in range(r.randrange(1, 4)))

    for _ in range(200):
        stream = html.tokens(made(3))[0]
        fold, place = html.Folder().folded(stream)
        plain = "".join(stream)
        want = brute_fold(plain)
        # an element that is repeated anywhere is a group wherever it comes later
        if "".join(fold).count("(") == want.count("("):
            assert "".join(fold) == want
        assert place == sorted(place) and len(place) == len(stream) and place[-1] == len(fold) - 1


def test_a_single_run_is_the_group_that_others_repeat():
    streams = [html.tokens("<ul><li>a</li></ul><ul><li>a</li><li>b</li></ul>")[0], html.tokens("<ul><li>a</li></ul>")[0]]
    assert [f for f, _ in html.refolded(streams)] == [["(<ul>(<li>#</li>)+</ul>)+"]] * 2


def test_hosts_apart_and_single_pages(spark):
    rows = [(1, "http://one.example/x", page(1)), (2, "https://two.example", "<p>same</p><p>a</p>"), (3, "https://TWO.example/y?z", "<p>same</p><p>b</p>")]
    got = run(spark, rows)
    assert "Site Name" in got[1].text and got[1].pages == 1
    assert got[2].text in ("a", "same\na") and got[3].pages == 2


def test_oddities(spark):
    rows = [(1, None, "<p>x</p>"), (2, "http://h.example", None), (3, "http://h.example", ""), (4, "http://[bad", "<p>y"), (None, "http://h.example", "plain < text"), (5, "http://h.example", "<p>" * 3000 + "deep"), (5, "http://h.example", "<p>" * 3000 + "deep"), (6, "http://h.example", prose(1, 30_000))]
    df = spark.createDataFrame(rows, PAGES)
    for name in ("host", "stream", "mask", "texts", "kept", "wrapper"):
        df = df.withColumn(name, F.lit("mine"))
    got = html.extracted(df).collect()
    by = {x.page_id: x for x in got}
    assert len(got) == 8
    assert by[1].text == "x" and by[1].wrapper is None and by[2].text is None and by[3].text == "" and by[4].text == "y"
    assert by[6].text == prose(1, 30_000)
    assert html.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_what_only_one_page_has_stays(spark):
    """A block or a layout that no other page of the host has; what two pages share still goes."""
    rows = [(i, f"http://a.example/{i}", page(i, 1 + i % 4, i % 3 > 0, 1 + i % 5)) for i in range(24)]
    rows[5] = (5, rows[5][1], rows[5][2].replace("<footer>", "<blockquote>only here</blockquote><h3>one more</h3><footer>"))
    rows.append((24, "http://a.example/24", "<table><tr><td>its own layout</td></tr></table><footer>All of it &copy; Site</footer>"))
    got = run(spark, rows)
    assert {"only here", "one more"} <= set(got[5].text.split("\n"))
    assert "its own layout" in got[24].text
    assert not any("Site Name" in got[i].text or "All of it" in got[i].text for i in range(24))
