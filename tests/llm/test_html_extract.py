import time

import pytest
from bindery.llm.html_blocks import read_page, text_below
from bindery.llm.html_extract import extract, extract_pages, host, votes
from pyspark.sql import functions as F

PARA = "A sentence of the article that is long enough to count as prose. "


def page(body, inner="div class='story-12'"):
    return f"""<!DOCTYPE html><html><head><title>t</title><style>p{{x}}</style><script>var a = "</p><p>no";</script></head><body>
<nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><{inner}>{body}</{inner.split()[0]}>
<aside>Side</aside><section id=comments><p>{PARA}{PARA}</p></section><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    "body,text",
    [
        (f"<h1>Head</h1><p>{PARA}</p><p>x&amp;y &lt;b&gt; &#228;&nbsp;&euro;</p>", f"Head\n{PARA.strip()}\nx&y <b> ä €"),
        (f"<p>{PARA}<p>two\n\n  <b>bold</b>ly<br>here", f"{PARA.strip()}\ntwo boldly here"),
        (f"<p>{PARA}</p><div class=share>Share</div><form>mail <input></form><p>end <!-- no --> of <i>it</i>", f"{PARA.strip()}\nend of it"),
        (f"<ul><li>{PARA}<li>two <a href=x>link</a> words</ul>", f"{PARA.strip()}\ntwo link words"),
        (f"<p>{PARA}</p><ul><li><a href=a>one</a><li><a href=b>two</a><li><a href=c>three</a></ul>", PARA.strip()),
        (f"<p>{PARA}</p></b></span></p><table><tr><td>a<td>b</table>", f"{PARA.strip()}\na\nb"),
        (f"<p title='a > b'>{PARA}</p>&amp", f"{PARA.strip()}\n&"),
    ],
)
def test_main_text(body, text):
    html = page(body)
    assert extract(html, [])[0] == text
    path = extract(html, [])[1]
    assert path == "/html/body/div.story-0" and path in dict(votes(html))
    assert extract(html, [path])[0] == text


def test_odd_pages():
    assert extract("", []) == ("", "")
    assert extract("plain & simple", [])[0] == "plain & simple"
    assert extract("<p>a<p>b", [])[0] == "a\nb"
    assert extract("<div><div><div>", [])[0] == ""
    assert extract("<script>never closed <p>x", [])[0] == ""
    assert extract("<p>" + "x " * 50_000, [])[0] == ("x " * 50_000).strip()
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert extract(deep, [])[0] == "deep"
    assert text_below(read_page("<div><a <b>q"), 0) == "q"


def test_consensus_overrules_a_page(spark):
    """A page whose comments outweigh its article is read as its host's other pages are."""
    other = "div class='talk'"
    rows = [(n, f"https://Host.example:80/p{n}", page(f"<p>{PARA * 3}</p>")) for n in range(8)]
    odd = page(f"<p>{PARA * 4}</p>").replace("<aside>", f"<{other}><p>{PARA * 5}</p></div><aside>")
    rows.append((8, "http://user@host.example/odd?x", odd))
    rows.append((9, "http://another.example/odd", odd))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: (r.path, r.text) for r in extract_pages(df).collect()}
    assert {found[n][0] for n in range(9)} == {"/html/body/div.story-0"}
    assert found[8][1] == (PARA * 4).strip()
    assert found[9][1] != found[8][1]


def test_awkward_rows(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "nonsense", "<p>x</p>", 2), (2, "https://a.b/c", "", 3), (3, "https://a.b/c", page(PARA), 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int").withColumn("path", F.lit(1)).withColumn("paths", F.lit(2))
    found = sorted((tuple(r)[:4] for r in extract_pages(df).collect()), key=repr)
    want = [(1, None, "", 0), (1, None, "", 0), (None, "nonsense", "x", 1), (2, "https://a.b/c", "", 0), (3, "https://a.b/c", PARA.strip(), len(PARA.strip()))]
    assert found == sorted(want, key=repr)
    assert extract_pages(df.limit(0)).collect() == []


def test_hosts(spark):
    urls = {"HTTP://u:p@Ex.Org:8080/a@b": "ex.org", "https://a.b?x": "a.b", "no url": "", None: "", "//x/y": ""}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", host(F.col("u")).alias("h")).collect()
    assert {r.u: r.h for r in rows} == urls


def test_all_parts_on_the_winning_path(spark):
    """An article in several siblings of one path comes back whole, in page order, also where most pages have one."""
    links = "<p>" + "<a href=x>elsewhere on this site</a> " * 12 + "</p>"

    def parts(*texts):
        sections = "".join(f"<section class=part><p>{t}</p></section>" for t in texts)
        return f"<html><body><main>{links}{sections}</main></body></html>"

    texts = [f"{n}. {PARA * size}".strip() for n, size in enumerate((4, 9, 3))]
    rows = [(n, "https://a.example/x", parts(texts[1])) for n in range(6)] + [(6, "https://a.example/y", parts(*texts)), (7, "https://b.example/", parts(*texts))]
    found = {r.page_id: (r.path, r.text) for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {path for path, _ in found.values()} == {"/html/body/main/section.part"}
    assert found[0][1] == texts[1] and found[6][1] == found[7][1] == "\n".join(texts)


def test_a_path_must_hold_most_of_the_prose():
    """Two fifths of a page in one place of the host and the rest in many others: the page keeps its own best."""
    rest = "".join(f"<section class=s{chr(97 + n)}><p>{PARA * 2}</p></section>" for n in range(3))
    html = f"<html><body><main><section class=part><p>{PARA * 4}</p></section>{rest}</main></body></html>"
    text, path = extract(html, ["/html/body/main/section.part"])
    assert path == "/html/body/main" and text.count(PARA.strip()) == 10


@pytest.mark.parametrize("name", ["content-with-sidebar", "layout-sidebar", "main-no-sidebar", "Page hasSidebar", "social"])
@pytest.mark.parametrize("tag", ["article", "section", "div"])
def test_an_article_inside_furniture_by_name(name, tag):
    """The container of an article is no furniture for its name; furniture inside and beside it still is."""
    inner = f"<{tag}><p>{PARA * 6}</p><div class=share>Share</div></{tag}><div class=sidebar><p>{PARA * 2}</p></div>"
    html = f"<html><body><div class=intro><p>{PARA}</p></div><div class='{name}'>{inner}</div><div class=comments><p>{PARA}</p></div></body></html>"
    text, path = extract(html, [])
    assert text.count(PARA.strip()) in (6, 7) and "Share" not in text
    assert path in dict(votes(html)) and extract(html, [path])[0] == text


def test_names_before_a_qualifier_count():
    html = f"<body><div class=story><p>{PARA * 4}</p></div><div class=share-with-friends><p>{PARA}</p></div><div class=sidebar-no-ads><p>{PARA}</p></div></body>"
    assert extract(html, [])[0] == (PARA * 4).strip()


def test_a_host_decides_on_a_container_by_its_name(spark):
    """On a page with a longer introduction the article in a named container is still what the host's pages have."""
    def named(intro, article):
        return f"<body><div class=intro><p>{PARA * intro}</p></div><div class=widget><div class=text><p>{PARA * article}</p></div></div></body>"

    rows = [(n, "https://a.example/", named(1, 9)) for n in range(6)] + [(6, "https://a.example/", named(2, 6))]
    found = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found[0] == (PARA * 9).strip() and found[6] == (PARA * 6).strip()


@pytest.mark.parametrize(
    "inside,text",
    [
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b</p>", "a x=2 b"),
        ("<p>a <svg><path d=1> b</p><p>c</p>", "a\nc"),
        ("<svg><p>b</p><p>c</p>", "b\nc"),
        ("<p>a <select><option>no</p><p>c</p>", "a\nc"),
        ("<object data=x><p>b</p>", "b"),
        ("<p>a <svg><svg>no</svg>no</svg> b</p><p>c <svg><title>no</title></svg>d</p>", "a b\nc d"),
        ("<p>a <noscript><p>no</p></noscript>b</p>", "a b"),
        ("<svg><p>b <svg>no</svg>c</p>", "b c"),
    ],
)
def test_what_is_left_open_ends_with_its_block(inside, text):
    assert extract(page(f"<p>{PARA}</p>{inside}<p>{PARA}</p>"), [])[0] == f"{PARA.strip()}\n{text}\n{PARA.strip()}"


MANY = 100_000


@pytest.mark.parametrize(
    "html",
    [
        '<a b="' * MANY, '<a b="' * MANY + ">", '<a ">" ' * MANY, "<a '>' " * MANY + '"', "<!" * MANY, "<script" * MANY, "<svg>" * MANY,
        "<div class='wrap'>" * MANY, "<div>" * MANY + "</section>" * MANY, "<i><div>" + "<b>" * MANY + "</i>" * MANY,
        "<article>" * MANY + PARA, "<table><tr>" + f"<td>{PARA}" * MANY, "<ul><li><a href=x>y</a>" * MANY, "<p class=share>x" * MANY,
        "<div class=widget>" * MANY + "x" + "</div>" * MANY,
    ],
)
def test_time_grows_with_the_page_only(html):
    """Pages of a megabyte that leave everything open take seconds."""
    begun = time.process_time()
    extract(html, [])
    votes(html)
    assert time.process_time() - begun < 20


def test_long_paths_stay_apart_and_alike():
    deep = "<div class=wrap>" * 500
    one, other = (read_page(f"{deep}<div class={name}>{PARA}</div>").paths[-1] for name in ("a", "b"))
    assert one != other and len(one) <= 1000
    assert one == read_page(f"{deep}<div class=a>x</div>").paths[-1]
