from pyspark.sql import functions as F

from scorewell.llm import style_tree

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="top">Site</header>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><article><header><h1>Head &amp; tail</h1></header><p><b>One
 two<br><p>Three&nbsp; four &lt;b&gt;</p><ul><li>a<li>b</ul><div class="comments"><p>Nice!</p></div><aside>See also</aside><form>Sign up</form></article>
<div id="sidebar">Links</div><footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    assert style_tree.main_text(ARTICLE, set()) == "Head & tail\nOne two\nThree four <b>\na\nb"


def test_broken_pages():
    assert style_tree.main_text(None, set()) == style_tree.main_text("", set()) == ""
    assert style_tree.main_text("just text &amp; no tags", set()) == "just text & no tags"
    assert style_tree.main_text("<article><p>cut <b>off", set()) == "cut off"
    assert style_tree.main_text("<p>x</p><script>never closed", set()) == "x"
    assert style_tree.main_text("<div" * 50 + "<p>1 < 2</p>", set()).endswith("1 < 2")


def page(i, note="Welcome to our site"):
    return f"<html><body><div class='box'><span>{note}</span></div><div class='body'><p>Story {i} tells {i * 7} things</p><p>More {i}</p></div></body></html>"


def test_template_noise_by_entropy(spark):
    rows = [(i, f"http://a.org/{i}", page(i)) for i in range(30)] + [(100 + i, "http://a.org/copy", page(1)) for i in range(40)]
    rows += [(200, "http://b.org/1", page(5)), (201, None, None), (202, "no url", ""), (0, "http://a.org/0", page(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit("clash"))
    got = {r.page_id: r.main_text for r in style_tree.extract(pages).collect()}
    assert got[4] == "Story 4 tells 28 things\nMore 4" and got[110] == "Story 1 tells 7 things\nMore 1"
    assert got[200].startswith("Welcome") and got[201] == got[202] == ""
    assert style_tree.extract(pages).count() == len(rows)


def test_copies_keep_their_article(spark):
    rows = [(i, "http://c.org/", ARTICLE) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.main_text for r in style_tree.extract(pages).collect()} == {style_tree.main_text(ARTICLE, set())}


def framed(i, n=0):
    return (
        f"<html><body><div class='lead'>Lead of {i}</div><div class='strap'>Our strap line</div><article><h1>Title {i}</h1><p>Story {i} tells {i * 7 + n} things</p>"
        "<div class='x9f'><p>Lesen Sie auch</p><p>Abonnieren</p></div></article></body></html>"
    )


def test_entropy_decides_inside_and_beside_an_article(spark):
    rows = [(i, f"http://d.org/{i}", framed(i)) for i in range(30)] + [(100, "http://e.org/1", framed(3))]
    rows += [(200 + i, f"http://f.org/{i}", framed(1)) for i in range(30)]
    rows += [(300 + i, f"http://g.org/{i}", ARTICLE.replace("Buy", f"Buy {i}").replace("See also", f"See {i}")) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    facts = style_tree.style_facts(pages).where("path LIKE '%article%'")
    assert facts.select("host").distinct().count() == 4
    got = {r.page_id: r.main_text for r in style_tree.extract(pages).collect()}
    assert all(got[i] == f"Lead of {i}\nTitle {i}\nStory {i} tells {i * 7} things" for i in range(30))
    # Too few pages, and copies whose adverts alone differ: names decide.
    assert got[100] == style_tree.main_text(framed(3), set()) and "Lesen" in got[100]
    assert all(got[200 + i] == style_tree.main_text(framed(1), set()) for i in range(30))
    assert all(got[300 + i] == style_tree.main_text(ARTICLE, set()) for i in range(30))


def test_an_article_is_not_emptied():
    page = framed(1)
    assert style_tree.main_text(page, {"/html/body/article"}) == style_tree.main_text(page, set()) != ""


def test_empty_table(spark):
    assert style_tree.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
