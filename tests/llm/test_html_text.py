from seqtally.llm.html_text import Settings, extract, extract_text, noise_nodes

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{margin:0}}</style><script>var t="</p><article>x";</script></head>
<body class="page"><header><h1>Site</h1></header><nav><ul><li><a href="/a>b">Home</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy</div><div id="side-bar" class="left sidebar">Links</div><article><h1>A &amp; B</h1><p><b>First&nbsp;one.<br><p>Second
  <i>two</i> &lt;3<ul><li>x<li>y</ul><aside>note</aside><div class="comments"><p>me too</p></div><form>Name <input name=q></form></article>
<footer>&copy; me</footer></body></html>"""


def test_furniture_markup_and_references():
    assert extract(PAGE) == "A & B\n\nFirst one.\n\nSecond two <3\n\nx\n\ny"
    assert extract(None) == extract("") == extract("<nav>a</nav>") == extract("<script>x") == ""
    assert extract("plain <b>text</b>") == "plain text"
    assert extract("<p>a<p>b<div>c</div>d") == "a\n\nb\n\nc\n\nd"
    assert extract("<article><p>cut in the midd") == "cut in the midd"
    assert extract("<div hidden>x</div><div style='display: none'>y</div><p>z") == "z"
    assert extract('<p title="a > b">q</p> 1 < 2') == "q\n\n1 < 2"
    long = "<article>" + "<p>word</p>" * 50_000
    assert len(extract(long).split("\n\n")) == 50_000


def test_site_style_tree_removes_what_hardly_varies(spark):
    def page(i):
        return f"<html><body><div class='top-{i}'>Welcome to the site</div><div class=post><p>Story {i} is new</p></div><div class=legal><p>All rights</p></div></body></html>"

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(20)]
    rows += [(100 + i, f"http://few.example/{i}", page(0)) for i in range(3)]
    rows += [(200, None, None), (201, "no host", "<p>x</p>"), (202, "http://b.example/", ""), (203, "http://b.example/", PAGE), (203, "http://b.example/", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as host", "'c' as text", "'c' as nodes")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert all(got[i] == f"Story {i} is new" for i in range(20))
    assert got[100] == "Welcome to the site\n\nStory 0 is new\n\nAll rights"  # too few pages to tell
    assert (got[200], got[201], got[202]) == ("", "x", "")
    assert got[203].startswith("A & B") and extract_text(pages).count() == len(rows)
    assert extract_text(pages.where("false")).count() == 0
    low = noise_nodes(pages.drop("host", "text", "nodes").selectExpr("*", "'a' as host").where("page_id < 20"), Settings()).collect()
    assert len(low) == 1 and len(low[0].nodes) == 3  # the top, the legal block and its paragraph


def test_style_tree_decides_inside_and_between_content_roots(spark):
    story = lambda i: f"Story {i} " + " ".join(f"w{i}x{k}" for k in range(30))
    same = "<div class=x12><p>Sign up today</p></div>"
    inner = lambda i: f"<body><article><p>{story(i)}</p>{same}</article></body>"
    card = lambda i: f"<body><article><h2>Our best offer</h2></article><div class=c7><p>{story(i)}</p></div>{same}</body>"
    vary = lambda i: f"<body><article><h2>Next {i}</h2></article><div class=c7><p>{story(i)}</p></div>{same}</body>"
    copy = lambda i: f"<body><article><p>{story(0)}</p></article></body>"
    kinds = [inner, card, vary, copy]
    rows = [(100 * h + i, f"http://h{h}.example/{i}", make(i)) for h, make in enumerate(kinds) for i in range(20)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == story(i)
        assert got[100 + i] == story(i)
        assert got[200 + i] == f"Next {i}\n\n{story(i)}"
        assert got[300 + i] == story(0)
