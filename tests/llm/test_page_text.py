from gavelworks.llm.html_blocks import read_page
from gavelworks.llm.page_text import main_text

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>"</p>"</script></head><body>
<header>Top</header><nav><ul><li>Menu</ul></nav><div id="cookie-notice">Cookies</div><article>
<h1>A &lt;title&gt;</h1><p>One &amp; <b>two</b><br>three<p>Four&nbsp; five<!-- no --><form>f</form>
<div class="reader comments"><p>Nice</p></div></article><aside>side</aside><footer>&copy; foot</footer></body>"""


def texts(source):
    return [b.text for b in read_page(source).blocks]


def test_the_article_alone():
    assert texts(PAGE) == ["A <title>", "One & two three", "Four five"]


def test_broken_pages():
    assert texts(None) == texts("") == texts("<p") == texts("<script>x") == []
    assert texts("a < b <i>c") == ["a < b c"]
    assert texts("<p>x &am") == ["x &am"]
    assert texts("<div>" * 2000 + "deep") == ["deep"]
    assert texts("<p title='a>b'>c</p>") == ["c"]


def test_recurring_subtrees_go(spark):
    pages = [
        (i, f"http://A.example.com/{i}", f"<div>Welcome to the site</div><div><p>Story {i}</p></div><div>See {i % 2}</div>")
        for i in range(20)
    ]
    # The same words elsewhere are no template, and an article published often is none either.
    pages.append((20, "http://b.example.com/", "<div>Welcome to the site</div>"))
    pages += [(30 + i, "http://c.example.com/", "<div><p>Same story</p></div>") for i in range(20)]
    pages += [(60, None, None), (61, None, ""), (None, "x", "<p>y")]
    got = {(r.page_id, r.url): r for r in main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(got) == len(pages)
    # "See 0" and "See 1" are each on half of the pages.
    assert got[3, "http://A.example.com/3"].text == "Story 3"
    assert got[20, "http://b.example.com/"].text == "Welcome to the site"
    assert got[35, "http://c.example.com/"].text == "Same story"
    assert got[60, None].text == "" and got[61, None].n_chars == 0
    assert got[None, "x"].text == "y" and got[None, "x"].n_chars == 1


def test_no_pages_and_other_columns(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string, text string, row int")
    assert main_text(frame).collect() == []
    frame = spark.createDataFrame([(1, "u://h/", "<p>a", "other", 2)] * 2, frame.schema)
    assert [r.text for r in main_text(frame).collect()] == ["a", "a"]


STORY = "<h1>Title</h1><p>The story of this page, told at some length.</p><p>And its end.</p>"
TOLD = ["Title", "The story of this page, told at some length.", "And its end."]


def test_articles_beside_the_story_do_not_replace_it():
    aside = "<aside><article><p>Teaser</p></article></aside>"
    comments = "<div class='comments'><article><p>Nice</p></article></div>"
    assert texts(f"<div>{STORY}</div>{aside}{comments}") == TOLD
    assert texts(f"<main>{STORY}</main>{aside}{comments}<div>Not in main</div>") == TOLD
    # A list of teasers without a name of its own is left to the counts; the story stays.
    teasers = "".join(f"<article><h3>Other {i}</h3><p>Read more</p></article>" for i in range(20))
    assert texts(f"<div>{STORY}</div><div>{teasers}</div>")[:3] == TOLD
    assert texts(f"<main>{STORY}{teasers}</main>")[:3] == TOLD
    comment = f"<article><p>{'A long comment. ' * 50}</p></article>"
    assert texts(f"<div>{STORY}</div><div>{comment}</div>")[:3] == TOLD
    assert texts(f"<main>{STORY}</main><div>{comment}</div>") == TOLD
    assert texts("<article></article><div>Only this</div>") == ["Only this"]
    assert texts(f"<main><div>x</div><article>{STORY}</article></main><div>y</div>") == TOLD


def test_teasers_that_recur_go_by_counts(spark):
    teaser = "<article>Read this too</article>"
    pages = [(i, "http://h.example.com/", f"<div><h1>Page {i}</h1><p>Its story {i}</p></div>{teaser}") for i in range(8)]
    got = main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Page {i}\n\nIts story {i}" for i in range(8)}


def test_wrappers_named_like_parts_keep_the_story():
    for name in ("content has-sidebar", "layout no-sidebar", "post comment-open", "share", "menu"):
        assert texts(f"<div class='{name}'>{STORY}</div><div class='sidebar'>Side</div>") == TOLD, name
    assert texts(f"<form id='aspnetForm'>{STORY}<form>f</form></form>")[:3] == TOLD
    # The only heading, with less text than the rest.
    assert texts(f"<div class='share'>{STORY}</div><div>{'x ' * 200}</div>")[:3] == TOLD
    assert texts(f"<header><h1>Title</h1></header><div>{'x ' * 200}</div>")[0] == "Title"
    assert texts(f"<div class='share'><p>Share it</p></div><div>{STORY}</div>") == TOLD
    # A site's name in the header does not stand for the story.
    assert texts("<header><h1>Site</h1></header><article><h2>A</h2><p>Long enough</p></article><div>b</div>") == ["A", "Long enough"]


def test_elements_without_an_end_do_not_take_the_page():
    for tag in ("svg", "button", "select", "object", "iframe", "canvas", "noscript"):
        assert texts(f"<div>{STORY}</div><{tag}><div>After</div>") == [*TOLD, "After"], tag
    for tag in ("script", "style", "textarea", "title"):
        assert texts(f"<div>{STORY}</div><{tag}><div>After</div>") == TOLD, tag
    assert texts(f"<svg viewBox='0 0 1 1'/>{STORY}<svg><path/></svg><p>After") == [*TOLD, "After"]
    assert texts(f"<button>{STORY}<button>b</button><p>After") == [*TOLD, "After"]
