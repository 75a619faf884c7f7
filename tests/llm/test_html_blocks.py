import re
from html import unescape

from tiermill.llm.html_blocks import extract, main_text
from tiermill.llm.queries import op1_html_extraction

PROSE = "The cat sat on the mat and it was warm in the sun, as it had been for the whole of the day that they were there. "


def marked_article(page):
    """Text of the article element by plain string work, for pages of the test tables' one template."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_whole_table_against_plain_reading(spark, folder):
    rows = op1_html_extraction(spark, folder).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for row in rows:
        assert row.text == marked_article(pages[row.page_id].html)
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url


def test_page_without_article_element():
    page = f"""<html><head><title>x</title></head><body class="has-sidebar"><div id="top-menu"><a href=/>Home</a></div>
    <h2>A heading</h2><div>{PROSE * 2}</div><p>Short one.</p><p>{PROSE * 2}</p>
    <div class="cookie-notice">{PROSE * 2}</div><ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>
    <form><p>{PROSE * 2}</p></form><div id=comments><p>{PROSE * 2}</p></div></body></html>"""
    long = " ".join((PROSE * 2).split())
    assert main_text(page) == f"A heading\n{long}\nShort one.\n{long}"


def test_parts_inside_an_article_that_are_not_its_text():
    page = f"""<article><header><h1>Title</h1></header><p>One &amp; two&nbsp;three <b>bo</b>ld<br>next</p>
    <aside>{PROSE * 2}</aside><div class="ad">Buy</div><p>Zzz zzz.</p><script>var a = "</p>";</script><!-- <p>no</p> -->
    <div class="share-buttons"><a href=x>Share</a></div><footer>{PROSE}</footer></article><p>{PROSE * 3}</p>"""
    assert main_text(page) == "Title\nOne & two three bold next\nZzz zzz."


def test_defined_cases(spark):
    assert main_text(None) == main_text("") == main_text("<p></p><script>x") == ""
    assert main_text("<article><p>Cut <b") == "Cut"
    assert main_text("<article><p>1 < 2 and <a title='x>y'>z</a> &lt;b&gt;") == "1 < 2 and z <b>"
    assert main_text('<article><p class="never closed>text</article>') == "text"
    assert len(main_text("<article><p>" + "a &amp; <i>b</i> " * 200_000)) == 200_000 * 6 - 1
    rows = [(1, None, "u", "t"), (1, None, "u", "t"), (None, "<article>x</article>", None, "t"), (2, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text string")
    assert sorted(map(repr, (tuple(r) for r in extract(pages).collect()))) == sorted(
        map(repr, [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1), (2, "", "", 0)])
    )
    assert extract(pages.where("false")).collect() == []


LONG = " ".join((PROSE * 2).split())


def test_layout_classes_do_not_empty_the_page():
    inner = f"<h1>Title</h1><p>{PROSE * 2}</p><div class='sidebar'><p>{PROSE}</p></div>"
    for page in (
        f'<body><div class="layout with-sidebar"><div id="content">{inner}</div></div></body>',
        f'<body><article class="post comments-open">{inner}</article></body>',
        f'<div class="page has-banner"><main>{inner}</main><div class="comments"><p>{PROSE * 3}</p></div></div>',
    ):
        assert main_text(page) == f"Title\n{LONG}"
    # A notice that is longer than the text beside it is still a notice.
    assert main_text(f'<div class="cookie">{PROSE * 6}</div><p>{PROSE * 2}</p>') == LONG


def test_languages_without_known_stop_words():
    chinese = "這是第一句話，說明今天的天氣。這是第二句話，說明明天的計劃。" * 8
    german = "Forscher entdeckten jüngst seltene Arten. Kollegen bestätigten frühere Messungen, weitere Proben folgten. " * 3
    menu = '<ul class="menu"><li><a href=a>首頁</a><li><a href=b>新聞</a></ul>'
    assert main_text(f"<body>{menu}<div><p>{chinese}</p><p>{chinese}</p></div></body>") == f"{chinese}\n{chinese}"
    assert main_text(f"<body>{menu}<div id=content><p>{german}</p></div></body>") == german.strip()


def test_a_teaser_is_not_the_article():
    page = f'<article><h2>Other story</h2><p>More on it.</p></article><div id=content><h1>T</h1><p>{PROSE * 4}</p><p>{PROSE * 4}</p></div>'
    long = " ".join((PROSE * 4).split())
    assert main_text(page).endswith(f"T\n{long}\n{long}")


def test_marked_paragraphs_items_and_inline_tags():
    page = f"""<article><p>{PROSE * 2}</p><p class="advert">Buy now, the best of all</p><p class="cookie notice">We use cookies.</p>
    <ul><li>One <span class="ad">Ad</span>two<li class="comment"><p>Nice text, thank you for it</p><li>three</ul>
    <h3 class="share">Share this</h3><p>End <b>of <i>it</i></b>.</p></article>"""
    assert main_text(page) == f"{LONG}\nOne two\nthree\nEnd of it."


def test_hidden_parts():
    page = f"""<article><p hidden>a</p><div hidden="">{PROSE}</div><div style="color:red; display: none">{PROSE}</div><p>{PROSE * 2}</p>
    <span hidden>x</span><p class="not hidden at all" title="hidden">shown</p><div style='visibility:hidden'><p>b</p></div></article>"""
    assert main_text(page) == f"{LONG}\nshown"


def test_odd_comments():
    assert main_text(f"<article><!--><p>{PROSE * 2}</p><!---><p>b</p><!-- c --!><p>d</p><!-- e") == f"{LONG}\nb\nd"


def test_tables_and_lists_left_open():
    page = f"<article><p>{PROSE * 2}</p><table><tr><td>a<td class=ad>b<td>c<tr><td>d</table><dl><dt>e<dd class=promo>f<dt>g</dl>h</article>"
    assert main_text(page) == f"{LONG}\na\nc\nd\ne\ng\nh"


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "<article>x</article>", 2, 3, 4)], "page_id long, html string, `a.b` int, row int, found int")
    got = extract(rows)
    assert got.columns == ["page_id", "a.b", "row", "found", "text", "n_chars"] and tuple(got.first()) == (1, 2, 3, 4, "x", 1)
