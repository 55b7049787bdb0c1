import pytest

from cadenza.llm.html import extract, main_text


@pytest.mark.parametrize(
    "head",
    [
        "<script>for(var i=0;i<n;i++){f(i)}</script>",
        "<script>if(a<!--b){}</SCRIPT >",
        "<script>x='<!-- <a \"';</script\n>",
        "<style>a<b{}</style><script>i<j</scripts></script/>",
        "<textarea><p class='</textarea>",
    ],
)
def test_raw_elements_end_at_their_own_end_tag(head):
    assert main_text(f"<body>{head}<article><p>kept</p>{head}<p>too</article>", None) == "kept\ntoo"


def test_a_raw_element_without_end_reaches_to_the_end():
    assert main_text("<article><p>kept</p><script>i<n <p>x</p></article>", None) == "kept"


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><h2 id='related-work'>Related</h2><p>a</p><h2 class='section-header'>H</h2><p id='notice-period'>n</p></article>", "Related\na\nH\nn"),
        ("<div class='layout with-sidebar'><article><p>a</p></article></div>", "a"),
        ("<div class='layout with-sidebar'><p>a</p></div>", "a"),
        ("<div class='sidebar widget'><article><p>a long text of the page</p></article></div>", "a long text of the page"),
        ("<div class='related'><article><p>card</p></article></div><div id=c1><p>the long text of the page itself</p></div>", "the long text of the page itself"),
        ("<article><div data-id='share' data-class=menu aria-role='banner'><p>a</p></div></article>", "a"),
        ("<article><div class='entry-header'><h1>T</h1></div><div class='related-work'><p>a</p></div><p class=ad>b <span class=share>c</span></p></article>", "T\na\nb c"),
        ("<article><p>a</p><div class='related-posts'>r</div><div class='shareButtons'>s</div><div CLASS=\"x Cookie-Notice\">c</div><ul id=comment-list><li>k</ul></article>", "a"),
    ],
)
def test_names_leave_out_containers_only(page, text):
    assert main_text(page, None) == text


def host_texts(spark, pages):
    rows = [(i, "http://h/x", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    return [got[i] for i in range(len(pages))]


def test_containers_that_are_the_same_on_a_host_are_left_out(spark):
    note = "<div class=x7f><p>Get our letter.</p><p>%s</p><ul><li>now<li>later</ul></div>" % ("Every week, free of charge. " * 5)
    body = lambda i: f"<h1>T{i}</h1><p>{f'long text {i} ' * 40}</p><h2>Method</h2><div class=k2>box {i}</div>"
    pages = [f"<article>{body(i)}{note if i != 3 else ''}<p>end {i}</p></article>" for i in range(5)]
    want = ["\n".join([f"T{i}", f"long text {i} " * 39 + f"long text {i}", "Method", f"box {i}", f"end {i}"]) for i in range(5)]
    assert host_texts(spark, pages) == want
    assert "Get our letter." in host_texts(spark, pages[:1])[0]


def test_pages_that_repeat_each_other_lose_nothing(spark):
    page = "<article><h1>T{0}</h1><div class=b><p>the whole text of the page</p></div><div class=c><p>more</p></div></article>"
    assert host_texts(spark, [page.format(1)] * 3) == ["T1\nthe whole text of the page\nmore"] * 3
    assert all("the whole text" in t for t in host_texts(spark, [page.format(i) for i in range(3)]))


def test_white_space_between_inline_elements_parts_words():
    from cadenza.llm.html import main_text

    page = "<html><body><article><p><b>one</b><i> <u>two</u></i><span>\n<em>three</em></span></p><ul> <li> <a> x</a></li> </ul></article></body></html>"
    assert main_text(page, None) == "one two three\nx"
