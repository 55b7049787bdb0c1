"""What a host's wrapper decides, and that it grows with the kinds of groups only."""

import json
import random
import time

import pytest

from cadenza.llm.html import Tree, align, article_path, expression, main_text, parse, pattern, wrappers

from .test_html_parse import host_texts


def wrapper(pages):
    out = expression(parse(pages[0]))
    for p in pages[1:]:
        w = align([out], [expression(parse(p))])
        assert len(w) == 1
        out = w[0]
    return out


def groups(w):
    return 1 + sum(map(groups, w[6]))


def test_stretches_between_two_of_a_kind_repeat():
    (div,) = expression(parse("<div><h2>a</h2><p>b</p><p>c</p><h2>d</h2><p>e</p><ul><li>f</ul></div>"))[6]
    assert pattern(div) == "<div>((<h2>#</h2>)*(<p>#</p>)*)+<ul><li>f</li></ul></div>"


def test_a_wrapper_stays_as_large_as_its_kinds():
    rng = random.Random(1)

    def page(i):
        body = "".join(f"<{t}>{i} {rng.random()}</{t}>" for t in rng.choices(("h2", "p", "ul", "pre", "blockquote", "h3"), k=rng.randint(5, 80)))
        return f"<body><nav>n</nav><article><h1>t{i}</h1>{body}</article><footer>f</footer></body>"

    sizes = [groups(wrapper([page(i) for i in range(n)])) for n in (10, 30, 120)]
    assert sizes[0] <= sizes[1] <= sizes[2] <= 30


def test_names_of_every_page_of_its_own_do_not_grow_a_wrapper():
    letters = "abcdefghijklmnopqrstuvwxyz"
    pages = [f"<body><article><h1>t{i}</h1><div class='css-{letters[i % 26]}{letters[i // 26]}'><p>text {i}</p></div></article></body>" for i in range(200)]
    w = wrapper(pages)
    assert groups(w) < 80 and article_path(Tree.of(w)) == ["body", "article"]


def test_order_of_pages_does_not_matter_for_the_groups():
    rng = random.Random(3)
    pages = ["<body>" + "".join(f"<{t}>{rng.random()}</{t}>" for t in rng.choices(("div", "section", "p", "ul"), k=rng.randint(1, 6))) + "</body>" for _ in range(8)]
    kinds = set()
    for _ in range(6):
        rng.shuffle(pages)
        (body,) = wrapper(pages)[6]
        kinds.add(tuple(sorted(m[0] for n in body[6] for m in (n[6] if n[0] == "+" else [n]))))
    assert len(kinds) == 1


def test_the_slots_tell_where_the_article_is(spark):
    frame = "<div class=q1><p>%s</p></div>" % ("About this site, the same on every page. " * 20)
    pages = [f"<body>{frame}<div class=z9><h1>T{i}</h1><div class=k1><p>{f'words of {i} ' * 9}</p></div></div><div class=q2><p>{'imprint ' * 50}</p></div></body>" for i in range(4)]
    assert host_texts(spark, pages) == [f"T{i}\n" + f"words of {i} " * 8 + f"words of {i}" for i in range(4)]
    # One page alone has no slots: the frame stays in.
    assert "About this site" in host_texts(spark, pages[:1])[0]


def test_a_teaser_that_is_the_same_on_all_pages_is_no_article(spark):
    pages = [f"<body><article><p>teaser</p></article><main><h1>T{i}</h1><p>text {i} of the page</p></main></body>" for i in range(3)]
    assert host_texts(spark, pages) == [f"T{i}\ntext {i} of the page" for i in range(3)]


@pytest.mark.parametrize("deep", [250, 3000])
def test_an_article_nested_deeply(spark, deep):
    page = lambda i: f"<p>beside</p>{'<div>' * deep}<article><p>kept {i}</p></article>{'</div>' * deep}<p>below</p>"
    assert main_text(page(0), None) == "kept 0"
    assert host_texts(spark, [page(i) for i in range(3)]) == [f"kept {i}" for i in range(3)]


def test_quotes_that_never_close_take_linear_time():
    start = time.perf_counter()
    assert main_text("<article><p>a</p>" + '<a "' * 50_000, None).startswith("a")
    assert main_text("<article><p>a</p><a href=\"x>b</a><p class='c'>d</p><p>e</p></article>", None) == "a\nb\nd\ne"
    assert time.perf_counter() - start < 2


def test_wrappers_of_a_host_in_many_parts_are_one(spark):
    rows = [(i, "http://h/x", f"<article><h1>{i}</h1>" + "<p>p</p><ul><li>l</ul>" * (i % 5) + "</article>") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = (json.loads(wrappers(df.repartition(n)).first().wrapper) for n in (1, 16))
    assert (groups(one), one[3], one[7]) == (groups(many), many[3], many[7]) and one[7] == 60
