import random

import pytest

from eventloom.llm.html_text import Plan, Wrapper, extract, infer, main_text

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"


def alone(page):
    return main_text(page, Plan(Wrapper.of(page)))


@pytest.mark.parametrize(
    "page,text",
    [
        ("", ""),
        (None, ""),
        ("plain text &amp; more", "plain text & more"),
        (HEAD + "<nav><ul><li>a<li>b</ul></nav><article><h1>One</h1><p><b>Two\n  words<br><p>Thr<i>ee</i>.</p><div class=ad>buy</div></article><footer>&copy;</footer>", "One Two words Three."),
        (HEAD + "<header><h1>Site</h1></header><main><header><h2>Title</h2><span>by X</span></header><p>Body &lt;b&gt; &#233;&nbsp;x</p><aside>side</aside><form><p>mail</p></form></main></body>", "Title Body <b> é x"),
        (HEAD + "<div id='cookie-notice'>ok?</div><div class='post-content'><p>Main text</p><ul><li>i<li>j</ul></div><div class='comments'><p>first!</p></div>", "Main text i j"),
        (HEAD + "<div><a href=x>link</a></div><div><div><p>Most of the text is here, in plain elements.</p><p>Two.</p></div></div>", "Most of the text is here, in plain elements. Two."),
        (HEAD + "<article>keep<!-- not <p>this</p> --><noscript>no</noscript><table><tr><td>x<td>y</table><section class='comment-list'><article>c</article></section></article>", "keep x y"),
        (HEAD + "<article><p>a &unknown; &am</p><textarea>form</textarea><p>b < c</p>", "a &unknown; &am b < c"),
        (HEAD + "<article class='comment'>no</article><article><p>yes</article>", "yes"),
        ("<article>a <b>b <!-- open", "a b"),
        ("<article><p>x</p>" + "<a " * 40_000, "x " + " ".join(["<a"] * 40_000)),
        ("<article>" + "<div>" * 500 + "deep" + "</div>" * 500 + "</article>", "deep"),
    ],
)
def test_pages(page, text):
    assert alone(page or "") == text == main_text(page, None)


def page(rnd, host):
    words = lambda n: " ".join(rnd.choice(["lorem", "ipsum", "dolor", "é", "&amp;"]) for _ in range(n))
    paragraphs = [words(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 6))]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    extra = f"<div class='related'>{words(5)}</div>" if rnd.random() < 0.5 else ""
    frame = ("<article>{}</article>", "<div class='entry-content'>{}</div>", "<div><div>{}</div></div>")[host]
    html = HEAD + f"<nav><ul>{'<li><a href=x>menu</a></li>' * rnd.randint(1, 5)}</ul></nav>" + frame.format(body + extra) + f"<footer>{words(3)}</footer></body></html>"
    return html, " ".join(paragraphs).replace("&amp;", "&")


def infer_here(pages):
    """The wrapper of a host's pages: one for each form first, then from the commonest form on."""
    forms = {}
    for p in pages:
        w = Wrapper.of(p)
        key = w.form()
        forms[key] = forms[key].align(Wrapper.load(w.dump())) if key in forms else w
    out = Wrapper()
    for _, _, w in sorted(((-w.pages, f, w) for f, w in forms.items()), key=lambda x: x[:2]):
        out.align(w)
    return out


def test_mismatches_become_optional_repeated_and_slots():
    rnd = random.Random(1)
    pages = [page(rnd, 0)[0] for _ in range(40)]
    text = infer_here(pages).expression()
    assert "(<li>#text</li>)+" in text and "<article>(<p>#slot</p>)+(<div.related>#slot</div>)?</article>" in text and "<title></title>" in text
    assert infer_here(["<h1>a</h1><p>x</p>", "<h1>b</h1><ul><li>x</ul><p>x</p>"]).expression() == "<h1>#slot</h1>(<ul><li>#text</li></ul>)?<p>#text</p>"
    # a kind that recurs after others makes all between a repeated group
    assert infer_here(["<p>a</p><h2>b</h2><p>c</p><h2>d</h2>"]).expression() == "((<p>#text</p>)+(<h2>#text</h2>)+)+"
    # other orders too
    assert infer_here(["<div class=a>1</div><div class=b>2</div>", "<div class=b>3</div><div class=a>1</div>"]).expression() == "(<div.a>#text</div><div.b>#slot</div>)+"
    # generic elements that say different things stay apart
    assert infer_here(["<div class=a>1</div>", "<div class=b>1</div>"]).expression() in ("(<div.a>#text</div>)?(<div.b>#text</div>)?", "(<div.b>#text</div>)?(<div.a>#text</div>)?")


def test_the_wrapper_does_not_depend_on_the_order_of_pages():
    rnd = random.Random(3)
    pages = ["".join(f"<div class={chr(97 + rnd.randrange(26)) * 2}{chr(97 + rnd.randrange(26))}>{rnd.random()}</div>" for _ in range(4)) + "<article><p>x</p></article>" for _ in range(120)]
    want = infer_here(pages).dump()
    for _ in range(3):
        rnd.shuffle(pages)
        assert infer_here(pages).dump() == want
    assert len(Wrapper.load(want).root.items) <= 70


def test_table(spark):
    rnd, rows, want = random.Random(2), [], {}
    for i in range(300):
        host = rnd.choice([0, 0, 0, 1, 2])
        html, text = page(rnd, host)
        rows.append((i, f"https://h{host}.example.com/{i}", html, "own"))
        want[i] = text
    rows += [(1000, None, None, "own"), (1001, "not a url", "", "own"), (1, rows[1][1], rows[1][2], "own")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(5)
    got = extract(frame).collect()
    assert len(got) == 303
    for r in got:
        assert r.text == want.get(r.page_id, "") and r.n_chars == len(r.text)
    assert infer(frame).count() == 4
    assert extract(frame.limit(0)).count() == 0


def host(pages):
    plan = Plan(Wrapper.load(infer_here(pages).dump()))
    return [main_text(p, plan) for p in pages]


def story(k):
    return f"Story {k} tells of {'this and ' * (k + 3)}that, {k} times."


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div class='x1'>{}</div>", "<div class='post'>{}</div>", "{}"])
def test_what_all_pages_repeat_in_the_article_stays(frame):
    same = "<h2>Introduction</h2><p>{0}</p><ul><li>one {1}<li>two<li>three</ul><table><tr><th>Name<th>Age<tr><td>n{1}<td>3</table><pre>x = 1</pre><h2>Conclusion</h2><p>The answer is yes.</p>"
    want = "Introduction {0} one {1} two three Name Age n{1} 3 x = 1 Conclusion The answer is yes."
    pages = [HEAD + "<nav>menu</nav>" + frame.format(same.format(story(k), k)) + "<footer>foot</footer>" for k in range(6)]
    assert host(pages) == [want.format(story(k), k) for k in range(6)]


def test_containers_without_a_slot_around_the_article_are_template():
    pages = [HEAD + f"<div>Home and more</div><div>About <a href=x>us and our many offices</a></div><h1>Title {k}</h1><p>{story(k)}</p><div><p>Boxed words.</p></div><p>{story(k + 1)}</p><div>Made by hand</div>" for k in range(6)]
    assert host(pages) == [f"Title {k} {story(k)} Boxed words. {story(k + 1)}" for k in range(6)]
    pages = [HEAD + f"<article><h1>Title {k}</h1><div><a href=x>All our stories</a> <a href=y>by day</a></div><p>{story(k)}</p><div>Since 1900</div></article>" for k in range(6)]
    assert host(pages) == [f"Title {k} {story(k)} Since 1900" for k in range(6)]
    assert host(pages[:1] * 3)[0].startswith("Title 0")


@pytest.mark.parametrize("n", [2, 3, 4, 5, 12])
def test_versions_of_one_article_keep_it(n):
    text = " ".join(story(k) for k in range(6))
    for frame in ("<article>{}</article>", "<div class='x1'>{}</div>"):
        pages = [HEAD + frame.format(f"<h1>Head</h1><p>{text}</p><p>Views: {k}</p>") + "<nav>menu</nav>" for k in range(n)]
        assert host(pages) == [f"Head {text} Views: {k}" for k in range(n)]


@pytest.mark.parametrize("many", [1, 5, 20])
def test_comments_never_stand_in_for_the_article(many):
    for name in ("comments", "comment-list", "replies", "user-remarks"):
        for frame in ("<div class='x1'>{}</div>", "<article>{}</article>", "<div><p>{}</p></div>"):
            pages = [HEAD + frame.format(f"<p>{story(k)}</p>") + f"<div class='{name}'>" + "".join(f"<div><p>I say {j} to {k}: {story(j + k)}</p></div>" for j in range(many)) + "</div>" for k in range(5)]
            assert host(pages) == [story(k) for k in range(5)]


@pytest.mark.parametrize(
    "frame",
    [
        "<article class='post has-sidebar'>{}</article>",
        "<div id='page' class='no-sidebar'><div class='entry'>{}</div><div class='sidebar'>side</div></div>",
        "<main><h1></h1><div class='content-area with-comments'>{}</div></main>",
        "<article class='post comment-open'>{}</article><div class='comments'><p>" + "first! " * 200 + "</p></div>",
        "<article>{}<div class='comment-list'><p>" + "first! " * 200 + "</p></div></article>",
        "<article>{}</article><aside class='related'><article class='post-related'>" + "teaser " * 200 + "</article></aside>",
        "<div class='cookie-notice'>" + "We use cookies. " * 200 + "</div><div class='page no-sidebar'>{}</div>",
    ],
)
def test_words_do_not_drop_the_article(frame):
    assert host([HEAD + frame.format(f"<p>{story(k)}</p>") for k in range(6)]) == [story(k) for k in range(6)]


def test_words_do_not_drop_the_article_of_some_pages():
    marks = [f"class='post tag-{chr(97 + k // 26)}{chr(97 + k % 26)}x has-sidebar'" if k % 2 else "class='post'" for k in range(200)]
    pages = [f"<nav>menu</nav><article {m}><p>{story(k)}</p></article><div class='comments'>no</div>" for k, m in enumerate(marks)]
    assert host(pages) == [story(k) for k in range(200)]


@pytest.mark.parametrize(
    "frame,text",
    [
        ("<div class='content has-sidebar'><article>{}</article><div class='sidebar'>side</div></div>", "{}"),
        ("<div class='site no-comments'><div class='menu'>menu</div><article>{}</article></div>", "{}"),
        ("<article class='post share'>{}</article><div class='site-footer'>foot</div><footer>end</footer>", "{}"),
        ("<article>{}<section class='related-work'><p>Others did it {k} times.</p></section><div class='related-posts'>more {k}</div></article>", "{} Others did it {k} times."),
        ("<article>{}<p class='share-price'>It fell by {k}.</p><p class='share-buttons'>Tell {k}</p></article>", "{} It fell by {k}."),
        ("<header class='top'>Site {k}</header><article><header class='entry-header'><h1>T{k}</h1><span>by X{k}</span></header>{}</article>", "T{k} {}"),
    ],
)
def test_hints_of_a_class(frame, text):
    assert host([HEAD + frame.format(f"<p>{story(k)}</p>", k=k) for k in range(8)]) == [text.format(story(k), k=k) for k in range(8)]


def test_the_wrapper_decides():
    """Without what aligning found out, other texts come out."""
    pages = [HEAD + f"<div class='x'><div>By us, the house of many words that all pages have, and many more</div><div><p>{story(k)}</p>{'<p>More.</p>' * (k % 3)}</div></div>" for k in range(8)]
    wrapper = infer_here(pages)
    plan = Plan(Wrapper.load(wrapper.dump()))
    assert main_text(pages[0], plan) == story(0)
    for x in plan.leaves:
        x.texts = None
    assert "By us" in main_text(pages[0], Plan(Wrapper(plan.root, plan.pages, wrapper.some)))


def test_query_against_a_parser_of_the_test_pages(spark):
    import html
    import re

    from eventloom.llm.queries import op5_html_extraction

    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r.page_id: r for r in op5_html_extraction(spark, folder).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search("(?s)<article>(.*)</article>", re.sub("(?s)<!--.*?-->", "", r.html or ""))
        text = re.sub(r"</?(?:p|h\d|br|div|li|ul|ol|blockquote|pre|table|tr|td)\b[^>]*>", " ", inside[1]) if inside else ""
        want = " ".join(html.unescape(re.sub("<[^>]*>", "", text)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_long_page_and_clashing_names(spark):
    long = HEAD + "<article>" + "<p>word</p><h2>x</h2>" * 60_000 + "</article>"
    frame = spark.createDataFrame([(1, "http://a.b/", long, "x", "y")], "page_id long, url string, html string, Text string, __host string")
    row = extract(frame).collect()[0]
    assert row.asDict().keys() == {"page_id", "url", "html", "__host", "text", "n_chars"} and row["__host"] == "y"
    assert row["text"] == " ".join(["word x"] * 60_000)


def test_an_article_without_names_keeps_its_headings_and_lists():
    pages = [f"<div><div><h2>Head {k}</h2><p>{story(k)}</p><ul><li>i{k}<li>j{k}</ul><p>{story(k + 1)}</p></div><div><a href=x>more {k}</a></div></div>" for k in range(6)]
    assert host(pages) == [f"Head {k} {story(k)} i{k} j{k} {story(k + 1)}" for k in range(6)]
