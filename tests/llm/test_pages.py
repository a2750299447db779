"""Main text that a template, a wrapper or the layout must not take away."""

from inkwell.llm import html


def extracted(spark, pages):
    rows = [(i, f"http://a.example/{i}", page) for i, page in enumerate(pages)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    return [r["text"] for r in sorted(got, key=lambda r: r["page_id"])]


def test_near_copies_of_an_article(spark):
    own = "\n".join(" ".join(f"w{i}x{j}" for j in range(60)) for i in range(4))
    paragraphs = "".join(f"<p>{x}</p>" for x in own.split("\n"))
    for begin, end in (("<article>", "</article>"), ("<main>", "</main>"), ("<div id=c>", "</div>")):
        got = extracted(spark, [f"<body>{begin}<h1>Title</h1>{paragraphs}<p>on day {i}</p>{end}</body>" for i in range(12)])
        assert got == [f"Title\n{own}\non day {i}" for i in range(12)]


def test_paragraph_that_articles_share(spark):
    pages = [f"<body><main><div>Share this</div><article><p>Our series on ink</p><p>story {i} {'x' * i}</p></article></main></body>" for i in range(12)]
    assert extracted(spark, pages) == [f"Our series on ink\nstory {i} {'x' * i}".strip() for i in range(12)]


WORDS = "word " * 40


def test_pages_without_article():
    page = f"<body><ul><li><a href=/>Home</a></ul><h1><a href=/t>Title</a></h1><div>Intro <p>{WORDS}</p><p><a href=/x>See our long report</a> now</p></div><section><p>{WORDS[:50]}</p></section><div class='w-1/2'>End</div></body>"
    assert html.main_text(page).split("\n") == ["Title", "Intro", WORDS.strip(), "See our long report now", WORDS[:50].strip(), "End"]


def test_wrappers_and_whole_class_names():
    article = "<article><div class='article-header'><h1>Title</h1></div><p>text</p><form><input>Your name</form></article>"
    for begin, end in (("<form id=page>", "</form>"), ("<div class='content with-sidebar'>", "</div>"), ("<div class='header widget'>", "</div>")):
        assert html.main_text(f"<body>{begin}{article}{end}</body>") == "Title\ntext"
    for begin, end in (("<aside>", "</aside>"), ("<div class=comments>", "</div>"), ("<div id='sidebar-2'>", "</div>")):
        assert html.main_text(f"<body>{article}{begin}<article>teaser</article>{end}</body>") == "Title\ntext"
    assert html.main_text(f"<body><form><div><p>{WORDS}</p></div></form><form>Search</form></body>").startswith(WORDS.strip())
    assert html.main_text(f"<body><div><p>{WORDS}</p></div><form>Search</form><div class=cookie-banner>c</div></body>") == WORDS.strip()
