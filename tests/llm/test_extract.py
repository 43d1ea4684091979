import pytest

from pacelane.llm.extract import Page, host_of, host_paths, main_texts

BODY = "This is a long enough paragraph of the article, with commas, and words."


def page(content, extra=""):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>menu</a></li></ul></nav>{extra}{content}<footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("", ""),
        ("plain text only", "plain text only"),
        (page(f"<article><h1>Head &amp; more</h1><p>{BODY}<p>Second\n  one<br>line &eacute; &#x41;</article>"), f"Head & more\n\n{BODY}\n\nSecond one line é A"),
        (page(f"<div class='post-12 body'><p>{BODY}</p><div class='ad'>buy</div><ul><li>one</li><li>two</li></ul></div>"), f"{BODY}\n\none\n\ntwo"),
        (page(f"<article><p>{BODY}</p><section class='comments'><p>{BODY * 3}</p></section></article>"), BODY),
        (page(f"<main><p>{BODY}</p><form><p>fill in</p></form><aside>{BODY}</aside><script>x='</p>'</script></main>"), BODY),
        (page(f"<article><p><b>Bold.<br><p>{BODY}</b></p></article>"), f"Bold.\n\n{BODY}"),
        (f"<body><article><p>{BODY}</p><p>cut &amp", f"{BODY}\n\ncut &"),
        (f"<article><p>{BODY}</p><!-- <p>no</p> --><p hidden>no</p><p>a &lt; b</p></article>", f"{BODY}\n\na < b"),
        (page(f"<div id='cookie-notice'><p>{BODY * 4}</p></div><article><p>{BODY}</p></article>"), BODY),
        (page(f"<article><p>a<i>b</i>c <a href='x'>link</a></p><pre>one\n two</pre><p>{BODY}</p></article>"), f"abc link\n\none two\n\n{BODY}"),
        # classes that speak of the layout, and wrappers named after a part
        (page(f"<div class='content has-sidebar'><p>{BODY}</p></div>"), BODY),
        (page(f"<div id='page' class='header-fixed'><article><p>{BODY}</p></article></div>"), BODY),
        (page(f"<div class='layout no-sidebar'><article><p>{BODY}</p></article><p>rest</p></div>"), BODY),
        (page(f"<article><p class='banner-story'>{BODY}</p><p class='reply-brief'>{BODY}</p></article>"), f"{BODY}\n\n{BODY}"),
        (page(f"<div class='newsletter'><article><p>{BODY}</p></article></div>"), BODY),
        (page(f"<article><p>{BODY}</p></article><div class='comments'><article><p>{BODY * 3}</p></article></div>"), BODY),
        (page(f"<article><p>{BODY}</p><div class='share-buttons'>x</div><div class='related-posts-2'>y</div><div id='site-footer'>z</div><p class='ad slot'>buy</p></article>"), BODY),
        # raw tags
        (page(f"<article><svg/><p>{BODY}</p><iframe src=x /><p>two</p></article>"), f"{BODY}\n\ntwo"),
        (f"<title>never closed<article><p>{BODY}</p><select><option>a<p>two</p></article>", f"{BODY}\n\na\n\ntwo"),
        (page(f"<article><svg><svg><text>in</text></svg><text>ner</text></svg><p>{BODY} <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>"), f"{BODY} x=1."),
        # attributes
        (page(f"<article><p title=\"abc>{BODY}</p><p>two</p></article>"), f"{BODY}\n\ntwo"),
        (page(f"<article><p title=it's>{BODY}</p><p>it's two</p><p data-x='a>b' title=\"class='ad'\">three</p></article>"), f"{BODY}\n\nit's two\n\nthree"),
    ],
)
def test_pages(source, expected):
    assert Page(source).text([]) == expected


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")


def test_host_consensus_wins_over_the_single_page(spark):
    usual = page(f"<div class='story s1'><p>{BODY * 2}</p></div>", f"<div class='teasers'><p>{BODY}</p></div>")
    odd = page("<div class='story s22'><p>Short piece.</p></div>", f"<div class='teasers'><p>{BODY * 3}</p></div>")
    rows = [(k, f"https://News.example.org:80/{k}", usual) for k in range(6)] + [(6, "https://news.example.org/odd", odd), (7, "https://other.example.org/", odd)]
    paths = {r.host: r.paths for r in host_paths(frame(spark, rows)).collect()}
    assert paths["news.example.org"][0] == "html>body>div.s#.story"
    found = {r.page_id: r.text for r in main_texts(frame(spark, rows)).collect()}
    assert found[6] == "Short piece." and found[7] == BODY * 3 and found[0] == BODY * 2


def test_odd_rows(spark):
    rows = [(1, None, page(f"<article><p>{BODY}</p></article>")), (2, "no url", None), (3, "http://a.b/", ""), (3, "http://a.b/", ""), (None, "http://[bad", "<p>x</p>"), (4, "http://a.b/", f"<article>{'<div>' * 3000}<p>{BODY}</p></article>"), (5, "http://a.b/", "<p>" + "x " * 100_000)]
    found = [(r.page_id, r.text) for r in main_texts(frame(spark, rows)).collect()]
    assert len(found) == len(rows)
    texts = dict(found)
    assert texts[1] == BODY and texts[2] == "" and texts[3] == "" and texts[None] == "x" and texts[4] == BODY and texts[5] == ("x " * 100_000).strip()
    assert main_texts(frame(spark, [])).count() == 0


def test_large_path_tables_are_joined_by_shuffle(spark, monkeypatch):
    from pacelane.llm import extract

    rows = [(k, f"http://h{k % 3}.org/", page(f"<article><p>{BODY}</p></article>")) for k in range(9)]
    first = sorted(map(tuple, main_texts(frame(spark, rows)).collect()))
    monkeypatch.setattr(extract, "SENT", 0)
    assert first == sorted(map(tuple, main_texts(frame(spark, rows)).collect())) and all(t == BODY for _, _, t in first)


def test_hosts():
    assert host_of("HTTP://User@Example.com:8080/x") == "example.com"
    assert host_of(None) is None and host_of("nonsense") is None and host_of("http://[bad") is None
