"""Articles in plain containers: what is nested in the winning container, and what stands around nested ones, is kept."""

from vigil.llm import html

NESTED = "<body><nav>Menu</nav><div class='post n{i}'><p>" + "first text " * 9 + "{i}</p><blockquote>A quote {i}</blockquote><table><tr><td>cell {i}</td></tr></table><div><p>wrapped {i}</p></div><section><h2>Part {i}</h2><p>more {i}</p></section></div><div class=links><a href=1>l1</a></div>"
SECTIONS = "<body><div class=page><div class=story><h1>Title {i}</h1><p>Intro {i}</p><section><p>" + "long text " * 20 + "{i}</p></section><section class=w-1/2><p>end {i}</p></section></div></div><div class=extra><p>tiny</p></div>"
SPREAD = "<body><div class=art><div class=para><p>" + "some words " * 8 + "</p></div><blockquote>" + "quoted words " * 6 + "</blockquote><section><p>" + "other words " * 6 + "</p></section></div>"
QUOTE = "<body><div><blockquote>" + "quoted words " * 9 + "</blockquote><section>said they</section></div>"


def test_text_of_nested_containers_is_kept(spark):
    pages = [(k, f"http://{h}.org/{k}", p.replace("{i}", str(k))) for h, at, p in (("n", 0, NESTED), ("s", 10, SECTIONS), ("p", 20, SPREAD), ("q", 30, QUOTE)) for k in range(at, at + 4)]
    out = {r.id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(4):
        assert out[k].split("\n") == [("first text " * 9) + str(k), f"A quote {k}", f"cell {k}", f"wrapped {k}", f"Part {k}", f"more {k}"]
        assert out[10 + k].split("\n") == [f"Title {10 + k}", f"Intro {10 + k}", ("long text " * 20) + str(10 + k), f"end {10 + k}"]
        assert [t.split()[0] for t in out[20 + k].split("\n")] == ["some", "quoted", "other"]
        assert [t.split()[0] for t in out[30 + k].split("\n")] == ["quoted", "said"]
    for _, _, p in pages:
        assert html.extract(p, None) == html.extract(p, "/no/such")
    assert html.extract(pages[0][2], None) == out[0] and html.extract(pages[4][2], None) == out[10]
