"""The given pages against a plain parser: each has one article of blocks, which the standard library's parser reads."""

from html.parser import HTMLParser

from vigil.llm import queries

SF = "/root/testdata/sf0.01"
BLOCKS = {"article", "h1", "h2", "h3", "p", "li", "blockquote", "td", "div", "section"}


class Article(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def plain(page: str | None) -> str:
    parser = Article()
    parser.feed(page or "")
    parser.close()
    return "\n".join(b for b in (" ".join(x.split()) for x in parser.blocks) if b)


def test_given_pages_equal_a_plain_parser(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op10_html_extract(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want := plain(pages[r.page_id].html), len(want))
    assert sum(bool(r.text) for r in got) > 200
