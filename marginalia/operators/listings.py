"""Papers from proceedings pages: a scan of links, layouts as joins over them, manifests.

A page is scanned once, in an Arrow function, into its links: address, text, place, and the paper block that holds it. What
is a title, a paper's PDF or a pair of both is decided by expressions and joins over the table of links.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from ..functions.identifiers import derived_pdf_url, link_target, without_query
from ..functions.text import spaces
from ..staging import written
from .curation import first_wins

#: Words in a PDF link that is not the paper, and texts that are no titles.
NOT_THE_PAPER = ("abstract", "appendix", "poster", "slides", "supp", "supplemental", "video")
NOT_A_TITLE = ("abstract", "bibtex", "code", "dataset", "details", "github", "html", "openreview", "pdf", "poster", "slides", "supp", "supplemental", "video")
NO_TITLE_START = ("http://", "https://", "proceedings of ")
SHORTEST_TITLE = 8
#: How far a title may stand from its PDF link, in links and in characters.
MOST_LINKS, MOST_CHARS = 8, 1500
LINKS = ArrayType(StructType().add("href", StringType()).add("raw_href", StringType()).add("text", StringType()).add("start", IntegerType()).add("block", IntegerType()).add("block_title", StringType()))


class LinkScan(HTMLParser):
    """Links with their texts in page order. A div of class `paper` is a block up to the next end of a div, a p of class `title` its title."""

    def __init__(self, source: str, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.links, self.titles = base, [], {}
        self.link: dict | None = None
        self.words: list[str] = []
        self.block, self.blocks, self.in_block = None, 0, False
        self.title: list[str] | None = None
        self.lines = [0]
        for line in source.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        own = dict(reversed(attrs))
        named = lambda word: re.search(rf"\b{word}\b", own.get("class") or "", re.I)
        if tag == "div" and not self.in_block and named("paper"):
            self.block, self.in_block = self.blocks, True
            self.blocks += 1
        elif tag == "p" and self.in_block and self.block not in self.titles and named("title"):
            self.title = []
        elif tag == "a" and self.link is None and own.get("href"):
            line, column = self.getpos()
            raw = own["href"]
            self.link = {"href": joined(self.base, raw), "raw_href": raw, "start": self.lines[line - 1] + column, "block": self.block if self.in_block else None}
            self.words = []
        self.handle_data(" ")

    def handle_data(self, data):
        if self.link is not None:
            self.words.append(data)
        if self.title is not None:
            self.title.append(data)

    def handle_endtag(self, tag):
        self.handle_data(" ")
        if tag == "a" and self.link is not None:
            self.links.append(self.link | {"text": " ".join("".join(self.words).split())})
            self.link = None
        elif tag == "p" and self.title is not None:
            self.titles[self.block] = " ".join("".join(self.title).split())
            self.title = None
        elif tag == "div" and self.in_block:
            self.in_block, self.title = False, None


def joined(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def links_of(source: str | None, base: str | None) -> list[dict]:
    scan = LinkScan(source or "", base or "")
    return [link | {"block_title": scan.titles.get(link["block"])} for link in scan.links]


@F.pandas_udf(LINKS)
def scanned(source: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links_of(s, b) for s, b in zip(source, base, strict=True)])


def raw_hrefs(source: Column) -> Column:
    """Quoted addresses of a page's links in order, as they stand."""
    return F.regexp_extract_all(source, F.lit(r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>.*?</a>"""), F.lit(1))


def links(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """page, place, href, raw_href, text, start, block, block_title and what each link may be: pdf, paper_pdf, title."""
    each = pages.select(F.col(url).alias("page"), F.posexplode(scanned(F.col(source), F.col(url))).alias("place", "l")).select("page", "place", "l.*")
    text, raw = F.lower("text"), F.lower(F.trim("raw_href"))
    path = F.lower(without_query(F.col("href")))
    seen = F.concat_ws(" ", text, F.lower("href"))
    none_of = lambda words, test: ~F.exists(F.array(*[F.lit(w) for w in words]), test)
    generic = ~none_of(NOT_A_TITLE, lambda w: (text == w) | text.startswith(F.concat(w, F.lit(" "))))
    placeholder = raw.isin("", "#") | raw.startswith("javascript:")
    each = each.withColumn("pdf", path.endswith(".pdf"))
    return each.withColumns({
        "paper_pdf": F.col("pdf") & none_of(NOT_THE_PAPER, lambda w: F.contains(seen, w)),
        "title": (F.char_length("text") >= SHORTEST_TITLE) & ~F.col("pdf") & ~placeholder & ~generic & none_of(NO_TITLE_START, lambda w: text.startswith(w)),
    })


def in_blocks(found: DataFrame) -> DataFrame:
    """One paper for each block with a title, a link `abs` and a paper's PDF: the last of either; the first block of an abstract page."""
    is_abs = F.lower("text") == "abs"
    paired = found.filter("block IS NOT NULL").groupBy("page", "block").agg(
        F.min("block_title").alias("title"), F.max_by(F.when(is_abs, F.col("href")), F.when(is_abs, F.col("place"))).alias("source_paper_url"),
        F.max_by("href", F.when(F.col("paper_pdf") & ~is_abs, F.col("place"))).alias("pdf_url"), F.count_if(F.col("paper_pdf") & ~is_abs).alias("n"),
    )
    whole = paired.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("source_paper_url", F.lit("")) != "") & (F.col("n") > 0))
    return first_wins(whole, ["page", "source_paper_url"], ["block"]).select("page", F.col("block").alias("place"), "title", "source_paper_url", "pdf_url")


def at_derived_pdfs(found: DataFrame, folder: str) -> DataFrame:
    """Title links to abstract pages under `folder` whose PDF address follows from theirs: the first link of each page and address."""
    pdf = F.when(F.contains("href", F.lit(folder)), derived_pdf_url(F.col("href")))
    titled = found.filter("title").withColumn("pdf_url", pdf).filter("pdf_url IS NOT NULL")
    first = first_wins(first_wins(titled, ["page", "href"], ["place"]), ["page", "pdf_url"], ["place"]) if folder == HASHED else first_wins(titled, ["page", "href"], ["place"])
    return first.select("page", "place", F.col("text").alias("title"), F.col("href").alias("source_paper_url"), "pdf_url")


def beside_pdfs(found: DataFrame) -> DataFrame:
    """One paper for each address of a paper's PDF that has a title near it; the first link that has one.

    Near are MOST_LINKS links to either side within MOST_CHARS characters. If some of them lead where the PDF does, only those count;
    of what is left the nearest in links, and of two at the same distance the one before.
    """
    pdfs = found.filter("paper_pdf").select("page", F.col("place").alias("at"), F.col("start").alias("from"), F.col("href").alias("pdf_url"), link_target(F.col("href")).alias("leads"), F.explode(F.sequence(F.lit(-MOST_LINKS), F.lit(MOST_LINKS))).alias("step")).filter("step <> 0")
    near = pdfs.withColumn("place", F.col("at") + F.col("step")).join(found.select("page", "place", "start", "text", "href", "title"), ["page", "place"]).filter(F.abs(F.col("start") - F.col("from")) <= MOST_CHARS)
    same = link_target(F.col("href")) == F.col("leads")
    told = F.struct(F.abs("step").alias("far"), (F.col("step") > 0).alias("behind"))
    pick = lambda fits: F.min_by(F.struct("text", "href"), F.when(fits, told))
    paired = near.groupBy("page", "at", "pdf_url").agg(F.max(same).alias("any_same"), F.count_if(same & F.col("title")).alias("n_same"), F.count_if("title").alias("n_near"), pick(same & F.col("title")).alias("by_target"), pick(F.col("title")).alias("by_place"))
    chosen = F.when(F.col("any_same"), F.when(F.col("n_same") > 0, F.col("by_target"))).when(F.col("n_near") > 0, F.col("by_place"))
    whole = paired.withColumn("t", chosen).filter("t IS NOT NULL")
    return first_wins(whole, ["page", "pdf_url"], ["at"]).select("page", F.col("at").alias("place"), F.col("t.text").alias("title"), F.col("t.href").alias("source_paper_url"), "pdf_url")


#: Folders of abstract pages whose PDF addresses follow from theirs.
CONTENT, HASHED = "/content/", "/paper_files/paper/"


def papers(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """page, place, title, source_paper_url, pdf_url: the papers of each page by the first layout that finds any.

    Layouts in order: blocks, abstract pages under CONTENT, PDF links with a title beside them, abstract pages under HASHED. Pages
    without papers have no rows; null and empty pages have none.
    """
    found = written(links(pages.dropDuplicates([url]), url, source), "links")  # pages are scanned once
    layouts = (in_blocks, lambda x: at_derived_pdfs(x, CONTENT), beside_pdfs, lambda x: at_derived_pdfs(x, HASHED))
    every, rest = None, found
    for layout in layouts:
        got = layout(rest)
        if layout is not layouts[-1]:  # pages that it settles are looked at by no other
            got = written(got, "listing")
            settled = got.select(F.col("page").alias("_page")).distinct()
            rest = rest.join(settled, F.col("page").eqNullSafe(F.col("_page")), "left_anti")
        every = got if every is None else every.unionByName(got)
    return every


def listing_pages(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """page, place, listing_url: links to all papers (by text or `day=all`), or else to single days; each address once for a page."""
    found = links(pages.dropDuplicates([url]), url, source).filter("NOT pdf")
    text, href = F.lower("text"), F.lower("href")
    all_papers = F.contains(text, F.lit("all papers")) | F.contains(href, F.lit("day=all"))
    a_day = text.startswith("day ") | F.contains(href, F.lit("day="))
    ranked = found.withColumn("rank", F.when(all_papers, 0).when(a_day, 1)).filter("rank IS NOT NULL").withColumn("best", F.min("rank").over(Window.partitionBy("page")))
    return ranked.filter("rank = best").groupBy("page", F.col("href").alias("listing_url")).agg(F.min("place").alias("place")).select("page", "place", "listing_url")


def manifest(pages: DataFrame, year: int, venue: str, url: str = "url", source: str = "html", max_papers: int | None = None) -> DataFrame:
    """Manifest rows of all papers on the pages, once for each PDF address (the first page and place); max_papers for each page."""
    each = papers(pages, url, source)
    if max_papers is not None:
        each = each.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy("place"))).filter(F.col("rank") <= max_papers).drop("rank")
    first = first_wins(each, ["pdf_url"], ["page", "place"])
    return first.select(F.col("title").alias("source_paper_title"), "source_paper_url", F.lit(year).alias("year"), "pdf_url", F.lit(venue).alias("venue"))


def follow_listings(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """landing_url, listing_url: pages with papers, and for the others the listing pages they name, joined from the same table of fetched pages."""
    direct = papers(pages, url, source).select(F.col("page").alias("listing_url")).distinct()
    named = listing_pages(pages, url, source).select(F.col("page").alias("landing_url"), "listing_url").join(direct.withColumnRenamed("listing_url", "landing_url"), "landing_url", "left_anti")
    return direct.select(F.col("listing_url").alias("landing_url"), "listing_url").unionByName(named.join(direct, "listing_url", "left_semi").select("landing_url", "listing_url"))


def pmc_manifest(summaries: DataFrame, year: int) -> DataFrame:
    """Manifest rows of summaries: uid, title, fulljournalname, articleids; without an id or a title none."""
    from ..functions.identifiers import pmc_id

    rows = summaries.withColumns({"_id": pmc_id(F.col("uid"), F.col("articleids")), "_title": spaces(F.col("title"))}).filter("_id IS NOT NULL AND coalesce(_title, '') <> ''")
    page = F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/"), F.col("_id"), F.lit("/"))
    return rows.select(F.col("_title").alias("source_paper_title"), page.alias("source_paper_url"), F.lit(year).alias("year"), F.concat(page, F.lit("pdf/")).alias("pdf_url"), F.col("fulljournalname").alias("venue"), F.lit("Biomedical Research").alias("domain"))


def europe_pmc_manifest(summaries: DataFrame, year: int) -> DataFrame:
    """As pmc_manifest from pmcid, title, journalInfo and fullTextUrlList: the first open-access PDF; without one no row."""
    pdf = F.get(F.filter("fullTextUrlList.fullTextUrl", lambda u: (u["documentStyle"] == "pdf") & (u["availabilityCode"] == "OA")), F.lit(0))["url"]
    rows = summaries.withColumns({"_pdf": pdf, "_title": spaces(F.col("title"))}).filter("pmcid IS NOT NULL AND coalesce(_title, '') <> '' AND _pdf IS NOT NULL")
    return rows.select(F.col("_title").alias("source_paper_title"), F.concat(F.lit("https://europepmc.org/article/PMC/"), F.col("pmcid")).alias("source_paper_url"), F.lit(year).alias("year"), F.col("_pdf").alias("pdf_url"), F.col("journalInfo.journal.title").alias("venue"), F.lit("Biomedical Research").alias("domain"))
