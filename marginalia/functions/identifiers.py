"""URLs and identifiers of papers as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The page of an identifier, by its namespace.
PAGES = {
    "ARXIV:": "https://arxiv.org/abs/",
    "OPENREVIEW:": "https://openreview.net/forum?id=",
    "DOI:": "https://doi.org/",
    "REPEC:": "https://ideas.repec.org/",
    "URL:": "",
}
DEFAULT_PAGE = "https://www.semanticscholar.org/paper/"
#: Namespaces that external identifiers may have.
NAMESPACES = "arxiv doi corpusid mag pubmed acl".split()


def paper_url(paper_id: Column) -> Column:
    out = F.concat(F.lit(DEFAULT_PAGE), paper_id)
    for prefix, page in PAGES.items():
        out = F.when(paper_id.startswith(prefix), F.concat(F.lit(page), F.substring(paper_id, F.lit(len(prefix) + 1), F.char_length(paper_id)))).otherwise(out)
    return out


def infer_pdf_url(url: Column, manifest_pdf: Column) -> Column:
    def as_pdf(old: str, new: str) -> Column:
        return F.concat(F.regexp_replace(F.replace(url, F.lit(old), F.lit(new)), r"\.html$", ""), F.lit(".pdf"))

    return (
        F.when(F.coalesce(manifest_pdf, F.lit("")) != "", manifest_pdf)
        .when(F.lower(url).endswith(".pdf"), url)
        .when(F.contains(url, F.lit("openaccess.thecvf.com/")) & F.contains(url, F.lit("/html/")), as_pdf("/html/", "/papers/"))
        .when(F.contains(url, F.lit("proceedings.iclr.cc/")) & url.endswith("-Abstract-Conference.html"), as_pdf("-Abstract-Conference.html", "-Paper-Conference"))
        .when(F.contains(url, F.lit("papers.nips.cc/")) & F.contains(url, F.lit("-Abstract-")) & url.endswith(".html"), as_pdf("-Abstract-", "-Paper-"))
    )


def infer_year(url: Column, manifest_year: Column) -> Column:
    found = F.nullif(F.regexp_extract(url, r"(?:19|20)\d{2}", 0), F.lit(""))
    return F.coalesce(F.nullif(manifest_year.cast("int"), F.lit(0)), found.cast("int"))


def url_year(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/paper/(\d{4})/", 1), F.lit("")).cast("int")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def link_target(url: Column) -> Column:
    """A link's path in lower case without closing slashes and `.pdf`."""
    path = F.regexp_extract(without_query(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/]*)?(.*)$", 1)
    return F.regexp_replace(F.lower(F.regexp_replace(path, "/+$", "")), r"\.pdf$", "")


def derived_pdf_url(url: Column) -> Column:
    """PDF address of two proceedings' abstract pages; null for others."""
    bare = without_query(url)
    hashed = r"(?i)^([a-z]+://[^/]+/paper_files/paper/\d+/)hash/([^/]+)-Abstract-([^./]+)\.html/?$"
    content = r"(?i)^([a-z]+://[^/]+/content/[^/]+)/html/([^/]+)\.html/?$"
    return F.when(F.rlike(bare, F.lit(hashed)), F.regexp_replace(bare, hashed, "$1file/$2-Paper-$3.pdf")).when(F.rlike(bare, F.lit(content)), F.regexp_replace(bare, content, "$1/papers/$2.pdf"))


def identifier_matches(paper_id: Column, external: Column, url: Column, target: Column) -> Column:
    """Whether a paper is the target: equal ids, a namespaced external id, or `URL:` without closing slashes. Empty targets match nothing."""
    t = F.trim(F.coalesce(target, F.lit("")))
    namespace, value = F.lower(F.substring_index(t, ":", 1)), F.trim(F.substring(t, F.locate(":", t) + 1, F.char_length(t)))
    lowered = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(F.coalesce(external, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))))
    named = F.contains(t, F.lit(":"))
    cut = lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), "/+$", ""))
    same_id = (F.trim(F.coalesce(paper_id, F.lit(""))) != "") & (F.lower(F.trim(paper_id)) == F.lower(t))
    by_name = namespace.isin(*NAMESPACES) & (F.lower(F.coalesce(F.try_element_at(lowered, namespace), F.lit(""))) == F.lower(value))
    by_url = (namespace == "url") & (cut(url) == cut(value))
    return (t != "") & (F.coalesce(same_id, F.lit(False)) | named & (by_name | by_url))


def pmc_id(uid: Column, article_ids: Column) -> Column:
    """The first typed PMC id; else a numeric uid with the prefix."""
    typed = F.get(F.filter(article_ids, lambda a: F.lower(a["idtype"]).isin("pmc", "pmcid") & a["value"].startswith("PMC")), F.lit(0))["value"]
    return F.coalesce(typed, F.when(F.rlike(uid, F.lit(r"^\d+$")), F.concat(F.lit("PMC"), uid)))
