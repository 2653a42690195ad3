"""Main text of HTML pages by equivalence-class template deduction.

1. Tokens of a page, in its order: each tag with its path; each word outside the main element with its path; each block inside it.
   Pages of one host and one layout (the container elements around the main text) are a site.
2. A token's occurrence vector is its count on each page of a site. Vectors are not gathered: their
   fingerprint, the sum over pages of a hash of (page, count), adds up over any grouping of the pages, so one
   host with a third of all pages is counted by all tasks, and one row for each token remains.
3. Tokens of a site with equal fingerprints form an equivalence class. Classes with MIN_TOKENS tokens or more,
   on MIN_PAGES pages and SUPPORT of the site's pages at least are looked up on every page again. Valid are those
   whose tokens stand in one order on all pages, as often as they repeat, and whose spans nest: no two classes cross. Nested by the class that
   holds them everywhere they are the site's template.
4. A page's text is what lies in the slots between the template's tokens. Inside the main element
   (article, main) blocks that are tokens of the template go, but for the article's own: between the page's first and last own block
   those at the same path as own ones, and headings, there or right over the first own block. On a page without one, blocks of the body go of whose words BLOCK_SHARE or
   more are tokens of the template. Where that leaves half of the main text or less (or no text), the page is a copy of others
   rather than a filled template, and keeps its blocks. The markup's own names (nav, form, class="ad") are a prior: such elements go beforehand.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, freeing, slices, staged

MIN_TOKENS, MIN_PAGES, SUPPORT = 3, 3, 0.5
#: Share of a block's words outside the main element from which on it is the template's, with what varies in it (a date, a counter).
BLOCK_SHARE = 0.75
#: Template tokens that go to all executors at most; beyond it pages are joined with their site's template, hot sites
#: dealt into parts of SITE_PAGES pages.
BROADCAST_TOKENS, SITE_PAGES = 200_000, 20_000
#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select object canvas audio video".split())
BOILERPLATE = frozenset("head nav header footer aside form button dialog menu label".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "head", "html"}
CONTAINERS = frozenset("header nav main article section aside footer form div table".split())
#: Words of class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo related respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Words of class, id or role of what readers say, where it is made of entries of its own rather than of paragraphs.
THREADS = frozenset("discussion discussions disqus guestbook reactions replies responses talkback".split())
ENTRIES = frozenset("article details div dl fieldset li ol section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that a compound name of boilerplate may have beside MARKS ("ad-box", "site-header", not "ad-hoc-networks").
PLAIN = frozenset(
    "area bar block body bottom box button buttons consent container content form global group holder inner item items left link links list main page panel post posts primary right secondary section signup site slot text thread title top unit wrap wrapper".split()
)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>?)""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@lru_cache(maxsize=20_000)
def attributes(source: str) -> dict[str, str]:
    """Names, lower-cased, and decoded values of a tag's attributes; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def is_boilerplate(name: str, source: str) -> bool:
    """By the element's name, by attributes that hide it, or by a class, id or role all of whose words name boilerplate or are plain."""
    if name in BOILERPLATE:
        return True
    if name in ("html", "body") or name in MAIN or not source.strip():
        return False
    own = attributes(source)
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""), re.I):
        return True
    return named(own, MARKS)


def named(own: dict[str, str], marks: frozenset[str]) -> bool:
    """Whether all words of a class, id or role are marks or plain, and one of them is a mark."""
    for part in " ".join(own.get(k, "") for k in ("class", "id", "role")).lower().split():
        words = {w for w in re.split(r"[^a-z]+", part) if len(w) > 1}
        if words & marks and words <= marks | PLAIN:
            return True
    return False


def may_be_thread(name: str, source: str) -> bool:
    return name in ENTRIES and bool(source.strip()) and named(attributes(source), THREADS | MARKS)


def step(name: str, source: str) -> str:
    """An element's part of a path: its name and the words of its class that hold no digit."""
    words = attributes(source).get("class", "") if "class" in source.lower() else ""
    return f"{name}.{'.'.join(sorted(w for w in words.lower().split() if w.isalpha()))}" if words else name


@dataclass(frozen=True)
class Template:
    """Tokens of a site's valid classes, each with its class; for each class the one that holds it everywhere (0: none)."""

    class_of: dict[int, int] = field(default_factory=dict)
    inside: dict[int, int] = field(default_factory=dict)


class Page:
    """One page in its order: tags (path, block number) and text runs (path, boilerplate, inside main, block number, text)."""

    def __init__(self, source: str):
        self.runs: list[tuple[str, int] | tuple[str, bool | int, bool, int, str]] = []  # boilerplate: True, False or the negative number of what may be a thread
        self.frame: set[str] = set()  # paths of containers outside the main element
        self.block = 0
        self.has_main = False
        self.threads: set[int] = set()  # elements outside the main one that hold readers' entries
        stack: list[tuple[str, str, bool, bool, int]] = [("", "", False, False, 0)]  # name, path, boilerplate, inside main, number of an element that may be a thread
        at, n = 0, len(source)
        lowered = None
        while at < n:
            mark = source.find("<", at)
            if mark < 0:
                mark = n
            if mark > at:
                self._text(stack[-1], source[at:mark])
            if mark == n:
                break
            if source.startswith("<!--", mark):
                end = source.find("-->", mark + 4)
                at = n if end < 0 else end + 3
                continue
            if source.startswith(("<!", "<?"), mark):
                end = source.find(">", mark)
                at = n if end < 0 else end + 1
                continue
            m = TAG.match(source, mark)
            if m is None:
                if source.startswith("</", mark):  # a broken closing tag, or a page cut within one
                    end = source.find(">", mark)
                    at = n if end < 0 else end + 1
                elif mark == n - 1:
                    break
                else:
                    self._text(stack[-1], "<")
                    at = mark + 1
                continue
            at = m.end()
            if not m[4]:  # an open quote, or the page ends
                end = source.find(">", at)
                at = n if end < 0 else end + 1
            name = m[2].lower()
            if name in BLOCKS:
                self.block += 1
            if m[1]:
                self._close(stack, name)
                continue
            if name in RAW:
                if not m[3].endswith("/"):
                    lowered = source.lower() if lowered is None else lowered
                    if len(lowered) == n:
                        end = lowered.find(f"</{name}", at)
                    else:  # lower() changed the length
                        end = next((x.start() for x in re.finditer(f"</{re.escape(name)}", source[at:], re.I)), -1)
                        end = end + at if end >= 0 else -1
                    close = source.find(">", end) if end >= 0 else -1
                    at = n if close < 0 else close + 1
                continue
            if name in VOID:
                if name in ("br", "hr", "wbr"):
                    self._text(stack[-1], " " if name != "wbr" else "")
                continue
            if name in CLOSES_P:
                self._close_open(stack, "p")
            if name in ("li", "dt", "dd", "tr"):
                self._close_open(stack, name)
            if name in ("td", "th"):
                self._text(stack[-1], " ")
            _, path, boiler, main, thread = stack[-1]
            if thread and name in ENTRIES:
                self.threads.add(thread)
            path = f"{path}/{step(name, m[3])}"
            self.runs.append((path, self.block))
            if name in CONTAINERS and not main and path.count("/") <= 4:
                self.frame.add(path)
            if not m[3].endswith("/") or name in BLOCKS:
                boiler = boiler or is_boilerplate(name, m[3])
                main = main or (name in MAIN and not boiler)
                self.has_main = self.has_main or main
                if not thread and not main and not boiler and may_be_thread(name, m[3]):
                    thread = len(self.runs)
                stack.append((name, path, boiler, main, thread))

    def _text(self, top: tuple[str, str, bool, bool, int], text: str) -> None:
        if text:
            self.runs.append((top[1], top[2] or -top[4], top[3], self.block, text))

    def _close(self, stack: list, name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if name not in BLOCKS and stack[i][0] in BLOCKS:  # an inline end tag does not close a block
                return

    @staticmethod
    def _close_open(stack: list, name: str) -> None:
        """Closes an open element of this name that the last container holds."""
        stop = {"p": CLOSES_P - {"p"}}.get(name, frozenset(("ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "article", "div", "section")))
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    def parts(self) -> Iterator[str | tuple[str, bool, bool, str]]:
        """Tags (path) and blocks (path, boilerplate, inside main, text) in order; references decoded, white space made one space."""
        texts: list[str] = []
        now = None
        for run in self.runs:
            ends = run[1] != now[0][0] if now is not None and len(run) == 2 else now is not None and now[0] != (run[3], run[1] is True or -run[1] in self.threads, run[2])
            if ends:
                if whole := _joined(texts):
                    yield *now[1], whole
                texts, now = [], None
            if len(run) == 2:
                yield run[0]
                continue
            path, boiler, main, block, text = run
            boiler = boiler is True or -boiler in self.threads
            if now is None:
                now = ((block, boiler, main), (path, boiler, main))
            texts.append(text)
        if now is not None and (whole := _joined(texts)):
            yield *now[1], whole

    def layout(self) -> str:
        return "\n".join(sorted(self.frame))

    def tokens(self) -> list[int]:
        """In order: digests of tags, of words outside the main element and of blocks inside it."""
        out: list[int] = []
        for part in self.parts():
            if isinstance(part, str):
                out.append(digest(part))
            elif part[2]:
                out.append(_digest(f"{part[0]}={part[3]}"))
            else:
                out += [digest(f"{part[0]}:{w}") for w in part[3].split()]
        return out

    def slots(self, template: Template) -> list[tuple[int, str, bool, str]]:
        """(the class in whose slot it lies, text, whether it is of the template, its path) of each block that the markup does not rule out.

        A class is open from its first token of a repetition to its last one; 0 is the page itself.
        """
        class_of, sizes = template.class_of, Counter(template.class_of.values())
        met: Counter[int] = Counter()
        stack: list[int] = [0]
        out: list[tuple[int, str, bool, str]] = []

        def meet(token: int) -> bool:
            c = class_of.get(token)
            if c is None:
                return False
            if met[c] % sizes[c] == 0:
                stack.append(c)
            met[c] += 1
            if met[c] % sizes[c] == 0 and c in stack:
                del stack[len(stack) - 1 - stack[::-1].index(c) :]
            return True

        for part in self.parts():
            if isinstance(part, str):
                meet(digest(part))
                continue
            path, boiler, main, text = part
            if main:
                of_template = meet(_digest(f"{path}={text}"))
            else:
                words = text.split()
                of_template = sum(meet(digest(f"{path}:{w}")) for w in words) >= BLOCK_SHARE * len(words)
            if not boiler and (main or not self.has_main):
                out.append((stack[-1], text, of_template, path))
        return out

    def text(self, template: Template) -> str:
        found = self.slots(template)
        own = [i for i, x in enumerate(found) if not x[2]]
        if not own or self.has_main and 2 * sum(len(found[i][1]) for i in own) <= sum(len(x[1]) for x in found):
            return "\n\n".join(x[1] for x in found)
        if self.has_main:  # a repeated heading between the article's own blocks or right over the first is the article's, and so is a block like own ones
            heading = [x[3].rpartition("/")[2].partition(".")[0] in HEADINGS for x in found]
            first, alike = own[0], {found[i][3] for i in own}
            while first and heading[first - 1]:
                first -= 1
            own = [i for i in range(first, own[-1] + 1) if not found[i][2] or heading[i] or found[i][3] in alike]
        return "\n\n".join(found[i][1] for i in own)


def _joined(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _digest(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


digest = lru_cache(maxsize=100_000)(_digest)


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.match(r"[^/?#]*", rest)[0].lower()


def site_of(url: str | None, page: Page) -> int:
    return _digest(f"{host_of(url)}\n{page.layout()}")


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """site, token, two halves of the fingerprint, pages: summed over a slice of (url, html). Token 0 stands once on each page."""
    for batch in batches:
        for part in slices(batch, 1):
            sums: dict[tuple[int, int], list[int]] = {}
            for u, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                page, own = Page(h or ""), _digest(f"{u}\n{h}")  # the whole page tells it apart; equal pages count as often as they stand
                site = site_of(u, page)
                for token, n in [(0, 1), *Counter(page.tokens()).items()]:
                    got = sums.setdefault((site, token), [0, 0, 0])
                    x = (own ^ (n * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
                    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
                    got[0] = (got[0] + (x ^ (x >> 29))) & 0xFFFFFFFF  # halves, so that Spark's sums cannot overflow
                    got[1] = (got[1] + (x >> 32)) & 0xFFFFFFFF
                    got[2] += 1
            rows = list(sums.items())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in rows], pa.int64()) for i in (0, 1)), *(pa.array([v[i] for _, v in rows], pa.int64()) for i in range(3))], names=["site", "token", "f0", "f1", "pages"])


def arrangement(tokens: list[int], class_of: dict[int, int]) -> list[tuple[int, int, int]]:
    """(class, order, holder) of each class on a page. order: digest of its tokens' order, 0 if its repetitions differ or it crosses
    a larger class; holder: the class within which it always begins, 0 for none."""
    seen: dict[int, list[int]] = defaultdict(list)
    for t in tokens:
        if (c := class_of.get(t)) is not None:
            seen[c].append(t)
    order: dict[int, int] = {}
    sizes = Counter(class_of.values())
    for c, own in seen.items():
        k = sizes[c]
        order[c] = _digest(repr(own[:k])) if own == own[:k] * (len(own) // k) and len(set(own[:k])) == k else 0
    met: Counter[int] = Counter()
    stack: list[int] = []
    holder: dict[int, int] = {}
    for t in tokens:
        c = class_of.get(t)
        if c is None or not order[c]:
            continue
        if met[c] % sizes[c] == 0:
            within = stack[-1] if stack else 0
            holder[c] = within if holder.get(c, within) == within else 0
            stack.append(c)
        met[c] += 1
        if met[c] % sizes[c] == 0:
            while stack and c in stack and stack[-1] != c:  # what is still open crosses c: the smaller one is no class
                other = stack[-1]
                low = min((sizes[other], other), (sizes[c], c))[1]
                order[low] = 0
                stack.remove(low)
            if c in stack:
                stack.pop()
    return [(c, o, holder.get(c, 0)) for c, o in order.items()]


def _arranged(batches: Iterator[tuple[list, list, list[dict[int, int]]]]) -> Iterator[pa.RecordBatch]:
    """site, class, order, holder over slices of (sites, pages, class of each token)."""
    for sites, pages, found in batches:
        rows = {(site, *x) for site, page, class_of in zip(sites, pages, found, strict=True) if class_of for x in arrangement(page.tokens(), class_of)}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["site", "class", "order", "holder"])


def _with_templates(pages: DataFrame, templates: DataFrame, keep: list[str], url: str, source: str, run, schema) -> DataFrame:
    """run over slices (kept columns, sites, pages, Template of each) of all pages. templates: site, token, class, holder.

    The same result on both ways: templates of at most BROADCAST_TOKENS tokens go to all executors; otherwise each page is sent
    to its site's template, hot sites in parts, each with a copy of the template.
    """
    src = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    k = len(keep)
    if templates.count() <= BROADCAST_TOKENS:
        rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for b in templates.toArrow().to_batches():
            for site, *rest in zip(*(b.column(c).to_pylist() for c in ("site", "token", "class", "holder")), strict=True):
                rows[site].append(tuple(rest))
        shared = pages.sparkSession.sparkContext.broadcast({site: Template({t: c for t, c, _ in own}, {c: h for _, c, h in own}) for site, own in rows.items()})

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def each():
                none = Template()
                for batch in batches:
                    for part in slices(batch, k + 1):
                        parsed = [Page(h or "") for h in part.column(k + 1).to_pylist()]
                        sites = [site_of(u, p) for u, p in zip(part.column(k).to_pylist(), parsed, strict=True)]
                        yield part.columns[:k], sites, parsed, [shared.value.get(s, none) for s in sites]

            yield from run(each())

        return src.mapInArrow(freeing(looked_up), schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, k + 1):
                sites = [site_of(u, Page(h or "")) for u, h in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sites, pa.int64())], names=[*part.schema.names, "site"])

    at_site = staged(src.mapInArrow(freeing(placed), src.withColumn("site", F.lit(0).cast("long")).schema), "html-pages")
    parts = at_site.groupBy("site").agg(F.ceil(F.count("*") / SITE_PAGES).cast("int").alias("parts"))
    packed = templates.groupBy("site").agg(F.collect_list(F.struct("token", "class", "holder")).alias("template")).join(parts, "site")  # no more than a few pages' tokens
    packed = packed.select("site", "template", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    hot = F.broadcast(parts.filter("parts > 1"))  # a row for each SITE_PAGES pages at most
    dealt = at_site.join(hot, "site", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("url", "html"), F.col("parts")), F.lit(0)).cast("int"))
    joined = dealt.join(packed, ["site", "part"], "left").select(*[f"k{i}" for i in range(k)], "html", "site", "template")

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for part in slices(batch, k):
                    templates_ = [Template({x["token"]: x["class"] for x in t or ()}, {x["class"]: x["holder"] for x in t or ()}) for t in part.column(k + 2).to_pylist()]
                    yield part.columns[:k], part.column(k + 1).to_pylist(), [Page(h or "") for h in part.column(k).to_pylist()], templates_

        yield from run(each())

    return joined.mapInArrow(freeing(carried), schema)


def deduce_templates(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """site, token, class, holder: the tokens of each site's template; sites without a valid class have no rows."""
    counted = pages.select(F.col(url).cast("string"), F.col(source).cast("string")).mapInArrow(freeing(_occurrences), "site long, token long, f0 long, f1 long, pages long")
    tokens = counted.groupBy("site", "token").agg((F.sum("f0") % (1 << 32)).alias("f0"), (F.sum("f1") % (1 << 32)).alias("f1"), F.sum("pages").alias("pages"))
    tokens = staged(tokens.filter(F.col("pages") >= MIN_PAGES), "html-tokens")
    sizes = tokens.filter("token = 0").select("site", F.col("pages").alias("site_pages"))
    frequent = tokens.filter("token <> 0").join(sizes, "site").filter(F.col("pages") >= F.col("site_pages") * SUPPORT)
    classes = frequent.groupBy("site", "f0", "f1", "pages").agg(F.collect_set("token").alias("tokens"))  # tokens of half the pages: no more than two pages hold
    classes = classes.filter(F.size("tokens") >= MIN_TOKENS).select("site", F.explode("tokens").alias("token"), F.xxhash64("f0", "f1", "pages").alias("class"))
    classes = staged(classes.withColumn("holder", F.lit(0).cast("long")), "html-classes")
    dropped(tokens)

    def run(parts):
        yield from _arranged((sites, parsed, [t.class_of for t in found]) for _, sites, parsed, found in parts)

    arranged = _with_templates(pages, classes, [], url, source, run, "site long, class long, order long, holder long")
    valid = arranged.groupBy("site", "class").agg(F.min("order").alias("o0"), F.max("order").alias("o1"), F.sum((F.col("order") == 0).cast("int")).alias("bad"), F.min("holder").alias("h0"), F.max("holder").alias("h1"))
    valid = valid.filter("o0 = o1 AND bad = 0").select("site", "class", F.when(F.col("h0") == F.col("h1"), F.col("h0")).otherwise(F.lit(0)).alias("holder"))
    return classes.drop("holder").join(valid, ["site", "class"]).select("site", "token", "class", "holder")


def extract_text(pages: DataFrame, keep: list[str], url: str = "url", source: str = "html", text: str = "text") -> DataFrame:
    """The columns `keep` of every page with its main text (a column of that name is replaced).

    Null and empty html: empty text. A null url, or one without a host, belongs to the host named ''. Repeated pages are judged
    one by one; long pages are read whole; an empty table gives an empty table; other columns may have any names.
    """
    templates = staged(deduce_templates(pages, url, source), "html-templates")
    keep = [c for c in keep if c != text]

    def run(parts):
        for columns, _, parsed, found in parts:
            texts = [page.text(t) for page, t in zip(parsed, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*keep, text])

    return _with_templates(pages, templates, keep, url, source, run, pages.select(*keep, F.lit("").alias(text)).schema)


def op8_html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page: nulls, ties, repeated and long pages as extract_text has them."""
    out = extract_text(pages, ["page_id", "url"])
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
