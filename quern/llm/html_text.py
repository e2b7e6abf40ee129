"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that stands in them outside links, where repeated containers, lists, tables and
quotes, and all that is in an article count as text of what holds them, and text within containers that look like boilerplate
(by element, role, or name of class or id) counts little; Spark adds up, per host, the shares that every generalised tag-class
path won, and the page is extracted again from the containers at its host's winning path (its own best one where the path is
absent). Boilerplate is left out only below the winning container: a name alone never removes what holds the main text.
Paths and hosts are 64-bit hashes, so a page costs memory in proportion to its length however deep it nests.
Defined results: null, empty or textless html gives ''; a null or odd url is the host ''; ties go to the path of the least hash;
repeated rows vote and are extracted each; extra columns are not read, whatever their names; pages of any length and depth are
read whole; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices, small_batches, stored

#: Elements that hold other blocks, that are left out with all they hold, that are boilerplate unless the main text is in them.
HOLDERS = frozenset("html body main article section div aside nav header footer form table tbody tr td th ul ol dl details dialog figure fieldset blockquote center menu".split())
OUT = frozenset("head title noscript template button select svg iframe object canvas".split())
ASIDE = frozenset("nav header footer aside form dialog menu".split())
RAW = frozenset("script style textarea xmp".split())
BREAKS = HOLDERS | frozenset("p br hr h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption summary option".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPARED = frozenset("html body main article".split())
INNER = frozenset("ul ol dl details figure blockquote table tbody tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Whole names of class or id that mark boilerplate; the same as first or last part of a compound name; those that a
#: compound marks only if most of the text is linked; first parts that make a name a state of the page; first parts of an article's own header.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus foot footer footnav header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted related replies respond share sharing sidebar sidenav signup social sponsor sponsored subscribe toolbar widget".split())
PARTS = frozenset("ad ads advert adverts advertisement breadcrumb breadcrumbs comment comments cookie cookies footer header menu nav navbar navigation newsletter pager pagination promo sidebar sponsored subscribe".split())
LINKED = NAMES - PARTS
STATES = frozenset("has no with without is not js show hide".split())
OWN = frozenset("entry post article story content".split())
#: Share of a block's text that its holder's parent is given too, weight of text a boilerplate container around it, and so many at most.
PARENT, DOUBT, MOST_DOUBT = 0.5, 0.02, 3

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
#: One attribute, whole: name, and value if it has one.
ATTR = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
PART = re.compile(r"[a-z]+")
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)

#: How sure a container is boilerplate: not at all, if most of its text is linked, whatever it holds.
PLAIN, IF_LINKED, SURE = 0, 1, 2

_paths: dict[tuple[int, str], int] = {}


def hash64(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def path_id(above: int, step: str) -> int:
    """The number of the path `above` with one more step."""
    got = _paths.get((above, step))
    if got is None:
        if len(_paths) > 100_000:
            _paths.clear()
        got = _paths[above, step] = hash64(f"{above}/{step}")
    return got


@dataclass
class Page:
    """Containers (parent, tag, path, doubt) and text blocks (container, text, linked characters) in page order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    doubt: list[int] = field(default_factory=lambda: [PLAIN])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def named(name: str) -> int:
    """What one whole name of class or id, lower case, says of its element."""
    if name in NAMES:
        return SURE
    parts = PART.findall(name)
    if len(parts) < 2 or parts[0] in STATES or parts[0] in OWN and parts[-1] == "header":
        return SURE if len(parts) == 1 and parts[0] in NAMES else PLAIN
    ends = {parts[0], parts[-1]}
    return SURE if ends & PARTS else IF_LINKED if ends & LINKED else PLAIN


def step(tag: str, attrs: str) -> tuple[str, int, bool]:
    """(generalised path step, doubt, whether a whole name or attribute says so). Digits are dropped, so numbered classes are one."""
    doubt, whole, classes = SURE if tag in ASIDE else PLAIN, False, []
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip() in ROLES:
                doubt, whole = SURE, True
            elif name in ("class", "id"):
                for w in value.split():
                    doubt, whole = max(doubt, named(w)), whole or w in NAMES
                if name == "class":
                    classes = sorted({"".join(PART.findall(w)) for w in value.split()} - {""})
    return ".".join([tag, *classes]), PLAIN if tag in SPARED else doubt, whole and tag not in SPARED


def parse(html: str | None) -> Page:
    page = Page()
    if not html:
        return page
    stack: list[tuple[str, int]] = []  # (tag, container outside) of open holders
    open_: Counter = Counter()
    skip, inside = "", 0  # the left-out element that is open, and how many of its name are open in it
    node, run, linked, link, articles = 0, [], 0, 0, 0
    pos, n = 0, len(html)

    def flush():
        nonlocal run, linked
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            if text:
                page.blocks.append((node, text, min(linked, len(text))))
            run = []
        linked = 0

    while pos < n:
        m = TAG.search(html, pos)
        end = m.start() if m else n
        if end > pos and not skip:
            run.append(html[pos:end])
            if link:
                linked += end - pos
        if not m:
            break
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not attrs.rstrip().endswith("/"):
                at = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, pos)
                pos = at.end() if at else n
            continue
        if skip:
            if skip in ("head", "title"):
                ended = tag == "body" or tag in SPARED and not closing or closing and tag == skip
                again = not (closing and tag == skip)
            elif skip in LINES:  # ends with the next block at the latest
                ended, again = tag in BREAKS and tag != "br", not (closing and tag == skip)
            elif tag == skip:
                inside += -1 if closing else 1
                ended, again = inside == 0, False
            else:  # what was left open ends with what holds it
                ended, again = closing and open_[tag] > 0 and skip not in OUT, True
            if not ended:
                continue
            skip = ""
            if not again:
                continue
        if tag in BREAKS or tag in OUT:
            flush()
        if tag == "a":
            link = 0 if closing else 1
        if closing:
            if open_[tag]:
                while stack:
                    t, node = stack.pop()
                    open_[t] -= 1
                    articles -= t in ("article", "main")
                    if t == tag:
                        break
            continue
        if tag in OUT:
            skip, inside = tag, 1
            continue
        name, doubt, whole = step(tag, attrs)
        if tag in HOLDERS:
            if tag == "header" and articles and not whole:
                doubt = PLAIN
            page.parent.append(node)
            page.tag.append(tag)
            page.path.append(path_id(page.path[node], name))
            page.doubt.append(doubt)
            stack.append((tag, node))
            open_[tag] += 1
            articles += tag in ("article", "main")
            node = len(page.parent) - 1
            link = 0
        elif whole and tag not in VOID and tag != "a":
            flush()
            skip, inside = tag, 1
    flush()
    return page


def doubted(page: Page) -> list[bool]:
    """Whether each container is boilerplate on its own account; those in doubt are if over half of their text is linked."""
    text, linked = [0] * len(page.path), [0] * len(page.path)
    for node, t, k in page.blocks:
        text[node] += len(t)
        linked[node] += k
    for node in range(len(page.path) - 1, 0, -1):
        text[page.parent[node]] += text[node]
        linked[page.parent[node]] += linked[node]
    return [d == SURE or d == IF_LINKED and 2 * k > t for d, t, k in zip(page.doubt, text, linked)]


def homes(page: Page) -> list[int]:
    """The container that each container's text counts for: its article, or the next one out that isn't INNER nor, with text, on the page more than once by its path."""
    held = [False] * len(page.path)
    for node, _, _ in page.blocks:
        while node >= 0 and not held[node]:
            held[node] = True
            node = page.parent[node]
    often = Counter(p for p, h in zip(page.path, held) if h)
    out, article = [], []
    for node, (path, tag, up) in enumerate(zip(page.path, page.tag, page.parent)):
        within = up >= 0 and article[up]
        article.append(within or tag == "article")
        out.append(out[up] if up >= 0 and tag not in ("html", "body") and (within or tag in INNER or often[path] > 1) else node)
    return out


def scores(page: Page) -> dict[int, float]:
    """Text of each container outside links and boilerplate; a block counts for its container's home and by PARENT for the next."""
    out: dict[int, float] = {}
    home, bad, around = homes(page), doubted(page), []
    for up, own in zip(page.parent, bad):
        around.append((around[up] if up >= 0 else 0) + own)
    for node, text, linked in page.blocks:
        s = (len(text) - linked) * (1 - linked / len(text)) * DOUBT ** min(around[node], MOST_DOUBT)
        node = home[node]
        out[node] = out.get(node, 0.0) + s
        up = page.parent[node]
        if up >= 0:
            out[up] = out.get(up, 0.0) + s * PARENT
    return out


def votes(page: Page) -> dict[int, float]:
    """Share of the page's score that each path has."""
    out: dict[int, float] = {}
    for node, s in scores(page).items():
        out[page.path[node]] = out.get(page.path[node], 0.0) + s
    total = sum(out.values())
    return {p: round(s / total, 6) for p, s in out.items() if s > 0} if total > 0 else {}


def below(page: Page, winner: int) -> str:
    """Blocks under the containers at a path, in page order, joined by one space, without boilerplate below them."""
    bad = doubted(page)
    inside = []
    for node, path in enumerate(page.path):
        up = page.parent[node]
        inside.append(path == winner or up >= 0 and inside[up] and not bad[node])
    return " ".join(t for node, t, _ in page.blocks if inside[node])


def extract(page: Page, winner: int | None) -> str:
    """Text at the winning path, or at the page's own best one where that gives none."""
    text = below(page, winner) if winner is not None and winner in page.path else ""
    if not text and page.blocks:
        own = votes(page)
        text = below(page, min(own, key=lambda p: (-own[p], p))) if own else " ".join(t for _, t, _ in page.blocks)
    return text


def _ballot(pages: DataFrame, url: str, html: str) -> DataFrame:
    rows = small_batches(pages.select(F.col(url).alias("url"), F.col(html).alias("html")))

    def run(batches):
        for b in batches:
            for part in slices(b, "html"):
                out: dict[tuple[int, int], float] = {}
                for u, h in zip(part.column("url").to_pylist(), part.column("html").to_pylist()):
                    host = hash64(host_of(u))
                    for p, s in votes(parse(h)).items():
                        out[host, p] = out.get((host, p), 0.0) + s
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array(list(out.values()), pa.float64())], ["host", "path", "share"])

    return rows.mapInArrow(run, "host long, path long, share double")


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path): each host's winning path, both as hashes. Sums are made in each batch and before the shuffle."""
    total = _ballot(pages, url, html).groupBy("host", "path").agg(F.round(F.sum("share"), 4).alias("share"))
    best = total.groupBy("host").agg(F.min(F.struct((-F.col("share")).alias("s"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


#: Hosts up to which the winners travel with the tasks, 16 bytes each; beyond, pages join them by host, both dealt by a salt.
MOST_HOSTS, SALTS = 1_000_000, 16


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", most_hosts: int = MOST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    winners = stored(host_paths(pages, url, html), "host-paths")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    id_type = dict(rows.dtypes)["page_id"]
    held = None
    if winners.count() <= most_hosts:
        got = winners.orderBy("host").toArrow()
        held = pages.sparkSession.sparkContext.broadcast((got.column("host").to_numpy(), got.column("path").to_numpy()))
    else:

        def with_host(batches):
            for b in batches:
                hosts = [hash64(host_of(u)) for u in b.column("url").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hosts, pa.int64())], [*b.schema.names, "host"])

        rows = small_batches(rows).mapInArrow(with_host, f"page_id {id_type}, url string, html string, host long")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        rows = rows.join(winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left").select("page_id", "url", "html", "path")

    def run(batches):
        hosts, paths = held.value if held else (np.zeros(0, np.int64),) * 2

        def winner(u: str | None) -> int | None:
            h = hash64(host_of(u))
            i = int(np.searchsorted(hosts, h))
            return int(paths[i]) if i < len(hosts) and hosts[i] == h else None

        for b in batches:
            for part in slices(b, "html"):
                urls, pages_ = part.column("url").to_pylist(), part.column("html").to_pylist()
                won = [winner(u) for u in urls] if held else part.column("path").to_pylist()
                text = [extract(parse(h), p) for h, p in zip(pages_, won)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return small_batches(rows).mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
