"""Main text of web pages by template deduction from equivalence classes.

1. Each page gives tokens: the paths of its container elements (``div.ad`` in ``body``) with the text and link text that stands
   directly in them, and the texts in them. The slot with most text outside links leads its page; its texts are no tokens.
2. Tokens of one host that occur on the same pages form an equivalence class. A text occurs only where its slot does, so it
   is in the slot's class exactly if both are on equally many pages; counts stand for occurrence vectors. Pages whose leading
   slots say the same (copies, mirrors, print versions) count as one. A slot is valid if enough of the host's pages hold it.
3. Texts in the class of their slot, or on a good part of its pages, are the template's. Those of a slot that leads its pages
   never are. This holds inside articles too, but for headings, lists and cells there. Names are hints: what is called
   navigation, advert, form or comments goes; where the page itself has an article, what lies outside it stays only if it leads its
   pages; elsewhere slots of links are navigation.
4. A slot that isn't valid is judged by its own page.

Character references are decoded, white space inside a block is one space, blocks are joined by two newlines. Scripts, styles,
titles, comments in markup, drawings, templates and choices of forms are dropped, to the end of the page only where HTML says so (scripts, styles,
titles, frames and text areas that aren't closed). A missing or empty page, or one without text, gives an empty
text. A page whose address has no host is a host of its own. Repeated pages are extracted each by itself.
"""

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.rows import map_texts
from txnflow.operators.sizing import broadcast_if_small
from txnflow.workspace import materialize

#: A class is valid if this share of the host's pages hold it, and two of them at least.
SUPPORT = 0.1
#: If this share of a slot's pages, and ``STATIC_PAGES`` at least, show the same text, its repeated texts belong to the template.
STATIC, STATIC_PAGES = 0.5, 3
#: A slot that has most text on this share of its pages holds the content; its texts are never the template's.
LEADS = 0.5
#: A slot with more of its text in links than this is navigation.
LINKS = 0.5
#: Without an article, slots with at least this share of the largest slot's text are kept.
SHARE = 0.2

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<(script|style|title|textarea|iframe)(?=[\s/>]).*?(?:</\1(?=[\s/>])[^>]*>|$)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'<]+|"[^"<]*"|'[^'<]*'|["'])*+)>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_CONTAINERS = frozenset("html body div section article main nav header footer aside form noscript".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th thead tbody caption blockquote pre figure "
                                  "figcaption address fieldset details summary hr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = "|".join(sorted(_BLOCKS - {"hr"}))
#: Elements without text of the page, and where they end; one that is never closed drops nothing.
_SKIPPED = {tag: re.compile(end, re.I) for tag, end in {
    "svg": rf"</svg\s*>|(?=</?(?:{_NAMES})[\s/>])", "select": rf"</select\s*>|(?=</?(?:{_NAMES}|input|textarea|button)[\s/>])",
    "template": r"</template\s*>"}.items()}
#: Start tags that end an open paragraph or an element of their own kind.
_ENDS_ITSELF = frozenset("li dt dd tr td th option".split())
_BOILERPLATE = frozenset(
    "nav navigation navbar menu header masthead footer aside side sidebar ad ads advert adverts advertisement advertising sponsor sponsored banner promo "
    "cookie cookies consent gdpr notice notices popup modal overlay form login signup subscribe newsletter comment comments commentlist "
    "disqus respond related recommended share sharing social breadcrumb breadcrumbs pagination pager widget toolbar skip complementary "
    "contentinfo search".split())
#: Words that a boilerplate name may have besides.
_BOILERPLATE_PARTS = _BOILERPLATE | frozenset(
    "main site global primary secondary bar box block list area section slot unit link links posts item items button buttons thread reply replies".split())
_MAIN = frozenset("article main".split())
#: Parts of an article's own text, such as a heading that many articles of a host share.
_PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dl dt dd tr th td thead tbody caption figcaption summary".split())


def _tag(path: str) -> str:
    """The name of the element a path ends in."""
    return path.rpartition("/")[2].partition(".")[0]


def _label(tag: str, attributes: str) -> str:
    """An element's name with its classes and id; digits don't count."""
    if "=" not in attributes:
        return tag
    words = sorted({re.sub(r"\d+", "", w).lower() for m in _ATTRIBUTE.finditer(attributes)
                    for w in (m[2] or m[3] or m[4] or "").replace("/", "-").split()} - {""})
    return ".".join([tag, *words])


def _names_boilerplate(name: str) -> bool:
    """Whether all of a class name says so: ``sidebar`` and ``comment-list`` do, ``has-sidebar`` and ``comment-open`` don't."""
    parts = [w for w in re.split(r"[-_:]+", name) if w]
    return not _BOILERPLATE.isdisjoint(parts) and _BOILERPLATE_PARTS.issuperset(parts)


@lru_cache(1 << 16)
def role_of(path: str) -> str:
    """``main``, ``inner`` (an article in boilerplate), ``boilerplate`` or nothing, from the names along a path.

    A header inside an article is part of it.
    """
    role, hidden = "", False
    for label in path.split("/"):
        tag, *names = label.split(".")
        if tag in ("html", "body"):
            continue
        main = tag not in _BOILERPLATE and not _MAIN.isdisjoint((tag, *names))
        found = {n for n in (tag, *names) if _names_boilerplate(n)} - ({"header", "masthead"} if role else set())
        if main:
            found = {n for n in found if not {"comment", "comments"}.isdisjoint(re.split(r"[-_:]+", n))}
        if found and role:
            return "boilerplate"
        if found:
            hidden = True
        elif main:
            role = role or ("inner" if hidden else "main")
    return role or ("boilerplate" if hidden else "")


def blocks(page: str | None) -> Iterator[tuple[str, str, int]]:
    """(path, text, characters in links) of each block of a page, in order."""
    open_tags: list[tuple[str, str]] = []  # tag, path of the container it is or stands in
    links, parts, linked, last = 0, [], 0, 0
    page, endless = page or "", set()

    def path() -> str:
        return open_tags[-1][1] if open_tags else ""

    def flush() -> Iterator[tuple[str, str, int]]:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            yield path(), text, min(linked, len(text))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() < last:  # in a skipped element
            last = max(last, m.end())
            continue
        if m.start() > last:
            parts.append(page[last:m.start()])
            linked += (m.start() - last) * (links > 0)
        last = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in _SKIPPED:
            if not m[2] and not (tag == "svg" and m[4].endswith("/")) and tag not in endless:
                if end := _SKIPPED[tag].search(page, last):
                    last = end.end()
                else:
                    endless.add(tag)
            continue
        if tag in _BLOCKS:
            yield from flush()
        elif tag == "br":
            parts.append(" ")
        if tag in _VOID:
            continue
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            at = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag), None)
            inner_container = at is not None and tag not in _CONTAINERS and any(t in _CONTAINERS for t, _ in open_tags[at + 1:])
            if at is not None and not inner_container:
                del open_tags[at:]
            continue
        if tag == "a":
            links += 1
        if tag in _BLOCKS:
            for k in range(len(open_tags) - 1, -1, -1):
                name = open_tags[k][0]
                if name == "p" or name == tag and tag in _ENDS_ITSELF:
                    del open_tags[k:]
                    links = 0 if tag != "a" else links
                    break
                if name in _CONTAINERS or name in ("ul", "ol", "dl", "table"):
                    break
        if tag in _CONTAINERS:
            own = _label(tag, m[4])
            open_tags.append((tag, f"{path()}/{own}" if path() else own))
        elif "=" in m[4] and tag in _BLOCKS and (own := _label(tag, m[4])) != tag:
            open_tags.append((tag, f"{path()}/{own}"))
        else:
            open_tags.append((tag, path()))
    parts.append(page[last:])
    linked += (len(page) - last) * (links > 0)
    yield from flush()


def _slots(found: list[tuple[str, str, int]]) -> dict[str, list[int]]:
    """path -> characters of the blocks that stand there, and those in links."""
    sizes: dict[str, list[int]] = {}
    for path, text, linked in found:
        own = sizes.setdefault(path, [0, 0])
        own[0] += len(text)
        own[1] += linked
    return sizes


def _leading(sizes: dict[str, list[int]]) -> set[str]:
    """The slots with most text outside links, of those that aren't boilerplate by their names."""
    free = {p: chars - linked for p, (chars, linked) in sizes.items() if chars > linked and role_of(p) != "boilerplate"}
    most = max(free.values(), default=0)
    return {p for p, n in free.items() if n == most}


def hash_text(*texts: str) -> int:
    raw = "\n\n".join(texts).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big", signed=True)


def _page_tokens(page: str | None) -> tuple[int, list[tuple]]:
    """What tells the page's content from others, and its tokens: path, text, characters, those in links, whether the slot leads.

    The token without a path is the page's own, those without a text are slots, the others the texts in slots that don't lead.
    """
    found = list(blocks(page))
    sizes = _slots(found)
    leading = _leading(sizes)
    content = hash_text(*(t for p, t, _ in found if p in leading)) if leading else hash_text(page or "")
    tokens = [(None, None, 0, 0, 0)]
    tokens += [(p, None, *sizes[p], int(p in leading)) for p in sizes if role_of(p) != "boilerplate"]
    tokens += [(p, h, 0, 0, 0) for p, h in {(p, hash_text(t)) for p, t, _ in found if p not in leading and role_of(p) != "boilerplate"}]
    return content, tokens


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    alone = F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    return pages.select("page_id", "url", "html", F.coalesce(F.nullif(host, F.lit("")), alone).alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """host, template: its slots with their verdict, as JSON; pages: html, host."""
    fields = {"content": "bigint", "path": "string", "shown": "bigint", "chars": "bigint", "linked": "bigint", "leads": "bigint"}

    def made(texts: list[str | None]) -> Iterator:
        rows = [(k, content, *t) for k, (content, tokens) in enumerate(map(_page_tokens, texts)) for t in tokens]
        columns = list(zip(*rows, strict=True)) or [()] * (1 + len(fields))
        yield columns[0], dict(zip(fields, columns[1:], strict=True))

    tokens = map_texts(pages, "html", made, fields, ["host"]).select("row.*", *fields)
    # Copies count once: pages of a host with the same content give one row for each token.
    once = tokens.groupBy("host", "content", "path", "shown").agg(*(F.max(c).alias(c) for c in ("chars", "linked", "leads")))
    counts = materialize(once.groupBy("host", "path", "shown").agg(
        F.count(F.lit(1)).alias("pages"), *(F.sum(c).alias(c) for c in ("chars", "linked", "leads"))), "tokens")
    sizes = counts.where("path is null").select("host", F.col("pages").alias("host_pages"))
    slots = counts.where("path is not null and shown is null").join(sizes, "host").where(
        (F.col("pages") >= SUPPORT * F.col("host_pages")) & ((F.col("pages") > 1) | (F.col("host_pages") == 1)))
    slots = materialize(slots.select("host", "path", "pages", (F.col("linked") > LINKS * F.col("chars")).alias("links"),
                                     (F.col("leads") >= LEADS * F.col("pages")).alias("leads")), "slots")
    shown = counts.where("shown is not null").select("host", "path", "shown", F.col("pages").alias("alike")).where("alike > 1")
    often = shown.join(broadcast_if_small(slots.where("not leads").select("host", "path", "pages")), ["host", "path"]).where(
        F.col("alike") >= SUPPORT * F.col("pages"))
    # At most 1 / SUPPORT texts for each block of a page are left of a slot.
    texts = often.groupBy("host", "path").agg(F.max("alike").alias("most"), F.max("pages").alias("held"), F.collect_list("shown").alias("texts"))
    static = texts.where((F.col("most") >= STATIC_PAGES) & (F.col("most") >= STATIC * F.col("held"))).select("host", "path", "texts")
    slots = slots.join(static, ["host", "path"], "left").select("host", F.struct("path", "links", "leads", "texts").alias("slot"))
    return slots.groupBy("host").agg(F.to_json(F.array_sort(F.collect_list("slot"))).alias("template"))


class Slot(NamedTuple):
    links: bool
    leads: bool
    texts: frozenset[int]


@lru_cache(1024)
def verdicts(template: str) -> dict[str, Slot]:
    """path -> whether it consists of links, whether it leads its pages, and the texts in it that are the template's."""
    return {s.get("path", ""): Slot(s["links"], s["leads"], frozenset(s.get("texts", ()))) for s in json.loads(template)}


def extracted(page: str | None, template: str | None) -> str:
    """The page's blocks in main slots."""
    known = verdicts(template or "[]")
    found = list(blocks(page))
    sizes = _slots(found)
    kept = []
    roles = {role_of(p) for p in sizes}
    # An article inside an advert or a sidebar is the page's only where nothing larger stands outside.
    main = "main" if "main" in roles else "inner" if "inner" in roles and {"inner"} == {role_of(p) for p in _leading(sizes)} else None
    for path, text, _ in found:
        role, slot = role_of(path), known.get(path)
        if role == "boilerplate" or role == "inner" != main:
            continue
        if main:
            keep = role == main or bool(slot and slot.leads and not slot.links)
        else:
            chars, linked = sizes[path]
            keep = not (slot.links if slot else linked > LINKS * chars)
        if keep and slot and slot.texts and not (role and _tag(path) in _PARTS):
            keep = hash_text(text) not in slot.texts
        if keep:
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    hosted = with_host(pages)
    found = broadcast_if_small(materialize(templates(hosted), "templates"))
    joined = hosted.join(found, "host", "left")
    # The page and its host's template travel together as one text, the template first.
    both = joined.select("page_id", "url", F.concat(F.coalesce("template", F.lit("[]")), F.lit("\n"), F.coalesce("html", F.lit(""))).alias("both"))

    def made(texts: list[str | None]) -> Iterator:
        cut = [t.split("\n", 1) for t in texts]
        done = [extracted(page, template) for template, page in cut]
        yield None, {"text": done, "n_chars": [len(t) for t in done]}

    return map_texts(both, "both", made, {"text": "string", "n_chars": "bigint"}, ["page_id", "url"]).select("row.*", "text", "n_chars")
