"""Main text of web pages by deducing the template of their host from equivalence classes of tokens.

1. Tokens. A page is a sequence of tags and texts. A token is a tag or a whole text together with the path of container
   elements it stands in (the second of two equal siblings is another element), so equal tags in different places differ.
2. Occurrence vectors. The vector of a token says how often it occurs on each page of a host. It is kept as a digest: the
   exclusive or over the pages of a hash of (page, number of times), with the number of pages and of occurrences. Digests of
   parts merge, so hosts of any size are counted with map-side combination and no page is gathered.
3. Equivalence classes. Tokens of a host with equal vectors form a class; it is valid on at least ``SUPPORT`` pages. The classes
   of at least ``CLASS`` tags that occur once a page are the roots of the host's layouts: what all pages share and what each
   layout adds; a page's own tokens choose among them. On less than ``ROOT_SHARE`` of the pages a root must not hold more texts
   than tags, else it is a group of copies. Classes of at least ``CLASS`` tokens of one container with several occurrences a
   page are records (items of a list, paragraphs) nested in the slots, if they begin with a block.
4. Slots. Between consecutive root tokens of containers lies a slot; a second reading of the pages sums its text and linked
   text, whatever other tags it holds, and that of each nested class. A slot is content if it has enough text over all pages of
   the host and links are the lesser part; a record that is decides for itself, and so does one of links. If no slot of a
   page is content, all are. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are page
   furniture, by their element or by their names: an article ends what one word of a longer name or a form around it says,
   main ends all, and inside an article a name must mean furniture as a whole, and not a header. If the page has an article
   or main element, what lies outside is furniture, too; inside, slots and records of links are none of the text, short ones
   stay. Texts of the classes are part of the template and no content. An article of which the template takes more than half
   is left whole.
5. Extraction. Each page is read once more; the texts of its content slots make blocks.

Hosts with fewer than ``SUPPORT`` pages have no template; the same rules are then applied to the page's own elements.

Defined cases: null and empty pages have an empty text; markup that is cut off or never closed is read as far as it goes; a null
or odd url counts as one more host; rows that repeat a page id are pages of their own; an empty table gives an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SUPPORT = 3
CLASS = 3
#: Share of a host's pages from which a class may hold more texts than tags.
ROOT_SHARE = 0.5
#: Templates up to this number of rows are broadcast; beyond it they are joined by host.
BROADCAST_ROWS = 200_000
#: Tokens that a task counts before it hands them on.
HELD = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|object|math)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+)|<",
    re.S | re.I,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Fixed values of HTML: elements without content, elements that start a block, elements that can hold others.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CONTAINER = frozenset("article aside body details dialog div dl fieldset figure footer form head header html main menu nav ol section table title ul button label".split())
_FURNITURE = frozenset("aside button dialog footer form head label menu nav title".split())
_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets contentinfo complementary search".split()
)
#: Words of headers, which may hold an article's title.
_HEADER = frozenset("header masthead banner".split())
#: Parts of a name that leave the meaning to the others, and those that say what surrounds an element.
_PLAIN = frozenset("area bar block bottom box button buttons container global group inner item items left link links list main outer page post posts right section site slot top unit wrap wrapper".split())
_ASIDE = frozenset("has with no without is not".split())
#: Elements inside a block whose name counts, up to their end; in texts and code some words say something else.
_INLINE = frozenset("p span h1 h2 h3 h4 h5 h6 a b i em strong small font".split())
_INLINE_WORDS = _WORDS - _HEADER - frozenset("comment comments replies search footer menu modal widget widgets contentinfo complementary".split())
_WRAPPED = re.compile(r"<(?:h1|article|main)\b", re.I)


def _marks(attributes: str) -> tuple[set[str], set[str], bool]:
    """Furniture words of an element's names: those that a whole name means, all of them; whether it is named main."""
    whole: set[str] = set()
    some: set[str] = set()
    main = False
    for n in _NAMED.finditer(attributes):
        for name in (n[2] or n[3] or n[4] or "").lower().split():
            main = main or name == "main"
            parts = [w for w in re.split(r"[^a-z]+", name) if w]
            mark = _WORDS.intersection(parts)
            if not mark or parts[0] in _ASIDE:
                continue
            some |= mark
            if all(w in _WORDS or w in _PLAIN for w in parts):
                whole |= mark
    return whole, some, main


class _Page:
    """Reads a page: yields (kind, token key, furniture, in article, text) with kind 'tag' or 'text'."""

    def __init__(self, html: str, trust: bool = False):
        self.html = html
        #: Whether an article is content in furniture, too.
        self.trust = trust
        self.form = (0, False)
        self.body = -1

    def wraps(self, at: int) -> bool:
        """Whether the form that begins here is around the page and not a part of it."""
        if at >= self.form[0]:
            end = re.compile(r"</form\b", re.I).search(self.html, at)
            end = end.start() if end else len(self.html)
            if self.body < 0:
                body = re.search(r"<body\b", self.html, re.I)
                self.body = body.start() if body else 0
            most = (end - at) * 2 > len(self.html) - self.body
            self.form = (end, bool(_WRAPPED.search(self.html, at, end)) or (most and re.compile(r"<(?:div|p|table)\b", re.I).search(self.html, at, end) is not None))
        return self.form[1]

    def tokens(self) -> Iterator[tuple[str, str, bool, bool, str, str]]:
        # name, furniture (2: an article does not end it), in article, path, number of children by name
        stack: list[tuple[str, int, bool, str, dict[str, int]]] = []
        top: dict[str, int] = {}
        path, furniture, article, links = "", 0, False, 0
        mute, level = "", 0  # the element inside a block that is furniture
        for m in _TOKEN.finditer(self.html):
            text = "<" if m[0] == "<" else m[5]
            if text is not None:
                if not text.isspace():
                    yield "text", path, bool(furniture or mute), article, text, "a" if links > 0 else ""
                continue
            name = m[3]
            if not name:
                continue
            name = name.lower()
            if name == "a":
                links = 0 if m[2] else 1
            if mute:
                if name == mute and (m[2] or name not in _BLOCK):
                    level += -1 if m[2] else 1
                    mute = mute if level else ""
                elif name in _BLOCK or name in _CONTAINER:
                    mute = ""
            named = not m[2] and m[4] and "=" in m[4]
            if name not in _CONTAINER:
                if named and not mute and name in _INLINE and _INLINE_WORDS & _marks(m[4])[0]:
                    mute, level = name, 1
                yield "tag", f"{path}|{m[2]}{name}", bool(furniture or mute), article, "", name
                continue
            if m[2]:
                depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), -1)
                yield "tag", f"{stack[depth][3] if depth >= 0 else path}|/{name}", bool(furniture), article, "", name
                if depth >= 0:
                    del stack[depth:]
                    path, furniture, article = stack[-1][3] if stack else "", stack[-1][1] if stack else 0, bool(stack) and stack[-1][2]
                continue
            whole, some, main = _marks(m[4]) if named else ((), (), False)
            mark = some
            if name in ("html", "body"):
                pass
            elif name == "main" or (main and name not in _FURNITURE and not whole):
                article, furniture = True, 0
            elif name == "article":
                furniture = 0 if self.trust or furniture < 2 else furniture
                article = True
            elif name == "header" or (whole and _HEADER.issuperset(whole)):
                furniture = furniture or (0 if article else 1)
            elif name == "form":
                furniture = furniture or (0 if self.wraps(m.start()) else 1)
            elif name in _FURNITURE or whole:
                furniture = 2
            elif some and not article:
                furniture = furniture or 1
            counts = stack[-1][4] if stack else top
            counts[name] = counts.get(name, 0) + 1
            path = f"{path}/{name}{'.' + min(mark) if mark else ''}{counts[name] if counts[name] > 1 else ''}"
            links = 0
            stack.append((name, furniture, article, path, {}))
            yield "tag", path, bool(furniture), article, "", name


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _hash(key: str) -> int:
    return int.from_bytes(_digest(key), "little", signed=True)


def _digest(key: str) -> bytes:
    import hashlib

    return hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=8).digest()


def page_counts(html: str) -> dict[str, list]:
    """For each token of a page: occurrences, furniture, in article, opens or ends a container, first position, kind, container."""
    found: dict[str, list] = {}
    for at, (kind, key, furniture, article, text, name) in enumerate(_Page(html).tokens()):
        base = key.partition("|")[0]
        if kind == "text":
            key = f"{key}#{' '.join(text.split())}"
        entry = found.get(key)
        if entry is None:
            entry = found[key] = [0, furniture, article, kind == "tag" and name in _CONTAINER, at, kind, base]
        entry[0] += 1
    return found


COUNTS = "host string, token long, digest long, pages long, times long, ahead long, text boolean, furniture boolean, article boolean, container boolean, base long, name string"


def token_counts(pages: DataFrame) -> DataFrame:
    """Merged vectors by (host, token); ``pages``: host, page (a hash that tells pages apart), html."""

    def run(batches):
        held: dict[tuple[str, str], list] = {}

        def flush():
            rows = [(h, _hash(k), *v[:4], v[4] == "text", *v[5:8], _hash(v[8]), None if v[4] == "text" else k[-60:]) for (h, k), v in held.items()]
            held.clear()
            types = (pa.string(), *[pa.int64()] * 5, *[pa.bool_()] * 4, pa.int64(), pa.string())
            names = ("host", "token", "digest", "pages", "times", "ahead", "text", "furniture", "article", "container", "base", "name")
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], list(names))

        for b in batches:
            hosts, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
            for host, page, html in zip(hosts, keys, b.column(2)):
                for key, (n, furniture, article, container, at, kind, base) in page_counts(html.as_py()).items():
                    mixed = ((page ^ (n * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
                    mixed = (mixed ^ (mixed >> 32)) - (1 << 63)
                    v = held.get((host, key))
                    if v is None:
                        held[host, key] = [mixed, 1, n, at, kind, furniture, article, container, base]
                    else:
                        v[0] ^= mixed
                        v[1] += 1
                        v[2] += n
                        v[3] += at
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    parts = pages.mapInArrow(run, COUNTS)
    return parts.groupBy("host", "token").agg(
        F.bit_xor("digest").alias("digest"), *[F.sum(c).alias(c) for c in ("pages", "times", "ahead")], *[F.max(c).alias(c) for c in ("text", "furniture", "article", "container", "base", "name")]
    )


def templates(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per host: the tokens of its valid root classes, with the slot that a container's token begins.

    ``sizes``: host and its number of pages. A template has as many rows as its host's root classes, whatever the pages.
    """
    some = counts.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "host").where(F.col("pages") >= SUPPORT)
    once = some.where("times = pages")
    # a class of texts and few tags is a group of copies and no layout
    groups = once.groupBy("host", "digest", "pages", "n").agg(F.count_if("text").alias("texts"), F.count_if(~F.col("text")).alias("tags"))
    roots = groups.where((F.col("tags") >= CLASS) & ((F.col("pages") >= F.col("n") * ROOT_SHARE) | (F.col("texts") <= F.col("tags")))).select("host", "digest", "pages")
    root = once.join(roots, ["host", "digest", "pages"]).where("text OR container").select("host", "token", F.when(~F.col("text"), F.col("token")).alias("slot"), "text", F.lit(False).alias("nested"), F.lit(False).alias("last"))
    # classes with several occurrences a page: records inside a container, from a block's tag on
    many = some.where("times > pages AND NOT container")
    tag = F.when(~F.col("text"), F.col("ahead") / F.col("pages"))
    records = many.groupBy("host", "digest", "pages", "times", "base").agg(F.count(F.lit(1)).alias("size"), F.min_by("name", tag).alias("first"), F.max_by("token", tag).alias("end")).where(F.col("size") >= CLASS)
    records = records.where(F.regexp_extract("first", r"\|([a-z0-9]+)$", 1).isin(sorted(_BLOCK))).select("host", "digest", "pages", "times", "base", "end")
    nested = many.join(records, ["host", "digest", "pages", "times", "base"]).select("host", "token", F.when(~F.col("text"), F.xxhash64("digest", "times", "base")).alias("slot"), "text", ~F.col("text"), F.col("token") == F.col("end"))
    tokens = root.union(nested).select("host", F.struct("token", "slot", "text", "nested", "last").alias("t"))
    return tokens.groupBy("host").agg(F.array_sort(F.collect_list("t")).alias("template"))


def _slots(tokens: list[tuple], template: dict[int, dict]) -> list[dict | None]:
    """The template's entry of each token of a page, if there is one."""
    nested = any(t["nested"] for t in template.values())
    return [template.get(_hash(f"{t[1]}#{' '.join(t[4].split())}" if t[0] == "text" else t[1])) if template and (nested or t[0] == "text" or t[5] in _CONTAINER) else None for t in tokens]


def slot_texts(html: str, template: dict[int, dict]) -> dict[int, list[int]]:
    """Text and linked text of a page by slot: all that stands between one root token and the next, but for template texts.

    What stands in a record counts for its class and for the slot around it.
    """
    found: dict[int, list[int]] = {}
    slot = inner = None
    tokens = list(_Page(html).tokens())
    for (kind, _, furniture, _, text, name), t in zip(tokens, _slots(tokens, template)):
        if kind == "tag":
            if t and t["nested"]:
                inner = None if t["last"] else found.setdefault(t["slot"], [0, 0])
            elif t:
                slot, inner = found.setdefault(t["slot"], [0, 0]), None
        elif not furniture and not t:
            n = len(" ".join(text.split()))
            for v in (slot, inner):
                if v is not None:
                    v[0] += n
                    v[1] += n if name else 0
    return found


def slot_counts(pages: DataFrame) -> DataFrame:
    """One row per host: whether its slots are content, by their text over all pages; ``pages``: host, html, template."""

    def run(batches):
        held: dict[tuple[str, int], list[int]] = {}
        known: dict[str, dict] = {}

        def flush():
            rows = [(h, k, *v) for (h, k), v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 4))], ["host", "slot", "pages", "chars", "linked"])

        for b in batches:
            for host, html, template in zip(*b.columns):
                for slot, (chars, linked) in slot_texts(html.as_py(), _known(known, host.as_py(), template)).items():
                    v = held.setdefault((host.as_py(), slot), [0, 0, 0])
                    v[0] += 1
                    v[1] += chars
                    v[2] += linked
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    sums = pages.mapInArrow(run, "host string, slot long, pages long, chars long, linked long").groupBy("host", "slot").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "linked")])
    rich = (F.col("chars") >= 25 * F.col("pages")) & (F.col("linked") * 2 < F.col("chars"))
    return sums.groupBy("host").agg(F.collect_list(F.struct("slot", rich.alias("rich"), ((F.col("linked") > 0) & (F.col("linked") * 2 >= F.col("chars"))).alias("links"))).alias("slots"))


def _known(known: dict[str, dict], host: str, template: pa.Scalar, slots: pa.Scalar | None = None) -> dict[int, dict]:
    """The template of a host by token, read once a host."""
    found = known.get(host)
    if found is None:
        if len(known) >= 1000:
            known.clear()
        kinds = {s["slot"]: s for s in (slots.as_py() if slots is not None else None) or ()}
        found = known[host] = {t["token"]: {"rich": False, "links": False} | t | kinds.get(t["slot"], {}) for t in template.as_py() or ()}
    return found


def extract(html: str, template: dict[int, dict] | None = None, trust: bool = False) -> str:
    """Main text of one page; ``template``: the tokens of its host by token (slot, text, nested, last, rich, links)."""
    tokens = list(_Page(html, trust).tokens())
    own_article = any(t[3] and not t[2] and t[0] == "text" for t in tokens)
    # the page's own tokens choose its layout
    at = _slots(tokens, template or {})
    judged = any(slot and slot["rich"] for slot in at)
    if own_article and template:
        # in an article short slots stay, and template texts and links are the lesser part, else they are what the page is about
        chars = [0, 0]
        for n, dropped in _kept(tokens, at, True, False):
            chars[dropped] += len(tokens[n][4])
        if chars[True] > chars[False]:
            at = [None] * len(tokens)
    kept = {n for n, dropped in _kept(tokens, at, own_article, judged) if not dropped}
    blocks: list[str] = []
    parts: list[str] = []

    def close() -> None:
        if parts and (block := _clean(parts)):
            blocks.append(block)
        parts.clear()

    for n, (kind, _, _, _, text, name) in enumerate(tokens):
        if kind == "text":
            if n in kept:
                parts.append(text)
        elif name == "br":
            parts.append(" ")
        elif name in _BLOCK:
            close()
    close()
    if not blocks and not trust and any(t[3] for t in tokens):
        return extract(html, template, True)  # a name on what is around the page
    return "\n".join(blocks)


def _kept(tokens: list[tuple], at: list[dict | None], own_article: bool, judged: bool) -> Iterator[tuple[int, bool]]:
    """The texts outside furniture by position, and whether the template says that they are no content."""
    rich, links, inner = True, False, None
    for n, ((kind, key, furniture, article, _, name), slot) in enumerate(zip(tokens, at)):
        if kind == "text":
            if furniture or (own_article and not article):
                continue
            if inner is not None and (inner["rich"] or inner["links"]):
                yield n, bool(slot) or (inner["links"] and not inner["rich"] and (own_article or judged))
            else:
                yield n, bool(slot) or (links if own_article else judged and not rich)
        elif slot and slot["nested"]:
            inner = None if slot["last"] else slot
        elif slot:
            rich, links, inner = slot["rich"], slot["links"], None
        elif name in _CONTAINER:
            inner = None
            if not links and "|" not in key:
                rich = True  # a container that no layout knows, and not in a list of links


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    # a number of its own for every row, so that equal rows do not cancel out; it is used in one stored pass alone
    page = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 62) - 1))
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), host.alias("host"))
    counted = token_counts(pages.select(host.alias("host"), page.alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html")))
    found = stored(templates(stored(counted, "tokens"), rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))), "templates")
    n = found.agg(F.sum(F.size("template"))).first()[0] or 0
    near = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    slots = slot_counts(rows.join(near(found), "host").select("host", "html", "template"))
    found = stored(found.join(slots, "host", "left"), "slots")

    def run(batches):
        known: dict[str, dict] = {}
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [extract(h.as_py(), _known(known, o.as_py(), t, s)) for o, h, t, s in zip(*(part.column(c) for c in ("host", "html", "template", "slots")))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    joined = rows.join(near(found), "host", "left").select("id", "url", "host", "html", "template", "slots")
    kind = dict(pages.dtypes)
    return joined.mapInArrow(run, f"id {kind[id]}, url {kind[url]}, text string, n_chars long").withColumnsRenamed({"id": id, "url": url})
