"""Main text of web pages by template deduction.

The pages of a host come from templates. Their tokens (elements by their place in the tree, and whole text blocks outside
the article) are found by their occurrence vectors, the number of times a token stands in each page of the host: tokens
with the same vector form an equivalence class. A class is valid if it holds an element, occurs in enough pages, and has
enough tokens or stands in every page. Valid classes are nested: each lies in the slot of one element of a class found
before it, most frequent classes first; one that straddles several slots is split by slot, and its parts must be valid
again. A host with several layouts has a class for each, as their vectors differ. On a page, a class counts if its tokens
come in the template's order. What isn't template there fills the slots between its elements, and the slots are extracted.

Names of elements and words of their class, id and role only label slots. Menus, headers, footers, sidebars, notices,
adverts, forms and comments are left out: by element name, or if an attribute has no other words than those for such
parts. An attribute with other words too ("share-price-table") labels nothing inside an article; elsewhere it does if
its element belongs to the template. If slots lie in an article element of the template, they are the text; failing
that, all articles of the page; failing these, every slot.

A vector is never built: two sums of page hashes, weighted by the count, identify it, so that a class is found by one
aggregation that combines before the shuffle, whatever a host's share of the pages. Hosts with few pages use the template
deduced from all pages together. A template has at most 1 / ``SUPPORT`` times the tokens of an average page.

A null or empty html gives an empty text; a null url has the empty host. Text blocks inside an article are never template,
so that copies of one article keep their text. Elements below ``DEEP`` levels are told apart by name only. Repeated rows
and ids are extracted one by one; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotalens.llm.common import append_columns, by_value, field, materialize, slices

by_value(__name__)

#: Pages from which a host has a template of its own, share of the pages a class must occur in, tokens of a class, levels
#: of elements, and parts into which the pages of one host are dealt when they meet their template.
OWN_TEMPLATE, SUPPORT, CLASS_SIZE, DEEP, SALTS = 4, 0.2, 3, 100, 16

#: All pages together.
POOLED = "*"

# Element names of the page format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td"
    " tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe object svg math textarea title noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button select search head header".split())
ARTICLE = frozenset("article main".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo cookie cookies consent notice notices gdpr popup modal overlay menu"
    " navbar navigation breadcrumb breadcrumbs sidebar widget footer header masthead comment comments disqus replies share sharing social"
    " related recommended newsletter subscribe signup login pagination pager toolbar skip".split())
#: Words that say nothing about a part.
NEUTRAL = frozenset(
    "area article articles author bar block body bottom box btn button buttons col column container content entry form group icon icons inner item"
    " items left link links list outer page panel post posts reader readers right section site tool tools top user users wrap wrapper".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)(?=[\s/>])((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|[^>]*>)", re.S)
_LABELS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORDS = re.compile(r"[a-z]+")
_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def label(name: str, attributes: list[str], inside: bool) -> str:
    """"!" for a part that is no article text, "?" if only some of an attribute's words say so. A header inside the article belongs to it."""
    if name in BOILERPLATE and not (name == "header" and inside):
        return "!"
    found = ""
    if name not in ARTICLE and name not in ("html", "body"):
        for value in attributes:
            words = set(_WORDS.findall(value.lower()))
            hints = words & HINTS - {"header"} if inside else words & HINTS
            if hints and words <= HINTS | NEUTRAL:
                return "!"
            found = "?" if hints else found
    return found


def parse(page: str | None) -> tuple[list[str], list[tuple[str, str]], list[int]]:
    """Elements as paths, text blocks as (path of the block element, text), both in page order, and the elements begun before each block.

    A path names block elements with their label and the words of their class, id and role; inline elements don't show in it.
    """
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # name, path, in an article, in a part left out
    elements: list[str] = []
    blocks: list[tuple[str, str]] = []
    begun: list[int] = []
    text: list[str] = []
    page = page or ""
    at, last = 0, page.rfind(">")

    def close_block():
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line:
                blocks.append((stack[-1][1], line))
                begun.append(len(elements))
            text.clear()

    while at < len(page):
        m = TAG.search(page, at) if at <= last else None
        if not m:  # behind the last ">" only a comment can begin
            rest = page.find("<!--", at)
            text.append(page[at:rest] if rest >= 0 else page[at:])
            break
        if m.start() > at:
            text.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in RAW and not m[1]:
            end = _ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in BLOCKS:
            if name == "br":
                text.append(" ")
            continue
        if m[1]:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
            if k or name == "p":
                close_block()
            if k:
                del stack[k:]
            continue
        close_block()
        while len(stack) > 1 and (stack[-1][0] == "p" or name == stack[-1][0] and name in ("li", "dt", "dd", "tr", "td", "th", "option")):
            stack.pop()
        values = _LABELS.findall(m[3]) if "=" in m[3] else []
        _, above, inside, out = stack[-1]
        mark = label(name, values, inside)
        if len(stack) <= DEEP:
            words = ".".join(sorted(set(_WORDS.findall(" ".join(values).lower()))))
            path = f"{above}>{name}{mark}{'.' + words if words else ''}"
        else:
            above = stack[DEEP][1] + (">article" if inside and not stack[DEEP][2] else "")
            path = f"{above}>{name}{'!' if out else mark}"
        elements.append(path)
        if name not in VOID:
            stack.append((name, path, inside or name in ARTICLE, out or mark == "!"))
    close_block()
    return elements, blocks, begun


def name_of(step: str) -> str:
    return step.split(".", 1)[0].rstrip("!?")


def article_of(path: str) -> str:
    """The outermost article element on the path, or nothing."""
    steps = path.split(">")
    k = next((i for i, s in enumerate(steps) if name_of(s) in ARTICLE), 0)
    return ">".join(steps[:k + 1]) if k else ""


def token_of(path: str, line: str) -> str:
    return f"{path}\n{crc32(line.encode()):08x}{crc32(line[::-1].encode()):08x}"


def page_tokens(page: str | None) -> dict[str, list[int]]:
    """Number of times and first place in the page of every token; elements have even places, texts the odd ones between them."""
    elements, blocks, begun = parse(page)
    tokens: dict[str, list[int]] = {}
    for k, path in enumerate(elements):
        tokens.setdefault(path, [0, 2 * k])[0] += 1
    inside = {p: article_of(p) for p, _ in blocks}
    for (p, line), k in zip(blocks, begun):
        if not inside[p]:
            tokens.setdefault(token_of(p, line), [0, 2 * k - 1])[0] += 1
    return tokens


def nest(tokens: list[tuple[str, int, int, int, int]], pages: int) -> list[list]:
    """Valid classes of a template, outer ones first: [once a page, tokens in order] for each.

    ``tokens`` are (token, pages, total, vector, sum of first places) of one key; ``pages`` is the number of its pages.
    """
    classes: dict[tuple[int, int, int], list[tuple[int, str]]] = {}
    for token, seen, total, vector, place in tokens:
        classes.setdefault((-seen, total, vector), []).append((place, token))
    held: set[str] = set()
    found = []
    for (seen, total, _), members in sorted(classes.items()):
        slots: dict[str, list[tuple[int, str]]] = {}
        for place, token in members:
            above = token.split("\n", 1)[0] if "\n" in token else token.rpartition(">")[0]
            while above and above not in held:
                above = above.rpartition(">")[0]
            slots.setdefault(above, []).append((place, token))
        for _, part in sorted(slots.items()):
            elements = [t for _, t in part if "\n" not in t]
            if elements and (len(part) >= CLASS_SIZE or -seen == pages):
                # A text starts with its element or after it, so that equal sums leave the element first.
                found.append([total == -seen, [t for _, t in sorted(part, key=lambda x: (x[0], "\n" in x[1], x[1]))]])
                held.update(elements)
    return found


def templates(pages: DataFrame) -> DataFrame:
    """(key, template) of each host with enough pages and of all pages; a template is the JSON text of its nested classes."""
    names = ("key", "token", "pages", "total", "first_sum", "second_sum", "place")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                held: dict[tuple[str, str], list[int]] = {}
                for page, url, one, two in zip(*(c.to_pylist() for c in piece.columns)):
                    tokens = page_tokens(page)
                    tokens[""] = [1, 0]
                    host = host_of(url)
                    for token, (n, place) in tokens.items():
                        for key in (host, POOLED):
                            x = held.setdefault((key, token), [0, 0, 0, 0, 0])
                            x[0] += 1
                            x[1] += n
                            x[2] += n * one
                            x[3] += n * two
                            x[4] += place
                columns = [[k[0] for k in held], [k[1] for k in held], *([x[i] for x in held.values()] for i in range(5))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.string()] * 2 + [pa.int64()] * 5)], names=names)

    hashed = pages.select("html", "url", *[
        F.pmod(F.xxhash64(F.col("page_id").cast("string"), "url", "html", F.lit(seed)), F.lit(1 << 30)).alias(f"h{seed}") for seed in (1, 2)])
    counted = hashed.mapInArrow(count, "key string, token string, pages long, total long, first_sum long, second_sum long, place long")
    tokens = counted.groupBy("key", "token").agg(*[F.sum(c).alias(c) for c in names[2:]])
    # A token of one page only can't belong to a template. What is left is written, so that pages are parsed once for both uses.
    tokens = materialize(tokens.filter((F.col("token") == "") | (F.col("pages") >= 2)), "tokens")
    sizes = tokens.filter(F.col("token") == "").select("key", F.col("pages").alias("n")).filter(F.col("n") >= OWN_TEMPLATE)
    # Salted, as one host may hold most tokens; those that pass the filter are few for every host.
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = tokens.filter(F.col("token") != "").withColumn("salt", F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int"))
    common = dealt.join(sizes, ["key", "salt"]).filter(F.col("pages") >= F.col("n") * SUPPORT)
    common = common.filter(~F.contains("token", F.lit("\n")) | (F.col("pages") > 2))
    listed = common.groupBy("key", "n").agg(
        F.collect_list(F.struct("token", "pages", "total", F.xxhash64("first_sum", "second_sum").alias("vector"), "place")).alias("tokens"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(nest([tuple(t.values()) for t in tokens], n)) for n, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["key", "template"])

    return listed.mapInArrow(build, "key string, template string")


def slot_text(elements: list[str], blocks: list[tuple[str, str]], begun: list[int], template: list[list]) -> str:
    """The extracted slots of one page, given the classes of its template."""
    fixed = [token_of(p, line) for p, line in blocks]
    first: dict[str, int] = {}
    for k, path in enumerate(elements):
        first.setdefault(path, 2 * k)
    for token, k in zip(fixed, begun):
        first.setdefault(token, 2 * k - 1)
    live: set[str] = set()
    once: set[str] = set()
    for single, tokens in template:
        places = [first[t] for t in tokens if t in first]
        if len(places) == len(tokens) and all(a <= b for a, b in zip(places, places[1:])):
            live.update(tokens)
            if single:
                once.update(tokens)
    paths = {p for p, _ in blocks}
    articles = {p: article_of(p) for p in paths if "!" not in p}
    inside = {p for p, article in articles.items() if article}
    framed = {p for p in inside if articles[p] in once}
    if framed or inside:
        kept = framed or inside
        return "\n".join(line for p, line in blocks if p in kept)
    kept = {p for p in articles if not _part_of_template(p, live)}
    return "\n".join(line for (p, line), token in zip(blocks, fixed) if p in kept and token not in live)


def _part_of_template(path: str, live: set[str]) -> bool:
    """Whether an element on the path has a word of a part that is left out and belongs to the template."""
    at = path.find("?")
    while at >= 0:
        end = path.find(">", at)
        if path[:end if end >= 0 else len(path)] in live:
            return True
        at = path.find("?", at + 1)
    return False


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    found = materialize(templates(pages), "templates")
    pooled = found.filter(F.col("key") == POOLED).collect()  # one row at most
    everywhere = pooled[0]["template"] if pooled else "[]"

    def start():
        pack = pa.Codec("zstd")

        def work(rows):
            out = []
            for page in rows:
                raw = json.dumps(parse(page)).encode()
                out.append(len(raw).to_bytes(8, "little") + pack.compress(raw, asbytes=True))
            return [out]

        return work

    packed = append_columns(pages, "html", [field("packed", "binary")], start, ["page_id", "url"])
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    salt = F.pmod(F.xxhash64("packed"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    own = found.filter(F.col("key") != POOLED).withColumn("salt", every)
    met = packed.withColumns({"key": host, "salt": salt}).join(own, ["key", "salt"], "left")
    given = met.select("page_id", "url", "packed", "template")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = pa.Codec("zstd")
        made: dict[str, list[list]] = {}
        for batch in batches:
            text = []
            for raw, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                template = everywhere if template is None else template
                if template not in made:
                    if len(made) > 64:
                        made.clear()
                    made[template] = json.loads(template)
                parts = json.loads(pack.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True))
                text.append(slot_text(*parts, made[template]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(text, pa.string())], names=["page_id", "url", "text"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema}
    return given.mapInArrow(fill, f"page_id {kind['page_id']}, url {kind['url']}, text string")
