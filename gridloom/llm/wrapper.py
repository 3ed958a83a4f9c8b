"""Main text of pages by wrapper induction.

Operator 6.  DOM trees of a host's pages are aligned by simple tree matching and folded into one
template tree: equal siblings become one slot, and a slot remembers whether its text varies over
pages and how much of it is links.  Constant slots are template; all others are content, unless
they lie in menus, headers, footers and the like.  Words in a class that marks either (``search``,
``social``, ...) leave a slot to its constancy: it is content if its text varies and isn't mostly links.  Pages are of three kinds: with text in an
article or main element, with text in an element whose class marks it as content, and others.  The
kind is each page's own, and each kind of a host has its own template: the content of the first
two is what lies inside.

Templates are partial aggregates: tasks fold their own pages and hand their templates on as one row
a slot.  Slots of one path add up over all tasks, as they do when whole trees are matched, since
equal siblings are joined wherever they stand.  So no task meets all pages or all slots of a host,
and no slot is forgotten, however many siblings it has.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Templates, slots of one template and slots of all templates that a task holds before it hands them on.
HOLDS = 1000, 4000, 100_000
#: Rows of slots that a task hands on at once.
ROWS = 10_000
#: The kind that stands for all pages of a host.
ANY = "any"
#: Bytes of wrappers up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

#: Elements by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio dialog".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title object svg math canvas noframes xmp".split())
DROPPED = frozenset("nav aside footer form menu dialog select option optgroup button video audio head fieldset legend".split())
CONTAINERS = frozenset("article main".split())
CLOSES_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "optgroup", "option", "body", "html"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Words in a class, id or role that mark what isn't article text.
BOILERPLATE = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs footer masthead sidebar aside ad ads adv advert adverts advertisement "
    "advertising adsense sponsor sponsored sponsors promo promos cookie cookies consent gdpr notice notices "
    "newsletter subscribe comment comments commentlist disqus contentinfo".split()
)
#: Words that mark either, so that constancy decides.
DOUBTFUL = frozenset(
    "widget widgets promotion promoted notification alert popup modal overlay interstitial subscription signup login respond reply replies share sharing social "
    "related recommended recommendations trending pagination pager toolbar copyright banner complementary search paywall teaser".split()
)
#: Elements nested deeper hang on their ancestor at this depth, in page order; no text is lost.
DEPTH = 100
HEADERS = frozenset({"header", "topbar", "site-header"})
CONTENT = frozenset("article articlebody content entry main post story maincontent".split())

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "words", "sig", "items", "path")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.items = tag, []  # items: texts, link texts as 1-tuples, and nodes, in page order
        self.words: tuple[str, ...] = ()
        if attributes and ("=" in attributes):
            found = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes))
            self.words = tuple(sorted({w.lower() for w in _SPLIT.split(found) if w and not w.isdigit()}))
        self.sig = tag + "".join("." + w for w in self.words)


def parsed(text: str) -> Node:
    """The tree of block elements of a page; inline elements dissolve into their block's text.

    Open paragraphs, items and cells end where the next one begins; what is left open ends with
    the page; end tags without a start are passed over.
    """
    root = Node("root")
    stack, at, link, n = [root], 0, 0, len(text)
    lower = None

    def hang(node: Node) -> None:
        stack[min(len(stack), DEPTH) - 1].items.append(node)

    def say(piece: str) -> None:
        if not piece:
            return
        if len(stack) > DEPTH:
            # a block beyond the depth goes on in a new part when another one has come between
            last = stack[DEPTH - 1].items[-1]
            if last is not stack[-1]:
                part = Node(stack[-1].tag)
                part.words, part.sig = stack[-1].words, stack[-1].sig
                hang(part)
                stack[-1] = part
        stack[-1].items.append((html.unescape(piece),) if link else html.unescape(piece))

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == tag:
                del stack[k:]
                return

    while at < n:
        m = _TAG.search(text, at)
        if not m:
            say(text[at:])
            break
        say(text[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:-3]))
            continue
        tag, end = m[2].lower(), bool(m[1])
        if tag in RAW:
            if not end and not m[3].endswith("/"):
                lower = lower if lower is not None else text.lower()
                stop = lower.find(f"</{tag}", at)
                if stop < 0:
                    break
                shut = text.find(">", stop)
                at = n if shut < 0 else shut + 1
        elif tag == "a":
            link = 0 if end else 1
        elif tag == "br":
            say("\n")
        elif tag in BLOCKS or tag in ("head", "button"):
            if end:
                close(tag)
            else:
                if tag in CLOSES_P:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag == "p":
                            del stack[k:]
                            break
                        if stack[k].tag in BLOCKS:
                            break
                if tag in CLOSED_BY:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].tag in CLOSED_BY[tag]:
                            del stack[k:]
                            if tag != "tr":
                                break
                        elif stack[k].tag in SCOPES[tag]:
                            break
                if tag == "body":
                    close("head")
                node = Node(tag, m[3])
                hang(node)
                if tag not in VOID:
                    stack.append(node)
        elif not end and tag not in VOID and m[3]:
            # an inline element that its class marks as no text is a node, so that it can be left out
            node = Node(tag, m[3])
            if (BOILERPLATE.intersection(node.words) or DOUBTFUL.intersection(node.words)) and not m[3].endswith("/"):
                hang(node)
                stack.append(node)
        elif end:
            if stack[-1].tag == tag and stack[-1] is not root:
                stack.pop()
    return root


# --- templates ---------------------------------------------------------------------------------
#
# A template node is a dict: s signature, n pages, h hash of the text (None where pages differ),
# t characters, l characters in links, p whether some page has text there that isn't mostly links,
# c children, which have distinct signatures.


def _folded(node: Node) -> dict:
    """The template of one page: equal siblings are folded into one slot."""
    texts = [(i if isinstance(i, str) else i[0]) for i in node.items if not isinstance(i, Node)]
    own = " ".join("".join(texts).split())
    size = len(own)
    links = min(sum(len(i[0].strip()) for i in node.items if isinstance(i, tuple)), size)
    children: dict[str, dict] = {}
    for child in node.items:
        if isinstance(child, Node):
            one = _folded(child)
            known = children.get(one["s"])
            children[one["s"]] = one if known is None else _same_page(known, one)
    return {"s": node.sig, "n": 1, "h": xxhash.xxh64_intdigest(own) if own else 0, "t": size, "l": links, "p": 0 < size >= links * 2, "c": list(children.values())}


def _same_page(a: dict, b: dict) -> dict:
    hash_ = a["h"] if not b["h"] else b["h"] if not a["h"] else xxhash.xxh64_intdigest(f"{a['h']},{b['h']}")
    size, links = a["t"] + b["t"], a["l"] + b["l"]
    return {"s": a["s"], "n": 1, "h": hash_, "t": size, "l": links, "p": 0 < size >= links * 2, "c": _children(a["c"], b["c"], _same_page)}


def _common(a: list[dict], b: list[dict]) -> tuple[list[tuple[int, int]], bool]:
    """The pairs of equal signature of two lists, and whether they stand in one order in both."""
    at = {y["s"]: j for j, y in enumerate(b)}
    pairs = [(i, at[x["s"]]) for i, x in enumerate(a) if x["s"] in at]
    return pairs, all(p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def _heaviest(pairs: list[tuple[int, int]], sizes: list[int], width: int) -> tuple[list[tuple[int, int]], int]:
    """Of pairs that ascend in the first place, those of greatest total size that ascend in both, and that size."""
    total, before = [], []
    best = [-1] * (width + 1)  # a Fenwick tree: the heaviest chain's last pair up to each place
    for k, (_, j) in enumerate(pairs):
        last, at = -1, j
        while at:
            if best[at] >= 0 and (last < 0 or total[best[at]] > total[last]):
                last = best[at]
            at &= at - 1
        total.append(sizes[k] + (total[last] if last >= 0 else 0))
        before.append(last)
        at = j + 1
        while at <= width:
            if best[at] < 0 or total[k] > total[best[at]]:
                best[at] = k
            at += at & -at
    k = max(range(len(pairs)), key=total.__getitem__)
    size, chain = total[k], []
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1], size


def aligned(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
    """Simple tree matching of two ordered lists of distinct signatures: the pairs of equal signature of greatest total size."""
    pairs, ordered = _common(a, b)
    return pairs if ordered else _heaviest(pairs, _sizes(a, b, pairs), len(b))[0]


def matched(a: list[dict], b: list[dict]) -> int:
    """Nodes that the best alignment of two lists of subtrees pairs."""
    pairs, ordered = _common(a, b)
    sizes = _sizes(a, b, pairs)
    return sum(sizes) if ordered else _heaviest(pairs, sizes, len(b))[1]


def _sizes(a: list[dict], b: list[dict], pairs: list[tuple[int, int]]) -> list[int]:
    return [1 + matched(a[i]["c"], b[j]["c"]) for i, j in pairs]


def _children(a: list[dict], b: list[dict], join) -> list[dict]:
    """Both lists in one: aligned subtrees are joined, others follow in order; signatures stay distinct."""
    if [x["s"] for x in a] == [x["s"] for x in b]:
        return [join(x, y) for x, y in zip(a, b)]
    pairs = dict((j, i) for i, j in aligned(a, b))
    out, at = [], 0
    for j, y in enumerate(b):
        if j in pairs:
            out += a[at : pairs[j]]
            out.append(join(a[pairs[j]], y))
            at = pairs[j] + 1
        else:
            out.append(y)
    out += a[at:]
    known: dict[str, dict] = {}
    for x in out:  # moved subtrees, which keep no order
        known[x["s"]] = join(known[x["s"]], x) if x["s"] in known else x
    return list(known.values())


def joined(a: dict, b: dict) -> dict:
    """The template of both templates' pages."""
    same = a["h"] == b["h"]
    below = _children(a["c"], b["c"], joined)
    return {"s": a["s"], "n": a["n"] + b["n"], "h": a["h"] if same else None, "t": a["t"] + b["t"], "l": a["l"] + b["l"], "p": a["p"] or b["p"], "c": below}


def _nodes(node: dict) -> int:
    return 1 + sum(map(_nodes, node["c"]))


# --- wrappers ----------------------------------------------------------------------------------


def _words(signature: str) -> tuple[str, list[str]]:
    tag, *words = signature.split(".")
    return tag, words


def _is_container(signature: str) -> bool:
    tag, words = _words(signature)
    return tag in CONTAINERS and not BOILERPLATE.intersection(words) or "main" in words and tag in ("div", "section")


def _has_container(node: dict) -> bool:
    return any(_is_container(c["s"]) or _has_container(c) for c in node["c"])


def _left_out(signature: str, inside: bool) -> bool | None:
    """Whether a slot is left out by its tag or class; None where it is unless a container lies in it."""
    tag, words = _words(signature)
    if tag in DROPPED:
        return None if tag == "form" else True
    if tag in ("html", "body", "main", "root"):
        return False
    if tag == "header" and not inside or not inside and HEADERS.intersection(words) and not CONTENT.intersection(words):
        return None
    return None if BOILERPLATE.intersection(words) else False


def _is_left_out(node: dict, inside: bool) -> bool:
    out = _left_out(node["s"], inside)
    return not _has_container(node) if out is None else out


def _slots(node: dict, path: str = "", inside: bool = False, doubtful: bool = False):
    """(path, node, whether in a container, whether doubtful) of each slot outside menus and the like."""
    path = f"{path}/{node['s']}"
    if _is_left_out(node, inside):
        return
    doubtful = doubtful or bool(DOUBTFUL.intersection(_words(node["s"])[1])) and not _has_container(node)
    inside = inside or _is_container(node["s"])
    yield path, node, inside, doubtful
    for child in node["c"]:
        yield from _slots(child, path, inside, doubtful)


def _marked(found: list[tuple]) -> list[str]:
    return [p for p, n, _, doubtful in found if not doubtful and CONTENT.intersection(_words(n["s"])[1]) and _text(n)]


def _kind(found: list[tuple]) -> str:
    if any(inside and not doubtful and n["t"] for _, n, inside, doubtful in found):
        return "container"
    return "marked" if _marked(found) else "plain"


def kind_of(page: dict) -> str:
    """The kind of a page, from its folded tree: it decides which of its slots are content."""
    return _kind(list(_slots(page)))


def _id(path: str) -> str:
    """What stands for a path in rows and wrappers: 128 bits, however deep the slot."""
    return xxhash.xxh3_128_hexdigest(path)


def _rows(node: dict, path: str = "", inside: bool = False, asks: tuple[str, ...] = ()):
    """(path, asks, n, h, t, l, p, has) of each slot of a template that isn't left out whatever lies in it.

    ``asks`` names the slots around it, itself included, that count by whether any page has a container in
    them (``has``): without one, those after ``-`` are left out and those after ``?`` doubtful.
    """
    path = f"{path}/{node['s']}"
    out = _left_out(node["s"], inside)
    if out:
        return
    id_, known = _id(path), len(asks)
    if out is None:
        asks += (f"-{id_}",)
    if DOUBTFUL.intersection(_words(node["s"])[1]):
        asks += (f"?{id_}",)
    inside = inside or _is_container(node["s"])
    h = node["h"] if node["h"] is None or node["h"] < 1 << 63 else node["h"] - (1 << 64)
    yield id_, ",".join(asks), node["n"], h, node["t"], node["l"], node["p"], len(asks) > known and _has_container(node)
    for child in node["c"]:
        yield from _rows(child, path, inside, asks)


def _text(node: dict) -> int:
    return node["t"] + sum(map(_text, node["c"]))


def rules_of(slots: str) -> dict[str, dict[str, set[str]]]:
    """What a wrapper says of slots, by kind of page."""
    rules: dict[str, dict[str, set[str]]] = {}
    for line in slots.split("\n") if slots else []:
        kind, what, path = line.split(" ")
        rules.setdefault(kind, {"same": set(), "links": set(), "vary": set()})[what].add(path)
    return rules


def chosen(page: dict, rules: dict[str, dict[str, set[str]]]) -> set[str]:
    """The paths of a page's content slots: those of its kind that its host's rules don't make template."""
    found = list(_slots(page))
    kind = _kind(found)
    none: dict[str, set[str]] = {"same": set(), "links": set(), "vary": set()}
    rule = rules.get(kind, none)
    same = rules.get(ANY, none)["same"]
    ids = {x[0]: _id(x[0]) for x in found} if rules else dict.fromkeys((x[0] for x in found), "")
    if kind == "container":
        found = [x for x in found if x[2]]
    elif kind == "marked":
        marked = _marked(found)
        found = [x for x in found if any((x[0] + "/").startswith(p + "/") for p in marked)]
    else:
        found = [x for x in found if ids[x[0]] not in rule["links"] and x[1]["l"] * 2 <= x[1]["t"]]
    return {p for p, _, _, doubtful in found if ids[p] not in rule["same"] and ids[p] not in same and (not doubtful or ids[p] in rule["vary"])}


def extracted(text: str, rules: dict[str, dict[str, set[str]]]) -> str:
    """The text of one page's content slots, blocks in page order; ``rules`` are the host's by kind of page."""
    blocks: list[str] = []
    page = parsed(text)
    slots = chosen(_folded(page), rules)

    def walk(node: Node, path: str) -> None:
        path = f"{path}/{node.sig}"
        keep, run = path in slots, []
        for item in node.items:
            if isinstance(item, Node):
                if run:
                    blocks.append(" ".join("".join(run).split()))
                    run = []
                walk(item, path)
            elif keep:
                run.append(item if isinstance(item, str) else item[0])
        if run:
            blocks.append(" ".join("".join(run).split()))

    walk(page, "")
    return " ".join(b for b in blocks if b)


def host_of(column: str = "url"):
    """The host of a URL, lower-cased; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(column, r"://([^/?#]*)", 1), F.lit("")))


def slot_rows(pages: DataFrame, holds: tuple[int, int, int] = HOLDS) -> DataFrame:
    """The slots of the templates that tasks fold of their own pages (host, html); a template that grows is handed on."""
    hosts, slots, held_slots = holds

    def fold(batches):
        held: dict[tuple[str, str], dict] = {}
        sizes: dict[tuple[str, str], int] = {}  # at most so many slots
        total = 0

        def given(keys):
            out = []
            for key in keys:
                sizes.pop(key)
                for row in _rows(held.pop(key)):
                    out.append((*key, *row))
                    if len(out) == ROWS:
                        yield framed(out)
                        out = []
            if out:
                yield framed(out)

        def framed(out):
            frame = pd.DataFrame(out, columns=["host", "kind", "path", "asks", "n", "h", "t", "l", "p", "has"])
            return frame.assign(h=pd.array([r[5] for r in out], "Int64"))

        for batch in batches:
            for host, text in zip(batch["host"], batch["html"]):
                one = _folded(parsed(text if isinstance(text, str) else ""))
                key, more = (host, kind_of(one)), _nodes(one)
                held[key] = joined(held[key], one) if key in held else one
                sizes[key] = sizes.get(key, 0) + more
                total += more
                if sizes[key] > slots:
                    total -= sizes[key]
                    sizes[key] = _nodes(held[key])
                    total += sizes[key]
                    if sizes[key] > slots // 2:
                        total -= sizes[key]
                        yield from given([key])
                full = len(held) > hosts
                if total > held_slots:
                    sizes.update((k, _nodes(t)) for k, t in held.items())
                    total = sum(sizes.values())
                    full = full or total > held_slots // 2
                if full:
                    yield from given(list(held))
                    total = 0
        yield from given(list(held))

    return pages.select("host", "html").mapInPandas(fold, "host string, kind string, path string, asks string, n long, h long, t long, l long, p boolean, has boolean")


def wrappers(pages: DataFrame, holds: tuple[int, int, int] = HOLDS) -> DataFrame:
    """(host, slots): the wrapper of each host from all of its pages (host, html), a line for each slot that has a rule.

    By kind of page, ``same`` are constant slots, ``links`` mostly links, ``vary`` doubtful ones that vary.
    Constancy counts from three pages on, of which not all are the same text, over the pages of
    the kind or of the host (kind ``any``).  What a single page says of a slot is seen on that page.
    """
    each = slot_rows(pages, holds).withColumn("kind", F.explode(F.array("kind", F.lit(ANY))))
    one = (F.count("h") == F.count("*")) & (F.min("h") == F.max("h"))
    sums = [F.sum("n").alias("n"), F.coalesce(one, F.lit(False)).alias("one"), F.min("h").alias("h"), F.sum("t").alias("t"), F.sum("l").alias("l"), F.bool_or("p").alias("p"), F.bool_or("has").alias("has")]
    known = checkpointed(each.groupBy("host", "kind", "path", "asks").agg(*sums).where("n >= 2"))

    asked = known.where("asks != ''").select("host", "kind", "path", F.explode(F.split("asks", ",")).alias("ask"))
    asked = asked.select("host", "kind", "path", F.substring("ask", 1, 1).alias("mark"), F.expr("substring(ask, 2)").alias("around"))
    held = known.where("has").select("host", "kind", F.col("path").alias("around"), "has")
    state = asked.join(held, ["host", "kind", "around"], "left").groupBy("host", "kind", "path")
    state = state.agg(F.expr("bool_or(mark = '-' and has is null)").alias("out"), F.expr("bool_or(mark = '?' and has is null)").alias("doubtful"))
    slots = known.join(state, ["host", "kind", "path"], "left").where("out is null or not out")

    pages_ = slots.groupBy("host", "kind").agg(F.max("n").alias("pages"), F.expr("bool_or(not one)").alias("varied"))
    rules = [
        F.when(F.expr("varied and n >= 3 and n * 2 > pages and one and h != 0"), "same"),
        F.when(F.expr("kind = 'plain' and l * 2 > t and p"), "links"),
        F.when(F.expr(f"kind != '{ANY}' and doubtful and n >= 3 and not one and l * 2 <= t"), "vary"),
    ]
    said = slots.join(pages_, ["host", "kind"]).select("host", "kind", "path", F.explode(F.array_compact(F.array(*rules))).alias("what"))
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", "kind", "what", "path")))
    return said.groupBy("host").agg(F.array_join(lines, "\n").alias("slots"))


def extract_main_text(pages: DataFrame, keep: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``keep`` columns (page_id and url by default), text and n_chars for each row of ``pages`` (url, html).

    A null html is empty and gives an empty text; pages whose url has no host, or is null, form
    one host; whole pages are read whatever their length; repeated rows repeat; other columns are
    ignored; an empty table gives an empty table.  Elements nested beyond DEPTH hang on their ancestor there.
    """
    keep = keep or ["page_id", "url"]
    host = F.when(F.length(host_of()) > 64, F.sha2(host_of(), 256)).otherwise(host_of())  # each slot's row names it
    hosted = pages.select(*keep, host.alias("host"), "html") if "host" not in keep else pages.select(*keep, "html")
    known = checkpointed(wrappers(hosted))
    size = known.agg(F.sum(F.octet_length("slots"))).first()[0] or 0
    known = F.broadcast(known) if size <= broadcast_bytes else known

    @F.pandas_udf("string")
    def text(pages_: pd.Series, slots: pd.Series) -> pd.Series:
        rules: dict[str, dict[str, dict[str, set[str]]]] = {}
        out = []
        for page, found in zip(pages_, slots):
            if found not in rules:
                rules[found] = rules_of(found)
            out.append(extracted(page, rules[found]) if isinstance(page, str) else "")
        return pd.Series(out, dtype=object)

    done = hosted.join(known, "host", "left").select(*keep, text("html", F.coalesce("slots", F.lit(""))).alias("text"))
    return done.select(*keep, "text", F.length("text").cast("long").alias("n_chars"))
