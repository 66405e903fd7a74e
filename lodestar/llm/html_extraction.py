"""Main text of web pages by equivalence-class template deduction.

A page is read as structural tokens (paths of block elements, with their classes) and text tokens (a block's path
and text). Over all pages of a host, tokens with the same occurrence vector form an equivalence class; vectors are
compared by an order-free hash of (page, count), so a host's pages never meet in one task. Pages without an element
don't count. A class is valid if its tokens occur in over half of the host's pages; tokens that occur once in each of
so many are the skeleton, into which the other classes nest by their paths. Text that half of the host's pages share
belongs to the template and is left out, but for the text of articles, which are taken as a whole; what remains are the
slots. Where an article or main element of the skeleton holds most of the remaining text outside menus, headers,
footers, sidebars, notices, adverts, forms and comments, it is the slot to extract; elsewhere all slots outside of
those are extracted, in page order, but for pages whose own articles hold most of their open text. A page of another
make than its host's template is read by its own articles or main elements, else by all its slots.

An element is outside by its name or role, or by a class or id that means nothing else and that neither holds the page's
largest article nor half of that article's text.

Cases: a null or empty html gives an empty text; a null url is a host of its own; a host of one page has a template
of one page; broken or unclosed markup is closed as browsers do for paragraphs and list items; repeated rows are
extracted alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import as_before, as_text, table
from lodestar.session import materialize

_RAW = "script|style|noscript|template|textarea|iframe|svg|select|object"
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_BLOCKS = frozenset(
    "html head title body div section article main nav header footer aside form fieldset ul ol li dl dt dd table thead "
    "tbody tfoot tr td th caption p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr details summary "
    "center dialog menu button".split()
)
_VOID = frozenset(["hr"])
#: A start tag that ends an open element of these names, up to the nearest of the names after.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_INLINE_SAFE = frozenset(["li", "td", "th", "dd", "dt"])
_OUTSIDE = frozenset("head nav footer aside form fieldset menu dialog button".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
_LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "notice notices alert gdpr sidebar aside menu nav navbar navigation breadcrumb breadcrumbs pagination pager comment "
    "comments disqus footer masthead share sharing social related recommended newsletter subscribe popup modal login "
    "signup search widget toolbar skip".split()
)
#: Words that may stand beside those in a class or id without making it mean something else.
_BESIDE = frozenset("site page main top bottom left right box bar list block items item links link posts articles area section inner head".split())
_READERS = frozenset(["comment", "comments", "disqus"])
_ARTICLES = frozenset(["article", "main"])
_PLAIN = frozenset("div section ul ol p table li blockquote figure article".split())


def outside(name: str, rest: str, inside_article: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, form or the like by its name or role."""
    if name in _OUTSIDE or name == "header" and not inside_article:
        return True
    if rest and name in _PLAIN | {"header"}:
        return any(kind.lower() == "role" and _ROLES.intersection((a or b or c).lower().split()) for kind, a, b, c in _NAMED.findall(rest))
    return False


def labelled(name: str, rest: str) -> str:
    """The word by which a class or an id says that an element isn't main text, else nothing. A class or id of several
    words counts only if all of them say so, or say nothing (site-footer does, content-sidebar-wrap and no-sidebar don't)."""
    if rest and name in _PLAIN | {"header"}:
        for kind, a, b, c in _NAMED.findall(rest):
            for label in (a or b or c).lower().split() if kind.lower() != "role" else ():
                words = [w for w in re.split(r"[_-]+", label) if w and not w.isdigit()]
                said = [w for w in words if w in _LABELS]
                if said and all(w in _LABELS or w in _BESIDE for w in words):
                    return next((w for w in said if w in _READERS), said[0])
    return ""


def read(page: str | None) -> tuple[list[tuple[str, bool, str]], Counter]:
    """Blocks as (path, outside the main text, text) in page order, and how often each path occurs.

    Names and roles decide by themselves. A label is only believed of an element that neither holds the page's
    largest article nor more than half of its text (or the page's, if it has no article); readers' comments may be as long
    as they are."""
    blocks: list[tuple[str, bool, tuple[int, ...], tuple[int, ...], str]] = []
    paths: Counter = Counter()
    #: name, path, outside, inside an article, numbers of labelled elements and of articles around
    stack: list[tuple[str, str, bool, bool, tuple[int, ...], tuple[int, ...]]] = []
    label_of: dict[int, str] = {}
    around: dict[int, tuple[int, ...]] = {}  # the labelled elements of each article
    words: list[str] = []
    at = 0

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if text:
                _, path, out, _, labels, articles = stack[-1] if stack else ("", "", False, False, (), ())
                blocks.append((path, out, labels, articles, text))

    page = page or ""
    for tag in _TAG.finditer(page):
        if tag.start() > at:
            words.append(page[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            words.append(" ")
        if name not in _BLOCKS:
            continue
        flush()
        if tag["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        if name in _ENDS:
            close, stop = _ENDS[name]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in close:
                    del stack[i:]
                    break
        if name in _VOID:
            continue
        _, path, out, article, labels, articles = stack[-1] if stack else ("", "", False, False, (), ())
        rest = tag["rest"]
        shown = "".join("." + (a or b or c) for kind, a, b, c in _NAMED.findall(rest) if kind.lower() == "class") if rest else ""
        path = f"{path}/{name}{shown}"
        paths[path] += 1
        said = labelled(name, rest)
        if said:
            label_of[tag.start()] = said
            labels = (*labels, tag.start())
        if name in _ARTICLES and not any(label_of[x] in _READERS for x in labels):
            around[tag.start()] = labels
            articles = (*articles, tag.start())
        stack.append((name, path, out or outside(name, rest, article), article or name in _ARTICLES, labels, articles))
    if at < len(page):
        words.append(page[at:])
    flush()
    mass: Counter = Counter()
    for _, out, _, articles, text in blocks:
        if not out:
            mass.update(dict.fromkeys(articles, len(text)))
    largest = max(around, key=lambda x: mass[x], default=None)
    # of the largest article, or of the page if there is none: what most of it lies in
    whole, held = 0, Counter()
    for _, out, labels, articles, text in blocks:
        if not out and (largest is None or largest in articles):
            whole += len(text)
            held.update(dict.fromkeys(labels, len(text)))
    kept = set(around.get(largest, ())) | {x for x, n in held.items() if 2 * n > whole and label_of[x] not in _READERS}
    return [(path, out or not kept.issuperset(labels), text) for path, out, labels, _, text in blocks], paths


def within(path: str, root: str) -> bool:
    return path == root or path.startswith(root + "/")


def text_key(path: str, text: str) -> int:
    """A text token as a number."""
    return xxhash.xxh64_intdigest(f"{path}\n{text}".encode("utf-8", "replace")) >> 1 | 1


def extract(page: str | None, root: str | None, shared: frozenset[int] = frozenset()) -> str:
    """The blocks of the article at root that aren't outside by name or label. A page without it is read by its own
    articles; where the host has no such article, only if they hold most of the page's open text. Else all the page's
    blocks are taken, less the shared text tokens, unless the page has nothing else."""
    blocks, paths = read(page)
    found = [(path, text) for path, out, text in blocks if not out]
    roots = [root] if root and paths.get(root) == 1 else [p for p in paths if _name(p) in _ARTICLES]
    inside = [(path, text) for path, text in found if any(within(path, r) for r in roots)]
    unshared = [(path, text) for path, text in found if not shared or text_key(path, text) not in shared]
    if not root:
        held = sum(len(text) for path, text in unshared if any(within(path, r) for r in roots))
        if held < 0.8 * sum(len(text) for _, text in unshared):
            roots = []
    return "\n".join(text for _, text in (inside if roots else unshared or found))


def _tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Structural and text tokens of each page with their counts, and a hash of (page, count) for the vectors."""
    task, row = TaskContext.get().partitionId(), 0
    for pdf in frames:
        out = []
        for host, page in zip(pdf["host"], pdf["html"]):
            row += 1
            blocks, paths = read(page)
            if not paths:
                continue
            name = f"{task}:{row}:"
            copy = xxhash.xxh64_intdigest(page.encode("utf-8", "replace")) >> 1
            for path, n in [("", 1), *paths.items()]:
                out.append((host, path, 0, n, 0, xxhash.xxh64_intdigest(name + str(n)) >> 1, copy))
            for (path, _, text), n in Counter((p, o, t) for p, o, t in blocks if not o).items():
                out.append((host, path, text_key(path, text), n, n * len(text), 0, copy))
        yield pd.DataFrame(out, columns=["host", "path", "text", "n", "chars", "vector", "copy"])


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0]


def around(path: str, tokens: dict[str, int]) -> str:
    """The nearest of tokens that holds a path or is it; the whole page if none does."""
    while path and path not in tokens:
        path = path.rsplit("/", 1)[0]
    return path


def nested_classes(classes: dict[int, list[str]], skeleton: dict[str, int]) -> dict[int, str]:
    """The slot that each valid class nests in: the innermost of the skeleton's tokens around all its tokens. A class that
    repeats is valid if its tokens lie in one slot of the classes around it."""
    slots, single = {}, set(skeleton.values())
    for vector, paths in classes.items():
        others = {path: v for path, v in skeleton.items() if v != vector}
        lying = {around(path.rsplit("/", 1)[0], others) for path in paths if path}
        slot = min(lying, key=len, default="")
        while slot and not all(within(x, slot) for x in lying):
            slot = around(slot.rsplit("/", 1)[0], others)
        if vector in single or len(lying) == 1:
            slots[vector] = slot
    return slots


def choose_slot(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a host: its equivalence classes, which are the tokens of one occurrence vector, nested into the slots of the
    skeleton; and the article around the slots that hold most of the text that the template leaves open, if there is one.
    The skeleton are the valid classes of tokens that occur once; its slots are what lies between its tokens."""
    pages = int(pdf["pages"].iloc[0])
    valid = pdf[(pdf["kind"] == 0) & (pdf["df"] * 2 > pages)]
    classes = valid.groupby("vector")["path"].agg(list).to_dict()
    single = set(valid["vector"][valid["once"] * 2 > pages])
    skeleton = {path: vector for vector in single for path in classes[vector] if path}
    nested = nested_classes(classes, skeleton)
    slots: Counter = Counter()
    for path, chars in pdf.loc[pdf["kind"] == 1, ["path", "chars"]].itertuples(index=False):
        slots[around(path, skeleton)] += chars
    held: Counter = Counter()
    for slot, chars in slots.items():
        while slot:  # the slots around it hold it as well
            held[slot] += chars
            slot = around(slot.rsplit("/", 1)[0], skeleton)
    total = sum(slots.values())
    slot = min((p for p in skeleton if _name(p) in _ARTICLES and total > 0 and held[p] >= 0.8 * total), key=len, default=None)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "slot": [slot], "skeleton": [len(skeleton)], "classes": [len(nested)]})


def templates(pages: DataFrame) -> DataFrame:
    """host, slot, skeleton (tokens that occur once in most pages), classes (valid classes), shared (text tokens that
    half of the pages share, copies of one page apart)."""
    tokens = pages.mapInPandas(_tokens, "host string, path string, text long, n long, chars long, vector long, copy long")
    counted = tokens.groupBy("host", "path", "text").agg(
        F.count("*").alias("df"),
        F.count_if(F.col("n") == 1).alias("once"),
        F.expr("bit_xor(vector)").alias("vector"),
        F.sum("chars").alias("chars"),
        (F.min("copy") < F.max("copy")).alias("many"),
    )
    counted = materialize(counted, "page-tokens")
    sizes = counted.where("path = '' and text = 0").select("host", F.col("df").alias("pages"))
    known = counted.join(sizes, "host")
    frame = known.where("text = 0 and df * 2 >= pages").select("host", "path", F.lit(0).alias("kind"), "df", "once", "vector", "chars", "pages")
    # text that half of the pages share is the template's; it counts for next to nothing
    common = F.col("many") & (F.col("df") * 2 >= F.col("pages"))
    open_ = F.when(common, F.col("chars") * 0.01).otherwise(F.col("chars"))
    texts = (
        known.where("text <> 0")
        .groupBy("host", "path")
        .agg(F.sum(open_).alias("chars"), F.max("pages").alias("pages"))
        .select("host", "path", F.lit(1).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("df", "once", "vector")), "chars", "pages")
    )
    rows = frame.withColumn("chars", F.col("chars").cast("double")).unionByName(texts)
    chosen = rows.groupBy("host").applyInPandas(choose_slot, "host string, slot string, skeleton long, classes long")
    shared = known.where((F.col("text") != 0) & common).groupBy("host").agg(F.collect_set("text").alias("shared"))
    return chosen.join(shared, "host", "left")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(as_text("page_id").alias("page_id"), "url", "html", host.alias("host"))
    found = materialize(templates(rows.select("host", "html")), "page-templates")
    joined = rows.join(found.select("host", "slot", "shared"), "host", "left")
    joined = joined.select("page_id", "url", "html", "host", "slot", "shared")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            known: dict[str, frozenset[int]] = {}
            for name, shared in zip(pdf["host"], pdf["shared"]):
                if name not in known:
                    known[name] = frozenset(() if shared is None else shared.tolist())
            texts = [extract(page, slot, known[name]) for page, slot, name in zip(pdf["html"], pdf["slot"], pdf["host"])]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return as_before(joined.mapInPandas(work, "page_id string, url string, text string, n_chars long"), pages, "page_id")


def op10_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
