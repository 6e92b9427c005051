"""Page boilerplate beside the main body, by equivalence classes of tokens with the same occurrences.

Each element of a page is cut into atoms: sentences, labels, list items, and the lead before a colon, whose rest is a
slot. Numbers and the site's name are slots too. A token is a word in its context, the atom and the tag path it stands in; the tokens of one atom occur
together. Over the pages of one host, a token's occurrence vector tells on which stories it stands and how often; copies
of a story count once. Each host, of any size, has vectors of its own, and so has the pool of all hosts of its language, which tells template parts that stand on too few stories of
one host; an atom is template if it is so on its host or in the pool. Tokens of
equal vectors on enough stories form an equivalence class. A class is valid if its atoms stand in one order on all its pages and no other
class's span crosses its own, so that classes nest in the template; one that isn't falls apart into its atoms. Beyond that, one of its words must hardly occur on
pages outside of such atoms, which tells the template's tokens from the body's.
An element that valid classes and the slots between them cover is boilerplate, as is a list under a heading that they cover; what they leave is the main body.

Defined results: an article without plain_content has no elements there, but its content has; code, tables and quotes are always body; articles of residue give
no row; repeated rows count once.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.lookalikes import consistent
from pagewright.llm.residue import has_residue
from pagewright.session import cut

#: Words in an element up to which what follows a lead is a slot; more words must recur themselves.
ELEMENT_WORDS = 60
#: Stories that an equivalence class must stand on, and share of the stories of its host, or of all hosts of its language. What recurs by chance keeps below the share at any size.
CLASS_STORIES, HOST_SHARE, POOL_SHARE = 3, 1e-3, 5e-4
#: Share of a token's pages that must lie in such atoms.
OWN_SHARE = 0.75
#: Tokens of valid classes that nest a sentence with slots between them, and words of such a sentence, at least.
NESTED, SLOTTED = 2, 9
#: Share of an element's letters that valid classes must cover.
COVER = 0.75
#: Rows of a table that is sent to every executor at most; a larger one is joined by shuffle, its keys spread over SALTS parts each so that no frequent label or giant host is one task's.
BROADCAST_ROWS, SALTS = 200_000, 16

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)>")
_ANY = re.compile(r"<[^<>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_SEPARATOR = re.compile(r"\s*[|»›•·/]\s*|\s{2,}|\s+-\s+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_a-zà-ÿа-яё]|[§¿¡©“„«])")
_LEAD = re.compile(r"([^:]{2,40}?\s?:)\s+(\S.*)", re.S)
_LABEL = re.compile(r"\s+(?=[A-ZÀ-ÖØ-ÞА-ЯЁ])")
_VOID = frozenset("br hr img input meta link".split())
_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table".split())
_HEADS, _LISTS, _TEXT = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(("ul", "ol")), frozenset(("p", "div", "span", "a", "nav", "aside", "footer"))


def children(plain: str | None) -> list[tuple[str, str]]:
    """(tag, inner markup) of each child element of the root element, in order."""
    out, depth, begin, tag = [], 0, 0, ""
    for m in _TAG.finditer(plain or ""):
        name = m[2].lower()
        if name in _VOID or m[3]:
            if depth == 1:
                out.append((name, ""))
            continue
        if not m[1]:
            if depth == 1:
                tag, begin = name, m.end()
            depth += 1
        else:
            depth -= 1
            if depth == 1:
                out.append((tag, plain[begin : m.start()]))
    return out


def blocks_of(content: str | None) -> list[tuple[str, str, int, int]]:
    """(tag, inner markup, begin, end) of each block of a page's markup, whatever wrappers it stands in; a block within a block is part of it."""
    out, open_tag, depth, begin, inner = [], "", 0, 0, 0
    for m in _TAG.finditer(content or ""):
        name = m[2].lower()
        if name in _VOID or m[3]:
            continue
        if not open_tag:
            if not m[1] and name in _BLOCKS:
                open_tag, depth, begin, inner = name, 1, m.start(), m.end()
        elif name == open_tag:
            depth += -1 if m[1] else 1
            if not depth:
                out.append((open_tag, content[inner : m.start()], begin, m.end()))
                open_tag = ""
    return out


def _plain(markup: str) -> str:
    text = _ANY.sub("", markup)
    if "&" in text:
        text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#34;", '"').replace("&#39;", "'").replace("&amp;", "&")
    return consistent(text)


def atoms_of(tag: str, inner: str, site_name: str | None, most: int | None = ELEMENT_WORDS) -> list[tuple[str, bool]]:
    """(atom, whether it is the rest after a lead) of an element that may be boilerplate; empty for one that is body for certain. most: words at most, else
    it is empty as well; None for any number."""
    if tag in _LISTS:
        parts = [_plain(x) for x in re.split(r"</?li\b[^<>]*>", inner)]
    elif tag != "h1" and tag in _HEADS or tag in _TEXT:
        parts = [_plain(inner)]
    else:
        return []
    whole = "".join(parts)
    if sum(map(str.isdigit, whole)) > sum(map(str.isalpha, whole)):  # figures, not labels
        return []
    out: list[tuple[str, bool]] = []
    words = 0
    for part in parts:
        if site_name:
            part = part.replace(site_name, "§")
        part = re.sub(r"\d+", "0", part).strip()
        if not part:
            continue
        words += len(_WORD.findall(part))
        if most is not None and words > most:
            return []
        if tag in _TEXT and words <= ELEMENT_WORDS and (m := _LEAD.fullmatch(part)) and part[-1] not in ".!?" and len(m[1].split()) <= 6:
            out += [(m[1], False), (m[2], True)]
            continue
        for sentence in _SENTENCE.split(part):
            if sentence[-1:] in ".!?" and not sentence.endswith("..."):
                out.append((sentence, False))
            else:
                for label in _SEPARATOR.split(sentence):
                    out += [(x, False) for x in _LABEL.split(label.strip()) if x]
    return out


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _story(title: str | None, elements: list[tuple[str, str]]) -> list[int]:
    """Numbers that copies of a story share: of the letters of its longest paragraph and, behind it, of all others of more than ELEMENT_WORDS words."""
    texts = sorted((_ANY.sub("", x) for t, x in elements if t == "p"), key=len, reverse=True) or [title or ""]
    texts = texts[:1] + [x for x in texts[1:] if len(_WORD.findall(x)) > ELEMENT_WORDS]
    return list(dict.fromkeys(_number("".join(_WORD.findall(consistent(x))).lower()) for x in texts))


def _joined(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", spread: str | None = None) -> DataFrame:
    """Joins a written table to one whose keys may be hot: sent whole where it is small, else by shuffle with spread keys. spread: the column that tells a
    row's part; without one, the partition that it comes from."""
    if few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return many.join(F.broadcast(few), keys, how)
    part = F.pmod(F.xxhash64(spread) if spread else F.spark_partition_id(), F.lit(SALTS)).cast("int")
    parts = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_part", part).join(parts, [*keys, "_part"], how).drop("_part")


def _with_story(found: DataFrame) -> DataFrame:
    """The elements with one number for their page's story: that of the longest paragraph that stands under fewer than CLASS_STORIES titles, as a long
    notice that stands on every page tells no story; where there is none, of the paragraph under the fewest titles."""
    pages = found.where(F.size("stories") > 1).select("article_id", "title", "stories").distinct()
    placed = pages.select("article_id", "title", "stories", F.posexplode("stories").alias("place", "story"))
    notices = cut(placed.groupBy("story").agg(F.countDistinct("title").alias("titles")).where(F.col("titles") >= CLASS_STORIES))
    rank = F.struct(F.coalesce("titles", F.lit(CLASS_STORIES - 1)).alias("n"), "place", "story")
    ranked = _joined(placed, notices, ["story"], "left", "article_id").groupBy("article_id", "stories").agg(F.min(rank)["story"].alias("chosen"))
    others = cut(ranked.where(F.col("chosen") != F.col("stories")[0]))
    told = _joined(found, others, ["article_id", "stories"], "left").withColumn("story", F.coalesce("chosen", F.col("stories")[0]))
    return told.drop("chosen", "stories", "title")


def elements(articles: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(article_id, node_no, in_plain, heading, path, site_id, lang, story, atoms array<struct<atom, letters>>) of elements that may be boilerplate, and (lang,
    word, total) with the number of articles whose page holds the word; articles of residue are left out. in_plain: whether the elements are those of
    plain_content; those of an article without one are of its content. path: the element's tag below the root. heading: the number of the list under a
    heading, else null. An article counts once, however often it is delivered: words of those delivered again are counted by article."""
    names = sites.select("site_id", "site_name", "lang").dropDuplicates(["site_id"])
    rows = articles.where(F.coalesce("plain_content", "content").isNotNull()).select("article_id", "site_id", "title", "content", "plain_content")
    rows = _joined(rows, names, ["site_id"], "left")
    again = cut(rows.groupBy("article_id").agg(F.count("*").alias("n")).where("n > 1").select("article_id")).withColumn("again", F.lit(True))
    rows = _joined(rows, again, ["article_id"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        shown_by: dict[int, set[str]] = {}
        for pdf in batches:
            out = []
            for key, site, title, content, plain, name, lang, more in zip(*(pdf[c] for c in ("article_id", "site_id", "title", "content", "plain_content", "site_name", "lang", "again"))):
                if has_residue(content):
                    continue
                own = children(plain) if plain is not None else [(t, x) for t, x, _, _ in blocks_of(content)]
                lang = lang if isinstance(lang, str) else ""
                name = name if isinstance(name, str) else None
                shown = consistent(_ANY.sub(" ", plain if plain is not None else content))
                shown = shown.replace(name, " ") if name else shown
                own_words = {w for w in _WORD.findall(shown) if len(w) > 1}
                if more is True:
                    if new := own_words - shown_by.setdefault(key, set()):
                        shown_by[key] |= new
                        out.append((key, None, None, None, None, None, lang, None, None, [{"atom": w, "letters": 0} for w in new], 1))
                else:
                    words.update([(lang, w) for w in own_words])
                story, name_no = _story(title, own), _number(title or str(key))
                site = None if site is None or site != site else int(site)
                for i, (tag, inner) in enumerate(own):
                    if found := atoms_of(tag, inner, name, None):
                        under = i + 2 if tag in _HEADS and i + 1 < len(own) and own[i + 1][0] in _LISTS else None
                        atoms = [{"atom": a, "letters": sum([len(w) for w in _WORD.findall(a) if len(w) > 1])} for a, rest in found if not rest]
                        out.append((key, i + 1, plain is not None, under, tag, site, lang, story, name_no, atoms, int(more is True)))
            yield pd.DataFrame(out, columns=COLUMNS).astype(TYPES)
        out = [(None, None, None, None, None, None, lang, None, None, [{"atom": w, "letters": 0}], n) for (lang, w), n in words.items()]
        yield pd.DataFrame(out, columns=COLUMNS).astype(TYPES)

    schema = "article_id bigint, node_no int, in_plain boolean, heading int, path string, site_id int, lang string, stories array<bigint>, title bigint, atoms array<struct<atom:string,letters:int>>, pages bigint"
    both = cut(rows.mapInPandas(run, schema))
    words = both.where(F.col("node_no").isNull()).select("article_id", "lang", F.explode("atoms.atom").alias("word"), "pages")
    repeated = words.where(F.col("article_id").isNotNull()).distinct()
    words = words.where(F.col("article_id").isNull()).unionByName(repeated).groupBy("lang", "word").agg(F.sum("pages").alias("total"))
    found = both.where(F.col("node_no").isNotNull())
    repeated = cut(found.where("pages = 1").dropDuplicates(["article_id", "node_no", "in_plain", "atoms"]))
    return cut(_with_story(found.where("pages = 0").unionByName(repeated).drop("pages"))), words


COLUMNS = ["article_id", "node_no", "in_plain", "heading", "path", "site_id", "lang", "stories", "title", "atoms", "pages"]
TYPES = {"article_id": "Int64", "title": "Int64", "node_no": "Int32", "in_plain": "boolean", "heading": "Int32", "site_id": "Int32"}


def occurrences(found: DataFrame) -> DataFrame:
    """(lang, site_id, article_id, story, node_no, heading, in_plain, place, h, atom, letters): each atom; h tells it with its path."""
    atoms = found.select("path", "lang", "site_id", "article_id", "story", "node_no", "heading", "in_plain", F.posexplode("atoms").alias("at", "x"))
    place = F.col("node_no").cast("bigint") * 1_000_000 + F.col("at")
    return cut(atoms.select("lang", "site_id", "article_id", "story", "node_no", "heading", "in_plain", place.alias("place"), F.xxhash64("path", "x.atom").alias("h"), "x.atom", "x.letters"))


def _with_units(rows: DataFrame) -> DataFrame:
    """The rows with (unit, own_host, host), once for the pool of all hosts of their language and, where it is known, once for their host. The pool's host is null."""
    pool = F.struct(F.xxhash64("lang").alias("unit"), F.lit(False).alias("own_host"), F.lit(None).cast("int").alias("host"))
    own = F.struct(F.xxhash64("lang", "site_id").alias("unit"), F.lit(True).alias("own_host"), F.col("site_id").cast("int").alias("host"))
    units = F.when(F.col("site_id").isNull(), F.array(pool)).otherwise(F.array(pool, own))
    return rows.withColumn("_unit", F.explode(units)).select(*rows.columns, "_unit.*")


def equivalence_classes(atoms: DataFrame, told: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(unit, own_host, h, cls, stories): the atoms on enough stories, each with its equivalence class, and their (unit, h, article_id, first, last) on each page. Tokens
    of equal occurrence vectors have one class; a class without one order on its pages, or whose span another's crosses, falls apart into its atoms. told: (unit, own_host,
    story) of all stories, if atoms don't hold them all."""
    told = atoms.select("unit", "own_host", "story") if told is None else told
    sizes = cut(told.distinct().groupBy("unit", "own_host").agg(F.count("*").alias("all")))
    recurrent = cut(atoms.groupBy("unit", "h").agg(F.count("*").alias("n")).where(F.col("n") >= CLASS_STORIES).select("unit", "h"))
    kept = _joined(atoms.select("unit", "h", "story", "article_id", "place"), recurrent, ["unit", "h"], "left_semi", "article_id")
    on_page = cut(kept.groupBy("unit", "h", "story", "article_id").agg(F.count("*").alias("times"), F.min("place").alias("first"), F.max("place").alias("last")))
    on_story = on_page.groupBy("unit", "h", "story").agg(F.max("times").alias("times"))
    vectors = on_story.groupBy("unit", "h").agg(F.count("*").alias("stories"), F.bit_xor(F.xxhash64("story", "times")).alias("vector"))
    least = F.greatest(F.lit(CLASS_STORIES), F.when(F.col("own_host"), HOST_SHARE).otherwise(POOL_SHARE) * F.col("all"))
    frequent = _joined(vectors, sizes, ["unit"], "inner", "h").where(F.col("stories") >= least)
    frequent = cut(frequent.select("unit", "own_host", "h", "stories", F.xxhash64("unit", "stories", "vector").alias("cls")))
    placed = cut(_joined(on_page, frequent, ["unit", "h"], "inner", "article_id").select("unit", "h", "cls", "article_id", "first", "last"))
    several = cut(frequent.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls"))
    lines = _joined(placed, several, ["cls"], "left_semi", "article_id").groupBy("unit", "cls", "article_id")
    lines = lines.agg(F.array_sort(F.collect_list(F.struct("first", "h"))).alias("line"), F.min("first").alias("first"), F.max("last").alias("last"))
    lines = cut(lines.select("unit", "cls", "article_id", F.xxhash64(F.transform("line", lambda x: x["h"])).alias("order"), "first", "last"))
    unordered = lines.groupBy("cls").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a != b").select("cls")
    spans = lines.groupBy("unit", "article_id").agg(F.collect_list(F.struct("first", "last", "cls")).alias("spans"))
    crosses = lambda x, y: (x["first"] < y["first"]) & (y["first"] <= x["last"]) & (x["last"] < y["last"])
    across = F.filter("spans", lambda x: F.exists("spans", lambda y: crosses(x, y) | crosses(y, x)))
    crossing = spans.select(F.explode(F.transform(across, lambda x: x["cls"])).alias("cls")).distinct()
    broken = cut(unordered.unionByName(crossing).distinct()).withColumn("broken", F.lit(True))
    cls = F.when(F.col("broken"), F.xxhash64("unit", "h")).otherwise(F.col("cls"))
    return cut(_joined(frequent, broken, ["cls"], "left", "h").select("unit", "own_host", "h", cls.alias("cls"), "stories")), placed


def _words_of(atom: str) -> Column:
    return F.array_distinct(F.filter(F.split(atom, r"[^\p{L}]+"), lambda w: F.length(w) > 1))


def template(atoms: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, unit, host, h, cls, stories) of the atoms of valid classes, and (lang, word) of the words that tell them. host: null for those valid in the pool of
    their language, which hold on every host; a host has those that the pool hasn't."""
    recurrent = cut(atoms.groupBy("lang", "h").agg(F.count("*").alias("n")).where(F.col("n") >= CLASS_STORIES).select("lang", "h"))
    kept = cut(_joined(atoms.select("lang", "site_id", "article_id", "story", "place", "h"), recurrent, ["lang", "h"], "left_semi", "article_id"))
    stories = cut(_with_units(atoms.select("lang", "site_id", "story").distinct()).select("lang", "unit", "own_host", "host", "story"))
    classes, placed = equivalence_classes(_with_units(kept), stories.select("unit", "own_host", "story"))
    units = cut(stories.select("lang", "unit", "host").distinct())
    classes = cut(_joined(classes, units, ["unit"], "inner", "h"))
    in_pool = cut(classes.where(~F.col("own_host")).select("lang", "h"))
    beside = _joined(classes.where("own_host"), in_pool, ["lang", "h"], "left_anti", "unit").select("unit", "h")
    counted = classes.where(~F.col("own_host")).select("unit", "h").unionByName(beside).withColumn("counted", F.lit(True))  # a page's atom once, not for pool and host
    shown = _joined(atoms.select("lang", "h", "article_id", "atom"), cut(classes.select("lang", "h").distinct()), ["lang", "h"], "left_semi", "article_id")
    shown = cut(shown.groupBy("lang", "h").agg(F.min("atom").alias("atom")).select("lang", "h", _words_of("atom").alias("words")))
    texts = _joined(classes.select("lang", "unit", "h", "cls"), shown, ["lang", "h"], "inner", "unit")
    texts = cut(_joined(texts, cut(counted), ["unit", "h"], "left", "h").select("lang", "unit", "h", "cls", "counted", F.explode("words").alias("word")))
    on_pages = _joined(placed.select("unit", "h", "article_id"), texts.where("counted").drop("cls", "counted"), ["unit", "h"], "inner", "article_id").select("lang", "word", "article_id").distinct()
    within = cut(on_pages.groupBy("lang", "word").agg(F.count("*").alias("within")))
    own = cut(_joined(words, within, ["lang", "word"], "inner", "word").where(F.col("within") >= OWN_SHARE * F.col("total")).select("lang", "word"))
    valid = cut(_joined(texts, own, ["lang", "word"], "left_semi", "h").select("cls").distinct())
    valid = cut(_joined(classes, valid, ["cls"], "left_semi", "h").select("lang", "unit", "host", "h", "cls", "stories"))
    pooled = cut(valid.where("host IS NULL").select("lang", "h"))
    return cut(valid.where("host IS NULL").unionByName(_joined(valid.where("host IS NOT NULL"), pooled, ["lang", "h"], "left_anti", "unit").select(*valid.columns))), own


def _marked(articles: DataFrame, sites: DataFrame) -> DataFrame:
    """(article_id, in_plain, node_no) of elements that don't belong to the main body."""
    found, words = elements(articles, sites)
    atoms = occurrences(found)
    valid, own = template(atoms, words)
    node = ("article_id", "in_plain", "node_no", "heading")
    letters = F.col("letters") + F.lit(0.01)
    marked = _joined(atoms, valid.where("host IS NULL").select("lang", "h", F.lit(True).alias("in_pool")), ["lang", "h"], "left", "article_id")
    on_host = valid.where("host IS NOT NULL").select("lang", F.col("host").alias("site_id"), "h", F.lit(True).alias("on_host"))
    marked = _joined(marked, on_host, ["lang", "site_id", "h"], "left", "article_id").withColumn("valid", F.coalesce("in_pool", "on_host"))
    covered = marked.select(*node, F.when(F.col("valid"), letters).otherwise(0).alias("covered"), letters.alias("fixed"), F.col("valid").cast("int").alias("n"))
    slotted = marked.where(F.col("valid").isNull() & F.col("atom").rlike("[.!?]$") & (F.size(F.split("atom", " ")) >= SLOTTED))
    tokens = _joined(slotted.select(*node, "letters", "lang", "h", F.explode(_words_of("atom")).alias("word")), own, ["lang", "word"], "inner", "article_id")
    nested = tokens.groupBy(*node, "h", "letters").agg(F.count("*").alias("k")).where(F.col("k") >= NESTED)
    nested = nested.select(*node, letters.alias("covered"), F.lit(0.0).alias("fixed"), F.lit(1).alias("n"))
    whole = covered.unionByName(nested).groupBy(*node).agg(F.sum("covered").alias("covered"), F.sum("fixed").alias("fixed"), F.sum("n").alias("n"))
    hit = whole.where((F.col("n") > 0) & (F.col("covered") >= COVER * F.col("fixed")))
    return hit.select("article_id", "in_plain", F.explode(F.filter(F.array("node_no", "heading"), lambda x: x.isNotNull())).alias("node_no")).distinct()


def boilerplate_elements(articles: DataFrame, sites: DataFrame) -> DataFrame:
    """(article_id, node_no): child elements of the root of plain_content, counted from 1, that don't belong to the main body."""
    return _marked(articles, sites).where("in_plain").select("article_id", "node_no")


def template_classes(articles: DataFrame, sites: DataFrame) -> DataFrame:
    """(host, lang, stories, size, atoms array<string>): the valid classes of the template that the hosts of a language share, whose host is null, and of each host's
    what these don't hold; size: the class's tokens."""
    found, words = elements(articles, sites)
    atoms = occurrences(found)
    valid, _ = template(atoms, words)
    shown = _joined(_with_units(atoms).select("unit", "h", "article_id", "atom", "place"), valid, ["unit", "h"], "inner", "article_id")
    shown = shown.groupBy("unit", "host", "lang", "cls", "stories", "h").agg(F.min("atom").alias("atom"), F.min("place").alias("place"))
    classes = shown.groupBy("unit", "host", "lang", "cls", "stories").agg(F.array_sort(F.collect_list(F.struct("place", "atom"))).alias("x"), F.sum(F.size(F.split("atom", " "))).alias("size"))
    return classes.select("host", "lang", "stories", "size", F.col("x.atom").alias("atoms"))


def main_bodies(articles: DataFrame, sites: DataFrame) -> DataFrame:
    """(article_id, content_body, body): the markup of each delivery's content and plain_content without their boilerplate elements; null where it has none. An element
    of content goes if the same element of plain_content goes."""
    drop = cut(_marked(articles, sites).groupBy("article_id").agg(F.collect_set("node_no").alias("nodes")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bodies, contents = [], []
            for content, plain, nodes in zip(pdf["content"], pdf["plain_content"], pdf["nodes"]):
                left_out = set() if nodes is None else set(nodes)
                own = children(plain)
                kept = [f"<{t}>{x}</{t}>" for i, (t, x) in enumerate(own) if i + 1 not in left_out]
                bodies.append(None if plain is None else "<div>\n" + "\n".join(kept) + "\n</div>")
                contents.append(_without(content, own if plain is not None else None, left_out))
            yield pd.DataFrame({"article_id": pdf["article_id"], "content_body": pd.Series(contents, dtype=object), "body": pd.Series(bodies, dtype=object)})

    once = articles.select("article_id", "content", "plain_content").distinct()
    return _joined(once, drop, ["article_id"], "left").mapInPandas(run, "article_id bigint, content_body string, body string")


def _without(content: str | None, own: list[tuple[str, str]] | None, left_out: set[int]) -> str | None:
    """Content without the elements with these numbers: its own, or those of plain_content, which are told by their kind, letters and turn."""
    if not content or not left_out:
        return content
    blocks = blocks_of(content)
    if own is None:
        gone = {i for i in range(len(blocks)) if i + 1 in left_out}
    else:
        told = lambda t, x: (t in _LISTS, "".join(_WORD.findall(_plain(x))))
        wanted, seen = set(), Counter()
        for i, (t, x) in enumerate(own):
            key = told(t, x)
            seen[key] += 1
            if i + 1 in left_out:
                wanted.add((key, seen[key]))
        gone, seen = set(), Counter()
        for i, (t, x, _, _) in enumerate(blocks):
            key = told(t, x)
            seen[key] += 1
            if (key, seen[key]) in wanted:
                gone.add(i)
    out, at = [], 0
    for i, (_, _, begin, end) in enumerate(blocks):
        if i in gone:
            out.append(content[at:begin])
            at = end
    return "".join([*out, content[at:]])
