"""13 HTML extraction: flat text blocks classified by a decision tree.

A page is read once, tag by tag, into its text blocks in page order: the text between two block-level tags. A block has its number of
words, the share of them in links, the same of the blocks before and after it, and what the markup around it says: whether it stands in
an article, in the chrome of the page (menus, sidebars, notices, forms, comments) or in an article's own header, and whether it is
a heading. A decision tree over these numbers, trained on the labelled layouts below, decides which blocks are main text.

Reading pages is Python, one page at a time; the tree is a condition in SQL over the blocks of a row, so pages are never shuffled.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from html import unescape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import blank, table, whole

#: Tags that end one text block and begin another; ``br`` is white space, all other tags are part of the line.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, or no text of the page.
RAW_TAGS = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
UNSEEN_TAGS = frozenset("template svg object canvas audio video button select datalist".split())
CLOSES_P = BLOCK_TAGS - frozenset("body html caption legend option optgroup summary tbody td tfoot th thead tr li dd dt".split())
#: Opening one of these ends an open one of the named kinds, unless one of the third group is in between.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}

CHROME_TAGS = frozenset("nav aside footer menu dialog".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Parts of class names and ids, split at - and _ and before capitals.
CHROME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead banner footer foot colophon copyright sidebar aside widget widgets ad ads advert adverts advertisement "
    "adsense adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments commentlist disqus respond reply replies discussion pagination pager toolbar search skip topbar".split())
HEADER_WORDS, NEGATIONS = frozenset(("header", "head", "byline", "meta")), frozenset(("has", "no", "with", "without", "not"))
MAIN_WORDS = frozenset("content main article post entry story articlebody maincontent".split())

_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG = re.compile(r"""/?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"/?([a-zA-Z][^\s/>]*)([^>]*+)>")
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

#: What encloses a text: main (0 none, 1 by class, 2 main, 3 article), chrome (0 none, 1 header of an article, 2 by class, 3 by tag), unseen.
NOWHERE = (0, 0, False)


def entered(tag: str, attributes: str, around: tuple) -> tuple:
    """What encloses the content of an element that stands within ``around``."""
    main, chrome, unseen = around
    unseen = unseen or tag in UNSEEN_TAGS
    words, role = [], ""
    if attributes and not attributes.isspace():
        for name, *values in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), values[0] or values[1] or values[2]
            if name in ("class", "id"):
                words += [[p.lower() for p in _PARTS.findall(w)] for w in value.split()]
            elif name == "role":
                role = value.strip().lower()
            elif name == "itemprop" and value.strip().lower() == "articlebody":
                main = 3
            elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
                unseen = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                unseen = True
    found = {p for w in words if not NEGATIONS & set(w) for p in w}
    if tag in CHROME_TAGS or role in CHROME_ROLES or (tag == "header" and not main):
        return main, 3, unseen
    if tag == "main" or role == "main":
        return max(main, 2), 0 if chrome == 2 else chrome, unseen
    if tag in ("html", "body"):
        return main, chrome, unseen
    if (found & CHROME_WORDS or tag == "form") and chrome < 3:
        return main, 2, unseen
    if (tag == "header" or (main and found & HEADER_WORDS)) and chrome < 2:
        return main, 1, unseen
    if found & HEADER_WORDS and tag != "article" and chrome < 3:
        return main, 2, unseen
    if tag == "article" or role == "article":
        return max(main, 3), chrome, unseen
    return max(main, 1) if found & MAIN_WORDS else main, chrome, unseen


def blocks(page: str) -> list[tuple]:
    """(text, words, words in links, main, chrome, heading) of the text blocks of a page, in page order.

    Takes time in proportion to the page, whatever its tags: a tag whose quotes don't end is taken up to the next ``>``, and from
    there on all are; a tag or comment that the page breaks off in ends it.
    """
    out, line, links = [], [], 0
    stack, open_tags = [], Counter()  # (tag, what encloses its content)
    around, link, heading, at, tags = NOWHERE, None, False, 0, _TAG

    def flush():
        nonlocal links
        if line:
            text = " ".join("".join(line).split())
            if text:
                words = text.count(" ") + 1
                out.append((text, words, min(links, words), around[0], around[1], heading))
            line.clear()
        links = 0

    def shut(to: int):
        nonlocal around, link, heading
        for tag, _ in stack[to:]:
            open_tags[tag] -= 1
        del stack[to:]
        around = stack[-1][1] if stack else NOWHERE
        heading = bool(stack) and len(stack[-1][0]) == 2 and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
        if link is not None and link > to:
            link = None

    def say(text: str):
        nonlocal links
        if text and not around[2]:
            text = unescape(text)
            line.append(text)
            if link is not None:
                links += len(text.split())

    while True:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        first = page[lt + 1 : lt + 2]
        if not (first.isascii() and first.isalpha()) and first not in ("/", "!", "?"):
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            if end < 0:
                break
            at = end + 3
            continue
        match = tags.match(page, lt + 1)
        if match is None and tags is _TAG and first not in "!?" and (match := _PLAIN_TAG.match(page, lt + 1)):
            tags = _PLAIN_TAG
        if match is None:
            end = page.find(">", lt)
            if end < 0:
                break
            at = end + 1
            continue
        tag, at = match[1].lower(), match.end()
        if first == "/":
            if tag == "a":
                link = None
            elif tag in BLOCK_TAGS:
                flush()
            if open_tags[tag]:
                to = len(stack) - 1
                while stack[to][0] != tag:
                    to -= 1
                flush()
                shut(to)
            continue
        if tag in RAW_TAGS:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            if end is None:
                break
            at = end.start()
            continue
        if tag == "br":
            line.append(" ")
            continue
        if tag == "a":
            link = len(stack)
        if tag in BLOCK_TAGS:
            flush()
            if tag in CLOSES_P and stack and open_tags["p"]:
                to = len(stack) - 1
                while to >= 0 and stack[to][0] not in BLOCK_TAGS:
                    to -= 1
                if to >= 0 and stack[to][0] == "p":
                    shut(to)
            kinds, stops = CLOSES.get(tag, ((), ()))
            if any(open_tags[k] for k in kinds):
                to = len(stack) - 1
                while to >= 0 and stack[to][0] not in kinds and stack[to][0] not in stops:
                    to -= 1
                if to >= 0 and stack[to][0] in kinds:
                    shut(to)
        if tag in VOID_TAGS:
            continue
        inside = entered(tag, match[2], around)
        # elements within a line count only where they change what encloses the text, or to pair their ends
        if tag in BLOCK_TAGS or inside != around or open_tags[tag]:
            if inside != around and not match[2].endswith("/"):
                flush()
            stack.append((tag, inside))
            open_tags[tag] += 1
            around, heading = inside, tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    flush()
    return out


FEATURES = ("words", "link density", "words before", "link density before", "words after", "link density after", "main", "main on the page", "chrome", "heading")


def described(found: list[tuple]) -> list[list[float]]:
    """The numbers of each block that the tree sees, in the order of ``FEATURES``."""
    own = [(float(words), linked / words) for _, words, linked, *_ in found]
    edge, top = (0.0, 0.0), max((b[3] for b in found), default=0)
    return [
        [*own[i], *(own[i - 1] if i else edge), *(own[i + 1] if i + 1 < len(own) else edge), float(main), float(top), float(chrome), float(heading)]
        for i, (_, _, _, main, chrome, heading) in enumerate(found)
    ]


# ---- the labelled table

#: Layouts of pages. K12-90 stands for 12 to 90 words of main text, M for main text in links, J for words of anything else,
#: L for links of them.
LAYOUTS = (
    "<nav><ul><li>L1-2</li><li>L1-3</li><li>L1</li></ul></nav><div class=ad>J3-40</div><article><h1>K2-14</h1><p>K20-120</p><p>K1-90</p><p>K1-6</p><p>K8-60 M1-2 K5-30</p></article><footer>J4-30</footer>",
    "<article><h1>K1-12</h1><p>K1-5</p></article><footer>J2-8 L1</footer>",
    "<header>L1 J2-9</header><nav>L1 L2 L1</nav><main><h1>K3-9</h1><p>K12-100</p><ul><li>K1-12</li><li>K2-20</li></ul><h2>K1-6</h2><p>K10-80</p><aside>J10-60</aside></main><footer>J5-60</footer>",
    "<div id=header>J1-6 L1</div><div class=menu><a>L1</a><a>L2</a></div><div id=content><h1>K2-10</h1><p>K10-110</p><p>K1-20</p><blockquote>K4-50</blockquote><table><tr><td>K1-3</td><td>K1-4</td></tr></table></div>"
    "<div class=sidebar><h3>J1-3</h3><p>J8-60</p><ul><li>L2-5</li><li>L2-6</li></ul></div><div id=comments><h3>J1-3</h3><p>J5-80</p><p>J1-50</p></div><div id=footer>J3-40</div>",
    "<div>L1 L1 L2 L1</div><div>L1</div><div>J1-3</div><h1>K3-12</h1><p>K30-120</p><p>K25-140</p><p>K20-90</p><div>L2 L3</div><div>L4 L3</div><div>J2-6 L2</div>",
    "<table><tr><td>L1</td><td>L2</td></tr></table><div>K30-130</div><div>K25-90 M1-3 K10-30</div><div>K40-100</div><p>L3-8</p><p>L2-7</p><p>J1-5</p>",
    "<div>J1-3</div><ul><li>L1-3</li><li>L1-4</li><li>L2</li></ul><h2>K2-8</h2><div>K35-150</div><h2>K2-8</h2><div>K30-120</div><ul><li>L3-9</li><li>L3-9</li></ul><div>J3-12</div>",
    "<div class=cookie-notice><p>J8-70</p></div><header><h2>J1-5</h2></header><article><header><h1>K2-12</h1><p>J2-5 L1-2</p></header><p>K15-90</p><figure><figcaption>K3-20</figcaption></figure><p>K2-70</p><div class=share>L1 L1</div>"
    "<section class=comments><h2>J1-3</h2><article><p>J4-90</p></article></section><footer>J2-14</footer></article><aside><h3>J2-4</h3><p>J10-70</p><article><h3>L3-8</h3><p>J8-30</p></article></aside>",
    "<div><p>J25-90</p></div><article><h2>K2-9</h2><p>K10-60</p><div class=promo><p>J5-60</p></div><pre>K4-60</pre><p>K1-40</p></article><div><p>J20-80</p></div><div>L2-6</div>",
    "<form><p>J2-20</p></form><main><article><h1>K2-10</h1><p>K9-80</p><p>K1-8</p><form>J3-30</form></article></main><div><p>J6-60</p></div>",
    "<main><h1>K2-8</h1><article><p>K10-80</p><p>K1-60</p></article></main><nav>L2 L1</nav><div>J1-40</div>",
    "<div class=page><div class=post-content><p>K1-60</p><h3>K1-5</h3><p>K10-80</p><ol><li>K2-30</li><li>M1-3 K1-9</li></ol></div><div class=related><p>L4-9</p><p>J10-50</p></div></div><div><p>J10-70</p></div><div>L2</div>",
    "<article><p>M1-6</p><h3>M2-6</h3><ul><li>M1-4</li><li>K1-9 M1-2</li></ul><p>K20-70</p></article><div>L1-6</div><p>J1-60</p>",
    "<header>L1 L2</header><article><header><h1>K2-12</h1><p>J2-9</p></header><p>K10-70</p><aside><h3>J1-4</h3><ul><li>L2-6</li><li>L2-6</li></ul></aside><p>K5-60</p><div class=related><h3>J2-4</h3><p>L3-8</p></div><p>K9-60</p></article>",
    "<article><header><h2>K2-9</h2></header><p>K4-70</p><nav><h2>J1-2</h2><a>L2</a></nav><h2>K1-5</h2><p>M1-2 K6-40</p><div class=social><h4>J2</h4>L1 J1-3</div></article><div class=comments><h3>J2-4</h3><p>J8-120</p><p>J1-4 L1-2 J5-30</p></div>",
    "<main><div class=breadcrumb>L1 L2</div><h1>K2-9</h1><div class=byline>J2-6 L1</div><p>K12-80</p><div class=ad><h4>J1-3</h4><p>L2-9</p></div><p>K2-50</p></main><aside><h4>J1-4</h4><p>L2-5</p></aside>",
    "<main><header><h1>K2-9</h1><p>J3-20</p><p>L1-3</p></header><section><h2>K1-4</h2><p>K5-60</p></section><section class=subscribe><h2>J2-5</h2><p>J4-20 L1-2</p></section></main>",
    "<article><h1>K2-9</h1><p>K4-70</p></article><div><h3>J1-6</h3><p>J10-70</p></div><div><h2>J1-4</h2><div>L2-6</div></div>",
    "<div>L1 L2</div><h1>K3-12</h1><div>K30-120</div><div>K28-120</div><h3>J1-3</h3><ul><li>L2-6</li><li>L2-6</li></ul><h3>J1-3</h3><div>L1-4</div>",
    "<div class=top-banner>J6-50</div><div id=main><p>K8-100</p><p>K3-40</p><div class=newsletter-signup><p>J8-40</p></div><p>K6-90</p></div><div class=footer-links>L1 L2 L1</div>",
)
#: Pages made of each layout.
COPIES = 40


def labelled(layouts=LAYOUTS, copies: int = COPIES) -> list[tuple[list[float], float]]:
    """(numbers of a block, 1.0 for main text) of the blocks of ``copies`` pages of each layout; always the same."""
    rng, out = random.Random(13), []

    def words(m: re.Match) -> str:
        kind, low, high = m[1], int(m[2]), int(m[3] or m[2])
        text = " ".join([{"K": "keep", "M": "keep"}.get(kind, "junk")] * rng.randint(low, high))
        return f"<a href=x>{text}</a>" if kind in "LM" else text

    for layout in layouts:
        for _ in range(copies):
            found = blocks(re.sub(r"\b([KJLM])(\d+)(?:-(\d+))?\b", words, layout))
            out += [(numbers, float("keep" in b[0])) for b, numbers in zip(found, described(found))]
    return out


def trained(spark: SparkSession, rows: list[tuple[list[float], float]] | None = None, depth: int = 9):
    """The decision tree of the labelled blocks, some thousand rows."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(Vectors.dense(x), y) for x, y in (labelled() if rows is None else rows)], ["features", "label"])
    return DecisionTreeClassifier(maxDepth=depth, maxBins=64, minInstancesPerNode=3, seed=13).fit(data.coalesce(1))


def rule(model) -> callable:
    """The tree as a function from a Column (array of the numbers) to a boolean Column."""

    def of(node, x: Column) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        return F.when(F.get(x, F.lit(split.featureIndex())) <= split.threshold(), of(node.leftChild(), x)).otherwise(of(node.rightChild(), x))

    root = model._call_java("rootNode")
    return lambda x: of(root, x)


def _read(pages):
    """Pages as a pandas series to the texts and numbers of their blocks."""
    import pandas as pd

    out = []
    for page in pages:
        found = blocks(page)
        out.append([{"text": b[0], "x": x} for b, x in zip(found, described(found))])
    return pd.Series(out, dtype=object)


def extracted(pages: DataFrame, model=None) -> DataFrame:
    """``pages`` with ``text`` and n_chars (in place of columns of these names, if there are some).

    Null html counts as empty and gives empty text, as does a page without main text. Rows are judged each for itself, so repeated
    rows and ids fare alike; an empty table stays empty. Further columns stay as they are, whatever their names. Texts that are no
    markup at all are one block of plain text.
    """
    keeps = rule(trained(pages.sparkSession) if model is None else model)
    read = F.pandas_udf(_read, "array<struct<text:string,x:array<double>>>")
    rows = whole(pages).withColumn("_found", read(blank("_row.html")))
    text = F.array_join(F.transform(F.filter("_found", lambda b: keeps(b["x"])), lambda b: b["text"]), "\n\n")
    made = ("text", "n_chars")
    rows = rows.withColumn("_text", text)
    return rows.select(*[F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in made], F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


#: Of pages in the form of the test tables the article is what stands between its tags; this is a plainer way to the same texts.
OP13_SQL = r"""WITH parts AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_extract(COALESCE(html, ''), '<article>(.*)</article>', 1, 's'), '<br>', ' ', 'g'), '</?(?:p|h1)>') AS p FROM pages),
plain AS (SELECT page_id, url, list_transform(p, lambda x: replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;', '&'), '&amp', '&')) AS p FROM parts),
clean AS (SELECT page_id, url, list_filter(list_transform(p, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM plain)
SELECT page_id, url, COALESCE(array_to_string(p, chr(10) || chr(10)), '') AS text, CAST(length(COALESCE(array_to_string(p, chr(10) || chr(10)), '')) AS BIGINT) AS n_chars FROM clean"""
