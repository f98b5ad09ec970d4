"""Main text of web pages, by rules over blocks in two passes.

A page is cut into blocks at its block elements. The first pass decides blocks
by where they stand, by link density, and by length and density of stop words;
what is too short or too thin to tell stays open. The second pass gives open
blocks the label of the nearest decided neighbour in the same region. If a page
marks its article, blocks outside of it are never part of it.

Defined results: null and empty pages give an empty text; unclosed and stray
tags are read as browsers do, as far as block rules need it; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select|object|xmp)\b"""
    r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<rest2>[^>]*+)(?:>|\Z)"""
    r"""|<[!?/][^>]*+(?:>|\Z)""",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")
# The blocks of Chinese, Japanese, Korean and Thai letters.
WIDE = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CONTAINERS = BLOCK - frozenset("p hr h1 h2 h3 h4 h5 h6 dt dd body html".split())
OUTSIDE = frozenset("nav aside footer menu dialog button".split())
ARTICLE = frozenset(("article", "main"))
# What an element holds by its class, id or role, and what such names are joined with.
NOT_ARTICLE = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|header|masthead|"
    r"menu|modal|nav|navbar|navigation|newsletter|notices?|overlay|pagination|popup|promo\w*|related|replies|reply|"
    r"respond|share|sharing|sidebar|social|sponsor\w*|subscribe|subscription|toolbar|widgets?|contentinfo|"
    r"complementary|search|alert|login|signup"
)
BESIDE = frozenset(
    "area articles bar block bottom box buttons container form global group icons inner item items left links list "
    "main page panel posts primary right secondary section site slot sticky stories tertiary top wrap wrapper".split()
)
JOINT = re.compile(r"[-_]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# The commonest function words of some languages, lower case.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his if in into is it its
    more no not of on one or other she so than that the their them there they this to up was we were what when which who
    will with would you
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas
    plus pour qu que qui sa se ses son sont sur un une vous
    aber als am auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer es für hat ich im in
    ist mit nach nicht noch nur oder sich sie sind so über um und vom von vor war wenn werden wie wird zu zum zur
    al como con del el ella entre era es esta este está fue ha hay la las lo los más me mi muy no nos o para pero por
    porque se ser si sin sobre son su sus también todo un una y ya
    che da della di gli ha i il io le ma nel non per più si sono uno e o os as um uma não com em na no dos
    een het van niet dat op te zijn voor met""".split()
)

BAD, GOOD, OPEN, NEAR = 0, 1, 2, 3
# Why an element is outside of the article: its kind, or a name that an article inside of it outweighs.
INSIDE, BY_NAME, BY_KIND = 0, 1, 2


@dataclass(frozen=True)
class BlockRules:
    """Limits of the first pass; lengths in characters, densities as shares.

    A page with fewer stop words than `known_stop_words` is in none of the
    languages that are listed, and is judged without them.
    """

    short: int = 70
    long: int = 200
    few_stop_words: float = 0.12
    many_stop_words: float = 0.25
    known_stop_words: float = 0.12
    link_share: float = 0.4


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool
    region: int
    heading: bool


def blocks_of(html: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    pieces: list[str] = []
    # Open containers: tag, why it is outside of the article, region number (0: no article).
    stack: list[tuple[str, int, int]] = []
    state = {"links": 0, "in_link": False, "heading": False, "regions": 0}

    def flush() -> None:
        if pieces:
            text = SPACE.sub(" ", unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                outside, region = (stack[-1][1], stack[-1][2]) if stack else (INSIDE, 0)
                out.append(Block(text, state["links"], outside != INSIDE, region, state["heading"]))
        if state["links"]:
            # A link that nobody closed ends with its block.
            state["in_link"] = False
        state["links"] = 0

    def text_piece(piece: str) -> None:
        if piece:
            pieces.append(piece)
            if state["in_link"]:
                state["links"] += len(SPACE.sub(" ", piece).strip())

    at = 0
    for m in TOKEN.finditer(html):
        text_piece(html[at : m.start()])
        at = m.end()
        tag = m.group("tag") or m.group("tag2")
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m.group("close") or m.group("close2"))
        rest = m.group("rest") or m.group("rest2") or ""
        if tag == "a":
            # Without a target it is a place, not a link.
            state["in_link"] = not closing and "href" in rest.lower()
        elif tag == "br":
            pieces.append(" ")
        elif tag in BLOCK or tag == "head" or tag == "button":
            flush()
            state["heading"] = len(tag) == 2 and tag[0] == "h" and tag != "hr" and not closing
            if tag in CONTAINERS or tag in ("head", "button"):
                if closing:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            del stack[k:]
                            break
                else:
                    outside, region = (stack[-1][1], stack[-1][2]) if stack else (INSIDE, 0)
                    own = stands_outside(tag, rest, region)
                    if tag in ARTICLE and not region and own == INSIDE:
                        # The first article outweighs the names of what it stands in.
                        if outside == INSIDE or outside == BY_NAME and not state["regions"]:
                            state["regions"] += 1
                            outside, region = INSIDE, state["regions"]
                    stack.append((tag, max(outside, own), region))
            elif tag == "body" and not closing:
                stack.clear()
    if at < len(html):
        text_piece(html[at:])
    flush()
    return out


def names_outside(names: str) -> bool:
    """Whether one of the names, taken as a whole, says that an element is not of the article."""
    for name in names.lower().split():
        parts = JOINT.split(name.strip("-_"))
        told = [NOT_ARTICLE.fullmatch(part) is not None for part in parts]
        if any(told) and all(yes or part in BESIDE or part.isdigit() for yes, part in zip(told, parts, strict=True)):
            return True
    return False


def stands_outside(tag: str, attributes: str, region: int) -> int:
    """Whether an element by itself holds what is not of the article, and why."""
    if tag in OUTSIDE or tag == "head" or (tag == "header" and not region):
        return BY_KIND
    # Some pages stand in one form as a whole.
    found = BY_NAME if tag == "form" else INSIDE
    if not attributes or tag in ARTICLE and "comment" not in attributes.lower():
        return found
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            return BY_KIND
        if name in ("class", "id", "role") and names_outside(value):
            found = BY_NAME
    return found


def length_of(text: str) -> int:
    """Characters, of which those of scripts that write words with one or two of them count for more."""
    return len(text) + (0 if text.isascii() else 2 * len(WIDE.findall(text)))


def is_linked(block: Block, rules: BlockRules) -> bool:
    return block.link_chars > rules.link_share * len(block.text)


def first_pass(block: Block, rules: BlockRules, marked: bool, listed: bool = True) -> int:
    """Label of one block by itself. `marked`: the page marks its article, inside of which
    only the place decides. `listed`: its language is one whose stop words are known."""
    if block.outside or (marked and not block.region):
        return BAD
    if block.region:
        return GOOD
    if is_linked(block, rules):
        return BAD
    size = length_of(block.text)
    if block.heading or size < rules.short:
        return OPEN
    if not listed:
        return GOOD if size >= rules.long else NEAR
    density = best_density(block.text, rules.many_stop_words)
    if density >= rules.many_stop_words:
        return GOOD if size >= rules.long else NEAR
    # Few stop words: names, code or tables, which go with what they stand beside.
    return NEAR if density >= rules.few_stop_words else OPEN


def best_density(text: str, enough: float) -> float:
    density = stop_density(text.lower().split())
    if density < enough:
        # Words may carry marks; look at their letters only.
        density = max(density, stop_density(WORD.findall(text.lower())))
    return density


def in_listed_language(blocks: list[Block], rules: BlockRules) -> bool:
    """Whether the longer texts of a page, links aside, show the stop words that are known."""
    words: list[str] = []
    for block in blocks:
        if not block.outside and length_of(block.text) >= rules.short and not is_linked(block, rules):
            words += WORD.findall(block.text.lower())
    return not words or stop_density(words) >= rules.known_stop_words


def stop_density(words: list[str]) -> float:
    return sum(map(STOP_WORDS.__contains__, words)) / max(len(words), 1)


def second_pass(blocks: list[Block], labels: list[int], rules: BlockRules) -> list[bool]:
    """Which blocks belong to the article.

    Where no block is good by itself, those near to it are; where none of them is
    either, those that are not short or read like sentences.
    """

    def like_prose(block: Block) -> bool:
        if length_of(block.text) >= rules.short:
            return True
        return stop_density(WORD.findall(block.text.lower())) >= rules.few_stop_words

    labels = list(labels)
    for instead in (NEAR, OPEN):
        if GOOD in labels:
            break
        for i, block in enumerate(blocks):
            if labels[i] == instead and (instead == NEAR or not block.heading and like_prose(block)):
                labels[i] = GOOD
    n = len(labels)
    decided = [label in (BAD, GOOD) for label in labels]
    before, after = [-1] * n, [n] * n
    last = -1
    for i in range(n):
        before[i] = last
        if decided[i] and not blocks[i].outside:
            last = i
    last = n
    for i in range(n - 1, -1, -1):
        after[i] = last
        if decided[i] and not blocks[i].outside:
            last = i
    out = []
    for i, block in enumerate(blocks):
        if decided[i]:
            out.append(labels[i] == GOOD)
            continue
        near = [(abs(j - i), labels[j]) for j in (before[i], after[i]) if 0 <= j < n]
        if block.heading and 0 <= after[i] < n:
            # A heading goes with what follows it.
            out.append(labels[after[i]] == GOOD)
        elif not near:
            out.append(labels[i] == NEAR)
        elif labels[i] == NEAR:
            # Prose between links is still prose if any article is beside it.
            out.append(any(label == GOOD for _, label in near))
        else:
            close = min(distance for distance, _ in near)
            nearest = {label for distance, label in near if distance == close}
            out.append(GOOD in nearest)
    return out


def main_text(html: str, rules: BlockRules) -> str:
    blocks = blocks_of(html)
    marked = any(b.region and not b.outside for b in blocks)
    listed = marked or in_listed_language(blocks, rules)
    labels = [first_pass(b, rules, marked, listed) for b in blocks]
    chosen = second_pass(blocks, labels, rules)
    return " ".join(b.text for b, keep in zip(blocks, chosen, strict=True) if keep)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), rules: BlockRules | None = None) -> DataFrame:
    """`text` and `n_chars` of the `html` of each row, beside the columns in `keep`. No shuffle."""
    rules = rules or BlockRules()
    source = pages.select(*keep, F.col("html").cast("string").alias("html"))
    schema = source.drop("html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", rules) for h in batch.column(len(keep))]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            arrays = [*batch.columns[: len(keep)], pa.array(texts, pa.string()), lengths]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "text", "n_chars"])

    return source.mapInArrow(run, schema)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
