"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import max_run

THINK = r"(?s)^\s*<think>(.*?)</think>(.*)$"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"

# Patterns and phrases that the rules look for.
LABELS = (r'(?i)one\s+labeled\s+"([^"]+)"', r"(?i)one\s+labeled\s+'([^']+)'", r'(?i)icon\s+that\s+displays\s+"([^"]+)"', r"(?i)icon\s+that\s+displays\s+'([^']+)'")
CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"
FORBIDDEN = (
    "ground truth", "provided action", "fixed action", "given action", "oracle", "offline supervision", "source trace", "source motion", "original move", "aggregated motion",
    "hidden target", "hidden label", "target answer", "annotation metadata", "this ablation", "compressed trace", "macro version",
)
CLICKS = r"\b(?:click|double[- ]click|right[- ]click|tap|press)\b"
SELECTS = r"(?:^|\b(?:and|then)\s+)(?:then\s+)?select\b"
HOVERS = r"\bhover\b"
CURSOR_MOVES = r"\b(?:aim|bring|hover|move|pass|pinpoint|place|point|position|use|zero\s+in)\b.{0,160}\b(?:(?:your|the)\s+)?(?:mouse(?:\s+(?:cursor|pointer))?|cursor|pointer)\b"
CURSOR_STATES = r"\b(?:cursor|pointer|mouse)\b.{0,40}\b(?:is\s+)?(?:located|placed|positioned)\b"
SENTENCE_ENDS = r"[.!?。！？\n]+"
# Thresholds of the repetition rule.
UNIQUE_SHARE, MOST_SAME, LEAST_WORDS, LEAST_GRAMS, SENTENCE_WORDS, WIDEST_TAIL = 0.55, 3, 24, 20, 6, 20


def normalize_ws(c: Column) -> Column:
    """Runs of (Unicode) white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without (Unicode) white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def required_text(c: Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def mask_email(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL, "<EMAIL>")


def category_default(c: Column, default: str = "__unlabeled__") -> Column:
    return F.coalesce(required_text(c), F.lit(default))


def prefix_category(c: Column) -> Column:
    """functional, direct (any ``direct_*``) or null."""
    return F.when(c == "functional", "functional").when(c.startswith("direct_"), "direct")


def extract_label(c: Column, patterns: Sequence[str] = LABELS) -> Column:
    """The first group of the first pattern that matches."""
    found = [required_text(F.regexp_extract(c, p, 1)) for p in patterns]
    return F.coalesce(*found)


def split_think(c: Column) -> tuple[Column, Column]:
    """Thought and remainder of a text that begins with a think block; else null and the text."""
    has = c.rlike(THINK)
    return F.when(has, strip(F.regexp_extract(c, THINK, 1))), F.when(has, strip(F.regexp_extract(c, THINK, 2))).otherwise(c)


def render_think(thought: Column, payload: Column) -> Column:
    return F.concat(F.lit("<think>"), thought, F.lit("</think>\n"), payload)


def id_split(c: Column, marker: str) -> Column:
    """The part after the marker and before the next ``_`` if it is train, val or test, else unknown."""
    part = F.substring_index(F.substring_index(c, marker, -1), "_", 1)
    return F.when(c.contains(marker) & part.isin("train", "val", "test"), part).otherwise("unknown")


def cursor_only(c: Column) -> Column:
    """An instruction to point, not to click or select."""
    has = lambda p: c.rlike(f"(?i){p}")
    return ~(has(CLICKS) | has(SELECTS)) & (has(HOVERS) | has(CURSOR_MOVES) | has(CURSOR_STATES))


def batch_key(c: Column) -> Column:
    """An id without its last two ``_`` parts."""
    return F.regexp_extract(c, r"^(.*)_[^_]*_[^_]*$", 1)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens as texts; none if there are fewer."""
    last = F.size(tokens) - n
    runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(tokens, i + 1, n), " "))
    return F.when(last >= 0, runs).otherwise(F.array().cast("array<string>"))


def think_issues(c: Column, forbidden: Sequence[str] = FORBIDDEN) -> Column:
    """Codes of what is wrong with a thought: empty, no_latin, cjk, forbidden, nested_tag."""
    low = F.lower(c)
    bad = F.lit(False)
    for p in forbidden:
        bad = bad | low.contains(p.lower())
    rules = [
        ("empty", F.trim(c) == ""),
        ("no_latin", ~c.rlike("[A-Za-z]")),
        ("cjk", c.rlike(CJK)),
        ("forbidden", bad),
        ("nested_tag", low.rlike("</?think>")),
    ]
    return F.array_join(F.array_compact(F.array(*[F.when(ok, code) for code, ok in rules])), ",")


def repetition_issues(c: Column, unique_share: float = UNIQUE_SHARE, most: int = MOST_SAME, least_words: int = LEAST_WORDS, least_grams: int = LEAST_GRAMS, sentence: int = SENTENCE_WORDS, widest: int = WIDEST_TAIL) -> Column:
    """Codes of repetition in a text of at least ``least_words`` words.

    duplicate_sentence: one of at least ``sentence`` words comes twice; ngram: of
    ``least_grams`` or more runs of four words few differ and one comes ``most``
    times; tail: the last 4 to ``widest`` words stand there three times in a row.
    """
    def tail(t: Column) -> Column:
        # The last words, backwards and cut once: position i stands there again w places on.
        back = F.reverse(F.slice(t, F.greatest(F.size(t) - 3 * widest + 1, F.lit(1)), 3 * widest))
        again = lambda b, w: F.slice(b, 1, 2 * w) == F.slice(b, w + 1, 2 * w)
        return let(back, lambda b: F.exists(F.sequence(F.lit(4), F.lit(widest)), lambda w: (F.size(b) >= 3 * w) & (F.get(b, 0) == F.get(b, w)) & again(b, w)))

    def few(grams: Column) -> Column:
        n = F.size(grams)
        return (n >= least_grams) & (F.size(F.array_distinct(grams)) / F.greatest(n, F.lit(1)) < unique_share) & (max_run(F.array_sort(grams)) >= most)

    def doubled(own: Column) -> Column:
        return F.size(F.array_distinct(own)) < F.size(own)

    def judge(t: Column) -> Column:
        sentences = F.filter(F.transform(F.split(F.lower(c), SENTENCE_ENDS), words), lambda x: F.size(x) >= sentence)
        rules = [("duplicate_sentence", let(sentences, doubled)), ("ngram", let(ngrams(t, 4), few)), ("tail", tail(t))]
        codes = F.array_join(F.array_compact(F.array(*[F.when(ok, code) for code, ok in rules])), ",")
        return F.when(F.size(t) >= least_words, codes).otherwise("")

    return let(words(c), judge)
