"""Scalar text functions, all on the JVM side unless they say otherwise."""

from __future__ import annotations

import html
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The character range kept by default, the author marker, and the character pairs of the simplification.
CJK = r"[^一-鿿]"
MARKER = "著"
TRADITIONAL = "書詩經論語學習時說樂遠來慍為鮮亂務謀傳國節愛謹眾親餘賢雖謂無過憚終歸問貢於聞溫儉讓諸異觀沒禮貴義復恥飽貧諂驕賜選記漢後晉齊陳戰華台灣門馬亞賓緬撾"
SIMPLIFIED = "书诗经论语学习时说乐远来愠为鲜乱务谋传国节爱谨众亲余贤虽谓无过惮终归问贡于闻温俭让诸异观没礼贵义复耻饱贫谄骄赐选记汉后晋齐陈战华台湾门马亚宾缅挝"
# What marks a line of a page as not being text.
PLAIN_SKIP = ("中国哲学书电子化计划", "简体字版", "繁体", "English", "本站介绍", "简介", "工具", "系统统计", "先秦两汉", "喜欢我们的网站", "网站的设计与内容", "版权", "沪ICP", "若有任何意见或建议", "Do not click this", "function", "var ", "if(")
RICH_SKIP = (*PLAIN_SKIP[:-1], "margin", "padding", "position", "height", "width")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends (``trim`` keeps the ideographic space)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def clean(text: Column, drop: str = CJK) -> Column:
    """Without the characters that ``drop`` matches; a null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), drop, "")


def clean_author(author: Column, marker: str = MARKER) -> Column:
    """Without one marker at the end."""
    return F.when(F.endswith(author, F.lit(marker)), F.substr(author, F.lit(1), F.length(author) - len(marker))).otherwise(author)


def drop_marker(author: Column, marker: str = MARKER) -> Column:
    """Without any marker."""
    return F.trim(F.replace(F.trim(author), F.lit(marker), F.lit("")))


def ngrams(text: Column, n: int) -> Column:
    """The overlapping n-grams of a text within the basic plane; none if it is shorter than n."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))"), F.lit(1))


def characters(text: Column) -> Column:
    """The characters of a text but its white space."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), ""), lambda c: c != "")


def sanitize(name: Column) -> Column:
    """Letters, digits, spaces, dashes and underscores."""
    return F.trim(F.regexp_replace(name, r"[^\p{L}\p{N} _-]", ""))


def simplify(text: Column) -> Column:
    """Traditional characters replaced by simplified ones, one by one."""
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def node_size(mentions: Column, divisor: float = 5.0) -> Column:
    return F.least(mentions / F.lit(divisor) + 5, F.lit(30.0))


def unescape(text: Column) -> Column:
    """HTML entities as characters (Python's table; Spark has none)."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            yield batch.map(html.unescape, na_action="ignore")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf("string")(run)(text)


def _without_code(page: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(page, r"(?s)<script[^>]*>.*?</script>", ""), r"(?s)<style[^>]*>.*?</style>", "")


def _lacks(word: str):  # noqa: ANN202
    return lambda s: ~F.contains(s, F.lit(word))


def _lines(text: Column, skip: Sequence[str], rich: bool, collapse: bool) -> Column:
    flat = F.regexp_replace(text, r"\s+", " ") if collapse else F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")
    kept = F.filter(F.transform(F.split(flat, "\n"), lambda s: F.trim(s)), lambda s: s != "")  # F.trim itself would take the place for its second argument
    for word in skip:
        kept = F.filter(kept, _lacks(word))
    if rich:
        kept = F.filter(kept, lambda s: ~F.rlike(s, F.lit(r"^[\d\s\-_]+$")) & ((F.length(s) >= 3) | F.rlike(s, F.lit(r"[一-鿿]"))))
    return F.trim(F.array_join(kept, "\n"))


def page_text(page: Column, skip: Sequence[str] = PLAIN_SKIP, collapse: bool = True) -> Column:
    """The text of an HTML page: no scripts, styles, tags or entities.

    ``collapse`` folds all white space before lines are told apart, so one word of ``skip`` blanks the page (parity);
    without it lines are filtered one by one.
    """
    bare = F.regexp_replace(F.regexp_replace(_without_code(page), "<[^>]+>", ""), "&[^;]+;", "")
    return _lines(bare, skip, rich=False, collapse=collapse)


def rich_page_text(page: Column, skip: Sequence[str] = RICH_SKIP, collapse: bool = True, decode: bool = True) -> Column:
    """As ``page_text``, from the main block if there is one, with breaks and paragraphs as line ends and entities as characters."""
    body = _without_code(page)
    block = r'(?s)<div[^>]*class="[^"]*text[^"]*"[^>]*>(.*?)</div>'
    body = F.when(F.rlike(body, F.lit(block)), F.regexp_extract(body, block, 1)).otherwise(body)
    for tag in (r"<br\s*/?>", "<p[^>]*>", "</p>"):
        body = F.regexp_replace(body, tag, "\n")
    body = F.regexp_replace(body, "<[^>]+>", "")
    return _lines(unescape(body) if decode else body, skip, rich=True, collapse=collapse)
