"""References inside a text: articles that another adopts, lists and ranges of paragraphs, quantities with their units."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An article, notes of amendment, quotation marks, an adoption clause, how paragraphs go on, how many a range may span.
_ARTICLE = r"제\s*(\d+)\s*조(?:\s*의\s*(\d+))?"
_PLAIN = r"제\s*\d+\s*조(?:\s*의\s*\d+)?"
HISTORY = re.compile(rf"\[(?:(?:전문개정|본조신설|제목개정|제목변경)\s*|{_PLAIN}에서\s*이동(?:,\s*종전\s*{_PLAIN}는\s*{_PLAIN}로\s*이동)?\s*|종전\s*{_PLAIN}는\s*{_PLAIN}로\s*이동\s*)<?\d{{4}}\.\s*\d{{1,2}}\.\s*\d{{1,2}}\.?>?\]")
MARKS = "[]「」“”\"'"
_ITEM = rf"(?:민법\s*)?{_PLAIN}(?:\s*제\s*\d+\s*항)?"
ADOPTION = re.compile(rf"({_ITEM}(?:\s*(?:,|및|와|과|내지)\s*{_ITEM})*)\s*의\s*규정은\s+[^.\[\]제]*준용한다\.")
RANGE = re.compile(rf"{_ARTICLE}\s*내지\s*{_ARTICLE}")
PARAGRAPH = re.compile(r"제\s*(\d+)\s*항(?:\s*까지)?")
GOES_ON = re.compile(r"\s*(부터|내지|[~～–—-]|[·ㆍ,](?:\s*및)?|및|와|과|또는)\s*(?:제\s*)?(\d+)\s*항(?:\s*까지)?")
SPANS = ("부터", "내지", "~", "～", "–", "—", "-")
LAW, WIDEST, LAST = "민법", 200, 50
_NUMBER, _POWER = r"\d+(?:\.\d+)?", "[조억만천백십]"
QUANTITY = (
    rf"{_NUMBER}(?:{_POWER}+{_NUMBER})*{_POWER}*(?:원|년|개월|월|일|평|퍼센트|%)"
    rf"|{_NUMBER}(?:{_POWER}+{_NUMBER})*{_POWER}+(?:원)?"
    r"|(?=[일이삼사오육칠팔구십백천만억조]*[십백천만억조])[일이삼사오육칠팔구십백천만억조]+원"
)

REFERENCE = "target string"
GROUP = "start int, end int, paragraphs array<int>"


def _article(number: str, branch: str) -> str:
    return f"{LAW}-제{int(number)}조" + (f"의{int(branch)}" if branch else "")


def adopted(row: dict) -> Iterator[tuple[str]]:
    """Articles that a chunk (article_no, text) adopts: its whole body is one adoption clause of the same law, else none.

    A range counts both ends and what is between; one of branches, backwards, or
    of more than 200 articles makes the clause count for nothing.
    """
    head = re.match(re.escape(f"[{LAW} {row['article_no']}") + r"(?:\([^\[\]]*\))?\]", row["text"])
    if not head:
        return
    lines = [line for line in map(str.strip, row["text"][head.end() :].splitlines()) if line and not HISTORY.fullmatch(line)]
    clause = ADOPTION.fullmatch(" ".join(lines))
    if not clause or any(mark in line for line in lines for mark in MARKS):
        return
    found = {_article(n, b) for n, b in re.findall(_ARTICLE, clause[1])}
    for a, branch, b, other in RANGE.findall(clause[1]):
        if branch or other or not 0 < int(a) <= int(b) <= int(a) + WIDEST:
            return
        found |= {_article(str(n), "") for n in range(int(a), int(b) + 1)}
    yield from ((target,) for target in sorted(found))


def paragraph_groups(text: str) -> Iterator[tuple[int, int, list[int]]]:
    """Runs of paragraphs behind an article: (start, end, numbers); a list counts its members, a range all from end to end.

    A range that does not rise within 1 to 50 counts as paragraph 0, which no text has.
    """
    for m in re.finditer(_PLAIN + r"\s*" + PARAGRAPH.pattern, text):
        last, end = int(m[1]), m.end()
        numbers = {last}
        while more := GOES_ON.match(text, end):
            n = int(more[2])
            if more[1] not in SPANS:
                numbers.add(n)
            elif 1 <= last <= n <= LAST:
                numbers |= set(range(last, n + 1))
            else:
                numbers.add(0)
            last, end = n, more.end()
        yield m.start(), end, sorted(numbers)


def quantities(text: Column) -> Column:
    """Distinct quantities of a text in order, without its spaces and commas: numbers with powers and units, and amounts in words."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, r"(?U)[\s,]", ""), F.lit(f"({QUANTITY})"), 1))
