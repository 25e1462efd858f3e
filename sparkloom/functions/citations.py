"""The citation grammar: mentions of statutes, decisions and agencies in a text with their offsets, and the identities of evidence."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise
from urllib.parse import quote, urlencode

#: The patterns of the grammar, its particles and conjunctions, quotation marks, aliases, link addresses.
_C = "[가-힣A-Za-z0-9·]"
ARTICLE = re.compile(r"제\s*(\d+)\s*조(?:\s*의\s*(\d+))?")
LAW = re.compile(rf"((?:{_C}+\s+){{0,5}}{_C}+법(?:\s*시행령|\s*시행규칙)?)\s*$")
COURT = "대법원|헌법재판소|[가-힣]+(?:지방법원|고등법원|가정법원|행정법원)"
CASE = re.compile(rf"(?:({COURT})\s*)?(\d{{4}}[가-힣]{{1,4}}\d+)")
NUMBER = re.compile(r"\d{2,4}[가-힣]{1,4}\d+")
AGENCY = re.compile(
    r"(?<![가-힣A-Za-z0-9])(?:HUG|NTS|[가-힣A-Za-z0-9·]{2,30}?(?:위원\s*회|부|청|공사|공단|원(?!\s*회)))"
    r"(?=$|[\s.,·!?;:()「」『』]|안내|자료|가이드|에\s*(?:따르면|의하면)|"
    r"(?:으로부터|로부터|에서는|에서|에게|의|에|은|는|이|가|을|를|와|과|으로|로)(?=$|[\s.,!?;:()「」『』]))",
    re.IGNORECASE,
)
JOINED = re.compile(r"^\s*(?:[,·]\s*(?:(?:및|그리고|또는)\s*)?|(?:및|과|와|그리고|또는)\s*)$")
EMPHASIS = re.compile(r"(?<![\\*_])(?P<marker>\*{1,3}|_{1,3})(?=\S)(?P<body>[^\n]+?)(?<=\S)(?P=marker)(?![*_])")
CLAUSE_END = re.compile(r"[.!?;\n]")
ACCORDING = re.compile(r"에\s*(?:따르면|의하면)")
ISSUED = re.compile(r"^(?:에서는|에서|가|이)?\s*(?:제공|발간|발행|배포|발표|게시)(?:하고\s*있는|되고\s*있는|되어\s*있는|돼\s*있는|\s*중인|하는|되는|한|된)\s*")
PARTICLE = re.compile(r"(?:으로부터|로부터|에서는|에서|에게|에|으로|로|을|를|와|과)(?:\s|$)")
MATERIAL = re.compile(r"[가-힣A-Za-z0-9·()「」『』\"' \t-]{0,60}?(?:안내자료|안내문|안내서|자료집|가이드북|안내|자료|가이드)(?=$|[\s「」『』\"')]|에|의|을|를|은|는|이|가|상)")
CITED = re.compile(r"(?:에\s*(?:따르|의하|의해|근거)|(?:을|를)\s*(?:근거|인용)|상(?:으로)?\s)")
RECEIVED = re.compile(r"(?:을|를)?\s*(?:받|수령|다운로드|내려받|신청|요청)")
SUFFIXES = ("은", "는", "이", "가", "을", "를", "의", "에", "에서", "으로", "로", "와", "과")
CONJUNCTIONS = ("및", "또는", "그리고")
QUOTES = "「」『』"
MARKER = re.compile("[*_]")
BLANK = re.compile(r"\s*")
ALIASES = {"hug": "주택도시보증공사", "nts": "국세청"}
STATUTES = ("law", "decree", "rule")
STATUTE_LINK = "https://www.law.go.kr/법령/"
DECISION_LINK = "https://glaw.scourt.go.kr/wsjo/intesrch/sjo022.do?"
STOPS = (". ", "\n", "。")
#: White space as Unicode has it (Python adds four control characters), where evidence is cut to sentences, words that count for overlap, characters of an excerpt.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BORDER = re.compile(rf"[.!?。\n①-⑳](?:(?<=[.!?。])(?=[{SPACE}])|(?<![.!?。]))")
OUTER = re.compile(rf"^[{SPACE}]+|[{SPACE}]+\Z")
WORD = re.compile("[가-힣A-Za-z0-9]{2,}")
EXCERPT = 160

MENTION = "kind string, start int, end int, text string, name string, article int, branch int, number string, sentence string"
FACT = "kind string, name string, article int, branch int, number string, title string, link string"
SPAN = "start_offset int, end_offset int, citation string, chunk_id {}, doc_type string, url string, current_url string, excerpt string"
#: Words before an article that may belong to its statute's name, and to a decree's.
_REACH = 9


def compact(text: str) -> str:
    """Letters and digits only, in compatibility form, without case."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", text).casefold())


def view(text: str) -> str:
    """The text with paired emphasis marks and quotation marks as spaces: offsets stay."""
    parts, done, at = [], 0, MARKER.search(text)
    while at:
        m = EMPHASIS.match(text, at.start())
        if m:
            parts += text[done : m.start()], " " * (m.start("body") - m.start()), m["body"], " " * (m.end() - m.end("body"))
            done = m.end()
        at = MARKER.search(text, m.end() if m else at.end())
    seen = "".join((*parts, text[done:])) if parts else text
    for quotation in QUOTES:
        seen = seen.replace(quotation, " ")
    return seen


def _name(words: list[str]) -> str:
    """A statute's name without the words of the sentence before it."""
    for k in reversed(range(len(words) - 1)):
        if words[k].endswith(SUFFIXES) or re.fullmatch(r"제\d+[항호목]", words[k]):
            words = words[k + 1 :]
            break
    while len(words) > 1 and words[0] in CONJUNCTIONS:
        words = words[1:]
    return compact(" ".join(words))


def statutes(seen: str) -> Iterator[tuple[int, int, str, int, int | None]]:
    """(start, end, name, article, branch) of each article that a statute's name stands before; a name never reaches back over another article."""
    last = 0
    for m in ARTICLE.finditer(seen):
        before = seen[last : m.start()]
        parts = before.rsplit(None, _REACH)
        skip = len(parts[0]) if len(parts) > _REACH else 0
        law = LAW.search(before, skip)
        if law:
            yield last + law.start(), m.end(), _name(law[1].split()), int(m[1]), int(m[2]) if m[2] else None
        last = m.end()


def _closing(text: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes, or -1."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if depth == 0:
            return k
    return -1


def without_titles(seen: str, titles: set[tuple]) -> str:
    """``seen`` with an article's title in brackets blanked where it is the very title of evidence on that article."""
    named = {t[:3] for t in titles}
    parts, done, until = [], 0, 0
    for start, end, *key in statutes(seen) if named else ():
        if start < until or tuple(key) not in named:
            continue
        at = BLANK.match(seen, end).end()
        close = _closing(seen, at) if seen[at : at + 1] == "(" else -1
        if close >= 0 and (*key, re.sub(r"\s+", "", seen[at : close + 1])) in titles:
            parts += seen[done : at + 1], " " * (close - at - 1)
            done, until = close, close + 1
    return "".join((*parts, seen[done:]))


def _cites_material(tail: str) -> bool:
    """Whether what follows an agency names its material as a source, not as something to go and get."""
    tail = CLAUSE_END.split(tail, maxsplit=1)[0].strip()
    if ACCORDING.match(tail):
        return True
    tail = re.sub(r"^의\s*", "", ISSUED.sub("", tail))
    material = None if PARTICLE.match(tail) else MATERIAL.match(tail)
    if not material:
        return False
    rest = tail[material.end() :].lstrip(" \t」』\"')")
    return bool(CITED.match(rest)) or not RECEIVED.match(rest)


def agency_identity(name: str) -> str:
    return ALIASES.get(compact(name), compact(name))


def agencies(seen: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, identity) of agencies that are cited for material; those joined by conjunctions share what follows the last."""
    found = list(AGENCY.finditer(seen))
    runs: list[list[re.Match]] = [[m] for m in found[:1]]
    for a, b in pairwise(found):
        if JOINED.match(seen[a.end() : b.start()]):
            runs[-1].append(b)
        else:
            runs.append([b])
    for k, run in enumerate(runs):
        begin, end = run[-1].end(), runs[k + 1][0].start() if k + 1 < len(runs) else len(seen)
        if _cites_material(seen[begin : min(end, begin + 100)]):
            yield from ((m.start(), m.end(), agency_identity(m[0])) for m in run if not re.fullmatch(COURT, m[0].strip()))


def _sentence(text: str, start: int, end: int) -> str:
    left = max(text.rfind(s, 0, start) for s in STOPS) + 1
    right = min((k for k in (text.find(s, end) for s in STOPS) if k >= 0), default=len(text))
    return text[left:right].strip()


def article_mentions(text: str, seen: str, titles: set[tuple]) -> Iterator[tuple]:
    """Mentions of the kinds law and article (no statute named) in ``text``, whose view is ``seen``."""
    laws_in = without_titles(seen, titles)
    ends = []
    for start, end, name, article, branch in statutes(laws_in):
        ends.append((end, start))
        yield "law", start, end, text[start:end].strip(), name, article, branch, "", _sentence(text, start, end)
    for m in ARTICLE.finditer(laws_in):
        # named ones do not overlap: only the first that ends behind this one's start can reach it
        at = bisect_left(ends, (m.start() + 1,))
        if at == len(ends) or ends[at][1] >= m.end():
            yield "article", m.start(), m.end(), m[0], "", int(m[1]), int(m[2]) if m[2] else None, "", _sentence(text, m.start(), m.end())


def mentions(row: dict) -> Iterator[tuple]:
    """Mentions in ``text``, given the ``titles`` of its evidence: kinds law, article (no statute named), case, number and guide.

    ``number`` is a docket number by itself, as display looks for it.
    """
    text, seen = row["text"], view(row["text"])
    yield from article_mentions(text, seen, {(t["name"], t["article"], t["branch"], t["title"]) for t in row["titles"] or []})
    for m in CASE.finditer(text):
        yield "case", m.start(), m.end(), m[0].strip(), compact(m[1] or ""), None, None, compact(m[2]), ""
    for m in NUMBER.finditer(text):
        yield "number", m.start(), m.end(), m[0], "", None, None, m[0], text
    for start, end, identity in agencies(seen):
        yield "guide", start, end, text[start:end].strip(), identity, None, None, "", ""


def label_identity(label: str) -> tuple[str, int, int | None] | None:
    """The statute and article that a label names, before one title in balanced brackets at its end; None for anything else."""
    head, bracket, _ = label.strip().partition("(")
    if bracket and _closing(label.strip(), len(head)) != len(label.strip()) - 1:
        return None
    seen = view(head)
    found = list(statutes(seen))
    return found[0][2:] if len(found) == 1 and len(ARTICLE.findall(seen)) == 1 else None


def link_of(citation: str, doc_type: str) -> str:
    """The official page of a citation, or an empty text."""
    if doc_type in STATUTES and label_identity(citation):
        m = re.fullmatch(r"(.+?)\s+(제\s*\d+\s*조(?:\s*의\s*\d+)?)", view(citation.partition("(")[0]).strip())
        return STATUTE_LINK + "/".join(quote(re.sub(r"\s+", "", part), safe="") for part in m.groups()) if m else ""
    m = NUMBER.search(citation) if doc_type == "case" else None
    return DECISION_LINK + urlencode({"q": m[0], "w": "panre", "section": "panre_tot"}) if m else ""


def _known(text: str) -> set[str]:
    """Names of statutes that a text refers to by article."""
    return {name for _, _, name, _, _ in statutes(view(text))} if "제" in text else set()


def _own(citation: str, text: str) -> tuple[tuple | None, str]:
    """The statute and article that evidence is, by its citation or else its header, and their title."""
    label = citation.strip()
    if not label and (header := re.match(r"\[([^\]\n]+)\]", text.lstrip())):
        label = header[1]
    own = label_identity(label) if label else None
    return own, re.sub(r"\s+", "", view(label[label.index("(") :])) if own and "(" in label else ""


def facts(row: dict) -> Iterator[tuple]:
    """What evidence (doc_type, citation, text) can support: its own article (kind law), names it knows, cases, guides, and its link."""
    kind, citation, text = row["doc_type"], row["citation"] or "", row["text"] or ""
    yield "link", "", None, None, "", "", link_of(citation, kind)
    if kind in STATUTES:
        known = _known(text)
        own, title = _own(citation, text)
        if own:
            known.add(own[0])
            yield "law", *own, "", title, ""
        yield from (("known", name, None, None, "", "", "") for name in sorted(known))
    elif kind == "case":
        pairs = {(compact(m[1] or ""), compact(m[2])) for m in CASE.finditer(f"{citation}\n{text}")}
        yield from (("case", court, None, None, number, "", "") for court, number in sorted(pairs | {("", n) for _, n in pairs}))
    elif kind == "guide":
        yield from (("guide", name, None, None, "", "", "") for name in sorted({agency_identity(m[0]) for m in AGENCY.finditer(view(citation))}))


def _parts(text: str) -> Iterator[str]:
    """A text cut at line ends, behind . ! ? and 。 before white space, and before circled numbers."""
    done = 0
    for m in BORDER.finditer(text):
        at = m.end() if m[0] in ".!?。" else m.start()
        yield text[done:at]
        done = at
    yield text[done:]


def excerpt(text: str, sentence: str) -> str:
    """The sentence of ``text`` that shares most words with ``sentence``, the first of equal ones, cut to 160 characters."""
    wanted = {w for w in WORD.findall(sentence) if w in text}
    best, most = "", -1
    for part in _parts(text):
        score = len(wanted.intersection(WORD.findall(part))) if any(w in part for w in wanted) else 0
        if score > most and (kept := OUTER.sub("", part)):
            best, most = kept, score
            if most == len(wanted):
                break
    return OUTER.sub("", best[:EXCERPT]) + "…" if len(best) > EXCERPT else best


def spans(row: dict, decisions: bool = True) -> Iterator[tuple]:
    """Spans of ``text`` that link to one of its ``evidence``; without ``decisions`` these have no excerpt. See ``operators.citations.citation_spans``."""
    text, rows = row["text"], [e for e in row["evidence"] or [] if e["doc_type"] is not None]
    order = lambda e: [(e[c] is not None, e[c]) for c in ("rank", "chunk_id")]
    laws = [(e, *_own(e["citation"] or "", e["text"] or "")) for e in sorted(rows, key=order) if e["doc_type"] in STATUTES]
    hits = []
    if any(own for _, own, _ in laws) and "제" in text:
        known = None
        for kind, start, end, _, name, article, branch, _, sentence in article_mentions(text, view(text), {(*own, title) for _, own, title in laws if own and title}):
            found = [(e, own[0]) for e, own, _ in laws if own and own[1:] == (article, branch)]
            if kind == "law" and found:
                if known is None:
                    known = {own[0] for _, own, _ in laws if own}.union(*(_known(e["text"] or "") for e, _, _ in laws))
                name = max((k for k in known if name.endswith(k)), key=len, default=name)
                found = [x for x in found if x[1] == name][:1]
            if len(found) == 1:
                hits.append((start, end, found[0][0], sentence))
    cases = [e for e in rows if e["doc_type"] == "case" and e["citation"] is not None]
    for m in NUMBER.finditer(text) if cases else ():
        found = [e for e in cases if m[0] in e["citation"]]
        if len(found) == 1:
            hits.append((m.start(), m.end(), found[0], None))
    for start, end, e, sentence in hits:
        decision = sentence is None
        shown = excerpt(e["text"] or "", text if decision else sentence) if decisions or not decision else None
        if e["rank"] is not None and e["chunk_id"] is not None and (shown or decision):
            link = link_of(e["citation"] or "", e["doc_type"])
            yield start, end, e["citation"], e["chunk_id"], e["doc_type"], e["source_url"] or link, link, shown
