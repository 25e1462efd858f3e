"""Search terms that a question asks for without saying them: a dictionary of everyday words, and ordered rules for concepts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .requests import CURRENT, QUOTED, requests_date_record

#: Everyday words with the terms of statutes for them, for all channels and for civil law alone.
TERMS = {
    "세입자": ["임차인"], "집주인": ["임대인"], "주인": ["임대인"], "새 주인": ["양수인", "임대인의 지위를 승계"], "주인이 바뀌": ["양수인", "임대인의 지위를 승계"],
    "집이 팔리": ["양수인", "매매", "임대인의 지위를 승계"], "명의": ["소유권", "등기"],
    "전세금": ["보증금"], "전세보증금": ["보증금"], "월세": ["차임", "월차임"], "반전세": ["월차임 전환", "차임"], "월세로 돌리": ["월차임 전환"], "월세로 바꾸": ["월차임 전환"],
    "올려달": ["증액청구", "증액"], "올려주": ["증액", "증액청구"], "깎아": ["감액청구", "감액"], "상한": ["초과하지 못한다", "증액청구"],
    "돌려받": ["반환", "회수"], "못 받": ["반환되지 아니한", "회수"], "떼이": ["반환되지 아니한"],
    "재계약": ["갱신"], "연장": ["갱신", "존속기간"], "자동 연장": ["묵시적 갱신", "갱신"], "계약 기간": ["임대차기간", "존속기간"],
    "나가라": ["갱신거절", "해지"], "쫓아내": ["갱신거절", "해지"], "특약": ["약정", "강행규정"], "계약서": ["임대차계약증서"],
    "이사": ["인도", "점유"], "입주": ["인도", "점유"], "전입신고": ["주민등록", "대항요건"], "살고 있": ["점유", "인도"], "비워주": ["인도"],
    "빚": ["채무", "채권"], "대출": ["채권", "근저당권"], "근저당": ["근저당권", "채권최고액", "담보물권"], "잡혀 있": ["근저당권", "담보물권"],
    "순위": ["우선변제", "후순위권리자"], "먼저 받": ["우선변제", "우선하여 변제"], "경매": ["경매", "환가대금", "배당"], "공매": ["공매", "환가대금"], "등기부": ["등기", "등기사항"],
    "세금": ["국세", "지방세", "납세증명서"], "세금을 안 낸": ["미납국세", "체납", "납세증명서"], "체납": ["미납국세", "체납액"],
    "소송": ["소", "보증금반환청구소송"], "조정": ["조정", "분쟁조정위원회"], "신고": ["신고", "확정일자"], "법원": ["지방법원", "법원"], "무효": ["효력이 없다", "강행규정"], "보호받": ["보호", "준용"],
    "오피스텔": ["주거용 건물", "주택"], "원룸": ["주거용 건물", "주택"], "빌라": ["주거용 건물", "주택"],
}
CIVIL_TERMS = {
    "보일러": ["수선", "사용 및 수익"], "온수": ["수선", "사용 및 수익"], "난방": ["수선", "사용 및 수익"], "고장": ["수선", "사용 및 수익"],
    "수리": ["수선", "필요비", "상환"], "수리비": ["필요비", "상환"], "제 돈": ["비용을 지출", "상환"], "먼저 내": ["비용을 지출", "상환"],
    "누수": ["일부를 사용·수익할 수 없게", "차임의 감액"], "물이 새": ["일부를 사용·수익할 수 없게", "차임의 감액"], "못 쓰": ["사용·수익할 수 없게", "차임의 감액"], "곰팡이": ["사용·수익할 수 없게", "차임의 감액"],
    "알려": ["통지"], "말해야": ["통지"], "말 안 하고": ["통지"], "친구한테 빌려": ["전대", "임대인의 동의"], "다른 사람에게 빌려": ["전대", "임대인의 동의"], "방 하나를 빌려": ["전대", "임대인의 동의"],
    "월세가 밀": ["차임액의 연체", "계약을 해지"], "월세를 밀": ["차임액의 연체", "계약을 해지"], "차임을 연체": ["차임액의 연체", "계약을 해지"],
}
#: The fixed date counts for its effect if that is asked for, or if it is absent and no procedure is asked for.
DATE, DATE_TERMS = "확정일자", ["우선변제권", "우선하여 변제"]
ABSENT = ["확정일자를 안 받", "확정일자 안 받", "확정일자를 받지 않", "확정일자 받지 않", "확정일자 없이", "확정일자가 없", "확정일자 없는", "확정일자도 없"]
EFFECTS = ["확정일자는 왜 필요", "확정일자가 왜 필요", "확정일자 왜 필요", "확정일자가 필요한 이유", "확정일자를 받아야 하는 이유", "확정일자의 효력", "확정일자 효력", "우선변제", "보증금을 먼저 받", "보호받", "보호 받", "보증금 보호", "보증금을 지키", "경매에서", "공매에서", "배당받", "후순위"]
PROCEDURES = ["신청", "발급", "부여", "교부", "접수", "방문", "온라인", "어디", "어느 기관", "방법", "절차", "수수료", "비용", "준비물", "필요 서류", "신분증", "계약서", "주민센터", "등기소", "받으려", "받는 법", "받을 수 있"]
#: Concepts of civil law and of statutes by what a question says, in their order.
CIVIL_RULES = [
    (r"공동\s*(?:명의|소유)|공유자|지분", "공유물의 관리 보존 공유자 지분 과반수"),
    (r"대리|위임|대신.{0,15}계약", "대리행위 대리권의 범위 본인 권한"),
    (r"등기|소유자|소유권", "부동산 물권변동 등기 물권취득"),
    (r"원상\s*(?:복구|회복)|벽지|장판|도배", "원상회복의무 철거권 임대차 준용규정"),
    (r"실수|과실|깨뜨|파손", "채무불이행 손해배상 고의 과실"),
    (r"특약|구두\s*합의|약정", "임의규정 당사자 의사표시"),
]
LAW_RULES = [(r"임대차\s*신고|계약\s*신고", "주택 임대차 계약 신고 확정일자 부여"), (r"중개사|중개\s*보수|중개\s*수수료|확인[·\s]*설명서", "중개대상물 확인 설명 중개보수")]
SITUATION, EARLIER = "사용자 추가 상황:", "이전 대화"
TURNS = r"[.!?\n;]|(?:지만|는데|고서|반면|대신)\s*"
NOT_SENT = r"(?:해지|종료|갱신|반환\s*요구|통지|통보|발송)(?:를|을|는|은|가|이)?\s*(?:하지(?:는)?\s*(?:않|못)|(?:안|못)\s*(?:했|하)|아니)|(?:알리|보내)지(?:는)?\s*(?:않|못)"
DELIVERY, LETTER = r"내용증명|등기\s*우편|우편|문자|통보|통지|연락", "내용증명"
PURPOSE = r"(?:계약|임대차).{0,15}(?:끝|종료|해지|갱신|나가|퇴거)|(?:끝|종료|해지|갱신|나가|퇴거).{0,15}(?:계약|임대차)|보증금.{0,20}(?:돌려|반환|요구|받)|(?:돌려|반환|요구).{0,20}보증금"
ACTION = r"보내|보낸|전달|도달|반송|돌아왔|수취|알리|통지|통보"
SERVICE = r"반송|(?:우편|편지|내용증명|서류).{0,40}돌아왔|소재.{0,8}모르|주소.{0,8}모르|행방"
LEAVES = r"이사|퇴거|비우|인도|짐|(?:열쇠|키|출입수단).{0,12}(?:넘|반납|돌려)"
TAXES = r"체납|미납.{0,8}(?:세금|국세|지방세)|세금.{0,8}(?:밀|안\s*낸|미납)"
MOVES_IN = r"전입|주민등록|주소.{0,8}(?:옮|이전)"
PUBLIC, PRIVATE, OPERATOR = r"공공\s*임대|국민\s*임대|행복\s*주택", r"등록\s*민간\s*임대|민간\s*임대", r"임대\s*사업자"
APPLIES = r"어디|언제|신청|발급|방법|현황|열람|다시.{0,8}(?:받|챙)"
NOTICE_TERM, SERVICE_TERM, PERFORMANCE = "의사표시 도달 효력발생시기", "의사표시 공시송달 상대방 소재", "쌍무계약 동시이행의 항변권 채무이행 거절"
TAX_TERM, MOVE_TERM = "미납국세 미납지방세 열람 납세증명", "주민등록 전입신고 주택 인도 대항력"
PUBLIC_TERM, PRIVATE_TERM = "공공임대주택 입주자 자격 임대차계약", "민간임대주택 임대사업자 임대료 임대차계약"
RECORD, EFFECT, ACCESS = "확정일자 부여 현황 정보제공", "확정일자 우선변제 주택 인도 주민등록", "정보제공 요청 이해관계인 임차인 범위"
HEADING = "\n관련 검색 개념: "


def _has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit("(?U)" + pattern))


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _when(*rules: tuple[Column, str]) -> Column:
    """The terms whose condition holds, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(x)) for c, x in rules])))


def _looked_up(question: Column, words: dict[str, list[str]]) -> Column:
    held = [F.when(F.contains(question, F.lit(word)), F.array(*map(F.lit, terms))).otherwise(F.array().cast("array<string>")) for word, terms in words.items()]
    return F.flatten(F.array(*held))


def _new(question: Column, terms: Column) -> Column:
    return F.when(question.isNotNull(), F.filter(F.array_distinct(terms), lambda x: ~F.contains(question, x)))


def expand(question: Column) -> Column:
    """Terms of the dictionary whose everyday word a question has, without those it has itself; null gives null."""
    return _new(question, _looked_up(question, TERMS))


def expand_law(question: Column) -> Column:
    """As ``expand``; terms of priority too where a question is about what a fixed date is good for."""
    asked = F.contains(question, F.lit(DATE)) & (_any(question, EFFECTS) | (_any(question, ABSENT) & ~_any(question, PROCEDURES)))
    more = F.when(asked, F.array(*map(F.lit, DATE_TERMS))).otherwise(F.array().cast("array<string>"))
    return _new(question, F.concat(_looked_up(question, TERMS), more))


def expand_civil(question: Column) -> Column:
    """As ``expand``, with the dictionary of civil law behind it."""
    return _new(question, F.concat(_looked_up(question, TERMS), _looked_up(question, CIVIL_TERMS)))


def current_request(question: Column) -> Column:
    return F.trim(F.substring_index(question, CURRENT, -1))


def current_context(question: Column) -> Column:
    """Facts that hold now: what follows their label, else the whole question unless it quotes an earlier talk."""
    return F.when(F.contains(question, F.lit(SITUATION)), F.trim(F.substring_index(question, SITUATION, -1))).when(F.contains(question, F.lit(EARLIER)), current_request(question)).otherwise(question)


def gives_notice(question: Column) -> Column:
    """Whether a clause, not quoted and not negated, is about sending a notice on the end of a contract or a deposit."""
    own = F.regexp_replace(current_request(question), QUOTED + "|'[^'\\n]*'", " ")
    return F.exists(F.split(own, "(?U)" + TURNS), lambda c: ~_has(c, NOT_SENT) & _has(c, DELIVERY) & _has(c, PURPOSE) & (_has(c, ACTION) | F.contains(c, F.lit(LETTER))))


def civil_concepts(question: Column) -> Column:
    """Concepts of civil law that a question is about, in the order of the rules."""
    rules = [(_has(question, p), x) for p, x in CIVIL_RULES]
    deposit = F.contains(question, F.lit("보증금")) & _has(question, LEAVES)
    return F.when(question.isNotNull(), _when(*rules, (gives_notice(question), NOTICE_TERM), (_has(current_request(question), SERVICE), SERVICE_TERM), (deposit, PERFORMANCE)))


def law_concepts(question: Column) -> Column:
    """Concepts of statutes that a question is about: some by what it asks, some by the facts it gives."""
    request, facts = current_request(question), current_context(question)
    public = _has(facts, PUBLIC)
    dated = F.contains(request, F.lit(DATE))
    rules = [(_has(request, p), x) for p, x in LAW_RULES]
    return F.when(
        question.isNotNull(),
        _when(
            *rules,
            (_has(facts, TAXES), TAX_TERM),
            (_has(facts, MOVES_IN), MOVE_TERM),
            (public, PUBLIC_TERM),
            (_has(facts, PRIVATE) | (~public & _has(facts, OPERATOR)), PRIVATE_TERM),
            (dated & _has(request, APPLIES), RECORD),
            (dated & ~_has(request, APPLIES), EFFECT),
        ),
    )


def final_law_concepts(question: Column) -> Column:
    """As ``law_concepts``; where the record of a fixed date is to be looked up, the terms of access instead of those of effect."""
    found, asks = law_concepts(question), requests_date_record(question)
    looked = F.array_distinct(F.concat(F.filter(found, lambda x: x != EFFECT), F.array(F.lit(RECORD), F.lit(ACCESS))))
    return F.when(asks, looked).otherwise(found)


def dense_context_query(question: Column, civil: bool) -> Column:
    """The question with its concepts behind it, as vector search gets it."""
    extra = civil_concepts(question) if civil else law_concepts(question)
    return F.when(F.size(extra) > 0, F.concat(question, F.lit(HEADING), F.array_join(extra, "; "))).otherwise(question)
