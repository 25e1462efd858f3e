"""What a question asks for, clause by clause with carried state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label of the current question, quotations, ends of clauses, and the words that ask, refer, look, deny and waive.
CURRENT = "사용자 질문:"
QUOTED = '"[^"\\n]*"|“[^”\\n]*”|「[^」\\n]*」'
CLAUSES = r"[.!?\n;]"
EXPLICIT = r"확정\s*일자(?:의|를|는|가)?\s*(?:(?:부여(?:된|받은)?|받은|받았던)\s*)?(?:기록|내역|여부|받았는지|유무)"
REFERENCE = r"(?:예전|그때|당시)(?:의)?\s*(?:기록|내역)"
LOOKS = "확인|조회|열람|찾"
DENIED = r"효력|대항력|우선\s*변제|보호|아니라"
WAIVED = "아니라|묻지|관계없"


def requests_date_record(question: Column) -> Column:
    """Whether a question asks to look up the record of a fixed date.

    Only what follows the last label of the current question counts, without
    quotations. Clauses are read in order: one that names the record, or refers
    back to it right after one that did, asks for it if it looks and does not
    deny; a clause that names and waives it leaves nothing to refer to. Null
    gives null.
    """
    own = F.trim(F.substring_index(question, CURRENT, -1))
    clauses = F.filter(F.split(F.regexp_replace(own, QUOTED, " "), CLAUSES), lambda c: F.trim(c) != "")
    has = lambda c, pattern: F.rlike(c, F.lit("(?U)" + pattern))
    start = F.struct(F.lit(False).alias("asks"), F.lit(False).alias("named"))

    def step(state: Column, c: Column) -> Column:
        named = has(c, EXPLICIT)
        asks = (named | (state["named"] & has(c, REFERENCE))) & has(c, LOOKS) & ~has(c, DENIED)
        return F.struct((state["asks"] | asks).alias("asks"), (named & ~has(c, WAIVED)).alias("named"))

    return F.when(question.isNotNull(), F.aggregate(clauses, start, step)["asks"])
