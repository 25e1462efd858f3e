"""Greedy cover against a plain version with ties, and requests by clauses."""

import random

from pyspark.sql import functions as F

from sparkloom.functions.requests import requests_date_record
from sparkloom.operators import selection
from sparkloom.plans.requesting import QUESTIONS


def plain(hits, terms, sizes, k, weight, least, support):
    out = []
    for qid in sizes:
        left, seen = [], set()
        for _, i, score, parent in sorted((h for h in hits if h[0] == qid and h[2] >= least and (qid, h[1]) in support), key=lambda h: (-h[2], h[1])):
            if parent not in seen:
                seen.add(parent)
                left.append((i, score))
        covered = set()
        for place in range(1, k + 1):
            if not left:
                break
            gain = [s + weight * len(terms.get((qid, i), set()) - covered) / max(1, sizes[qid]) for i, s in left]
            i, s = left.pop(max(range(len(left)), key=lambda j: (gain[j], -j)))
            covered |= terms.get((qid, i), set())
            out.append((qid, place, i, s))
    return out


def test_cover_equals_plain_greedy(spark):
    dice = random.Random(3)
    hits = [(q, i, dice.choice([0.5, 1.0, 1.0, 2.0]), dice.choice(["a", "b", "c", "d", "e", None])) for q in range(12) for i in range(dice.randrange(0, 15))]
    terms = {(q, i): set(dice.sample(range(8), dice.randrange(1, 5))) for q, i, _, _ in hits if dice.random() < 0.9}
    sizes = {q: 8 for q in range(12)}
    support = {(q, i) for q, i, _, _ in hits if dice.random() < 0.8}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    h = frame(hits, "qid long, id long, score double, parent string")
    t = frame([(q, i, x) for (q, i), own in terms.items() for x in own], "qid long, id long, term long")
    s = frame(list(sizes.items()), "qid long, n_terms long")
    for weight in (0.0, 0.5, 8.0):
        got = selection.cover_query(h, t, s, 4, weight, 0.75, frame(sorted(support), "qid long, id long"))
        assert sorted(tuple(r) for r in got.select("qid", "place", "id", "score").collect()) == sorted(plain(hits, terms, sizes, 4, weight, 0.75, support))
    assert selection.cover_query(h.limit(0), t, s, 4, 1.0).count() == 0


def test_requests_carry_state_over_clauses(spark):
    more = [("확정일자 기록은 무엇인가요! 당시의 내역 확인", True), ("그때 기록 확인", False), ("확정일자 기록 확인은 보호와 관계없나요", False), ("", False), ('"확정일자 기록" 확인', False)]
    rows = QUESTIONS + more
    got = spark.createDataFrame([(k, q) for k, (q, _) in enumerate(rows)] + [(99, None)], "k int, q string").select("k", requests_date_record(F.col("q")).alias("asks")).collect()
    assert {r.k: r.asks for r in got} == {**{k: asks for k, (_, asks) in enumerate(rows)}, 99: None}
