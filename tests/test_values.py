"""Canonical values: mixed units, periods inside dates, bad units, against written results."""

import pytest

from sparkloom.functions import values


@pytest.mark.parametrize(
    "text, amount",
    [
        ("3,500,000원", 3500000), ("1억원", 10**8), ("1억 2천 3백 4십 5만 원", 123450000), ("2억 500원", 200000500), ("7만원", 70000), ("3천 5백원", 3500), ("1천 2원", 1002),
        ("12원", 12), ("1.5억원", 15 * 10**8), ("0원", 0), ("원", 0), ("3만5천원", None), ("1억2억원", None), ("5달러", None), ("", None), ("a원", None),
    ],
)
def test_amounts(text, amount):
    assert values.won(text) == amount


def test_values_by_place():
    text = "2024년 3월 5일부터 30일, 2023-1-2 3년 10개월; 10분의 3 또는 12.50 % 5할 0.5퍼센트 1,000,000원 3억 원 12,34원 99년"
    got = [(k, raw, canon) for k, _, _, raw, canon in values.values(text)]
    assert got == [
        ("date", "2024년 3월 5일", "2024-03-05"),
        ("period", "30일", "30일"),
        ("date", "2023-1-2 ", "2023-01-02"),
        ("period", "3년", "3년"),
        ("period", "10개월", "10개월"),
        ("fraction", "10분의 3", "3/10"),
        ("percent", "12.50 %", "12.5"),
        ("percent", "5할", "50"),
        ("percent", "0.5퍼센트", "0.5"),
        ("money", "1,000,000원", "1000000"),
        ("money", "3억 원", "300000000"),
        ("period", "99년", "99년"),
    ]
    assert all(text[s:e].strip() == raw.strip() for _, s, e, raw, _ in values.values(text))
    assert list(values.values("")) == [] and list(values.values("전세 원 % 할 년")) == []
