"""Scalar functions where the meaning is not Spark's own."""

import datetime

import pytest


def value(session, text):
    return session.relation(f"π {text} → x (UNIT)").to_list()[0].x


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("IIf(NULL = NULL, 1, 2)", 1), ("Nz(NULL)", ""), ("CHOOSE(2, 'a', 'b')", "b"), ("CONCAT('a', NULL, 'b')", "ab"), ("GREATEST(1, NULL)", None), ("LEAST(3, 2)", 2),
        ("SUBSTRING('hello', 0, 3)", "he"), ("SUBSTRING('hello' FROM 2 FOR 2)", "el"), ("INITCAP('o''neil-smith x')", "O'Neil-Smith X"), ("REGEXP_REPLACE('aXbX', 'X', '_')", "a_bX"), ("REGEXP_REPLACE('aXbX', 'X', '_', 'g')", "a_b_"),
        ("SPLIT_PART('a,b,c', ',', -1)", "c"), ("POSITION('l' IN 'hello')", 3), ("CARDINALITY([1, 2])", 2), ("ARRAY_TO_STRING(['a', NULL, 'c'], '-')", "a-c"), ("Soundex('Ashcraft')", "A261"), ("FORMAT(1234.5, 0)", "1,235"),
        ("DATEDIFF('month', DATE '2026-01-31', DATE '2026-02-01')", 1), ("EXTRACT(YEAR FROM DATE '2026-02-01')", 2026), ("CAST('12' AS NUMBER) + 1 = 13", True), ("1 / 3 > 0.3333 ∧ 1 / 3 < 0.3334", True), ("'a' || 'b'", "ab"), ("'ab' LIKE 'a_'", True), ("'a\\\\b' LIKE 'a\\\\%'", True), ("5 IN {1, 5}", True),
        ("CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' END", "b"), ("JSON_VALUE('{\"a\": {\"b\": 5}}', '$.a.b')", "5"), ("JSON_VALUE('{\"a\": {\"b\": 5}}', '$.a')", None), ("Asc('A')", 65), ("Chr(233)", "é"), ("TRUNC(-3.789, 2) = -3.78", True), ("MD5('')", "d41d8cd98f00b204e9800998ecf8427e"), ("ISNUMERIC('1e3')", True), ("ISNUMERIC('x')", False),
    ],
)
def test_values(session, text, wanted):
    got = value(session, text)
    assert got == wanted, got


def test_dates(session):
    assert value(session, "ADD_MONTHS(DATE '2026-02-28', 1)") == datetime.date(2026, 3, 31)
    assert value(session, "DATE '2026-03-01' + DURATION 'P1D'").strftime("%F") == "2026-03-02"
    assert value(session, "DATE '2026-03-03' - DATE '2026-03-01'") == datetime.timedelta(days=2)
    assert value(session, "DATEADD('day', 2, DATE '2026-03-01')") == datetime.date(2026, 3, 3)


def test_parts_of_durations_are_not_rounded_up(session):
    assert value(session, "MINUTES(DURATION 'PT59.999999S')") == 0
    assert value(session, "DAYS(DURATION 'PT23H59M59.99S')") == 0
    assert value(session, "SECONDS(DURATION 'PT0S' - DURATION 'PT0.5S')") == -1
    assert value(session, "MINUTES(DURATION 'PT0S' - DURATION 'PT90S')") == -1
    assert value(session, "DAYS(DURATION 'P2DT1H')") == 2


@pytest.mark.parametrize("text", ["Log(0)", "Sqr(-1)", "Asin(2)", "CStr(NULL)", "CBool('perhaps')", "1 / 0", "MAKE_DATE(2026, 13, 1)"])
def test_errors_are_errors(session, text):
    with pytest.raises(Exception):
        value(session, text)


def test_jaro_winkler(session):
    assert round(value(session, "JaroWinkler('MARTHA', 'MARHTA')"), 4) == 0.9611
