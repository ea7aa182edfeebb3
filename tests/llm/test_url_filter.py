"""Temporal list join on planted captures."""

import datetime

import pytest

from symtransfer.llm import url_filter
from symtransfer.llm.url_filter import ENTRIES, evaluate, validity

DAY = datetime.date


def captures(spark, rows):
    return spark.createDataFrame([(i, u, t, "x", 0) for i, u, t in rows], "page_id long, url string, fetched date, list string, host int")


def entries(spark, rows):
    return spark.createDataFrame(rows, "list string, host string, action string, day string")


def test_intervals(spark):
    got = {tuple(r) for r in validity(entries(spark, [*ENTRIES[:3], ("spam", "SPAM-FARM.example.org", "add", "2024-02-01"), ("a", None, "add", "2024-01-01"), ("b", "x.y", "add", "2024-01-01"), ("b", "x.y", "remove", "2024-01-01")])).collect()}
    assert got == {
        ("spam", "spam-farm.example.org", DAY(2024, 1, 1), DAY(2024, 2, 1)), ("spam", "spam-farm.example.org", DAY(2024, 2, 1), DAY(2024, 4, 1)), ("spam", "spam-farm.example.org", DAY(2024, 7, 1), None),
    }


@pytest.mark.parametrize("broadcast, hot", [(url_filter.BROADCAST, url_filter.HOT), (-1, 0), (-1, 1)])
def test_as_of(spark, monkeypatch, broadcast, hot):
    """With listed hosts on all executors, and with hot hosts dealt into parts."""
    monkeypatch.setattr(url_filter, "BROADCAST", broadcast)
    monkeypatch.setattr(url_filter, "HOT", hot)
    rows = [
        (1, "http://spam-farm.example.org/x", DAY(2024, 1, 1)), (2, "https://u:p@www.Spam-Farm.example.org.:80/x", DAY(2024, 3, 31)), (3, "http://spam-farm.example.org", DAY(2024, 4, 1)),
        (4, "http://spam-farm.example.org?q", DAY(2023, 12, 31)), (5, "http://cheap-pills.example.com/", DAY(2024, 3, 5)), (6, "http://notspam-farm.example.org/", DAY(2024, 1, 5)),
        (7, None, DAY(2024, 1, 5)), (8, "no url", DAY(2024, 1, 5)), (9, "http://spam-farm.example.org/", None), (None, "http://spam-farm.example.org/", DAY(2024, 8, 1)), (1, "http://spam-farm.example.org/x", DAY(2024, 1, 1)),
        (10, "http://a.b.example.net/", DAY(2024, 6, 3)), (11, "http://localhost/", DAY(2024, 6, 3)), (12, "http://spam-farm.example.org/" + "x" * 50_000, DAY(2024, 1, 9)), (13, "", DAY(2024, 1, 9)),
    ]
    got = sorted(((r.page_id or 0, ",".join(r.lists), r.kept) for r in evaluate(captures(spark, rows), entries(spark, ENTRIES)).collect()))
    assert got == [(0, "spam", False), (1, "spam", False), (1, "spam", False), (2, "spam", False), (3, "", True), (4, "", True), (5, "drugs,spam", False), (6, "", True), (7, "", True), (8, "", True), (9, "", True), (10, "registry", False), (11, "", True), (12, "spam", False), (13, "", True)]
    assert evaluate(captures(spark, []), entries(spark, ENTRIES)).count() == 0
    assert all(r.kept for r in evaluate(captures(spark, rows), entries(spark, [])).collect())
