"""Scalar expressions on literal cases."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from workpulse.functions import dates, people, text

D = datetime.date


def values(spark, use, cases):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r["v"] for r in rows.select("i", use(F.col("c")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "use, cases",
    [
        (text.keyify, {"  Task&nbsp;Name: ": "task name", "S.No": "sno", None: "", "Didn’t-do": "didnt do"}),
        (text.sender_address, {"Ann <Ann@X.example>": "ann@x.example", "b@y.example ": "b@y.example"}),
        (text.sender_domain, {"Ann <Ann@X.example>": "x.example", "nobody": ""}),
        (lambda c: text.normalize_status(c, {"wip": "In Progress"}), {"Completed": "Completed", "task is completed": "Completed", "WIP": "In Progress", "purple": None}),
        (text.normalize_priority, {"URGENT!": "High", "p3": "Low", "normal": "Medium", "": None}),
        (dates.parse_date, {"2026-03-09": D(2026, 3, 9), "9/3/26": D(2026, 3, 9), "3/19/2026": D(2026, 3, 19), "9th March 2026": D(2026, 3, 9), "Sep 1, 2026": D(2026, 9, 1), "31/02/2026": None, "soon": None, None: None, "(9-3-2026)": D(2026, 3, 9), "2026/03/09T10:00": D(2026, 3, 9), "9 March": D(datetime.date.today().year, 3, 9), "9 Mrch 2026": None, "1 Jan 70": None, "13/13/2026": None}),
        (dates.parse_time, {"9:30": "09:30", "9.30 PM": "21:30", "12 AM": "00:00", "25:00": None, "noon": None, "930": "09:30", "2130": "21:30", "9": "09:00", "12 PM": "12:00"}),
        (dates.parse_hours, {"2": 2.0, "90 min": 1.5, "2:30": 2.5, "1h30m": 1.5, "later": None, "2.5 hrs": 2.5, "45 minutes": 0.75, "-1": None}),
        (lambda c: dates.duration_in_hours(c, F.lit("Time taken (Minutes)")), {"45": 0.75, "90": 1.5, "1h30m": 1.5, "": None}),
        (lambda c: dates.duration_in_hours(c, F.lit("Hours admin")), {"45": 45.0}),
        (lambda c: text.status_from_answer(c, F.lit("Did I do?")), {"All": "Completed", "partly": "In Progress", "50%": "In Progress", "No": "Pending", "maybe": None}),
        (lambda c: text.status_from_answer(c, F.lit("Status")), {"All": None, "No": None}),
        (lambda c: text.normalize_status(c, text.STATUS_ALIASES), {"on hold": "Pending", "todo": "Pending", "N/A": "Cancelled", "100%": "Completed", "in-progress": "In Progress", "no": None, "stuck": "Blocked"}),
        (text.status_means_planned, {"Planned for Monday": True, "To be done": True, "done": False}),
        (text.status_is_ambiguous, {"Completed/Ongoing": True, "done and pending": True, "done": False, "a/b": False}),
        (text.decode_entities, {"a &amp; b": "a & b", "caf&#233; &#x263A; &#39;": "café ☺ '", "&#x1F600; &# &#;": "&#x1F600; &# &#;"}),
        (people.looks_like_person, {"Ada Lovelace": True, "O'Neil, Sam": False, "Hr Meeting": False, "Priya – Coordination": False, "Jean-Luc Picard": True, "Attendance Reports": False, "x" * 61: False, "": False}),
        (text.title_case, {"HEAD OF THE TEAM": "Head of the Team"}),
        (text.split_list, {"a, b;c |  ": ["a", "b", "c"], None: []}),
    ],
)
def test_cases(spark, use, cases):
    assert values(spark, use, cases) == list(cases.values())


def test_similarity(spark):
    rows = spark.createDataFrame([("checked the claims today", "claim checking"), ("wrote minutes", "called suppliers")], "a string, b string")
    tokens = lambda c: text.task_tokens(text.normalize_task(F.col(c)))
    assert [r[0] for r in rows.select(text.tasks_are_similar(tokens("a"), tokens("b"))).collect()] == [True, False]


def test_dates_and_hours_cut_their_text_once(spark):
    """A text is cut into numbers and names in one place of the expression, not in each that refers to them."""
    rows = spark.createDataFrame([("9 March 2026",)], "t string")
    for made in (dates.parse_date(F.col("t")), dates.parse_hours(F.col("t"))):
        plan = rows.select(made.alias("made"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("regexp_extract_all") == 1
    assert spark.createDataFrame([("",), (None,), (" ",)], "t string").select(dates.parse_date(F.col("t")).alias("d"), dates.parse_time(F.col("t")).alias("m"), dates.parse_hours(F.col("t")).alias("h")).distinct().collect() == [(None, None, None)]
