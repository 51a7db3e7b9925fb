"""Days and plans that the text around a report states.

A covering text is cut into words; what it states is told by neighbouring words. No pattern runs over the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import parse_date
from .text import let

# Words that a written date follows, words of days, and of work that is reported or ahead.
LEADS = ("for", "dated", "dt", "date", "of", "on")
DAYS = {"yesterday": -1, "today": 0}
WORK = ("work", "update", "report", "task", "tasks", "activity", "activities")
DATED_BEFORE = (("work", "done"), ("report", "for"), ("update", "for"))
PLANS = (("plan", "for", "tomorrow"), ("next", "day", "plan"), ("tomorrow", "plan"), ("tomorrow", "work"), ("tomorrow", "task"), ("tomorrow", "tasks"), ("upcoming", "work"), ("upcoming", "task"), ("upcoming", "tasks"))


def words_of(text: Column) -> Column:
    """The words of a text without the signs at their ends; a colon parts words."""
    parts = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit(":"), F.lit(" ")), r"\s+")
    return F.filter(F.transform(parts, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")


def plain(words: Column) -> Column:
    """Words in lower case, those of days without a possessive ending: today's and todays are today."""
    low = F.transform(words, lambda w: F.regexp_replace(F.lower(w), "['’]", ""))
    return F.transform(low, lambda w: F.when(w.isin("yesterdays", "todays", "tomorrows"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))


def has_phrase(words: Column, phrases: tuple[tuple[str, ...], ...]) -> Column:
    """Whether some phrase's words follow one another."""
    at = lambda i, k: F.get(words, i + k)

    def here(i: Column) -> Column:
        found = F.lit(False)
        for phrase in phrases:
            whole = F.lit(True)
            for k, word in enumerate(phrase):
                whole = whole & (at(i, F.lit(k)) == word)
            found = found | F.coalesce(whole, F.lit(False))
        return found

    return F.exists(F.sequence(F.lit(0), F.size(words)), here)


def day_phrases(day: str) -> tuple[tuple[str, ...], ...]:
    """Ways to speak of a day's work: the day before a word of work, or after words that are followed by a day."""
    return tuple((day, w) for w in WORK) + tuple((*before, day) for before in DATED_BEFORE)


def written_day(words: Column, order: str) -> Column:
    """The first date that follows a leading word: one word of numbers with signs between them, or a day, month and year
    in three words."""
    word = lambda i, k: F.get(words, i + F.lit(k))

    def after(i: Column) -> Column:
        one, three = word(i, 1), F.concat(word(i, 1), F.lit(" "), word(i, 2), F.lit(" "), word(i, 3))
        return F.when(one.rlike(r"^\d+[-/]"), one).when(one.rlike(r"^\d{1,2}$"), three)

    places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: word(i, 0).isin(*LEADS))
    days = F.transform(F.filter(F.transform(places, after), lambda d: d.isNotNull()), lambda d: parse_date(d, order))
    return F.get(F.filter(days, lambda d: d.isNotNull()), F.lit(0))


def stated_day(text: Column, received: Column, order: str = "DMY") -> Column:
    """(date, basis) that a text states: a date written out, else yesterday's or today's work; null if neither. Tomorrow's
    plan is no day of work."""

    def relative(words: Column) -> Column:
        found = None
        for day, offset in DAYS.items():
            here = has_phrase(words, day_phrases(day))
            found = F.when(here, F.lit(offset)) if found is None else found.when(here, F.lit(offset))
        return found

    def stated(words: Column) -> Column:
        near = F.date_add(received, let(plain(words), relative))
        told = lambda day, basis: F.when(day.isNotNull(), F.struct(day.alias("date"), F.lit(basis).alias("basis")))
        return F.coalesce(let(written_day(words, order), lambda d: told(d, "stated")), let(near, lambda d: told(d, "relative")))

    return let(words_of(text), stated)


def report_day(body: Column, subject: Column, received: Column, order: str = "DMY") -> Column:
    """(date, basis) of a report whose rows have none: what the body states, else the subject; never the day it arrived
    by itself."""
    received = received.cast("date")
    return F.when(received.isNotNull(), F.coalesce(stated_day(body, received, order), stated_day(subject, received, order)))


def day_of_title(title: Column) -> Column:
    """The first date within a title line: 30 August 2026, August 30, 2026 or 2026-08-30."""

    def first(words: Column) -> Column:
        word = lambda i, k: F.get(words, i + F.lit(k))
        three = lambda i: F.concat(word(i, 0), F.lit(" "), word(i, 1), F.lit(" "), word(i, 2))
        letters = lambda i: sum((F.coalesce(word(i, k).rlike(r"^\p{L}"), F.lit(False)).cast("int") for k in range(3)), F.lit(0))
        shaped = lambda i: F.when(word(i, 0).rlike(r"^\d{4}-"), word(i, 0)).when(letters(i) == 1, three(i))
        given = F.filter(F.transform(F.sequence(F.lit(0), F.size(words)), shaped), lambda t: t.isNotNull())
        return F.get(F.filter(F.transform(given, lambda t: parse_date(t)), lambda d: d.isNotNull()), F.lit(0))

    return let(words_of(title), first)


def looks_planned(text: Column) -> Column:
    """Whether a text speaks of work that is still ahead."""
    return let(plain(words_of(text)), lambda words: has_phrase(words, PLANS))


def too_far_ahead(day: Column, today: Column, most: int = 2) -> Column:
    return F.datediff(day, today) > most


def shown_in_zone(stamp: Column, zone: str, pattern: str = "d MMM yyyy, HH:mm") -> Column:
    return F.date_format(F.from_utc_timestamp(stamp, zone), pattern)
