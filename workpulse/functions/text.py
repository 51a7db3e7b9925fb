"""Text expressions, Column to Column, kept inside code generation."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a task.
TASK_STOPWORDS = (
    "the", "a", "an", "of", "for", "to", "and", "on", "in", "at", "with", "today", "todays", "daily", "pls", "please", "done",
)
# The statuses a task can have.
STATUSES = ("Completed", "Pending", "In Progress", "Blocked", "Cancelled", "Not Started")
# Other words for a status.
STATUS_ALIASES = {
    "completed": "Completed", "complete": "Completed", "done": "Completed", "finished": "Completed", "closed": "Completed", "delivered": "Completed",
    "completd": "Completed", "compeleted": "Completed", "yes": "Completed", "ok": "Completed", "over": "Completed", "100%": "Completed", "c": "Completed",
    "in progress": "In Progress", "inprogress": "In Progress", "in-progress": "In Progress", "progress": "In Progress", "ongoing": "In Progress", "wip": "In Progress",
    "working": "In Progress", "started": "In Progress", "doing": "In Progress", "partially done": "In Progress", "partial": "In Progress", "ip": "In Progress",
    "in review": "In Progress", "under review": "In Progress", "reviewing": "In Progress", "for review": "In Progress", "in testing": "In Progress", "in qa": "In Progress",
    "pending": "Pending", "waiting": "Pending", "not done": "Pending", "incomplete": "Pending", "open": "Pending", "todo": "Pending", "to do": "Pending", "hold": "Pending", "on hold": "Pending", "p": "Pending",
    "blocked": "Blocked", "stuck": "Blocked", "blocker": "Blocked", "dependency": "Blocked", "waiting on client": "Blocked", "awaiting approval": "Blocked",
    "not started": "Not Started", "notstarted": "Not Started", "new": "Not Started", "yet to start": "Not Started", "not yet started": "Not Started", "ns": "Not Started",
    "cancelled": "Cancelled", "canceled": "Cancelled", "dropped": "Cancelled", "not required": "Cancelled", "na": "Cancelled", "n/a": "Cancelled",
}
# What answers a status column that is a question means.
ANSWERS = {
    "Completed": r"(?i)^(all|all done|yes|y|fully|full|done|completed?|100 ?%)$",
    "In Progress": r"(?i)^(partial|partially|partly|part|half|some|mostly|in part|\d{1,2} ?%)$",
    "Pending": r"(?i)^(no|n|none|nothing|not done|not at all|zero|0 ?%)$",
}
# Named character references that are decoded.
_ENTITIES = (
    ("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("apos", "'"),
    ("mdash", "—"), ("ndash", "–"), ("hellip", "..."),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_whitespace(c: Column) -> Column:
    c = F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"[\r\n\t]+", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s{2,}", " "))


def decode_entities(c: Column) -> Column:
    """Named references, and numeric ones (decimal and hexadecimal) of the basic plane; others stay as they are. Most texts
    hold none, and aren't searched for them."""
    return F.when(F.contains(c, F.lit("&")), let(c, _decoded)).otherwise(c)


def _decoded(c: Column) -> Column:
    for name, value in _ENTITIES:
        c = F.regexp_replace(c, f"(?i)&{name};", value)

    def decoded(part: Column) -> Column:
        code = F.regexp_extract(part, r"^([xX][0-9a-fA-F]{1,4}|\d{1,5});", 1)
        number = F.when(F.lower(F.substring(code, 1, 1)) == "x", F.conv(F.substring(code, F.lit(2), F.length(code)), 16, 10)).otherwise(code).try_cast("int")
        sign = F.decode(F.unhex(F.lpad(F.hex(number), 4, "0")), "UTF-16BE")
        return F.when(number.between(1, 0xFFFF) & ~number.between(0xD800, 0xDFFF), F.concat(sign, F.substring(part, F.length(code) + 2, F.length(part)))).otherwise(F.concat(F.lit("&#"), part))

    rest = lambda parts: F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
    return let(F.split(c, "&#"), lambda parts: F.concat(F.get(parts, F.lit(0)), F.array_join(rest(parts), "")))


def keyify(c: Column) -> Column:
    """The lower-case, punctuation-free key of every lookup. Most texts are their own key, but for capitals."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike(r"^[a-z0-9]+(?: [a-z0-9]+)*\z"), low).otherwise(_keyified(c))


def _keyified(c: Column) -> Column:
    c = F.lower(clean_whitespace(decode_entities(F.coalesce(c, F.lit("")))))
    c = F.regexp_replace(F.regexp_replace(c, "[.’']", ""), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(c, " {2,}", " "))


def normalize_task(c: Column) -> Column:
    """A task's wording without links, punctuation and short numbers; plain words stay as they are."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.rlike(r"^[a-z]+(?: [a-z]+)*\z"), low).otherwise(_normalized_task(c))


def _normalized_task(c: Column) -> Column:
    c = F.lower(clean_whitespace(decode_entities(F.coalesce(c, F.lit("")))))
    c = F.regexp_replace(F.regexp_replace(c, r"https?://\S+", " "), "[‘’“”]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9%\s]+", " "), r"\b\d{1,4}\b", " ")
    return F.trim(F.regexp_replace(c, r"\s{2,}", " "))


def split_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;|]"), lambda x: F.trim(x)), lambda x: x != "")


def stem_token(t: Column) -> Column:
    """Folds plural, -ed and -ing endings of words of five letters and more, and a final e."""
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    single = lambda b: F.when((F.length(b) > 3) & (F.right(b, F.lit(1)) == F.substring(b, -2, 1)), F.substring(b, F.lit(1), F.length(b) - 1)).otherwise(b)
    base = (
        F.when(t.endswith("ing") & (n > 5), single(cut(3)))
        .when(t.endswith("ies") & (n > 5), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("ed") & (n > 4), single(cut(2)))
        .when(t.endswith("es") & (n > 4), cut(2))
        .when(t.endswith("s") & (n > 4), cut(1))
        .otherwise(t)
    )
    folded = F.when((F.length(base) > 3) & base.endswith("e"), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(base)
    return F.when(n <= 4, t).otherwise(folded)


def task_tokens(normalized: Column) -> Column:
    """Stemmed words that mean something, sorted, each once."""
    stop = F.array(*map(F.lit, TASK_STOPWORDS))
    words = F.filter(F.split(normalized, " "), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, stem_token), lambda w: (w != "") & ~F.array_contains(stop, w))))


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / F.size(F.array_union(a, b)))


def token_containment(a: Column, b: Column) -> Column:
    """Whether all tokens of the shorter, two at least, are in the longer, which has two more at most."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (low >= 2) & (high - low <= 2) & (F.size(F.array_intersect(a, b)) == low)


def tasks_are_similar(a: Column, b: Column, threshold: float = 0.88) -> Column:
    return (token_similarity(a, b) >= threshold) | token_containment(a, b)


def title_case(c: Column) -> Column:
    """Capital initials, but for small words inside."""
    c = F.initcap(F.lower(c))
    for word in ("Of", "And", "The", "To", "For"):
        c = F.regexp_replace(c, rf"(?<!^)\b{word}\b", word.lower())
    return c


def normalize_status(c: Column, aliases: dict[str, str]) -> Column:
    """A status by its name or an alias, with or without words such as "task" around it; null if unknown."""
    known = {s.lower(): s for s in STATUSES} | {re.sub("[^a-z0-9]+", " ", k.lower().replace(".", "").replace("'", "")).strip(): v for k, v in aliases.items()}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    bare = lambda key: F.trim(F.regexp_replace(F.regexp_replace(key, r"\b(task|status|is|was)\b", ""), r"\s{2,}", " "))
    return let(keyify(c), lambda key: F.coalesce(F.try_element_at(table, key), F.try_element_at(table, bare(key))))


def status_from_answer(answer: Column, heading: Column) -> Column:
    """A status from an answer under a heading that asks whether the work was done; null under other headings."""
    asked = clean_whitespace(F.coalesce(heading, F.lit(""))).rlike(r"(?i)^(did|have|has|was|is)\b.*\b(do|done|it|complete|completed|finish|finished)\b")
    said = clean_whitespace(answer)
    return F.when(asked, F.coalesce(*(F.when(said.rlike(pattern), status) for status, pattern in ANSWERS.items())))


def status_means_planned(c: Column) -> Column:
    """Whether a status places the work in the future."""
    return F.trim(c).rlike(r"(?i)^(planned|planned work|to ?be ?started|to ?be ?done|scheduled|upcoming|next ?day|tomorrow|future|yet to begin)\b")


def status_is_ambiguous(c: Column) -> Column:
    """Whether a status cell names two states at once."""
    parts = F.split(F.trim(c), r"(?i)\s*[/|,]\s*|\s+(?:or|and|then)\s+")
    return F.size(F.filter(parts, lambda p: p.rlike("(?i)(complete|done|finish|progress|ongoing|pending|blocked|hold|start|cancel|review)"))) >= 2


def normalize_priority(c: Column) -> Column:
    key = keyify(c)
    return (
        F.when(key.rlike("^(urgent|critical|highest|p0|p1|high)"), "High")
        .when(key.rlike("^(medium|normal|moderate|p2)"), "Medium")
        .when(key.rlike("^(low|minor|p3|p4)"), "Low")
    )


def sender_address(c: Column) -> Column:
    inside = F.regexp_extract(c, "<([^>]+)>", 1)
    return F.lower(F.trim(F.when(inside != "", inside).otherwise(c)))


def sender_domain(c: Column) -> Column:
    return F.coalesce(F.get(F.split(sender_address(c), "@"), F.lit(1)), F.lit(""))


def short_hash(c: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, n)


def fingerprint(*parts: Column) -> Column:
    return short_hash(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 40)
