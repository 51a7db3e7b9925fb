"""Names of people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_whitespace, keyify

# Words that name work, teams or documents rather than people; their plurals follow by rule.
WORK_WORDS = (
    "meeting", "monitoring", "team", "building", "calendar", "event", "plan", "planning", "interview", "induction", "management", "support",
    "coordination", "update", "report", "reporting", "review", "training", "engagement", "communication", "recruitment", "attendance", "capability",
    "process", "project", "task", "work", "follow", "followup", "documentation", "document", "asset", "details", "form", "register", "leave", "hr", "qa",
    "sop", "testing", "test", "ticket", "defect", "deployment", "fixed", "fix", "resolved", "developed", "implemented", "discussed", "performed",
    "worked", "continued", "completed", "call", "email", "mail", "data", "entry", "sheet", "content", "design", "designing", "creation", "create",
    "created", "preparation", "prepare", "prepared", "onboarding", "payroll", "audit", "compliance", "policy", "vendor", "client", "campaign", "post",
    "blog", "video", "social", "media", "website", "app", "application", "server", "bug", "feature", "module", "dashboard", "analysis", "research",
    "session", "workshop", "presentation", "marketing", "sales", "operations", "admin", "office", "biometric", "medical", "fitness", "directory",
    "official", "acknowledgement", "absence", "compensatory", "record", "priority", "internal", "external", "day", "week", "weekly", "daily", "monthly",
    "round", "department", "development", "relations", "relationship", "employee", "staff", "candidate", "hiring", "salary", "invoice", "order",
    "account", "finance", "budget", "approval", "upload", "download", "backup", "maintenance", "installation", "setup", "config", "configuration",
    "issue", "query", "feedback", "survey", "brochure", "banner", "logo", "creative", "script", "course", "lesson", "quiz", "assessment", "drive",
    "visit", "pending", "progress", "status", "adhoc", "misc", "miscellaneous", "general", "other", "total", "summary", "na", "none", "all", "yes", "no",
    "unassigned", "unknown", "panel", "group", "today", "dubai", "delhi", "noida", "india", "indian", "uae", "mumbai", "pune", "bengaluru", "bangalore",
    "gurgaon", "gurugram", "hyderabad", "chennai", "kolkata", "sharjah", "london", "france", "resource", "human", "travel", "reimbursement", "welcome",
    "kit", "letter", "response", "cv", "database", "chart", "organisational", "organizational", "organisation", "organization", "welfare", "committee",
    "confirmation", "gmail", "birthday", "poster", "celebration", "probation", "tracking", "tracker", "menu", "invitation", "agenda", "signature",
    "payment", "stipend", "visa", "permit", "insurance", "handbook", "newsletter", "magazine", "internship", "certificate", "completion", "system",
    "access", "joiner", "intern",
)
# Words that join a phrase, not a name.
CONNECTORS = ("with", "for", "the", "to", "of", "on", "in", "at", "from", "and", "by", "about", "into", "via", "per")


def looks_like_person(c: Column) -> Column:
    """One to four words of letters, without digits, marks of phrases, or words that name work."""
    name = clean_whitespace(F.coalesce(c, F.lit("")))
    shape = name.rlike(r"^[A-Za-z][A-Za-z.'’-]*( [A-Za-z][A-Za-z.'’-]*){0,3}$") & (F.length(name) <= 60) & ~name.rlike(r"\s-\s|^-|-$")
    keys = F.filter(F.split(keyify(name), " "), lambda k: k != "")
    cut = lambda k, n: F.substring(k, F.lit(1), F.length(k) - n)
    single = F.transform(keys, lambda k: F.when(k.endswith("ies"), F.concat(cut(k, 3), F.lit("y"))).when(k.endswith("sses") | k.endswith("ches") | k.endswith("xes"), cut(k, 2)).when(k.endswith("s"), cut(k, 1)).otherwise(k))
    plain = lambda k: k.isin(*WORK_WORDS, *CONNECTORS)
    return shape & (F.size(keys) > 0) & ~F.exists(keys, plain) & ~F.exists(single, plain)


def shaped_like_name(c: Column) -> Column:
    """Two to four capitalised words that could be a person's name."""
    return c.rlike(r"^[A-Z][a-z'’-]+([ ,]+[A-Z][a-z'’.-]+){1,3}$") & looks_like_person(c)
