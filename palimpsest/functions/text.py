"""Text expressions: tokens, concepts, n-grams, question features."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed value: what a token is
TOKEN = "[a-zA-Z0-9_-]+"

#: fixed values: words that say nothing about a subject
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "by", "current", "did", "do", "does", "for", "from", "has", "have", "how", "in", "is", "it",
    "latest", "of", "on", "or", "the", "to", "was", "what", "when", "where", "which", "who", "why", "with",
)

#: fixed values: words and the concept that stands for them
CONCEPTS = {
    "launch": "release", "released": "release", "launching": "release",
    "deadline": "due", "due": "due", "target": "due",
    "delayed": "delay", "slipped": "delay", "slip": "delay", "late": "delay",
    "vendor": "supplier", "supplier": "supplier",
    "certification": "approval", "certified": "approval", "approval": "approval",
    "moved": "changed", "changed": "changed", "revised": "changed",
    "wrong": "correction", "incorrect": "correction", "correction": "correction",
    "reports": "report", "reported": "report", "says": "report",
    "depends": "dependency", "dependency": "dependency",
}
#: fixed value: tokens that name an entity
ENTITY = r"^(?:project|company|person|service|vendor|target|distractor|alias)[-_].+|^[a-z]+-\d{3,}$"

#: fixed values: phrases that name a predicate
PHRASES = {
    "deadline": ("deadline", "due date", "due", "target date"),
    "project_status": ("project status", "status"),
    "works_at": ("works at", "employer", "employment"),
    "lives_in": ("lives in", "resides in", "residence"),
    "depends_on": ("depends on", "dependency", "dependencies"),
    "approved": ("approved", "approver", "approval"),
    "value": ("value", "amount"),
}
#: fixed values: substrings that name an intent, in order
INTENTS = (
    ("provenance", ("why do", "evidence", "source", "support")),
    ("relation_classification", ("correction", "corrected", "wrong", "superseded", "moved from", "changed from")),
    ("historical", ("as of", "previous", "earlier", "before", "historical")),
)


def tokens(text: Column) -> Column:
    """Lower-cased ASCII tokens in order; null text has none."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), F.lower)


def lexical(text: Column) -> Column:
    """Tokens without stop words."""
    return F.filter(tokens(text), lambda t: ~t.isin(*STOP))


def concepts(text: Column) -> Column:
    """Tokens without entity names, synonyms replaced."""
    table = F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair])
    # an entity has one of two marks; few words do, and only those meet the pattern
    kept = F.filter(tokens(text), lambda t: ~((t.contains("-") | t.contains("_")) & t.rlike(ENTITY)))
    return F.transform(kept, lambda t: F.coalesce(F.element_at(table, t), t))


def terms(words: Column) -> Column:
    """Words and pairs of neighbouring words. The words are bound to a name first: what they are made of is not
    evaluated again each time that they are mentioned."""

    def both(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        return F.concat(w, pairs)

    return F.transform(F.array(words), lambda w: both(w))[0]


def grams(token: Column, n: int = 4) -> Column:
    """Character n-grams; a shorter token stands for itself."""
    return F.when(F.length(token) <= n, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.length(token) - (n - 1)), lambda i: F.substring(token, i, F.lit(n))))


def fragments(token: Column) -> Column:
    return F.filter(F.split(token, "[-_]+"), lambda x: F.length(x) >= 3)


def intent(text: Column) -> Column:
    low, out = F.lower(text), F
    for name, cues in INTENTS:
        test = F.lit(False)
        for cue in cues:
            test = test | low.contains(cue)
        out = out.when(test, name)
    return out.otherwise("current")


def predicate(text: Column) -> Column:
    """The predicate with the longest phrase in the text; null if none, or if two have equally long ones. Lengths are
    tried from the longest, so that each phrase is looked for once or twice."""
    low, out = F.lower(text), F
    for n in sorted({len(p) for phrases in PHRASES.values() for p in phrases}, reverse=True):
        hits = {}
        for name, phrases in PHRASES.items():
            for p in (x for x in phrases if len(x) == n):
                hits[name] = hits[name] | low.contains(p) if name in hits else low.contains(p)
        for name, hit in hits.items():
            others = [h for x, h in hits.items() if x != name]
            tied = reduce(or_, others) if others else F.lit(False)
            out = out.when(hit, F.when(~tied, name))
    return out.otherwise(None)


def number_after(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("long")


def valid_time(text: Column) -> Column:
    """The day that the text names (a fixed pattern)."""
    return number_after(text, r"(?i)\b(?:as\s+of\s+)?day\s+(\d+)\b")


def recorded_seq(text: Column) -> Column:
    """The sequence number that the text names (a fixed pattern)."""
    return number_after(text, r"(?i)\b(?:record(?:ed)?(?:\s+sequence|\s+seq)?|seq)\s+(\d+)\b")
