"""Tokens, keywords, patterns and likeness of texts as column expressions."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOPWORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "her", "was", "one", "our", "out", "day", "get", "has", "him", "his", "how",
    "man", "new", "now", "old", "see", "two", "way", "who", "boy", "did", "its", "let", "put", "say", "she", "too", "use", "this", "that", "with",
    "have", "from", "they", "been", "will", "more", "when", "your", "said", "each", "which", "their", "there", "would", "about", "could", "other",
)

# Error types by name.
ERROR_TYPES = (
    "AttributeError", "TypeError", "ValueError", "KeyError", "IndexError", "ImportError",
    "ModuleNotFoundError", "NameError", "SyntaxError", "AssertionError", "RuntimeError", "RecursionError",
)

# Tags and the patterns that earn them.
TAG_PATTERNS = {
    "regression": "regress", "crash": "crash|segfault|core dump", "hang": "hang|infinite loop|deadlock",
    "wrong_result": "wrong|incorrect|unexpected result", "missing_feature": "missing|not supported|not implemented",
    "deprecation": "deprecat", "performance": "slow|performance|timeout", "compatibility": "compat|backward|breaking change",
    "documentation": "doc|docstring|help text",
}

# Issue types and the words that show them.
ISSUE_WORDS = {"crash": ["crash"], "hang": ["hang", "freeze"], "memory_issue": ["memory", "leak"], "performance": ["performance", "slow"], "regression": ["regression"]}

# The direction of a change, the first that matches.
DIRECTIONS = {
    "fixed": "fix(ed)?|修复了?|解决了?|resolved?",
    "broken": "crash|崩溃|broken|fail(ed)?|挂了|oom|死",
    "degraded": "降|掉|跌|下降|drop|decrease|fell|degrad|worse|lower|crash|fail|broken|挂|崩|报错|error|exception",
    "improved": "升|提升|涨|提高|improve|increase|better|higher|faster|fix|修复|解决|resolve|pass|成功|green",
}

# The patterns of versions, files, numbers with units, modules and connectives.
VERSION = r"v?([0-9]+\.[0-9]+(?:\.[0-9]+)?)"
FILE = r"[A-Za-z0-9_/]+\.(?:py|js|ts|java|cpp|c|h|go|rs)"
NUMBER_UNIT = r"([0-9.]+)\s*(%|px|ms|s|fps|MB|GB|KB|hz|Hz)"
MODULE = r"(?:(?:[A-Za-z0-9_-]+/)+[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+|(?:[A-Za-z0-9_-]+\.){1,5}[A-Za-z0-9_-]+(?:\.(?:ts|js|py|rs|go|java|c|cpp|h|hpp))?)"
CAUSE_EFFECT = r"(?i)[，,]\s*(?:导致|结果|然后|之后|后来|所以|因此|hence|then|so|resulting|caused|led\s+to|→|->)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters, digits and _ (ASCII) of more than two characters, in order."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9_]+", " "))
    return F.filter(F.split(low, " "), lambda w: F.length(w) > 2)


def keywords(text: Column) -> Column:
    """The tokens that are no stop words, repeated as they come."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(tokens(text), lambda w: ~F.array_contains(stop, w))


def canonical(text: Column) -> Column:
    """Sorted lower-case tokens, CJK kept, repeats kept: the key under which contents count as equal."""
    low = F.regexp_replace(F.lower(text), "[^a-z0-9_一-龥]+", " ")
    return F.array_join(F.array_sort(F.filter(F.split(low, " "), lambda w: F.length(w) > 0)), " ")


def matching(text: Column, patterns: dict[str, str]) -> Column:
    """The names whose pattern occurs in the lower-case text."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(k)) for k, p in patterns.items()]))


def first_matching(text: Column, patterns: dict[str, str], other: str) -> Column:
    low, out = F.lower(text), None
    for k, p in patterns.items():
        out = F.when(low.rlike(p), k) if out is None else out.when(low.rlike(p), k)
    return out.otherwise(other)


def issue_types(text: Column) -> Column:
    low = F.lower(text)
    cond = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return F.array_compact(F.array(*[F.when(cond(ws), F.lit(k)) for k, ws in ISSUE_WORDS.items()]))


def error_patterns(text: Column) -> Column:
    """error_type:…, then the sorted file_ext:…, has_test and has_failure."""
    kinds = [F.when(text.contains(t), F.lit(f"error_type:{t}")) for t in ERROR_TYPES]
    exts = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\.(py|js|ts|java|cpp|go|rs|rb)\b"), F.lit(1)), lambda e: F.concat(F.lit("file_ext:"), e))))
    low = F.lower(text)
    tests = F.when(low.rlike(r"\btest[_\s]"), F.lit("has_test"))
    fails = F.when(low.rlike(r"\bfail(ed|ing)?\b"), F.lit("has_failure"))
    return F.concat(F.array_compact(F.array(*kinds)), exts, F.array_compact(F.array(tests, fails)))


def edit_ratio(a: Column, b: Column) -> Column:
    """Likeness 0 to 100 by edit distance; 100 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.round((1 - F.levenshtein(a, b) / longest) * 100)).otherwise(F.lit(100.0))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best edit ratio among the common tokens and either text's tokens, all sorted."""
    ta, tb = (F.array_sort(F.array_distinct(tokens(x))) for x in (a, b))
    both = F.array_join(F.array_sort(F.array_intersect(ta, tb)), " ")
    wa, wb = (F.trim(F.concat_ws(" ", both, F.array_join(F.array_sort(F.array_except(x, y)), " "))) for x, y in ((ta, tb), (tb, ta)))
    return F.greatest(edit_ratio(both, wa), edit_ratio(both, wb), edit_ratio(wa, wb))


def partial_ratio(short: Column, long: Column) -> Column:
    """The best edit ratio of short against all equally long pieces of long."""
    a = F.when(F.length(short) <= F.length(long), short).otherwise(long)
    b = F.when(F.length(short) <= F.length(long), long).otherwise(short)
    starts = F.sequence(F.lit(1), F.length(b) - F.length(a) + 1)
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 100.0).otherwise(0.0)).otherwise(F.array_max(F.transform(starts, lambda i: edit_ratio(a, b.substr(i, F.length(a))))))


def token_jaccard(a: Column, b: Column) -> Column:
    """Common tokens in percent of all, rounded."""
    ta, tb = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    union = F.size(F.array_union(ta, tb))
    return F.when(union > 0, F.round(F.size(F.array_intersect(ta, tb)) / union * 100)).otherwise(F.lit(0.0))


def cause_and_effect(text: Column) -> tuple[Column, Column]:
    """What stands before and after the connectives of a text, else its commas; the text for both if it has neither."""
    a = F.split(text, CAUSE_EFFECT)
    b = F.filter(F.split(text, r"[，,；;]\s*"), lambda x: F.length(F.trim(x)) > 0)
    rest = lambda x: F.trim(F.array_join(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), "，"))
    first = F.when(F.size(a) >= 2, F.trim(F.get(a, F.lit(0)))).when(F.size(b) >= 2, F.trim(F.get(b, F.lit(0)))).otherwise(text)
    return first, F.when(F.size(a) >= 2, rest(a)).when(F.size(b) >= 2, rest(b)).otherwise(text)


def magnitude(text: Column) -> Column:
    """struct(from_, to_, unit): the first two numbers with a unit, one of them, or the first two without."""
    number = lambda x: F.regexp_extract(x, r"[0-9]*\.?[0-9]*", 0).try_cast("double")
    u, k = (F.regexp_extract_all(text, F.lit(NUMBER_UNIT), F.lit(i)) for i in (1, 2))
    n = F.regexp_extract_all(text, F.lit("[0-9.]+"), F.lit(0))
    at = lambda c, i: F.get(c, F.lit(i))
    low = F.when(F.size(u) >= 2, number(at(u, 0))).when((F.size(u) == 0) & (F.size(n) >= 2), number(at(n, 0)))
    to = F.when(F.size(u) >= 2, number(at(u, 1))).when(F.size(u) == 1, number(at(u, 0))).when(F.size(n) >= 2, number(at(n, 1))).otherwise(number(at(n, 0)))
    unit = F.when(F.size(u) >= 2, at(k, 1)).when(F.size(u) == 1, at(k, 0))
    return F.struct(low.alias("from_"), to.alias("to_"), unit.alias("unit"))


def module(text: Column) -> Column:
    """The first path or dotted name of more than three characters that is no number; null if there is none."""
    found = F.regexp_extract_all(text, F.lit(MODULE), F.lit(0))
    return F.get(F.filter(found, lambda m: (F.length(m) > 3) & ~m.rlike(r"\A[0-9]+\.[0-9]+\z")), F.lit(0))


def fuzzy_score(query: Column, text: Column, token_set: float = 1.5, partial: float = 1.0) -> Column:
    """0 to 100: 100 for the query itself, 90 where it is contained, else the better of both likenesses by their weights."""
    q, t = F.lower(query), F.lower(text)
    best = F.greatest(token_set * token_set_ratio(q, t), partial * partial_ratio(q, t)) / max(token_set, partial)
    return F.when(t == q, 100.0).when(t.contains(q), 90.0).otherwise(F.round(F.least(F.lit(100.0), best)))


def packed(text: str, size: int = 200) -> list[tuple[int, str]]:
    """(start, chunk): the sentences of each paragraph put together until they have `size` characters; chunks of up to ten characters are left out."""
    out, at = [], 0
    for para in re.split(r"(\n{2,})", text):
        if re.fullmatch(r"\n{2,}", para):
            at += len(para)
            continue
        start, end = at, at
        for sentence in re.finditer(r".*?(?:[。！？.!?]\s*|\Z)", para, re.S):
            end = at + sentence.end()
            if end - start >= size:
                out.append((start, text[start:end]))
                start = end
        if end > start:
            out.append((start, text[start:end]))
        at += len(para)
    return [(s + len(c) - len(c.lstrip()), c.strip()) for s, c in out if len(c.strip()) > 10]


def packed_rows(batches):
    """packed() of the texts of (doc_id, text) frames."""
    for pdf in batches:
        rows = [(doc, i, start, len(c), hashlib.md5(c.encode()).hexdigest()) for doc, text in zip(pdf.doc_id, pdf.text, strict=True) for i, (start, c) in enumerate(packed(text))]
        yield pd.DataFrame(rows, columns=["doc_id", "chunk", "start", "size", "text_md5"])
