"""Full-text match and rank (FLT11, RT2, WN1) over tokens: runs of letters and digits in lower case.

The query syntax knows words (all must occur), ``or`` between words, ``-word`` (must not occur) and quoted phrases
(words in sequence). The score of a row is the sum of the occurrences of the wanted words divided by the row's tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import word_array

_WORD = re.compile(r"[^\W_]+")


@dataclass
class Query:
    """``groups``: alternatives of each wanted place (any of a group, all groups); ``phrases``; ``without``."""

    groups: list[list[str]] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    without: list[str] = field(default_factory=list)

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys([w for g in self.groups for w in g] + [w for p in self.phrases for w in p]))


def parse(text: str) -> Query:
    """Reads a query as a web search box does. An unclosed quote ends with the text."""
    out, joined = Query(), False
    for phrase, word in re.findall(r'"([^"]*)"?|(\S+)', text or ""):
        if phrase:
            own = _WORD.findall(phrase.lower())
            if own:
                out.phrases.append(own)
        elif word.lower() == "or":
            joined = bool(out.groups)
        elif word.startswith("-"):
            out.without += _WORD.findall(word.lower())
        else:
            for w in _WORD.findall(word.lower()):
                if joined:
                    out.groups[-1].append(w)
                else:
                    out.groups.append([w])
                joined = False
    return out


def matches(tokens: Column, query: Query) -> Column:
    """Whether a token array satisfies the query. An empty query is satisfied by nothing."""
    has = lambda w: F.array_contains(tokens, w)
    tests = []
    for group in query.groups:
        any_ = has(group[0])
        for w in group[1:]:
            any_ = any_ | has(w)
        tests.append(any_)
    padded = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    tests += [F.contains(padded, F.lit(" " + " ".join(p) + " ")) for p in query.phrases]
    if not tests:
        return F.lit(False)
    tests += [~has(w) for w in query.without]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def rank(df: DataFrame, text: str, query: str, k: int | None = None, key: str = "id") -> DataFrame:
    """Rows that match, with ``text_score``; the best k if asked, ties by key. Null and empty texts never match.

    A cheap substring test goes first, so only candidates are cut into tokens.
    """
    q = parse(query)
    if not q.words:
        return df.limit(0).withColumn("text_score", F.lit(0.0))
    low = F.lower(F.col(text))
    hint = None
    for group in q.groups + [[w] for p in q.phrases for w in p]:
        any_ = F.contains(low, F.lit(group[0]))
        for w in group[1:]:
            any_ = any_ | F.contains(low, F.lit(w))
        hint = any_ if hint is None else hint & any_
    found = df.filter(hint).withColumn("_tokens", word_array(F.col(text))).filter(matches(F.col("_tokens"), q))
    hits = F.size(F.filter("_tokens", lambda t: t.isin(q.words)))
    scored = found.withColumn("text_score", F.round(hits / F.size("_tokens"), 9)).drop("_tokens")
    return scored if k is None else scored.orderBy(F.desc("text_score"), key).limit(k)
