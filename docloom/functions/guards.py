"""Rule guards for queries and responses.

A pre-guard maps ``(query, domain)`` to ``(query, warnings)`` columns; a
post-guard maps ``(response, domain)`` to a response column. Lists of guards are
folded in order and callers may append their own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom import rules
from docloom.functions.arrays import let
from docloom.functions.text import jvm, rstrip, strip

PreGuard = Callable[[Column, Column], tuple[Column, Column]]
PostGuard = Callable[[Column, Column], Column]


def _warnings(*checks: tuple[Column, str]) -> Column:
    return F.filter(
        F.array(*[F.when(hit, F.lit(message)) for hit, message in checks]),
        lambda w: w.isNotNull(),
    )


def injection_message(pattern: str) -> str:
    shown = pattern[: rules.WARN_PATTERN_CHARS]
    return f"{rules.WARN_INJECTION_PREFIX}{shown}{rules.WARN_INJECTION_SUFFIX}"


def sanitise(query: Column, domain: Column) -> tuple[Column, Column]:
    """Flag long queries and injection patterns anywhere in the text, which is kept as it is."""
    checks = [(F.length(query) > rules.MAX_QUERY_CHARS, rules.WARN_LONG)]
    checks += [
        (query.rlike(jvm(p, "i")), injection_message(p)) for p in rules.INJECTION_PATTERNS
    ]
    return query, _warnings(*checks)


def asks_diagnosis(query: Column) -> Column:
    return query.rlike(jvm(rules.DIAGNOSIS_REQUEST, "i"))


def flag_diagnosis(query: Column, domain: Column) -> tuple[Column, Column]:
    hit = (domain == "medical") & asks_diagnosis(query)
    return query, _warnings((hit, rules.WARN_DIAGNOSIS))


PRE_GUARDS: list[PreGuard] = [sanitise, flag_diagnosis]


def apply_pre(
    query: Column, domain: Column, guards: Sequence[PreGuard] | None = None
) -> tuple[Column, Column]:
    """Clean query and all warnings in guard order."""
    found = []
    for guard in PRE_GUARDS if guards is None else guards:
        query, warnings = guard(query, domain)
        found.append(warnings)
    return query, F.concat(*found) if found else F.expr("cast(array() as array<string>)")


def replace_empty(response: Column, domain: Column) -> Column:
    empty = response.isNull() | (strip(response) == "")
    return F.when(empty, rules.EMPTY_RESPONSE).otherwise(response)


def _append_once(response: Column, text: str, separator: str) -> Column:
    present = F.contains(response, F.lit(text))
    return F.when(~present, F.concat(rstrip(response), F.lit(separator + text))).otherwise(response)


def forward_looking(response: Column, domain: Column) -> Column:
    trigger = F.lower(response).rlike("|".join(rules.FORWARD_LOOKING_TRIGGERS))
    return F.when(
        (domain == "financial") & trigger,
        F.concat(F.lit(rules.FORWARD_LOOKING_NOTICE), response),
    ).otherwise(response)


def crisis_referral(response: Column, domain: Column) -> Column:
    hit = (domain == "medical") & response.rlike(jvm(rules.SENSITIVE_TOPICS, "i"))
    added = _append_once(response, rules.CRISIS_REFERRAL, "\n\n")
    return F.when(hit, added).otherwise(response)


def prescribing_note(response: Column, domain: Column) -> Column:
    hit = (domain == "medical") & response.rlike(jvm(rules.DOSE, "i"))
    added = _append_once(response, rules.PRESCRIBING_NOTE, "\n\n")
    return F.when(hit, added).otherwise(response)


def disclaimer(response: Column, domain: Column) -> Column:
    """Medical and general footers; financial answers carry none."""
    rule = rules.DISCLAIMER_RULE
    medical = _append_once(response, rules.MEDICAL_DISCLAIMER, rule)
    general = _append_once(response, rules.GENERAL_DISCLAIMER, rule)
    return (
        F.when(domain == "medical", medical)
        .when(domain == "financial", response)
        .otherwise(general)
    )


POST_GUARDS: list[PostGuard] = [
    replace_empty,
    forward_looking,
    crisis_referral,
    prescribing_note,
    disclaimer,
]


def apply_post(
    response: Column, domain: Column, guards: Sequence[PostGuard] | None = None
) -> Column:
    """All guards in order, each looking at the previous one's result once."""
    return reduce(
        lambda text, guard: let(text, lambda t: guard(t, domain)),
        POST_GUARDS if guards is None else guards,
        response,
    )
