"""Deflection gate: does a reply dodge the question? Pattern lists are plain data and can be replaced."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from convqa.functions.text import col, strip

# Pattern lists and the length of text that counts as an answer.
NO_INFO_AR = (
    r"(ما عندي|معنديش|ما عنديش|ما قدرت (ألاقي|القى|لاقي)|ما لقيت|"
    r"مش (متوفر|متوفرة)( (عندي|هاي))?|ما بتحدد|ما بتوضح|ما بتشرح|ما بتحدّد)"
    r".{0,40}(معلوم|تفصيل|تفاصيل|بيانات|قائمة)",
    r"(معلوم|تفصيل|تفاصيل|بيانات|قائمة).{0,40}(ما بتحدد|ما بتوضح|ما بتشرح|ما بتحدّد|ما عندي)",
    r"للأسف.{0,60}(ما عندي|ما بتحدد|ما بتوضح|ما بتشرح|مش متوفر)",
)
HAND_OFF_AR = (
    r"أوصلك (على|ب)?\s*موظف",
    r"موظف مختص",
    r"تحويلك ل(موظف|فرع|قسم)",
    r"الجواب الأكيد",
    r"بقدر أساعدك بالمعلومات اللي عندي",
)
NO_INFO_EN = (
    r"(i'?m sorry|i apologize)?,?\s*(but\s+)?(i (don'?t|do not) have|i couldn'?t find)\s+"
    r"(a|an|any)?\s*(specific|particular|exact|complete)?\s*"
    r"(information|info|details?|list)\s+(in my records\s*)?(regarding|about|on|of)",
)
HAND_OFF_EN = (
    r"connect you (with|to) (an?|a) (agent|specialist|representative|human)",
    r"transfer you\s+to\s+(a|an)\s+(agent|representative|specialist)",
    r"reach out to\s+(our|a)\s+(support|specialist)\s+team",
    r"speak\s+(with|to)\s+a\s+(representative|specialist|human)",
    r"that(?:'s| is)\s+beyond\s+(my|the)\s+(scope|knowledge|capability)",
    r"i'?m\s+unable\s+to\s+answer",
    r"i\s+cannot\s+(provide|answer|help\s+with)\s+that",
)
MIN_SUBSTANCE_CHARS = 40


@dataclass(frozen=True)
class Patterns:
    """``no_info`` dodges wherever it occurs; ``hand_off`` only when little text stands before it."""

    no_info: tuple[str, ...]
    hand_off: tuple[str, ...]


DEFAULT_PATTERNS = {"ar": Patterns(NO_INFO_AR, HAND_OFF_AR), "en": Patterns(NO_INFO_EN, HAND_OFF_EN)}
OTHER = "en"


def _no_info_hit(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?isU)(?:{pattern})")


def _hand_off_hit(text: Column, pattern: str) -> Column:
    before = F.regexp_extract(text, f"(?isU)^(.*?)(?:{pattern})", 1)
    return text.rlike(f"(?isU)(?:{pattern})") & (F.length(strip(before)) < MIN_SUBSTANCE_CHARS)


def _any(tests: list[Column]) -> Column:
    result = F.lit(False)
    for test in tests:
        result = result | test
    return result


def _for_language(text: Column, patterns: Patterns) -> Column:
    return _any([_no_info_hit(text, p) for p in patterns.no_info] + [_hand_off_hit(text, p) for p in patterns.hand_off])


def is_deflection(text: str | Column, language: str | Column, patterns: dict[str, Patterns] = DEFAULT_PATTERNS) -> Column:
    """True when the reply gives no answer. Languages without a list use the ``en`` list."""
    reply = strip(F.coalesce(col(text), F.lit("")))
    result = _for_language(reply, patterns[OTHER])
    for lang, lists in patterns.items():
        if lang != OTHER:
            result = F.when(col(language) == lang, _for_language(reply, lists)).otherwise(result)
    return result


def fired_pattern(text: str | Column, language: str | Column, patterns: dict[str, Patterns] = DEFAULT_PATTERNS) -> Column:
    """The first pattern that made the reply a deflection, null for a real answer."""
    reply = strip(F.coalesce(col(text), F.lit("")))

    def first(lists: Patterns) -> Column:
        hits = [F.when(_no_info_hit(reply, p), F.lit(p)) for p in lists.no_info]
        hits += [F.when(_hand_off_hit(reply, p), F.lit(p)) for p in lists.hand_off]
        return F.coalesce(*hits)

    result = first(patterns[OTHER])
    for lang, lists in patterns.items():
        if lang != OTHER:
            result = F.when(col(language) == lang, first(lists)).otherwise(result)
    return result
