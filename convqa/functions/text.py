"""Text, id and time expressions. Everything is Column -> Column and stays inside code generation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script range and combining marks of the Arabic blocks, acknowledgement words, name patterns.
ARABIC = "[\\u0600-\\u06FF]"
ARABIC_MARKS = "[\\u0640\\u064B-\\u0670]"
ARABIC_MARKS_LOOSE = "[\\u064B-\\u065F\\u0640]"
ACK_WORDS = (
    "نعم", "ايوه", "أيوه", "تمام", "كمّل", "اكمل", "أكمل", "تفضل", "ماشي", "التالي", "نكمل",
    "yes", "ok", "okay", "yeah", "continue", "go on", "yep",
)
AGENT_WORDS = ("agent", "assistant", "ai", "bot")
CUSTOMER_WORDS = ("customer", "caller", "user", "human", "client")
FLOW_FILE = "(?i)^(.+?)-(Incremental|FullDump)_(ar|en)(?:\\.json)?$"
STAMP = "(\\d{4}-\\d{2}-\\d{2}T\\d{2}-\\d{2}-\\d{2}(?:-\\d+)?Z?)"
RETRYABLE_REASONS = (
    "silent-clip", "reply-too-slow", "transcript-not-saved", "recording-url-missing", "attempt-timeout",
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(c), "(?U)^\\s+|\\s+$", "")


def is_json(c: str | Column) -> Column:
    """Whether a text is one JSON value from end to end; null for null.

    The engine's parser reads the first value and leaves what follows, so the text has to parse as an only element and as an
    only member: what follows a value breaks one of them.
    """
    alone = lambda before, after: F.try_parse_json(F.concat(F.lit(before), col(c), F.lit(after))).isNotNull()
    return F.when(col(c).isNotNull(), alone("[", "]") & alone('{"v":', "}"))


def blank_to_null(c: str | Column) -> Column:
    trimmed = strip(c)
    return F.when(trimmed != "", trimmed)


def detect_language(c: str | Column, script: str = ARABIC, match: str = "ar", other: str = "en", empty: str = "?") -> Column:
    text = F.coalesce(col(c), F.lit(""))
    return F.when(text == "", empty).when(text.rlike(script), match).otherwise(other)


def normalize_text(c: str | Column) -> Column:
    """Lower case, no combining marks, every run of other characters becomes one blank."""
    bare = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), ARABIC_MARKS, "")
    return F.trim(F.regexp_replace(bare, "[^\\p{L}\\p{N}]+", " "))


def norm_text_loose(c: str | Column) -> Column:
    """Like ``normalize_text`` but one blank per dropped character, so its length keeps meaning."""
    bare = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), ARABIC_MARKS_LOOSE, "")
    return F.regexp_replace(bare, "[^\\p{L}\\p{N}]", " ")


def tokens(c: str | Column) -> Column:
    return F.filter(F.split(normalize_text(c), " "), lambda t: t != "")


def words_loose(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(norm_text_loose(c), " +"), lambda t: t != ""))


def canonical_speaker(c: str | Column, agent_names: Sequence[str] = ()) -> Column:
    """Agent words are tested before customer words; matching is by substring."""
    label = F.lower(F.coalesce(col(c), F.lit("")))
    return (
        F.when(label.rlike("|".join((*AGENT_WORDS, *[re.escape(n.lower()) for n in agent_names if n]))), "agent")
        .when(label.rlike("|".join(CUSTOMER_WORDS)), "customer")
        .when(label == "", "unknown")
        .otherwise(label)
    )


def first_text(*cols: str | Column) -> Column:
    """First non-empty of several alternative fields."""
    return F.coalesce(*[F.when(col(c) != "", col(c)) for c in cols])


def finite(*cols: str | Column) -> Column:
    """First present of several alternative number fields; not-a-number and infinity become null."""
    value = F.coalesce(*[col(c) for c in cols]).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def turn_type(c: str | Column, words: Sequence[str] = ACK_WORDS) -> Column:
    text = strip(F.coalesce(col(c), F.lit("")))
    ack = "(?iU)^\\s*(" + "|".join(words) + ")\\s*[!.]*$"
    return F.when((text == "") | text.rlike(ack), "ack").otherwise("question")


def slugify(c: str | Column) -> Column:
    base = strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), "\\([^)]*\\)", ""))
    parts = F.filter(F.split(base, "[\\s\\-_.]+"), lambda p: p != "")
    slug = F.upper(F.array_join(parts, "_"))
    return F.when(slug == "", "FLOW").otherwise(slug)


def safe_file_name(c: str | Column, replacement: str = "") -> Column:
    return F.regexp_replace(col(c), "[\\\\/:*?\"<>|]", replacement)


def strip_run_suffix(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "#\\d+$", "")


def stamp_second(c: str | Column) -> Column:
    """Second-level prefix of a stamp, with either separator in front of the milliseconds."""
    return F.regexp_replace(col(c), "[.]\\d{3}Z?$", "")


def stamp_prefix(c: str | Column) -> Column:
    """The first 19 characters of a file stamp: date and time down to the second."""
    return F.regexp_extract(col(c), "^(\\d{4}-\\d{2}-\\d{2}T\\d{2}-\\d{2}-\\d{2})", 1)


def embedded_stamp(c: str | Column) -> Column:
    found = F.regexp_extract(col(c), STAMP, 1)
    return F.when(found != "", found)


def source_stamp(c: str | Column) -> Column:
    """Stamp part of a captured-answers file name, else the bare name."""
    found = F.regexp_extract(col(c), "captured-answers-(.+)\\.json$", 1)
    return F.when(found != "", found).otherwise(F.regexp_replace(col(c), "\\.[^.]*$", ""))


def judge_slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), ":free", ""), "[^A-Za-z0-9._-]+", "_")


def question_id_from_clip(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), "^\\d+_", ""), "(?i)\\.wav$", "")


def question_id_from_clip_strict(c: str | Column) -> Column:
    return F.regexp_extract(col(c), "^\\d+_(.+)\\.wav$", 1)


def call_url(app_url: str | Column, agent_id: str | Column, conversation_id: str | Column, locale: str = "en") -> Column:
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (app_url, agent_id, conversation_id)]
    present = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    url = F.concat(parts[0], F.lit(f"/{locale}/agents/"), parts[1], F.lit("/conversations/"), parts[2])
    return F.when(present, url).otherwise("")


def parse_iso_utc(c: str | Column) -> Column:
    """ISO-8601 text to a timestamp, naive input read in the session zone (UTC), bad input null."""
    return F.try_to_timestamp(col(c))


def epoch_ms(c: str) -> Column:
    """Milliseconds of a zone-less timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {c})")


def caller_phone(c: str | Column) -> Column:
    """Caller number; null for a web call."""
    return F.regexp_replace(F.when(col(c) != "", col(c)), "^tel:", "")


def fmt_mmss(seconds: str | Column) -> Column:
    whole = col(seconds).cast("bigint")
    return F.format_string("%d:%02d", F.floor(whole / 60), F.pmod(whole, F.lit(60)))


def padded_id(prefix: str | Column, n: str | Column, width: int = 3) -> Column:
    """Zero-padded number that grows beyond ``width`` instead of being cut."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(head, F.format_string(f"%0{width}d", col(n).cast("bigint")))


def numeric_suffix(c: str | Column, prefix: str) -> Column:
    """Number behind ``prefix``; null when the id has another form."""
    return F.regexp_extract(col(c), f"^{re.escape(prefix)}(\\d+)$", 1).try_cast("bigint")


def looks_garbled(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike("\\?{3,}")


def flow_file_part(c: str | Column, part: str) -> Column:
    group = {"base": 1, "mode": 2, "language": 3}[part]
    value = F.regexp_extract(col(c), FLOW_FILE, group)
    return value if part == "base" else F.lower(value)


def round_half_up(c: str | Column) -> Column:
    """Nearest integer, ties towards positive infinity."""
    return F.floor(col(c) + F.lit(0.5)).cast("bigint")


def round2(c: str | Column) -> Column:
    return F.floor(col(c) * 100 + F.lit(0.5)) / 100


def percent1(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, ties to even; null for an empty whole."""
    return F.when(whole != 0, F.bround(F.lit(100.0) * part / whole, 1))


def is_retryable(c: str | Column) -> Column:
    return col(c).isin(*RETRYABLE_REASONS)


def error_class(error: str | Column, kind: str | Column | None = None) -> Column:
    """Failed judge call: quota, malformed JSON, or other."""
    text = F.lower(F.coalesce(col(error), F.lit("")))
    name = F.lower(F.coalesce(col(kind), F.lit(""))) if kind is not None else F.lit("")
    quota = (
        text.contains("429") | text.contains("resource_exhausted") | F.replace(text, F.lit("_"), F.lit("")).contains("ratelimit")
        | text.contains("retryerror")
    )
    malformed = text.contains("json") | name.contains("json") | name.contains("validationerror")
    return F.when(quota, "quota").when(malformed, "malformed-json").otherwise("other")


def agent_id_for(agent_id: str | Column, language: str | Column, by_language: dict[str, str]) -> Column:
    """Session's own agent, else the one configured for its language, else empty."""
    fallback = F.lit("")
    for lang, agent in by_language.items():
        fallback = F.when(col(language) == lang, F.lit(agent)).otherwise(fallback)
    return F.coalesce(blank_to_null(agent_id), fallback)
