"""Expressions over text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What "all tasks" stands for in a request: fixed values.
ALL_TASKS = ["browsing", "contact_search", "calendar_management", "email_management", "phone_calls", "task_planning"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cache_key(key: Column | str, namespace: str = "", longest: int = 100) -> Column:
    """Namespace and key; a key of more than `longest` characters is stored by its md5."""
    key = _c(key)
    return F.concat(F.lit(namespace), F.when(F.char_length(key) > longest, F.md5(key)).otherwise(key))


def strip_namespace(key: Column | str, namespace: str) -> Column:
    key = _c(key)
    return F.when(F.startswith(key, F.lit(namespace)), F.substring(key, len(namespace) + 1, 1 << 30)).otherwise(key)


def composite_key(kind: str, text: Column | str, model: str, normalized: bool) -> Column:
    return F.concat_ws(":", F.lit(kind), _c(text), F.lit(model), F.lit(str(normalized)))


def answer_after(text: Column | str, prompt: Column | str) -> Column:
    """What follows the first occurrence of the prompt, else the whole text, trimmed."""
    text, prompt = _c(text), _c(prompt)
    at = F.instr(text, prompt)
    return F.trim(F.when(at > 0, F.substring(text, at + F.char_length(prompt), F.char_length(text))).otherwise(text))


def shorten(text: Column | str, longest: int) -> Column:
    text = _c(text)
    return F.when(F.char_length(text) > longest, F.concat(F.left(text, F.lit(longest)), F.lit("..."))).otherwise(text)


def display_name(name: Column | str) -> Column:
    return F.upper(F.replace(_c(name), F.lit("_"), F.lit(" ")))


def title(text: Column | str) -> Column:
    """A capital after every character that is no letter (foo_bar: Foo_Bar)."""
    text = F.lower(_c(text))
    letters = F.split(text, "")
    return F.array_join(F.transform(letters, lambda c, i: F.when(~F.coalesce(F.get(letters, i - 1), F.lit(" ")).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def tasks(request: Column | str) -> Column:
    """The tasks named in a request, in order: split at commas, trimmed, lower case, underscores for blanks."""
    request = _c(request)
    own = F.transform(F.split(request, ","), lambda t: F.replace(F.lower(F.trim(t)), F.lit(" "), F.lit("_")))
    return F.when(F.lower(F.trim(request)) == "all tasks", F.array(*map(F.lit, ALL_TASKS))).otherwise(own)


def one_line(text: Column | str) -> Column:
    return F.replace(_c(text), F.lit("\n"), F.lit(""))


def listed(text: Column | str) -> Column:
    """The strings of a list written as text, in single or double quotes; any other text: itself alone."""
    text = _c(text)
    return F.coalesce(F.from_json(F.when(F.startswith(F.trim(text), F.lit("[")), F.replace(text, F.lit("'"), F.lit('"'))), "array<string>"), F.array(text))


def is_error(text: Column | str, missing_image: bool = True) -> Column:
    """Whether an output reports an error; missing_image: also that there was no image."""
    text = _c(text)
    found = F.startswith(text, F.lit("Error:"))
    return F.coalesce(found | (text == "No image available for processing") if missing_image else found, F.lit(False))


def kind_of_prompt(prompt: Column | str) -> Column:
    """The kind of answer that a prompt asks for; the first clause that fits counts."""
    prompt = F.lower(_c(prompt))
    out = F.lit("general")
    for word, kind in reversed([("describe", "description"), ("what", "identification"), ("how many", "count"), ("color", "color"), ("where", "place")]):
        out = F.when(F.contains(prompt, F.lit(word)), kind).otherwise(out)
    return out


def elided(v: Column | str) -> Column:
    """A stand-in for an array in printed records."""
    return F.format_string("[%d float values]", F.size(_c(v)))


def numbers_after(text: Column | str, label: str) -> Column:
    """All numbers that follow a label in a text, as doubles."""
    found = F.regexp_extract_all(_c(text), F.lit(label + r"\s*:?\s*([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("double"))
