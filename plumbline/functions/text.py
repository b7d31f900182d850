"""Text normalisation, roles of sheet text and error classes as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces that drawings use beside the ordinary one: no-break, figure, narrow no-break, thin.
ODD_SPACES = "\u00a0\u2007\u202f\u2009"
#: Fixed replacements for fonts without these signs.
PLAIN = {
    "°": " deg", "Ø": "D", "ø": "d", "×": "x", "✕": "x", "✖": "x", "—": "-", "–": "-", "−": "-", "…": "...", "·": "-",
    "≤": "<=", "≥": ">=", "±": "+-", "²": "2", "⟨": "<", "⟩": ">", "⟶": "->",
}

#: Roles of sheet text, first match wins; every pattern is anchored at the start.
#: Fixed values: (pattern, role, reason).
ROLE_RULES = (
    (r"<\s*\d+\s*>$", "node", "position mark <N>"),
    (r"[XYZxyz]\s{0,3}[+±-]?\s{0,3}\d+", "coordinate", "tie-in coordinate"),
    (r"[ОOoККk]\s{0,3}\d+", "support", "support mark"),
    (r"\d+\s*/\s*\d+$", "support", "support mark N/M"),
    (r"[Сс][Мм]\.?\s*\d", "coordinate", "reference to another sheet"),
    (r"\d{2,4}[_-]\d{2,3}[_-]\w+", "spec", "drawing number"),
    (r"[Dd][Nn]\s{0,3}\d+\s{0,3}[XxХх]\s{0,3}\d+", "spec", "pipe DN with sizes"),
    (r"[Dd][Nn]\s{0,3}\d", "spec", "pipe DN"),
    (r"(?i:[SW]{1,2}[_-]?\d)", "title", "set designation"),
    (r"(?i:Лист\b)", "title", "sheet number"),
    (r"(?i:Страница\b)", "title", "stamp"),
    (r"(?i:ТЕСТОВОЕ\s*ЗАДАНИЕ)", "other", "watermark"),
    (r"[Рр][Вв][Бб][Лл]\b", "support", "support mark RVBL"),
    (r"[Нн][Ии][Пп][Ее]\b", "other", "text mark NPE"),
    (r"[Сс]\.?$", "other", "letter at the north arrow"),
    (r"[Nn]$", "other", "letter at the north arrow"),
    (r"[Сс][Мм]\.?\s*$", "coordinate", "reference to another sheet"),
    (r"(?i:ПОДКЛЮЧЕНИЕ)", "other", "written remark"),
    (r"[A-Za-zА-Яа-я]{1,3}-[\d/]+$", "other", "connection point"),
    (r"(?i:\d+\s*mm\b)", "spec", "diameter in millimetres"),
    (r"(Н\.)?[ОOo]\.?\s*[А-Яа-яA-Za-z]", "other", "text mark"),
    (r"(?i:[ОДНОДНА]{1,2}\s*$)", "other", "the word one"),
    (r"(?i:ШТУРВАЛ\b)", "other", "handwheel"),
)
#: Everything that is known not to be a dimension goes.
CUT_ROLES = ("coordinate", "node", "support", "title", "spec", "other")

#: Parts of messages that mean "try again" and "give up".
RETRYABLE = (
    "429", "rate limit", "rate_limit", "too many", "too_many", "concurrency limit", "concurrent request", "timeout", "timed out",
    "temporarily", "overloaded", "service unavailable", "502", "503", "504", "connection reset", "connection error",
)
FATAL = (
    "api key", "unauthorized", "authentication", "insufficient", "insufficient_quota", "credit", "not_found_error", "model not found",
    "do not have access to model", "no access to model", "does not exist", "context_length",
)
NO_SCHEMA = ("response_format", "json_schema", "structured")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def norm_key(text: Column) -> Column:
    """Lookup key of sheet text."""
    return F.lower(collapse(F.translate(text, ODD_SPACES, " " * len(ODD_SPACES))))


def plain_ascii(text: Column) -> Column:
    """Text for fonts that hold only printable ASCII."""
    for sign, written in PLAIN.items():
        text = F.replace(text, F.lit(sign), F.lit(written))
    return collapse(F.regexp_replace(text, "[^ -~]", " "))


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | text.contains(part)
    return found


def first_rule(text: Column, rules: Iterable[tuple[str, str, str]], value: int = 1, flags: str = "(?U)") -> Column:
    """Role (1) or reason (2) of the first rule that matches the start of the text; null if none."""
    return F.coalesce(*[F.when(text.rlike(f"{flags}^(?:{r[0]})"), F.lit(r[value])) for r in rules])


def role_of_text(text: Column) -> Column:
    return first_rule(collapse(text), ROLE_RULES)


def role_reason(text: Column) -> Column:
    return first_rule(collapse(text), ROLE_RULES, 2)


def is_cut(role: Column) -> Column:
    return role.isin(*CUT_ROLES)


def error_class(message: Column) -> Column:
    """retryable before fatal: a 429 that mentions an API key is worth another try."""
    low = F.lower(message)
    return F.when(contains_any(low, RETRYABLE), "retryable").when(contains_any(low, FATAL), "fatal").when(contains_any(low, NO_SCHEMA), "no_schema").otherwise("other")


def reply_class(reply: Column, finish_reason: Column, parsed: Column, problems: Column | None = None) -> Column:
    """Why a reply can't be used: truncated, empty, not JSON, not by its schema; null if it can be.

    ``problems`` lists where the reply departs from its schema (``schemas.checked``).
    """
    found = (
        F.when(finish_reason == "length", "truncated")
        .when(reply.isNull() | (strip(reply) == ""), "empty")
        .when(parsed.isNull(), "not_json")
    )
    return found if problems is None else found.when(F.size(problems) > 0, "schema")


def substitute(template: Column, token: str, block: Column) -> Column:
    """All occurrences of {{TOKEN}}, or the block after the template if there is none."""
    mark = F.lit("{{" + token + "}}")
    return F.when(template.contains("{{" + token + "}}"), F.replace(template, mark, block)).otherwise(F.concat(template, F.lit("\n\n"), block))


def strip_section(text: Column, heading: str) -> Column:
    """Text up to a Markdown heading."""
    return F.regexp_replace(text, f"(?s)\\n*#+ *{heading}\\b.*$", "")


def clip(text: Column, most: int = 6000) -> Column:
    return F.substring(text, 1, most)


#: What a model is asked where an experiment says nothing of its own, and what is said of the picture.
ASKED = "Проанализируй этот лист изометрического чертежа трубопровода и верни результат строго по схеме."
PICTURE = "\n\nЛист № {page}. Размер изображения: {width}x{height} px."


def instruction(own: Column, page: Column, width: Column, height: Column) -> Column:
    """What goes with the picture of one sheet: the experiment's own words or the usual ones, and the picture's size."""
    said = F.lit(PICTURE)
    for name, x in (("page", page), ("width", width), ("height", height)):
        said = F.replace(said, F.lit("{" + name + "}"), x.cast("bigint").cast("string"))
    return F.concat(F.coalesce(F.nullif(own, F.lit("")), F.lit(ASKED)), said)


def user_content(text: Column, urls: Column) -> Column:
    """Message parts as JSON: the text, then a picture for each URL."""
    part = lambda kind, words, url: F.struct(F.lit(kind).alias("type"), words.alias("text"), url.alias("image_url"))
    none, no_url = F.lit(None).cast("string"), F.lit(None).cast("struct<url:string>")
    return F.to_json(F.concat(F.array(part("text", text, no_url)), F.transform(urls, lambda u: part("image_url", none, F.struct(u.alias("url"))))))


def backoff(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
