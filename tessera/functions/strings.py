"""String, date and URL functions of posts and programs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vectorised import vectorised

# Letters that Unicode does not decompose, in ASCII.
LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i", "đ": "d", "Đ": "D", "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "…": "...", "€": "EUR", "£": "PS", "©": "(c)", "®": "(r)"}
# Fixed value: what begins a new top-level statement after a completion.
CODE_BREAK = r"\nclass|\ndef|\n#|\n@|\nprint|\nif"


def tag_list(raw: Column) -> Column:
    """"<a><b>" as an array of its tags."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ">"), lambda t: F.trim(F.replace(t, F.lit("<"), F.lit(""))))
    return F.filter(parts, lambda t: t != "")


def to_ascii(text: str | None) -> str | None:
    """Latin letters without their marks, common signs spelt out, anything else left out."""
    if text is None:
        return None
    out = "".join(LETTERS.get(c, c) for c in text)
    return unicodedata.normalize("NFKD", out).encode("ascii", "ignore").decode()


@vectorised("string")
def ascii_text(text: pd.Series) -> pd.Series:
    return text.map(to_ascii)


def before_marker(text: Column, marker: str = "# Solution") -> Column:
    return F.substring_index(text, marker, 1)


def first_block(text: Column) -> Column:
    """The code before the next top-level statement, right-trimmed."""
    return F.regexp_replace(F.split(text, CODE_BREAK, 2)[0], r"\s+$", "")


def context_and_program(text: Column) -> tuple[Column, Column]:
    """What stands before the first "class " or "def ", and the rest from it on."""
    context = F.regexp_extract(text, r"(?s)^(.*?)(?:class |def |$)", 1)
    return context, F.substr(text, F.length(context) + 1)


def docstring(text: Column) -> Column:
    """The lines of the first docstring, trimmed and joined; quotes may be double or single."""
    body = F.when(F.contains(text, F.lit('"""')), F.split(text, '"""')[1]).when(F.contains(text, F.lit("'''")), F.split(text, "'''")[1]).otherwise("")
    return F.array_join(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def without_returns(text: Column) -> Column:
    return F.replace(text, F.lit("\r"), F.lit(""))


def prompt_and_target(code: Column, prompt: Column | None = None) -> tuple[Column, Column]:
    """(prompt, target): what a program has up to its first "def " at the start of a line other than its first goes to the end of the prompt.

    Without such a line the prompt stays as it is, and all of the program is the target.
    """
    head = F.regexp_extract(code, r"(?s)^(.*?\ndef )", 1)
    return F.concat(F.lit("") if prompt is None else prompt, head), F.substr(code, F.length(head) + 1)


def outcome_text(kind: Column, message: Column) -> tuple[Column, Column]:
    """("Type: message", the type with _ for spaces); a null or empty message leaves the type."""
    empty = F.coalesce(message, F.lit("")) == ""
    return F.when(empty, kind).otherwise(F.concat(kind, F.lit(": "), message)), F.replace(kind, F.lit(" "), F.lit("_"))


def function_name(calls: Column) -> Column:
    """The name that all of some calls have: of the names before an opening bracket (without what follows a dot), in order of the alphabet, the first that each call contains; null if there is none."""
    heads = F.flatten(F.transform(calls, lambda c: F.transform(F.split(c, r"\("), lambda part: F.substring_index(F.substring_index(part, " ", -1), ".", 1))))
    names = F.array_sort(F.array_distinct(F.filter(heads, lambda n: F.rlike(n, F.lit(r"^[A-Za-z_]\w*$")))))
    return F.try_element_at(F.filter(names, lambda n: F.forall(calls, lambda c: F.contains(c, n))), F.lit(1))


def comment(text: Column, style: str) -> Column:
    """Text as a block comment, as line comments, or as it is."""
    if style == "BLOCK":
        return F.concat(F.lit('"""\n'), text, F.lit('\n"""'))
    if style == "LINE":
        return F.concat(F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n# ")))
    return text


def ordinal(n: Column) -> Column:
    """1ST, 2ND, 3RD, 4TH, ... 11TH ..."""
    teen = (n % 100).between(11, 13)
    suffix = F.when(teen, "TH").when(n % 10 == 1, "ST").when(n % 10 == 2, "ND").when(n % 10 == 3, "RD").otherwise("TH")
    return F.concat(n.cast("string"), suffix)


def filled(template: str, **values: Column) -> Column:
    """A template with __name__ replaced by each value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"__{name}__"), value)
    return out


def run_name(name: Column) -> Column:
    """The text before "-", without its last part after "_"."""
    return F.regexp_replace(F.substring_index(name, "-", 1), r"_[^_]*$", "")


def metric_name(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("eval_")), F.concat(F.lit("eval/"), F.substr(name, F.lit(6)))).when(F.startswith(name, F.lit("test_")), F.concat(F.lit("test/"), F.substr(name, F.lit(6)))).otherwise(F.concat(F.lit("train/"), name))


def contains_all(text: Column, *words: str) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(text, F.lit(w))
    return out


def human_size(n: Column) -> Column:
    """Bytes with one digit and a unit."""
    out, size = None, n.cast("double")
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    for k in reversed(range(len(units))):
        text = F.format_string(f"%.1f {units[k]}", size / float(1024**k))
        out = text if out is None and k == 0 else (F.when(size >= float(1024**k), text) if out is None else out.when(size >= float(1024**k), text) if k else out.otherwise(text))
    return out


def duration_text(seconds: Column) -> Column:
    """Seconds as hours, minutes and seconds, "1:02:03"."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60)


def indented(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^", "\t")


def clean_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def date_text(date: Column, pattern: str) -> Column:
    """A date in a strftime pattern of %Y, %m, %d, %H, %M and %S."""
    for a, b in {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}.items():
        pattern = pattern.replace(a, b)
    return F.date_format(date, pattern)


def hrefs(html: Column) -> Column:
    """Targets of the links in an HTML text, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1)


def host(url: Column) -> Column:
    """Host of a URL without a leading www.; null if it has none. No public-suffix list is used."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def path(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def joined_url(base: str):
    """A function that resolves links against ``base``."""
    from urllib.parse import urljoin

    def resolve(link: pd.Series) -> pd.Series:
        return link.map(lambda x: urljoin(base, x), na_action="ignore")

    return F.pandas_udf(resolve, "string")
