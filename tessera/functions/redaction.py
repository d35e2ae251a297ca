"""Redaction of credential-like text as a chain of JVM regular expressions, in a fixed order.

Letters, digits, white space and word bounds are those of Unicode, as in the patterns' own engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "[REDACTED:credential]"

# The patterns that make a passage look like a credential, in the order they are tried.
PRIVATE_KEY = r"(?is)-----BEGIN ((?:[A-Z0-9][A-Z0-9 -]* )?PRIVATE KEY(?: BLOCK)?)-----.*?-----END \1-----"
TOKENS = [
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"(?i)\b(?:Basic|ApiKey|Token)\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\b(?:gh[pousr]_[A-Za-z0-9]{20,255}|github_pat_[A-Za-z0-9_]{22,255})\b",
    r"\bglpat-[A-Za-z0-9_-]{20,255}\b",
    r"\bxox[baprs]-[A-Za-z0-9-]{10,255}\b",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\b(?:sk-(?:proj-)?[A-Za-z0-9_-]{20,255}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,255}|npm_[A-Za-z0-9]{32,255}|pypi-[A-Za-z0-9_-]{32,255})\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
    r"(?i)\b(?:Bearer|Basic|ApiKey|Token)\s+\S+",
    r"(?i)(?:\bBearer\s+[A-Za-z0-9._~+/=-]+|\b(?:sk|ghp|github_pat)[-_][A-Za-z0-9_-]{8,}|\bxox[a-z]-[A-Za-z0-9-]{8,}|\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|\bAKIA[0-9A-Z]{12,})",
]
LIKELY = r"(?i)(^|\s)(?:bearer\s+\S+|sk-[A-Za-z0-9_-]{12,}|gh[pousr]_[A-Za-z0-9]{12,}|xox[baprs]-[A-Za-z0-9-]{12,}|AIza[A-Za-z0-9_-]{12,})"
ASSIGNED = r"api[_-]?key|access[_-]?token|auth(?:entication|orization)?[_-]?(?:key|token)?|bearer[_-]?token|client[_-]?secret|credentials?|password|passwd|private[_-]?key|pwd|secret(?:[_-]?key)?|token"
SPOKEN = ASSIGNED.replace("[_-]", "[ _-]")
URI = r"(?i)(\b[a-z][a-z0-9+.-]{1,31}://)(?!\[REDACTED:)[^/@\s:]+:[^/@\s]+@"
URI_NAME = r"([A-Za-z][A-Za-z0-9+.-]*://)(?!\[REDACTED:)[^/\s@]+(?::[^/\s@]*)?@"

# Names before = or :, and before is, was or equals, that make what follows a credential; words that don't.
_done = r"\[REDACTED:credential\]"
_prefix = rf"(?i)((?<![A-Za-z0-9_])[\"']?(?:[A-Za-z0-9]+[_-])*(?:{ASSIGNED})[\"']?\s*[=:]\s*)"
_said = rf"(?i)((?<![A-Za-z0-9_])(?:{SPOKEN})\s+(?:is|equals?|was)\s+)(?!(?:configured|invalid|missing|optional|required|redacted|sensitive|unset|valid)\b)"


def _steps() -> list[tuple[str, str]]:
    """(pattern, replacement) of each pass; $n keeps a prefix. A value that is already the mark never matches."""
    steps = [(PRIVATE_KEY, MARK), *((p, MARK) for p in TOKENS), (LIKELY, "$1" + MARK)]
    for prefix, least in ((_prefix, 1), (_said, 6)):
        value = rf"(?:(\")(?!{_done}\")[^\"\r\n]{{{least},4096}}\"|(')(?!{_done}')[^'\r\n]{{{least},4096}}'|(?![\"'])(?!{_done}(?:[\s,;}}]|$))[^\s,;}}\r\n]{{{least},4096}})"
        steps.append((prefix + value, "$1$2$3" + MARK + "$2$3"))
    return [*steps, (URI, "$1" + MARK + "@"), (URI_NAME, "$1" + MARK + "@")]


def _java(pattern: str) -> str:
    """The pattern with Unicode classes; the four separators that Java doesn't count as white space are added."""
    out, in_set, k = "", False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two[0] == "\\":
            more = {"\\s": r"\s\x1c-\x1f", "\\S": r"[^\s\x1c-\x1f]"}.get(two, two)
            out, k = out + (f"[{more}]" if two == "\\s" and not in_set else more), k + 2
        else:
            in_set = two[0] == "[" or (in_set and two[0] != "]")
            out, k = out + two[0], k + 1
    return "(?U)" + out


#: Some of these stands in any text that a pass matches, in lower case; of the last two both do.
HINTS = ("bearer", "basic", "apikey", "token", "ghp", "gho", "ghu", "ghs", "ghr", "github_pat", "glpat-", "xox", "akia", "asia", "aiza", "sk-", "sk_", "rk_", "npm_", "pypi-", "eyj", "private", "api_key", "api-key", "api key", "auth", "secret", "credential", "password", "passwd", "pwd")
#: Letters beyond ASCII that the patterns take for ASCII ones.
FOLDED = ("\u017f", "\u212a", "\u0130", "\u0131")


def may_hold_credential(column: Column) -> Column:
    """Whether a text holds anything without which no pass matches: plain searches, no regular expression."""
    low = F.lower(column)
    uri = F.contains(column, F.lit("://")) & F.contains(column, F.lit("@"))
    found = reduce(lambda a, b: a | b, [F.contains(low, F.lit(h)) for h in HINTS] + [F.contains(column, F.lit(c)) for c in FOLDED])
    return F.coalesce(found | uri, F.lit(False))


def redacted(frame: DataFrame, column: str, clean: str = "clean", count: str = "redactions") -> DataFrame:
    """`frame` with the redacted text and the number of replacements; null text stays null, with none.

    Ordered passes, each a projection over the one before; only texts that may hold a credential go through them, scanned
    twice a pass. A second redaction changes nothing. Groups that didn't take part in a match are empty in a Java
    replacement, so quotes are kept by naming both.
    """
    gate = f"{clean}_may_hold_credential"
    out = frame.withColumns({clean: F.col(column), count: F.lit(0), gate: may_hold_credential(F.col(column))})
    for pattern, put in _steps():
        pattern = _java(pattern)
        hits = F.when(F.col(gate), F.regexp_count(clean, F.lit(pattern))).otherwise(0)
        out = out.withColumns({count: F.col(count) + hits, clean: F.when(F.col(gate), F.regexp_replace(clean, pattern, put)).otherwise(F.col(clean))})
    return out.drop(gate)


def has_credential(column: Column) -> Column:
    """Whether any pass would replace something: one scan per pattern, no replacement."""
    found = reduce(lambda a, b: a | b, [F.regexp_like(column, F.lit(_java(pattern))) for pattern, _ in _steps()])
    return may_hold_credential(column) & found
