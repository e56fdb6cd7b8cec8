"""Personal data by anchor expansion.

An Aho-Corasick automaton passes once over a text and reports anchors: at-signs, plus signs before a digit, digits,
URL schemes and identifier cues. Small deterministic parsers grow each anchor to the boundaries of an e-mail
address, an IP address, a card, phone or account number, and validate it. Nothing else of the text is looked at.

Base kinds equal the leftmost non-overlapping matches of these patterns, failing ones dropped without a retry:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip four dot-separated numbers of at most 255; card 13 to 19
digits, single spaces or hyphens between, passing Luhn; phone ``\\+[0-9][ ().0-9-]+[0-9]`` of 9 to 15 digits. The method
adds kinds that need a cue before them, in any case: ``login`` (the user information of a URL), ``account`` (an
identifier after a cue such as ``iban`` or ``account number``, an IBAN only if its check digits hold) and ``secret`` (what a
token, key, secret or password is set to by ``=`` or ``:``, if it has letters and digits, 16 characters of at least 3 bits each, or
8 after a cue for passwords).
A missing or empty text has no spans. Spans are in code points, the end exclusive; kinds may overlap each other.
"""

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.rows import map_texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIALLED = re.compile(r"[ ().0-9-]+")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&*+,;=-]+(?::[^\s@/?#]*)?(?=@[A-Za-z0-9])")
_AFTER_CUE = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|id|#))?[ \t]*[:=#]?[ \t]*([A-Za-z]{0,4}[0-9][A-Za-z0-9]*(?:[ -][A-Za-z0-9]+)*)",
                        re.IGNORECASE | re.ASCII)
_ASSIGNED = re.compile(r"[\"']?[ \t]*(?::=|=>|[:=])[ \t]*[\"']?([A-Za-z0-9+/_.~=-]{8,})")
_SCHEMES = ("http://", "https://", "ftp://", "ssh://")
_CUES = ("iban", "account", "acct", "ssn", "passport", "konto", "cuenta", "compte")
_PASSWORDS = ("password", "passwd", "pwd", "passphrase")
_SECRETS = ("token", "secret", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "accesskey", "private key", "private_key",
            "secret key", "secret_key", *_PASSWORDS)
_MARKS = {"@": "at", "+": "plus"} | dict.fromkeys("0123456789", "digit") | dict.fromkeys(_SCHEMES, "scheme") | dict.fromkeys(_CUES, "cue") | dict.fromkeys(_SECRETS, "secret")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _built() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for text, kind in _MARKS.items():
        automaton.add_word(text, (kind, len(text)))
    automaton.make_automaton()
    return automaton


_ANCHORS = _built()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    """Country, two check digits, 11 to 30 more characters, remainder 1 of 97."""
    text = text.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str, at_signs: list[int]) -> Iterator[tuple[int, int]]:
    end = 0
    for at in at_signs:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _LABELS.match(text, at + 1)):
            end = domain.end()
            yield start, end


def _number_runs(digits: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for i in digits:
        if out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1)
        else:
            out.append((i, i + 1))
    return out


def _chains(text: str, numbers: list[tuple[int, int]], between: str) -> Iterator[list[tuple[int, int]]]:
    """Numbers that stand one character apart, that character being one of ``between``."""
    chain: list[tuple[int, int]] = []
    for run in numbers:
        if chain and run[0] == chain[-1][1] + 1 and text[run[0] - 1] in between:
            chain.append(run)
        else:
            if chain:
                yield chain
            chain = [run]
    if chain:
        yield chain


def _addresses(text: str, numbers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in _chains(text, numbers, "."):
        for k in range(0, len(chain) - 3, 4):
            if all(len(text[s:e].lstrip("0")) <= 3 and int(text[s:e][-3:]) <= 255 for s, e in chain[k:k + 4]):
                yield chain[k][0], chain[k + 3][1]


def _cards(text: str, numbers: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for chain in _chains(text, numbers, " -"):
        if 13 <= sum(e - s for s, e in chain) <= 19 and luhn("".join(text[s:e] for s, e in chain)):
            yield chain[0][0], chain[-1][1]


def _phones(text: str, plus_signs: list[int]) -> Iterator[tuple[int, int]]:
    for plus in plus_signs:
        if text[plus + 1:plus + 2] not in set("0123456789"):
            continue
        run = _DIALLED.match(text, plus + 2)
        if not run:
            continue
        end = run.end()
        while end > plus + 3 and text[end - 1] not in "0123456789":
            end -= 1
        if end > plus + 3 and 9 <= sum(c.isdigit() for c in text[plus:end]) <= 15:
            yield plus, end


def _logins(text: str, after_schemes: list[int]) -> Iterator[tuple[int, int]]:
    for start in after_schemes:
        if found := _LOGIN.match(text, start):
            yield found.span()


def _accounts(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    end = 0
    for start, after in cues:
        if start < end or (start and text[start - 1].isalnum()) or not (found := _AFTER_CUE.match(text, after)):
            continue
        s, e = found.span(1)
        parts = re.split(r"([ -])", text[s:e])
        if text[start:after].lower() == "iban":
            ends = [s + len("".join(parts[:k])) for k in range(len(parts), 0, -2)]
            hit = next((x for x in ends if iban_holds(text[s:x])), None)
        else:
            kept = 1
            while kept + 1 < len(parts) and parts[kept + 1].isdigit():
                kept += 2
            hit = s + len("".join(parts[:kept]))
            hit = hit if sum(c.isdigit() for c in text[s:hit]) >= 6 else None
        if hit:
            end = hit
            yield s, hit


def _bits(text: str) -> float:
    """Entropy of a character."""
    return sum(n / len(text) * math.log2(len(text) / n) for n in Counter(text).values())


def _secrets(text: str, cues: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    end = 0
    for start, after in cues:
        if start < end or (start and text[start - 1].isalnum()) or not (found := _ASSIGNED.match(text, after)):
            continue
        s, e = found.span(1)
        while e > s and text[e - 1] in ".=-":  # the end of a sentence, or padding
            e -= 1
        value = text[s:e]
        if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
            continue
        if len(value) >= 16 and _bits(value) >= 3 or len(value) >= 8 and text[start:after].translate(_LOWER) in _PASSWORDS:
            end = e
            yield s, e


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind in the order of KINDS, then start."""
    at: dict[str, list] = {"at": [], "plus": [], "digit": [], "scheme": [], "cue": [], "secret": []}
    for last, (kind, length) in _ANCHORS.iter(text.lower() if text.isascii() else text.translate(_LOWER)) if text else ():
        at[kind].append((last - length + 1, last + 1))
    first = lambda kind: [s for s, _ in at[kind]]
    numbers = _number_runs(first("digit"))
    found = {
        "email": _emails(text, first("at")), "ip": _addresses(text, numbers), "card": _cards(text, numbers),
        "phone": _phones(text, first("plus")), "login": _logins(text, sorted({e for _, e in at["scheme"]})),
        "account": _accounts(text, sorted(at["cue"])), "secret": _secrets(text, sorted(at["secret"])),
    }
    return [(kind, s, e) for kind in KINDS for s, e in found[kind]]


def redacted(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each group of overlapping spans replaced by its first kind in angle brackets."""
    if not spans:
        return text
    out, end, last = [], 0, 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= last:
            out += [text[end:s], f"<{kind.upper()}>"]
            end = e
        elif e > end:
            end = e
        last = end
    return "".join(out) + text[end:]


def _joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, text: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``row`` (the ``keep`` columns), base spans, all spans, the text without them, and a count per base kind.

    One pass, no shuffle; other columns of ``docs`` aren't read.
    """
    def made(texts: list[str | None]) -> Iterator:
        spans = [find_spans(t) for t in texts]
        base = [[x for x in s if x[0] in BASE_KINDS] for s in spans]
        yield None, {
            "spans": [_joined(s) for s in spans], "base_spans": [_joined(s) for s in base],
            "redacted": [redacted(t, s) for t, s in zip(texts, spans, strict=True)],
        } | {f"n_{k}": [sum(x[0] == k for x in s) for s in base] for k in BASE_KINDS}

    fields = {"spans": "string", "base_spans": "string", "redacted": "string"} | {f"n_{k}": "bigint" for k in BASE_KINDS}
    return map_texts(docs, text, made, fields, keep)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, a digest of them, and all spans."""
    return scan(docs).select("row.doc_id", *(f"n_{k}" for k in BASE_KINDS),
                             F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars``, if there, counted again."""
    done = scan(docs, keep=[c for c in docs.columns if c != "text"])
    counted = F.coalesce(F.length("redacted"), F.lit(0))
    new = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        new["n_chars"] = counted.cast(docs.schema["n_chars"].dataType)
    return done.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))
