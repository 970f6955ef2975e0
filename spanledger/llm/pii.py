"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ``://``, plus signs, digit-dot-digit,
pairs of digits of a possible card number and cue words of identifiers. A local parser per anchor
expands it left and right to its longest form and validates it. Two capitals and two digits that begin
a word are the anchors of IBANs, wherever they stand. All parsers use ASCII classes and
step over each character a bounded number of times, so a text costs time in proportion to its length.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.scan import digest, scan, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
KINDS = BASE + ADDED
MARKS = {k: f"[{k.upper()}]" for k in KINDS}

# Words that announce an identifier, in the four languages of the corpus.
CUES = (
    "account", "acct", "passport", "ssn", "customer id", "member id", "tax id",
    "konto", "kontonummer", "reisepass", "kundennummer", "steuernummer",
    "compte", "passeport", "num\u00e9ro client", "num\u00e9ro fiscal",
    "cuenta", "pasaporte", "n\u00famero de cliente", "dni",
)

_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
_digits = re.compile(r"[0-9](?:[ -]?[0-9])*")
_dialled = re.compile(r"\+[0-9][ ().0-9-]*")
_rest = re.compile(r"[^\x00-\x20\"'<>\\^`{|}]+")
_host = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}|localhost|[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_scheme = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*")
_country = re.compile(r"[A-Z][A-Z][0-9][0-9](?:(?<![A-Z0-9][A-Z]{2}[0-9]{2})|(?<=IBAN[A-Z]{2}[0-9]{2}))")
_group = re.compile(r" ?([A-Z0-9]{1,4})(?![A-Za-z0-9])| ?([A-Z0-9]{4})")
_told = re.compile(r"\s*+(?:(?:number|numbers|no\.?|nr\.?|num\.?|#)(?![A-Za-z])\s*+)?+[:=#]?+\s*+", re.A)
_form = re.compile(r"[0-9A-Z]++(?:-[0-9A-Z]++)*+(?![0-9A-Za-z])")
_next = re.compile(r" (?=[A-Z]*+[0-9])[0-9A-Z]{1,4}+(?:-[0-9A-Z]++)*+(?![0-9A-Za-z])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DIGIT = frozenset("0123456789")


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 0))
    found.add_word("://", ("url", 2))
    found.add_word("+", ("phone", 0))
    for a in "0123456789":
        for b in "0123456789":
            found.add_word(f"{a}.{b}", ("ip", 2))
            for sep, width in (("", 1), (" ", 2), ("-", 2)):
                found.add_word(f"{a}{sep}{b}", ("card", width))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("account", len(form) - 1))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _left(text: str, at: int, floor: int, allowed: frozenset) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """Around an at-sign: the longest local part after ``floor`` and the longest dotted domain."""
    domain = _domain.match(text, at + 1)
    if not domain:
        return None
    start = _left(text, at, floor, _LOCAL)
    return (start, domain.end(), True) if start < at else None


def address(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """Around digit-dot-digit: a whole dotted chain of numbers gives its next four."""
    start = _left(text, at, floor, _DIGIT)
    if start == at and text[at] not in _DIGIT:
        return None
    chain = _dotted.match(text, start)
    parts = chain.group().split(".") if chain else []
    if len(parts) < 4:
        return None
    end = start + sum(map(len, parts)) + 3
    return start, end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def card(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """Digits with single blanks or hyphens between them, 13 to 19 of them, that pass Luhn."""
    run = _digits.match(text, max(at, floor))
    if not run:
        return None
    digits = re.sub("[ -]", "", run.group())
    if len(digits) < 2:
        return None
    return run.start(), run.end(), 13 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """A plus sign, a digit, then digits, blanks, dots, brackets and hyphens up to the last digit."""
    run = _dialled.match(text, at)
    if not run:
        return None
    form = run.group().rstrip(" ().-")
    if len(form) < 4:  # plus, digit, one more, digit
        return None
    return at, at + len(form), 9 <= sum(c in _DIGIT for c in form) <= 15


def url(text: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    """Around ``://``: a scheme to the left, a host and the rest of the address to the right."""
    start = _left(text, at, floor, _SCHEME)
    scheme = _scheme.search(text, start, at)
    rest = _rest.match(text, at + 3) if scheme else None
    if not rest:
        return None
    form = rest.group().rstrip(".,;:!?)]")
    host = re.split("[/?#]", form, maxsplit=1)[0].rpartition("@")[2].split(":")[0]
    return scheme.start(), at + 3 + len(form), bool(_host.fullmatch(host))


def iban(text: str, start: int) -> int | None:
    """The end of the longest IBAN that begins at ``start``: groups of four and a last one, right check digits."""
    ends, at, size = [], start + 4, 4
    while size < 34 and (group := _group.match(text, at)):
        at = group.end()
        size += len(group.group(1) or group.group(2))
        if group.group(1) and 15 <= size <= 34:
            ends.append(at)
        if size % 4:  # a shorter group is the last
            break
    for end in reversed(ends):
        plain = text[start:end].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return end
    return None


def account(text: str, begin: int, end: int) -> tuple[str, int, int] | None:
    """After a cue that is a word of its own: an identifier of six or more digits, whole, however long.

    Its parts hang together by hyphens; a blank joins parts of at most four characters that hold a digit, as account
    numbers are written in groups, so that a word or a number of its own that follows stays outside.
    """
    if (begin and text[begin - 1].isalnum()) or text[end : end + 1].isalnum():
        return None
    start = _told.match(text, end).end()
    part = _form.match(text, start)
    if not part:
        return None
    at = part.end()
    if "-" not in part.group() and at - start <= 4:
        while group := _next.match(text, at):
            at = group.end()
    form = text[start:at]
    if sum(c in _DIGIT for c in form) >= 6 and not re.search("[A-Z]{4}", form):
        return "account", start, at
    return None


_PARSERS = {"email": email, "ip": address, "card": card, "phone": phone, "url": url}


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed in KINDS, then start.

    Spans of one kind do not overlap; a parsed form that fails its check is passed over whole.
    """
    found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
    floor = dict.fromkeys(KINDS, 0)
    for last, (kind, back) in anchors().iter(text):
        if kind == "account":
            form = account(text, last - back, last + 1)
            if form and form[1] >= floor[form[0]]:
                found[form[0]].append(form)
                floor[form[0]] = form[2]
            continue
        at = last - back
        if kind == "ip":
            at, low = at + 1, floor[kind]
            if at <= low:
                continue
        else:
            low = floor[kind]
            if at < low:
                continue
        form = _PARSERS[kind](text, at, low)
        if form:
            floor[kind] = form[1]
            if form[2]:
                found[kind].append((kind, form[0], form[1]))
        elif kind == "ip":  # too short a chain: none of its numbers can begin another
            floor[kind] = _dotted.match(text, _left(text, at, low, _DIGIT)).end()
    for anchor in _country.finditer(text):
        if anchor.start() >= floor["iban"] and (end := iban(text, anchor.start())):
            found["iban"].append(("iban", anchor.start(), end))
            floor["iban"] = end
    return [s for k in KINDS for s in found[k]]


def masked(text: str) -> str:
    """The text with every span replaced by its kind's mark; overlapping spans become one mark,
    that of the first and then longest."""
    out, at = [], 0
    for kind, start, end in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], MARKS[kind]]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    A null or empty text has no spans. Repeated rows are answered each; further columns are not read.
    """
    def row(text: str) -> tuple:
        got = spans(text)
        base = [s for s in got if s[0] in BASE]
        return (*(sum(s[0] == k for s in base) for k in BASE), digest(base), written(got))

    columns = {f"n_{k}": "long" for k in BASE} | {"base_sha256": "string", "spans": "string"}
    return scan(docs, columns, row)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data in ``text`` masked; null texts stay null."""
    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: t if t is None else masked(t))

    return docs.withColumns({"text": mask(F.col("text").cast("string"))})
