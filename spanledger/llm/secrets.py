"""Secrets by assignment-aware lexing.

A text's lines that hold an operator, a tag or a call are lexed as source and configuration: names, strings with their prefixes
and triple quotes, operators, tags. A small parser turns the tokens into name-literal pairs: assignments (also typed, ``:=`` and
to a subscript), entries of mappings, keyword arguments, calls with a name and a value, elements and attributes
of markup, block scalars. Strings that stand side by side or are joined by ``+`` are one literal of several parts. A name on the
right stands for the constant last assigned to it, or, where it is used first, for the one assigned next, over any
number of steps. A pair's score says how sensitive its name is (the words of the name) and how key-like its
literal is (length, kinds of characters, spread). Loose literals with the form of an access key or a long hex
string count too.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

from spanledger.llm.scan import digest, scan, written

BASE = ("assign", "access", "hex")
ADDED = ("literal", "constant")
KINDS = BASE + ADDED
SCORE = 1.0  # a pair counts from here on
SHORT = 8  # characters below which a literal's form says nothing and its name alone counts

# How far a word in a name points to a secret.
WORDS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.8, "private": 0.5,
    "signing": 0.5, "encryption": 0.5, "access": 0.4, "api": 0.4, "client": 0.2, "key": 0.4, "salt": 0.5,
}

_operator = re.compile("[:=]")
_named = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*\Z", re.I | re.A)
_bare = re.compile(r"\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_access = re.compile("AKIA[A-Z0-9]{16,}")
_hex = re.compile("[0-9a-f]{24,}")
_blanks = re.compile(r"[ \t]*+")
_word = re.compile(r"[^\s\"',;{}()\[\]]++")
_identifier = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*\Z", re.A)
_hint = re.compile(r"[:=<]|\([ \t]{0,8}[\"']")
_token = re.compile(
    r"""(?P<str>(?<![A-Za-z0-9_])(?:[bBfFrRuUL]{1,2}|[$@]{1,2})?(?:\"\"\"(?P<t1>(?:[^"\\]++|\\.|"(?!""))*+)\"\"\"|\'\'\'(?P<t2>(?:[^'\\]++|\\.|'(?!''))*+)\'\'\'|"(?P<q1>(?:[^"\\\n]++|\\.)*+)"|'(?P<q2>(?:[^'\\\n]++|\\.)*+)'))
    |(?P<tag><(?P<tagname>[A-Za-z_][A-Za-z0-9_.:\-]*+)[^<>\n]*+>(?=(?P<inner>[^<>]*+)</))
    |(?P<name>[A-Za-z_$][A-Za-z0-9_.$]*+(?:-[A-Za-z0-9_.$]++)*+)
    |(?P<op>:=|=>|==|!=|<=|>=|->|[=:+,()\[\]|>\\\n]|[^\s])""",
    re.X | re.S | re.A,
)
_parts = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_stand_in = re.compile(r"(?i)(?:(?:your|my|the|some|example|changeme|dummy|xxx+|todo|none|null|true|false)(?![a-z0-9])|\$|<|%)")
_type = re.compile(r"(?i)(?:str|string|int|bytes|bool|any|object)\Z")  # bare after a colon it declares the name
_told = re.compile(r"(?i)\b(?:your|my|the|enter|please|here|example|is|not|must|be)\b")  # a literal of several words that is prose
_block = re.compile(r"[ \t]*+[|>][+\-0-9]{0,2}[ \t]*+\n")
REACH = 160  # code points to the left of an operator in which its name must lie


def sensitivity(name: str) -> float:
    """How far a name points to a secret: the weights of its words together."""
    words = [w.lower() for w in _parts.findall(name)]
    return sum(WORDS.get(w, 0.0) for w in dict.fromkeys(words))


def keyness(literal: str) -> float:
    """How far a literal looks like a key: 0 for short or wordy ones, up to 1."""
    if len(literal) < SHORT or " " in literal or _stand_in.match(literal):
        return 0.0
    kinds = sum(bool(re.search(k, literal)) for k in _KINDS)
    spread = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    return _keyness(kinds, spread)


_KINDS = ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")


def _keyness(kinds: int, spread: float) -> float:
    return min(1.0, spread / 4) * (0.4 + 0.2 * kinds)


def _endings(text: str, starts: list[int], end: int) -> dict[tuple[int, int], float]:
    """``keyness`` of bare literals that all end at ``end``, in one pass from there to the first start."""
    out: dict[tuple[int, int], float] = {}
    held: Counter[str] = Counter()
    kinds: set[str] = set()
    total, at = 0.0, end  # total: the sum of n * log2(n) over the characters' counts
    for start in sorted(set(starts), reverse=True):
        for c in text[start:at]:
            n = held[c]
            if not n:
                kinds.add(next(k for k in _KINDS if re.match(k, c)))
            held[c] = n + 1
            total += (n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0)
        at, size = start, end - start
        plain = size < SHORT or _stand_in.match(text, start, end)
        out[start, end] = 0.0 if plain else _keyness(len(kinds), math.log2(size) - total / size)
    return out


def spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed in KINDS.

    ``assign`` spans reach from the sensitive name to the end of its value and do not overlap; a
    value under six characters is passed over. ``literal`` marks a literal whose pair scores, and
    ``constant`` one that reached a sensitive name through other names, where no base span covers it.
    """
    found = [("access", *m.span()) for m in _access.finditer(text)]
    found += [("hex", *m.span()) for m in _hex.finditer(text)]
    floor = 0
    for op in _operator.finditer(text):
        at = op.start()
        told = at  # where the blanks before the operator begin; those of one operator end no other's
        while told > floor and text[told - 1] == " ":
            told -= 1
        low = max(floor, told - REACH)
        head = text[low:told]
        named = _named.search(head)
        if named:
            value = _bare.match(text, at + 1)
            if value:
                if len(value.group(1)) >= 6:
                    found.append(("assign", low + named.start(), value.end()))
                floor = value.end()
    found += _scored(text, list(_pairs(text)), found)
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(found, key=lambda s: (s[1], rank[s[0]], s[2]))


_ASSIGN = ("=", ":=", "=>", ":")

Part = tuple[int, int, str]  # start, end, and what it is: "quoted", "bare" or "name"


def _pairs(text: str) -> Iterator[tuple[str, list[Part]]]:
    """Name-literal pairs of the lines that may hold one, in order; each character is lexed at most once."""
    done = 0
    ended = [0]  # where the last bare run of characters does
    for hint in _hint.finditer(text):
        if hint.start() >= done:
            yield from _statement(text, text.rfind("\n", done, hint.start()) + 1 or done, ended)
            done = ended.pop()
            ended = ended or [0]


def _left(recent: deque, op: str) -> str | None:
    """The name that an operator assigns to, from the tokens before it."""
    held = list(recent)
    if held and held[-1][0] == "]":  # a subscript, or a type with arguments
        depth, i = 0, len(held) - 1
        while i >= 0:
            depth += (held[i][0] == "]") - (held[i][0] == "[")
            if not depth:
                break
            i -= 1
        if i < 0:
            return None
        if i >= 3 and held[i - 1][0] == "name" and held[i - 2][0] == ":" and op != ":":
            held = held[:i]  # name : type [ ... ]
        else:
            return held[i + 1][1] if i + 3 == len(held) and held[i + 1][0] in ("name", "str") else None
    if not held or held[-1][0] not in ("name", "str"):
        return None
    if op != ":" and len(held) >= 3 and held[-1][0] == "name" and held[-2][0] == ":" and held[-3][0] in ("name", "str"):
        return held[-3][1]  # name : type
    return held[-1][1]


def _statement(text: str, start: int, ended: list[int]) -> Iterator[tuple[str, list[Part]]]:
    """Pairs of the line from ``start`` on, and of those that it goes on to; leaves its end in ``ended``, last."""
    recent: deque = deque(maxlen=12)  # (kind, text) of the tokens before
    target, parts, bare, open_, end = None, [], None, "", len(text)
    by, inside = "", 0  # the operator of the open pair, and brackets open since
    call: list = []  # after a bracket: a string, then a comma

    def value() -> Iterator[tuple[str, list[Part]]]:
        if target and any(p[2] == "quoted" for p in parts):
            yield target, parts
        elif target and bare:
            yield target, [(*bare, "bare")]

    at = start
    while token := _token.search(text, at):
        kind = token.lastgroup if token.lastgroup in ("name", "op") else "str" if token["str"] is not None else "tag" if token["tag"] is not None else token.lastgroup
        at = token.end()
        if kind == "op":
            kind = token["op"]
        if kind == "\n":
            if open_ and (inside or recent and recent[-1][0] in ("+", "\\", "=", ":=")):
                continue
            end = at
            break
        said = token.group()
        if kind == "str":
            group = next(g for g in ("t1", "t2", "q1", "q2") if token[g] is not None)
            span, said = token.span(group), token[group]
            if open_:
                parts.append((*span, "quoted"))
                open_ = "after"
            if len(call) == 2 and call[0] and _identifier.match(call[0]):
                yield call[0], [(*span, "quoted")]
            call = [said] if recent and recent[-1][0] == "(" else []
        elif kind == "tag":
            yield from value()
            target, parts, open_ = None, [], ""
            begin, stop = token.span("inner")
            inner = text[begin:stop]
            yield token["tagname"], [(begin + len(inner) - len(inner.lstrip()), begin + len(inner.rstrip()), "quoted")]
            # the attributes are lexed on their own
            at = token.start() + 1 + len(token["tagname"])
            call = []
        else:
            if kind == "," and len(call) == 1:
                call.append(",")
            else:
                call = []
            name = _left(recent, kind) if kind in _ASSIGN else None
            if open_ and by == ":" and kind != ":" and name and name == target:
                target, parts, open_ = None, [], ""  # that was its type
            elif open_ == "after" and kind == "+":
                open_ = "start"
            elif open_ and by == ":" and kind in ("[", "]", "name") and not any(p[2] == "quoted" for p in parts):
                parts, open_ = [], "after"  # perhaps a type with arguments
            elif open_ == "start" and kind == "name":
                parts.append((*token.span(), "name"))
                open_ = "after"
            elif open_ == "start" and kind == "(":
                inside += 1
            elif open_ and kind != "\\":
                yield from value()
                target, parts, open_ = None, [], ""
            if kind in _ASSIGN:
                block = _block.match(text, at) if kind == ":" and name else None
                if block:
                    lines, at = _indented(text, start, block.end())
                    if lines:
                        yield name, [(*line, "quoted") for line in lines]
                elif name:
                    target, parts, open_, by, inside, bare = name, [], "start", kind, 0, _bare_value(text, at, ended)
        recent.append((kind, said if kind in ("name", "str") else ""))
    yield from value()
    ended.append(max(end, start + 1))


def _bare_value(text: str, at: int, ended: list[int]) -> tuple[int, int] | None:
    """The run of characters after an operator; runs that end at one place are met once."""
    start = _blanks.match(text, at).end()
    if start >= ended[0] and (run := _word.match(text, start)):
        ended[0] = run.end()
    return (start, ended[0]) if start < ended[0] else None


def _indented(text: str, line: int, at: int) -> tuple[list[tuple[int, int]], int]:
    """The lines from ``at`` on that are indented further than the line at ``line``, without the blanks around each, and
    where they end."""
    own = _blanks.match(text, line).end() - line
    lines, end = [], at
    while end < len(text):
        begin = _blanks.match(text, end).end()
        if begin < len(text) and text[begin] != "\n" and begin - end <= own:
            break
        stop = text.find("\n", begin)
        stop = len(text) if stop < 0 else stop
        last = begin + len(text[begin:stop].rstrip())
        if last > begin:
            lines.append((begin, last))
        end = min(len(text), stop + 1)
    return lines, end


def _scored(text: str, pairs: list[tuple[str, list[Part]]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Literals of sensitive names, constants followed, that no base span covers."""
    covers = sorted((s, e) for _, s, e in base)
    ends, most = [], 0
    for _, e in covers:
        most = max(most, e)
        ends.append(most)
    starts = [s for s, _ in covers]

    def covered(start: int, end: int) -> bool:
        i = bisect_right(starts, start)
        return i > 0 and ends[i - 1] >= end

    bare: dict[int, list[int]] = {}
    names: dict[str, list[int]] = {}  # the pairs that assign to a name
    for k, (name, parts) in enumerate(pairs):
        names.setdefault(name, []).append(k)
        for start, end, kind in parts:
            if kind == "bare":
                bare.setdefault(end, []).append(start)
    forms: dict[tuple, float] = {}

    def form(spans_: tuple[tuple[int, int], ...]) -> float:
        if spans_ not in forms:
            (start, end), *more = spans_
            if not more and start in bare.get(end, ()):
                forms.update({(k,): v for k, v in _endings(text, bare[end], end).items()})
            else:
                forms[spans_] = keyness("".join(text[a:b] for a, b in spans_))
        return forms[spans_]

    def counts(weight: float, parts: list[Part]) -> bool:
        spans_ = tuple((a, b) for a, b, _ in parts)
        size, quoted = sum(b - a for a, b in spans_), parts[0][2] == "quoted"
        if quoted and weight >= SCORE and size <= REACH and any(" " in text[a:b] for a, b in spans_):
            words = "".join(text[a:b] for a, b in spans_)
            return size >= SHORT and not _stand_in.match(words) and not _told.search(words) and words.count(" ") + 1 <= size // 3
        if size >= SHORT:
            key = form(spans_)
            return weight + key >= SCORE and key > 0.3
        literal = "".join(text[a:b] for a, b in spans_)
        plain = not literal or " " in literal or _stand_in.match(literal) or (not quoted and _type.match(literal))
        return weight >= SCORE and not plain

    def resolved(k: int) -> list[tuple[Part, str]]:
        """The literals that a pair comes to, each with its kind; a name that leads back to itself has none."""
        out, seen, open_ = [], {k}, [(p, k, "literal") for p in reversed(pairs[k][1])]
        while open_:
            part, where, kind = open_.pop()
            start, end, what = part
            if what != "quoted" and end - start <= REACH and (known := names.get(text[start:end])):
                # the last assignment before, else the first after
                i = bisect_right(known, where - 1)
                target = known[i - 1] if i else next((x for x in known if x > where), None)
                if target is not None:
                    if target not in seen:
                        seen.add(target)
                        open_ += [(p, target, "constant") for p in reversed(pairs[target][1])]
                    continue
            if what != "name":
                out.append((part, kind))
        return out

    out: dict[tuple[int, int], str] = {}
    for k, (name, _) in enumerate(pairs):
        weight = sensitivity(name)
        if not weight:
            continue
        told = [(p, kind) for p, kind in resolved(k) if p[0] < p[1]]
        if told and not all(covered(p[0], p[1]) for p, _ in told) and counts(weight, [p for p, _ in told]):
            for p, kind in told:
                if not covered(p[0], p[1]):
                    out.setdefault(p[:2], kind)
    return [(kind, *value) for value, kind in out.items()]


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``.

    A null or empty text has no spans. Repeated rows are answered each; further columns are not read.
    """
    def row(text: str) -> tuple:
        got = spans(text)
        base = [s for s in got if s[0] in BASE]
        return (*(sum(s[0] == k for s in base) for k in BASE), digest(base), written(got))

    return scan(docs, {f"n_{k}": "long" for k in BASE} | {"base_sha256": "string", "spans": "string"}, row)
