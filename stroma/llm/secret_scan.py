"""Secrets in texts, by assignment-aware lexing.

Three plain patterns give the base spans. Beside them the text is lexed, in one pass,
as source or configuration: names, assignment signs, quoted, triple-quoted and bare
literals, calls, options, brackets, section headers and indentation. An assignment gives
its name its literals: ``name = "x"``, ``name: x``, ``"name": "x"``, ``name := x``,
``name => x``, ``export NAME=x``, ``set_name("x")``, ``--name x``, literals over several lines
in brackets or triple quotes, and indented blocks behind ``|`` or ``>``. What encloses an
assignment (a section, an indented key, a key before a bracket) belongs to its name.
Comments and strings that nothing is assigned are lexed like the rest, as they may hold
assignments, too.

A name that is assigned another name passes its own name on to the other's literals,
through any number of steps, and concatenated literals are judged both alone and
together. A literal is a secret if what it was given to sounds sensitive and it looks
like a value. All of it takes linear time.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stroma.llm.shared import annotate, ship_package

# Fixed patterns of the base spans.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 8
_WORDS = re.compile(r"password|passwd|secret|token|apikey|api_key", re.I | re.A)

# Names and literals of any length; what is matched possessively isn't tried again, so that the time is linear.
NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_QUOTED = r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\n]*+`"
_BARE = r"[A-Za-z0-9_./+\-$@%^&*~]++(?:[!?#|]++[A-Za-z0-9_./+\-$@%^&*~]++)*+=*"
#: What the scan stops at; all else is passed over. A word is read whole; its name begins at its first segment without a leading digit.
TOKEN = re.compile(
    rf"""(?P<line>\n[ \t]*+(?:-[ \t]++)?)|(?P<word>[A-Za-z0-9_.\-]++)|(?P<key>[\"'](?P<quoted>{NAME})[\"'](?=[ \t]*+(?::|=)))|(?P<sign>:=|=>|=(?!=)|:(?![:/]))|(?P<open>[{{(\[])|(?P<close>[}})\]])|(?P<blank>[ \t]++)|(?P<other>.)""",
    re.A | re.S,
)
_LEADING = re.compile(r"(?:[0-9][A-Za-z0-9_]*+|[.\-])*+", re.A)
TRIPLE = re.compile(r"(\"{3}|'{3})")
TERM = re.compile(rf"{_QUOTED}|{_BARE}", re.A)
STRING = re.compile(_QUOTED, re.A)
PLUS = re.compile(r"[ \t]*+\+\s*+")
BLANK, SPACE = re.compile(r"[ \t]*+"), re.compile(r"\s*+")
BLOCK = re.compile(r"[|>][+\-0-9]*+[ \t]*+(?=\n)")
SECTION = re.compile(r"\[{1,2}([^\[\]\n]++)\]{1,2}[ \t\r]*+(?=\n|\Z)")
SPACED, LINE = re.compile(r"\s"), re.compile(r"[^\s](?:[^\n\r]*[^\s])?")
REST_OF_NAME = re.compile(NAME, re.A)
_SIGN = re.compile(r"[A-Za-z0-9_.\-\"'][ \t]*+[:=(]|--")
#: A bare word without digits is a constant; if its parts are on average not so long, it may be a value as well.
PARTS_OF_NAMES = (3, 15)

# Fixed weights of the words in a target's name.
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 3, "apikey": 3, "credential": 3, "credentials": 3,
    "auth": 2, "authorization": 2, "bearer": 2, "private": 2, "key": 1, "api": 1, "access": 1, "signing": 2, "signature": 1, "session": 1,
    "cookie": 1, "salt": 2, "pin": 2, "client": 1, "encryption": 2, "master": 1, "webhook": 1, "oauth": 2, "jwt": 3,
}
HARMLESS = {"public": -3, "example": -3, "test": -1, "name": -2, "length": -3, "count": -3, "file": -2, "path": -2, "url": -2, "type": -3, "id": -1, "expiry": -3, "expires": -3, "hint": -3, "policy": -3}
PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|your|change.?me|placeholder|\$\{|\{\{|example|none|null|true|false")
THRESHOLD = 4.0
_KINDS_OF_CHARACTERS = [re.compile(k) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points; kinds: 0 assign, 1 access, 2 hex."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST] if _WORDS.search(text) else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


@lru_cache(4096)
def name_score(name: str) -> float:
    """Sum of the weights of the words that a name is made of."""
    return float(sum(SENSITIVE.get(w, 0) + HARMLESS.get(w, 0) for w in (p.lower() for p in _PART.findall(name))))


def literal_score(value: str) -> float:
    """How much a literal looks like a secret value: its length, kinds of characters and entropy."""
    if len(value) < LEAST or PLACEHOLDER.search(value) or "<" in value and ">" in value[value.index("<") :] or any(c.isspace() for c in value):
        return -math.inf
    kinds = sum(bool(k.search(value)) for k in _KINDS_OF_CHARACTERS)
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))
    return 0.5 * (kinds - 1) + 0.4 * (entropy - 2) + (0.5 if n >= 16 else 0)


def like_a_name(word: str) -> bool:
    """Whether a word of letters, dots, dashes and underscores reads as a name: a constant, not a value."""
    parts = _PART.findall(word)
    return bool(parts) and PARTS_OF_NAMES[0] <= sum(map(len, parts)) / len(parts) <= PARTS_OF_NAMES[1]


Place = tuple[int, int]
#: A dotted name: a hash that can be extended by a further part, and the sum of the weights of its words.
Path = tuple[int, float]
_PRIME = 2**128 - 159


def longer(path: Path, name: str) -> Path:
    """``path`` with one more part, in time of the part alone."""
    raw = (f".{name}" if path != NO_PATH else name).encode()
    return (path[0] * pow(256, len(raw), _PRIME) + int.from_bytes(raw, "big")) % _PRIME, path[1] + name_score(name)


NO_PATH: Path = (0, 0.0)


class Lexer:
    """One pass over a text: ``pairs`` of a name, its path and the literals it was given; ``given``: constant -> names and paths it was given to; ``own``: the score of each by itself.

    Names, paths and constants are hashes, as paths may be as long as brackets are deep.
    """

    def __init__(self, text: str):
        self.text, self.pairs, self.given, self.own = text, [], defaultdict(set), {}
        self.section = NO_PATH
        #: What encloses the place read: (path, indentation, False) of an indented key, or (path, -1, True) of a bracket.
        self.scopes: list[tuple[Path, int, bool]] = []
        self.indent = 0
        self._scan()

    def _enter(self, name: str, indent: int, bracket: bool) -> None:
        around = self._around()
        self.scopes.append((longer(around, name) if name else around, indent, bracket))

    def _around(self) -> Path:
        return self.scopes[-1][0] if self.scopes else self.section

    def _scan(self) -> None:
        text, at, end = self.text, self._line(0), len(self.text)
        held, adjacent = "", False  # the name before the place, which a sign may follow, and whether it ends there
        while at < end:
            m = TOKEN.match(text, at)
            kind, first, at = m.lastgroup, m.start(), m.end()
            if kind == "blank":
                adjacent = False
                continue
            name, held = held, ""
            if kind == "line":
                self.indent = at - first - 1
                at = self._line(at)
            elif kind == "word":
                skip = _LEADING.match(text, first, at).end()
                if text.startswith("--", first) and (first == 0 or text[first - 1].isspace()):
                    at = self._option(first, at)
                elif skip < at:
                    held, adjacent = text[skip:at], True
            elif kind == "key":
                held, adjacent = m["quoted"], False
            elif kind == "sign" and name:
                at = self._value(name, at)
            elif kind == "open":
                if m[0] == "(" and name and adjacent:
                    self._call(name, at)
                self._enter("", -1, True)
            elif kind == "close":
                while self.scopes and not self.scopes.pop()[2]:
                    pass

    def _line(self, at: int) -> int:
        """At a line's first character: leaves the keys that don't enclose it, and at an empty line the brackets; reads a section header."""
        text = self.text
        if at >= len(text):
            return at
        if text[at] in "\n\r":
            self.scopes = [s for s in self.scopes if not s[2]]
        elif text[at] != "#":
            while self.scopes and not self.scopes[-1][2] and self.scopes[-1][1] >= self.indent:
                self.scopes.pop()
        if text[at] == "[" and (header := SECTION.match(text, at)):
            self.section, self.scopes = longer(NO_PATH, header[1].strip("\"' \t")), []
            return header.end()
        return at

    def _named(self, name: str) -> tuple[int, int]:
        """The name itself, and with all that encloses it, the section first."""
        both = longer(NO_PATH, name), longer(self._around(), name)
        self.own.update(both)
        return both[0][0], both[1][0]

    def _give(self, name: str, places: list[Place], at: int) -> int:
        """Notes the literals, which end at ``at``; gives where to go on: within the first with white space, which is no value but may hold assignments, else behind them."""
        if places:
            self.pairs.append((*self._named(name), places))
        return next((s for s, e in places if SPACED.search(self.text, s, e)), at)

    def _term(self, name: str, m: re.Match) -> Place | None:
        """The place of a literal; a bare word without digits is a constant, one that doesn't read as a name may be a value as well."""
        raw, s, e = m[0], m.start(), m.end()
        if raw[0] in "\"'`":
            return s + 1, e - 1
        if REST_OF_NAME.fullmatch(raw) and not any(c.isdigit() for c in raw):
            constant, score = longer(NO_PATH, raw)
            self.own[constant] = score
            self.given[constant].update(self._named(name))
            if like_a_name(raw):
                return None
        return s, e

    def _value(self, name: str, at: int) -> int:
        """Reads what stands behind an assignment sign; gives where it ends."""
        text = self.text
        at = BLANK.match(text, at).end()
        if at >= len(text) or text[at] in "\n\r":
            self._enter(name, self.indent, False)
            return at
        if block := BLOCK.match(text, at):
            return self._block(name, block.end())
        if text[at] in "{[":
            self._enter(name, -1, True)
            return at + 1
        if text[at] == "(":
            return self._strings(name, at + 1)
        places: list[Place] = []
        while True:
            if (quote := TRIPLE.match(text, at)) and (close := text.find(quote[0], at + 3)) >= 0:
                places += [m.span() for m in LINE.finditer(text, at + 3, close)]
                at = close + 3
            elif m := TERM.match(text, at):
                place = self._term(name, m)
                if place:
                    places.append(place)
                at = m.end()
            else:
                break
            more = PLUS.match(text, at)
            if not more:
                break
            at = more.end()
        return self._give(name, places, at)

    def _strings(self, name: str, at: int) -> int:
        """Strings in parentheses, over lines, joined by white space or plus signs; the bracket stays open for what else it holds."""
        text, places, start = self.text, [], at
        while True:
            spot = SPACE.match(text, at).end()
            spot = more.end() if (more := PLUS.match(text, spot)) and places else spot
            m = STRING.match(text, spot)
            if not m:
                break
            places.append((m.start() + 1, m.end() - 1))
            at = m.end()
        self._enter(name, -1, True)
        return self._give(name, places, at) if places else start

    def _block(self, name: str, at: int) -> int:
        """The lines behind the key that are indented farther than it; each is a literal, and all together."""
        text, places = self.text, []
        while at < len(text) and text[at] == "\n":
            s = BLANK.match(text, at + 1).end()
            e = text.find("\n", s)
            e = len(text) if e < 0 else e
            if s < e and s - at - 1 <= self.indent:
                break
            e2 = e - 1 if e > s and text[e - 1] == "\r" else e
            if s < e2:
                places.append((s, e2))
            at = e
        return self._give(name, places, at)

    def _call(self, name: str, at: int) -> None:
        """Notes the string of ``name("x")``; what it holds is lexed, too."""
        m = STRING.match(self.text, BLANK.match(self.text, at).end())
        if m and self.text.startswith(")", BLANK.match(self.text, m.end()).end()):
            self._give(name[3:].lstrip("_") if name.startswith("set") and len(name) > 3 else name, [(m.start() + 1, m.end() - 1)], at)

    def _option(self, first: int, past: int) -> int:
        """``--name value`` or ``--name=value``; a dash more or a digit makes no option."""
        name = REST_OF_NAME.fullmatch(self.text, first + 2, past)
        if not name:
            return past
        if past < len(self.text) and self.text[past] in " =" and (m := TERM.match(self.text, past + 1)):
            place = self._term(name[0], m)
            return self._give(name[0], [place] if place else [], m.end())
        return past


def best_scores(own: dict, given: dict) -> dict:
    """For each name the best score among its own and those of the names it was given to, step by step.

    Names are taken by falling score; each passes its score on to the constants given to
    it that have none yet. So every assignment is looked at once, cycles included.
    """
    holds: dict = defaultdict(list)
    for constant, names in given.items():
        for n in names:
            holds[n].append(constant)
    best: dict = {}
    for name in sorted(own, key=lambda n: -own[n]):
        todo = [name]
        while todo:
            n = todo.pop()
            if n not in best:
                best[n] = own[name]
                todo += holds.get(n, ())
    return best


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the literals that are given to sensitive names."""
    if not _SIGN.search(text):
        return []
    lexer = Lexer(text)
    best = best_scores(lexer.own, lexer.given)
    found: set[Place] = set()
    for name, path, places in lexer.pairs:
        score = max(best[name], best[path])
        if score < 2:
            continue
        parts = [text[s:e] for s, e in places]
        if len(parts) > 1 and score + literal_score("".join(parts)) >= THRESHOLD:
            found.update((s, e) for s, e in places if e > s)
        else:
            found.update(p for p, value in zip(places, parts) if score + literal_score(value) >= THRESHOLD)
    return [(s, 3, e) for s, e in sorted(found)]


KINDS = ("assign", "access", "hex", "lexed")


def spans(text: str) -> list[tuple[int, int, int]]:
    """All spans by start and kind; a lexed one that lies within a base span isn't repeated, one that reaches beyond it stands beside it."""
    base = sorted(base_spans(text))
    starts, ends = [s for s, _, _ in base], []
    for _, _, e in base:
        ends.append(max(e, ends[-1]) if ends else e)  # the farthest end so far

    def beyond(span: tuple[int, int, int]) -> bool:
        before = bisect_right(starts, span[0])  # base spans that start no later
        return not before or ends[before - 1] < span[2]

    return sorted(base + [x for x in lexed_spans(text) if beyond(x)])


def scan(docs: DataFrame, out: str = "secrets") -> DataFrame:
    """``docs`` and an array column ``out`` of structs (kind, start, end) by start, then kind; places in code points, end exclusive.

    Every row comes back with all its columns (one called ``out`` is replaced). Null and
    empty texts have none. Base spans are always all there; lexed ones add to them.
    """
    place = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def compute():
        def function(column):
            found = [spans(t) if t else [] for t in (x.as_py() for x in column)]
            return [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], pa.list_(place))]

        return function

    name = f"_{out}_struct"
    while name in docs.columns:
        name += "_"
    return annotate(docs, name, "spans: array<struct<kind: string, start: bigint, end: bigint>>", compute).withColumn(out, F.col(name)["spans"]).drop(name)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans by one. All rows and columns stay."""
    ship_package(docs.sparkSession)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            at = batch.schema.names.index("text")
            texts = []
            for x in batch.column(at):
                t = x.as_py()
                cut = spans(t) if t else []
                if cut:
                    parts, to = [], 0
                    for s, _, e in cut:
                        if s >= to:
                            parts += [t[to:s], mark]
                        to = max(to, e)
                    t = "".join([*parts, t[to:]])
                texts.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 :]], columns)

    return docs.mapInArrow(run, docs.schema)
