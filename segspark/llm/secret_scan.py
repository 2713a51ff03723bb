"""Secret scans by assignment-aware lexing.

Three base patterns are searched for everywhere. Beyond them, texts are lexed as source or configuration. Heads are names with
an assignment: ``name =``, ``name :=``, ``name:``, ``"name":``, ``x["name"] =``, ``name: type =``, ``f("name",``, ``<name>``. What
follows a head is read as an expression: quoted strings of any length with escapes, triple-quoted ones, block scalars,
concatenations, lists, calls and their arguments, alternatives, with comments in between; or as a bare literal. A name also
stands for the names that enclose it, by braces, indentation, elements or the call whose named argument it is. Setters
(``setName(...)``), option flags (``--name value``), ``name ?=`` and ``name <-`` assign as well, and ``Bearer`` and the like before
a literal belong to its name. ``name = other`` passes the literals of ``other`` on, wherever in the text they are assigned. Literals are scored by the most sensitive name that holds them and by their own make-up;
those that reach the threshold are spans of kind ``literal`` (one for each part of a concatenation), unless a base span covers them.
Quoted literals with spaces count under strong names (a word of weight 3) that don't describe something (a hint, a label); a name
within a line of prose before a colon isn't enough for them. Private keys are found by their BEGIN line, whatever holds them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segspark.llm.common import map_texts, slices


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), f"{_either_case('api')}_?{_either_case('key')}"])
_ASSIGN = re.compile(f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # the maximal runs of 24 or more, as [0-9a-f]+ finds them
_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
KINDS = ("assign", "access", "hex", "literal")

#: Weights of words in names. Fixed values of this scanner.
SENSITIVE = {"password": 3, "passwd": 3, "pwd": 3, "pass": 3, "pw": 3, "authorization": 2, "passphrase": 3, "secret": 3, "secrets": 3, "passwords": 3, "token": 2, "tokens": 2, "credential": 3, "credentials": 3, "apikey": 3, "auth": 2, "bearer": 2, "private": 2, "signing": 1, "encryption": 1, "access": 1, "api": 1, "client": 1, "key": 1, "salt": 1, "cookie": 1, "session": 1, "dsn": 1}
_ANY_SENSITIVE = re.compile("|".join(SENSITIVE), re.I)  # without such a word no name has a score
#: Words beside ``pass`` that make it another noun; words of names whose literals tell about a secret. Fixed values of this scanner.
OTHER_PASS = {"first", "second", "third", "last", "next", "one", "two", "three", "multi", "single", "render", "band", "low", "high", "filter", "through", "test", "shader", "boarding"}
DESCRIBING = {"hint", "prompt", "label", "message", "msg", "error", "help", "description", "desc", "title", "text", "placeholder", "url", "uri", "path", "file", "filename", "dir", "name", "policy", "rule", "rules", "type", "format", "encoding", "question", "note", "comment", "usage", "header", "doc", "algorithm", "mode"}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_PLACEHOLDERS = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|\$\w+|\$\(.*\)|none|null|true|false|changeme|example.*|(?:your|enter|insert|choose)[-_ ].*|todo|redacted)$", re.I)

_NAME = r"[A-Za-z_$][\w$.-]*+"
_COMMENT = r"/\*(?:(?!\*/|/\*).)*+\*/"
_GAP = rf"(?:[ \t]|{_COMMENT})*+"
# Types in declarations: names with bracketed parts, three deep, and unions of them. No part holds a colon, so that work stays linear.
_INNER = r"[\w$.,|?&'\" \t]"
_BRACKETS = rf"(?:<{_INNER}*+>|\[{_INNER}*+\])"
for _ in range(2):
    _BRACKETS = rf"(?:<(?:{_INNER}|{_BRACKETS})*+>|\[(?:{_INNER}|{_BRACKETS})*+\])"
_ATOM = rf"(?:&(?:'\w+[ \t]+)?)?[A-Za-z_$][\w$.]*+{_BRACKETS}*+\??"
_TYPED = rf"[?!]?[ \t]*:[ \t]*(?P<type>{_ATOM}(?:[ \t]*\|[ \t]*{_ATOM})*+)(?:[ \t]*=(?=[ \t]*[\"'])|[ \t]+=(?=[ \t]))"
#: A head, a setter, an option flag, a brace, or an element's tag. indent: what is before a name that begins its line.
_HEAD = re.compile(
    rf"""(?:^(?P<indent>[ \t]*+)(?:-[ ]|export[ ])?|(?<![\w$.-]))["']?(?P<name>{_NAME})["']?\]?(?:{_TYPED}|{_GAP}(?P<op>=>|:=|\?=|<-(?!-)|=(?!=)|:(?!:)))"""
    rf"""|(?<![\w$])(?P<setter>(?:set|with|use)(?:_|(?=[A-Z]))\w++)(?=[ \t]*\()|(?<![\w-])--(?P<flag>[A-Za-z][\w-]*+)(?:=|[ \t]++)"""
    rf"""|\([ \t]*(?P<q>["'])(?P<arg>{_NAME})(?P=q)[ \t]*,|(?P<brace>[{{}}])|<(?P<close>/?)(?P<tag>[A-Za-z_][\w.-]*+)(?:[ \t][^<>]*+)?>""",
    re.M | re.S,
)
_SPACES = re.compile(rf"(?:[ \t]|\\\r?\n|{_COMMENT})*+", re.S)
_WHITE = re.compile(rf"(?:\s|\\\r?\n|{_COMMENT})*+", re.S)
_LINE_COMMENT = re.compile(r"(?://|#)[^\n]*+\n")
_QUOTED = re.compile(r"""[rRbBuUfF]{0,2}(?:(?P<t>\"{3}|'{3})|(?P<q>["'])(?P<body>(?:(?!(?P=q))[^\\\n]|\\.)*+)(?P=q)|`(?P<back>[^`]*+)`)""", re.S)
_CALL = re.compile(r"(?:(?:new|await)[ \t]+)?[A-Za-z_$][\w$.]*+[(\[]|[(\[]")
_ARGUMENT = re.compile(r"(?P<named>[A-Za-z_]\w*+)[ \t]*=[ \t]*(?=[\"'`A-Za-z_(\[])")
_SCHEME = re.compile(r"(?:[Bb]earer|[Bb]asic|[Tt]oken)[ \t]++(?=[A-Za-z0-9+/_.=~-]{6})")
_KEY_LINE = re.compile(r"-----(BEGIN|END) (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----")
_KEY_RUN = re.compile(r"[A-Za-z0-9+/=]{32}")
_KEY_REST = re.compile(r"(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{16,}+)*+")
_BARE = re.compile(r"[A-Za-z0-9+/_.=$~-]++")
_LINE_VALUE = re.compile(r"[^\s\"'`]\S*+")
_JOIN = re.compile(r"\+|\.(?=[ \t]*[\"'])|&(?!&)")
_OR = re.compile(r"\|\||\?\?|or\b")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*$")
_BLOCK = re.compile(r"[|>][+-]?[ \t]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three base patterns, leftmost and non-overlapping within each kind; end is exclusive."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@lru_cache(maxsize=4096)
def name_score(name: str) -> int:
    words = {w.lower() for w in _WORDS.findall(name)}
    if "pass" in words and words & OTHER_PASS:
        words.discard("pass")
    return sum(SENSITIVE.get(w, 0) for w in words)


@lru_cache(maxsize=4096)
def _describes(name: str) -> bool:
    return any(w.lower() in DESCRIBING for w in _WORDS.findall(name))


def key_spans(text: str) -> list[tuple[int, int, str]]:
    """Private keys: from a BEGIN line to the END line after it, or to the end of the encoded lines where none follows."""
    marks = list(_KEY_LINE.finditer(text))
    found = []
    for m, after in zip(marks, [*marks[1:], None]):
        if m[1] == "BEGIN":
            end = after.end() if after and after[1] == "END" else _KEY_REST.match(text, m.end()).end()
            if _KEY_RUN.search(text, m.end(), end):
                found.append((m.start(), end, "literal"))
    return found


def literal_score(literal: str) -> float:
    """Up to 2 for a literal that looks random: bits a character, and several kinds of characters."""
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, bits / 3.5) + (0.5 if kinds > 1 else 0) + (0.5 if any(c.isdigit() for c in literal) else 0)


def _over_lines(text: str, at: int, known: dict[int, int]) -> int:
    """The place after white space and comments; ``known`` holds it for each line comment seen, so that none is passed twice."""
    passed = []
    while True:
        at = _WHITE.match(text, at).end()
        m = _LINE_COMMENT.match(text, at)
        if not m or at in known:
            break
        passed.append(at)
        at = m.end()
    at = known.get(at, at)
    known.update(dict.fromkeys(passed, at))
    return at


def _expression(text: str, at: int, known: dict[int, int], calls: bool = True) -> tuple[list[list[tuple[int, int, bool]]], int]:
    """Operands of the expression at ``at``, each a list of joined parts (start, end, quoted), and where it ends. ``calls``: look into
    calls and lists; their named arguments are operands (to 32 calls deep, so that nested ones aren't read over and over), but not those
    whose names describe something."""
    found, parts, depth, wanted, told = [], [], 0, True, False
    while True:
        at = _over_lines(text, at, known) if depth or wanted and parts else _SPACES.match(text, at).end()
        if wanted:
            if m := _QUOTED.match(text, at):
                if m["t"]:
                    end = text.find(m["t"], m.end())
                    if end < 0:
                        break
                    parts.append((m.end(), end, True))
                    at = end + 3
                else:
                    parts.append((*(m.span("body") if m["q"] else m.span("back")), True))
                    at = m.end()
            elif 0 < depth <= 32 and (m := _ARGUMENT.match(text, at)):
                told, at = _describes(m["named"]), m.end()
                continue
            elif calls and (m := _CALL.match(text, at)):
                depth, at = depth + 1, m.end()
                continue
            elif m := _BARE.match(text, at):
                parts.append((*m.span(), False))
                at = m.end()
            elif depth and text[at : at + 1] in (")", "]"):
                depth, at = depth - 1, at + 1
            else:
                break
            wanted = False
        elif m := _JOIN.match(text, at):
            wanted, at = True, m.end()
        elif depth and text[at : at + 1] in ('"', "'") and parts and parts[-1][2]:
            wanted = True  # strings side by side are one
        elif (m := _OR.match(text, at)) or depth and text[at : at + 1] == ",":
            found.append([] if told else parts)
            parts, wanted, told, at = [], True, told and bool(m), m.end() if m else at + 1
        elif depth and text[at : at + 1] in (")", "]"):
            depth, at = depth - 1, at + 1
        else:
            break
    return [*found, [] if told else parts], at


def _block(text: str, at: int, indent: int) -> list[tuple[int, int, bool]]:
    """The lines from ``at`` on that are further in than ``indent``: a block scalar."""
    parts = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        inner = line.lstrip(" \t")
        if inner and len(line) - len(inner) <= indent:
            break
        if inner:
            parts.append((end - len(inner), at + len(line.rstrip()), True))
        at = end + 1
    return parts


def _assignments(text: str) -> Iterator[tuple[str, int, list[list[tuple[int, int, bool]]], bool]]:
    """(name, score of the names that enclose it, operands, whether it may be prose) of every assignment in the text."""
    braces, lines, tags, awaited, known, bare_end, seen, set_end = [], [], [], None, {}, 0, 0, 0
    for m in _HEAD.finditer(text):
        if m.end() < bare_end:
            continue  # within a bare literal
        if m["brace"]:
            if m["brace"] == "{":
                braces.append(max(awaited[1] if awaited and awaited[0] == m.start() else 0, braces[-1] if braces else 0))
            elif braces:
                braces.pop()
            continue
        if m["setter"]:
            if m.start() >= set_end and name_score(m["setter"]):
                operands, set_end = _expression(text, m.end(), known)
                yield m["setter"], 0, operands, False
            continue
        if m["flag"]:
            if (value := _QUOTED.match(text, m.end())) and value["q"]:
                yield m["flag"], 0, [[(*value.span("body"), True)]], False
            elif (value := _LINE_VALUE.match(text, m.end())) and value[0][0] != "-":
                yield m["flag"], 0, [[(*value.span(), False)]], False
            continue
        if m["tag"]:
            if not m["close"] and not m[0].endswith("/>"):
                tags.append((m["tag"], m.end(), max(name_score(m["tag"]), tags[-1][2] if tags else 0)))
            elif m["close"] and tags and tags[-1][0] == m["tag"]:
                name, start, _ = tags.pop()
                inner = text[start : m.start()]
                if "<" not in inner and inner.strip():
                    start += len(inner) - len(inner.lstrip())
                    yield name, tags[-1][2] if tags else 0, [[(start, start + len(inner.strip()), True)]], False
            continue
        name, at = m["name"] or m["arg"], m.end()
        around = max(braces[-1] if braces else 0, tags[-1][2] if tags else 0)
        if lines:  # any line that isn't further in ends what is above it
            for line in text[seen : m.start()].splitlines():
                inner = line.lstrip(" \t")
                while inner and lines and lines[-1][0] >= len(line) - len(inner):
                    lines.pop()
        seen = m.start()
        after = _SPACES.match(text, at).end()
        if m["indent"] is not None:
            while lines and lines[-1][0] >= len(m["indent"]):
                lines.pop()
            around = max(around, lines[-1][1] if lines else 0)
            if m["op"] == ":" and text[after : after + 1] in ("\n", "\r"):
                lines.append((len(m["indent"]), max(name_score(name), around)))
                seen = after
                continue
            if m["op"] == ":" and (block := _BLOCK.match(text, after)):
                yield name, around, [_block(text, block.end(), len(m["indent"]))], False
                continue
            if m["op"] == "=" and after == at == m.start("op") + 1 and text[m.start("op") - 1] not in " \t/" and (bare := _LINE_VALUE.match(text, at)):
                bare_end = max(bare_end, bare.end())
                yield name, around, [[(*bare.span(), False)]], False  # NAME=value to the end of the word
        if text[after : after + 1] == "{":
            awaited = after, max(name_score(name), around)
            continue
        if m["type"] and any(c.isdigit() for c in m["type"]):  # what looks like a type may be a literal: name: literal = ...
            yield name, around, [[(*m.span("type"), False)]], False
        if scheme := _SCHEME.match(text, after):
            at, around = scheme.end(), max(around, name_score(name) + 1)
        operands, _ = _expression(text, at, known, calls=not m["arg"])
        bare_end = max([bare_end, *(end for parts in operands for _, end, quoted in parts if not quoted)])
        yield name, around, operands, m["op"] == ":" and m["indent"] is None and text[m.start("op") - 1] not in "\"'"


def _plain(name: str) -> str:
    return name.removeprefix("self.").removeprefix("this.")


def _covered(keys: list[tuple[int, int, str]], start: int, end: int) -> bool:
    k = bisect_right(keys, (start, float("inf"))) - 1
    return k >= 0 and keys[k][1] >= end


def lexed_spans(text: str, threshold: float = 4.0) -> list[tuple[int, int, str]]:
    """(start, end, "literal") of the literals whose names and make-up reach the threshold."""
    if not _ANY_SENSITIVE.search(text):
        return []
    literals: list[tuple[str, int, list[tuple[int, int, bool]], bool]] = []
    scores: dict[str, int] = {}
    for name, around, operands, prose in _assignments(text):
        name = _plain(name)
        scores[name] = max(scores.get(name, 0), name_score(name))
        literals += [(name, around, parts, prose) for parts in operands if parts]
    # An operand that is a name of this text passes on what that name holds: its score is at least that of the name it is assigned to.
    users = defaultdict(list)
    for name, around, parts, _ in literals:
        for start, end, quoted in parts:
            if not quoted and _IDENTIFIER.match(text[start:end]) and _plain(text[start:end]) in scores:
                users[_plain(text[start:end])].append((name, around))
    best = {n: max([s, *(a for _, a in users.get(n, ()))]) for n, s in scores.items()}
    sources = defaultdict(list)
    for source, targets in users.items():
        for target, _ in targets:
            sources[target].append(source)
    by_score = defaultdict(list)
    for n, s in best.items():
        by_score[s].append(n)
    done: set[str] = set()
    for s in sorted(by_score, reverse=True):
        waiting = by_score[s]
        while waiting:
            n = waiting.pop()
            if n not in done:
                done.add(n)
                best[n] = max(best[n], s)
                waiting += sources.get(n, ())
    found = set(key_spans(text))
    keys = sorted(found)
    for name, around, parts, prose in literals:
        score = max(best[name], around)
        if score < 2:
            continue
        own = [(a, b) for a, b, quoted in parts if quoted or not (_IDENTIFIER.match(text[a:b]) and _plain(text[a:b]) in scores)]
        if own and parts[0][2] and (scheme := _SCHEME.match(text, *own[0])):
            own[0], score = (scheme.end(), own[0][1]), score + 1
        literal = "".join(text[a:b] for a, b in own)
        if len(literal) < 6 or _PLACEHOLDERS.match(literal):
            continue
        if any(c.isspace() for c in literal):
            sure = score >= 3 and not prose and all(quoted for _, _, quoted in parts) and not _describes(name)
        else:
            sure = score + literal_score(literal) >= threshold
        if sure:
            found.update((a, b, "literal") for a, b in own if b > a and not _covered(keys, a, b))
    return sorted(found)


def spans(text: str | None, threshold: float = 4.0) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans, and all spans: with literals that no base span covers; both by start, then kind as listed."""
    if not text:
        return [], []
    base = base_spans(text)
    starts, ends = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    more = []
    for s in lexed_spans(text, threshold):
        k = bisect_right(starts, s[0])
        if not k or ends[k - 1] < s[1]:
            more.append(s)
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


_SPANS = "array<struct<start:long,end:long,kind:string>>"


def scan(docs: DataFrame, threshold: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (``id_col``, base, spans), a row for each row of ``docs``: arrays of (start, end, kind), in code points.

    Null and empty texts give empty arrays; ids may be null or repeated; other columns, whatever their names, are left out.
    ``base`` holds the spans of the three base patterns; ``spans`` holds these and what lexing adds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in slices(batches):
            both = [spans(t, threshold) for t in batch.column(1).to_pylist()]
            columns = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in x[k]] for x in both], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "base", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, base {_SPANS}, spans {_SPANS}").withColumnRenamed("id", id_col)


def listed(found: str):
    """The array column ``found`` as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, threshold: float = 4.0, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by ``mark``; overlapping spans become one. Null texts stay null."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for start, end, _ in spans(text, threshold)[1]:
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pa.array([clean(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == place else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return map_texts(docs, run, docs.schema)
