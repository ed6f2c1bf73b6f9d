"""Secret scans: fixed patterns, and a lexer for assignments that follows constants.

The lexer reads name-value pairs of source and configuration syntax (`name = "literal"`, `"name": 'literal'`,
`name := other + "rest"`, `export NAME=bare`), keeps the literals of each name, carries them through later references, and
scores a literal by how sensitive the names that receive it are and by how secret-like it looks. Literals that reach
THRESHOLD add spans of kind `lexed`, which never overlap one another. In a bare value a `#` begins a comment only after white space; it
ends at `&` and `?`, as in query strings, and an identifier before `(` or `[` is a call or a lookup, no literal. Texts are read whole, in
time that is linear in their length.

Defined results: a null text is an empty one and has no spans; a null id is carried along; spans that tie in their start are in the
order of their kinds; repeated rows get a row each; an empty table gives no rows; only
the id and the text are read. Spans count code points; their end is exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of spans in the order that breaks ties; the first three are the fixed patterns.
KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 0.5

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

_TARGET = re.compile(r"""(?<![A-Za-z0-9_$.\-])([A-Za-z_$][A-Za-z0-9_$.\-]*+)["'\]]{0,2}[ \t]*+(?:=>|:=|[=:])(?![=:])[ \t]*+""", re.ASCII)
_TERM = re.compile(
    r"""(?:[rbfu]{1,2}(?=["']))?(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')"""
    r"""|([A-Za-z_$][A-Za-z0-9_$.\-]*+)(?![A-Za-z0-9+/=@!%^&*~(\[#])"""
    r"""|([^\s"',;#(){}\[\]&?][^\s"',;(){}\[\]&?]*+)(?![(\[])""",
    re.ASCII,
)
_PLUS = re.compile(r"[ \t]*+(?:\+|\.\.)[ \t]*+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(?:<.*>|\$?\{.*\}|%.*%|x{3,}|\*+|change_?me|example.*|your[_-].*|none|null|true|false|todo|redacted|placeholder)$")

#: How sensitive the parts of a name are, alone or in pairs.
NAME_PARTS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "token": 0.8, "auth": 0.5, "bearer": 0.7, "salt": 0.5, "pin": 0.5}
NAME_PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("master", "key"): 0.9, ("account", "key"): 0.8, ("pass", "word"): 1.0}
#: Last parts that tell of something about a secret rather than of the secret.
ABOUT = frozenset({"id", "name", "count", "length", "len", "size", "type", "path", "file", "url", "uri", "field", "label", "hint", "expiry", "ttl", "limit", "max", "min", "regex", "policy"})


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[-1] in ABOUT:
        return 0.0
    return max([0.0, *(NAME_PARTS.get(p, 0.0) for p in parts), *(NAME_PAIRS.get(x, 0.0) for x in zip(parts, parts[1:], strict=False))])


def literal_score(value: str) -> float:
    """0 to 1: length, bits of entropy per character and mixed kinds of characters raise it; prose and placeholders lower it."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or value.count(" ") > 3:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9 ]"))
    return max(0.0, min(1.0, 0.1 * entropy + 0.2 * kinds + min(n, 20) / 50) - 0.3 * (kinds == 1) - 0.15 * value.count(" "))


def lex(text: str) -> list[tuple[str, list[int], list[tuple[int, int]]]]:
    """Assignments in their order: the name, the earlier assignments that its value refers to, and its own literals' spans.

    A text is read once: behind a bare value the next target is looked for at its end. Only quoted literals are looked into, for the
    assignments that they hold.
    """
    known: dict[str, int] = {}
    found = []
    target = _TARGET.search(text)
    while target:
        earlier, spans, at, end = [], [], target.end(), target.end()
        quoted = False
        while term := _TERM.match(text, at):
            spans += [term.span(g) for g in (1, 2, 4) if term[g] is not None]
            quoted = quoted or term[1] is not None or term[2] is not None
            if term[3] is not None:
                if (short := term[3].rpartition(".")[2]) in known:
                    earlier.append(known[short])
                else:
                    spans.append(term.span(3))
            end = term.end()
            plus = _PLUS.match(text, end)
            if not plus:
                break
            at = plus.end()
        if spans or earlier:
            known[target[1].rpartition(".")[2]] = len(found)
            found.append((target[1], earlier, spans))
        target = _TARGET.search(text, target.end() if quoted else end)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def lexed_spans(text: str) -> dict[tuple[int, int], float]:
    """Literal spans with their scores. Names pass their score on to the constants that they are made of. Of spans that overlap (a literal
    and one within it) that of the higher score stays, then the earlier, then the longer."""
    if ":" not in text and "=" not in text:
        return {}
    found = lex(text)
    reach = [name_score(name) for name, _, _ in found]
    scored = []
    for i in range(len(found) - 1, -1, -1):
        for j in found[i][1]:
            reach[j] = max(reach[j], reach[i])
        for a, b in found[i][2] if reach[i] else ():
            if (score := reach[i] * literal_score(text[a:b])) >= THRESHOLD:
                scored.append((-score, a, -b))
    kept: list[tuple[int, int]] = []
    best: dict[tuple[int, int], float] = {}
    for score, a, b in sorted(scored):
        at = bisect.bisect(kept, (a, -b))
        if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or -b <= kept[at][0]):
            kept.insert(at, (a, -b))
            best[a, -b] = -score
    return best


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x in batch.column(1):
            text = x.as_py() or ""
            base, more = base_spans(text), lexed_spans(text)
            count = Counter(k for _, k, _ in base)
            every = sorted(base + [(a, 3, b) for a, b in more])
            rows.append((count[0], count[1], count[2], len(more), max(more.values(), default=0.0), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        kinds = [pa.int64()] * 4 + [pa.float64(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["__key", "n_assign", "n_access", "n_hex", "n_lexed", "top_score", "base_sha256", "spans"])


def scan_secrets(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts by kind, top_score, base_sha256 and spans (kind:start:end, comma-joined), a row for each input row."""
    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    out = rows.mapInArrow(_scan, f"__key {kind}, n_assign long, n_access long, n_hex long, n_lexed long, top_score double, base_sha256 string, spans string")
    return out.withColumnRenamed("__key", key)
