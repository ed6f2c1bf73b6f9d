"""The assignment lexer on the syntaxes that it reads: which literals reach a sensitive name, directly or through constants."""

from __future__ import annotations

import random
import string
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ragmill.llm import secrets

SECRET = "Zk9#qLm2x8Vw"

DIRECT = [
    f'password = "{SECRET}"',
    f"password: '{SECRET}'",
    f'"client_secret": "{SECRET}"',
    f"export API_KEY={SECRET}",
    f'secret_key := "{SECRET}"',
    f"conf['auth_token'] = '{SECRET}'",
    f"$config->{{x}}; $dbPassword => '{SECRET}'",
    f'self.access_key = "{SECRET}"',
    f"PRIVATE-KEY = {SECRET}",
    f'signingKey= b"{SECRET}"',
]


@pytest.mark.parametrize("text", DIRECT)
def test_direct(text):
    found = [text[a:b] for a, b in secrets.lexed_spans(text)]
    assert found == [SECRET]


@pytest.mark.parametrize(
    "text",
    [
        f'name = "{SECRET}"',
        f'password_hint = "{SECRET}"',
        f'token_count = "{SECRET}"',
        'password = "changeme"',
        'password = "${DB_PASSWORD}"',
        'password = "<your password>"',
        "password = None",
        'password == "Zk9#qLm2x8Vw"',
        "the password is long, and the secret: keep it in mind always",
        'password = "aaaaaaaa"',
        "",
        "=",
        "password =",
    ],
)
def test_none(text):
    assert secrets.lexed_spans(text) == {}


def test_constants_are_followed():
    text = f'''
a = "{SECRET}"
b = a
c = b + "tail9#Xy"
other = "Qw3rTy!uiop"
api_token = c
'''
    found = {text[x:y] for x, y in secrets.lexed_spans(text)}
    assert found == {SECRET, "tail9#Xy"}


def test_the_latest_value_counts():
    text = f'key = "plain text"\nkey = "{SECRET}"\npassword = key\nkey = "Other9#zzQ"'
    assert {text[x:y] for x, y in secrets.lexed_spans(text)} == {SECRET}


def test_long_chains_and_texts():
    """A constant that a secret name receives through 3000 others, behind 200 KB of text."""
    chain = [f'v0 = "{SECRET}"'] + [f"v{i} = v{i - 1}" for i in range(1, 3000)] + ["db_password = v2999"]
    text = "word " * 40_000 + "\n" + "\n".join(chain)
    assert [text[x:y] for x, y in secrets.lexed_spans(text)] == [SECRET]


def test_spans_are_sound():
    """On random syntax: spans lie in the text, hold no quote, and are found again in the text repeated."""
    rnd = random.Random(3)
    parts = ["password", "x", " = ", ": ", '"', "'", SECRET, "\n", " + ", "api_key", "=", "{", "}", ",", " ", "\\", "é"]
    for _ in range(500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40)))
        spans = secrets.lexed_spans(text)
        for (a, b), score in spans.items():
            assert 0 <= a < b <= len(text) and secrets.THRESHOLD <= score <= 1.0
        again = secrets.lexed_spans(text + "\n;\n" + text)
        assert set(spans) <= set(again)


def test_scores():
    assert secrets.name_score("dbPassword") == 1.0 and secrets.name_score("api_key") == 1.0 and secrets.name_score("token_ttl") == 0.0 and secrets.name_score("title") == 0.0
    rnd = random.Random(1)
    for n in (8, 20, 40):
        strong = "".join(rnd.choices(string.ascii_letters + string.digits + "!#%", k=n))
        assert secrets.literal_score(strong) > secrets.literal_score("a" * n)


NAME = set(string.ascii_letters + string.digits + "_$.-")
FIRST = NAME - set(string.digits) - set(".-")
WHITE = " \t\n\r\x0b\x0c"
STOPS = set("\"',;(){}[]&?") | set(WHITE)


def read_target(t, i):
    """(name, end) of a target that begins at i, read character by character, or None."""
    if t[i] not in FIRST or (i and t[i - 1] in NAME):
        return None
    j = i
    while j < len(t) and t[j] in NAME:
        j += 1
    name, tries = t[i:j], 0
    while tries < 2 and j < len(t) and t[j] in "\"']":
        j, tries = j + 1, tries + 1
    while True:  # fewer marks may belong to the name when what follows is no sign of assignment; a mark never is one
        k = j
        while k < len(t) and t[k] in " \t":
            k += 1
        for sign in ("=>", ":=", "=", ":"):
            if t.startswith(sign, k) and t[k + len(sign) : k + len(sign) + 1] not in ("=", ":"):
                k += len(sign)
                while k < len(t) and t[k] in " \t":
                    k += 1
                return name, k
        return None


def read_term(t, i):
    """(kind, start, end, where to go on) of a term at i, or None. Kinds: quoted, name, bare."""
    j = i
    while j < len(t) and j - i < 2 and t[j] in "rbfu":
        j += 1
    while j > i and not (j < len(t) and t[j] in "\"'"):
        j -= 1
    for at in (j, i):
        if at < len(t) and t[at] in "\"'":
            k = at + 1
            while k < len(t) and t[k] not in (t[at], "\n"):
                if t[k] == "\\":
                    if k + 1 == len(t) or t[k + 1] == "\n":
                        break
                    k += 1
                k += 1
            if k < len(t) and t[k] == t[at]:
                return "quoted", at + 1, k, k + 1
    if i < len(t) and t[i] in FIRST:
        k = i
        while k < len(t) and t[k] in NAME:
            k += 1
        if k == len(t) or t[k] not in "+/=@!%^&*~([#":
            return "name", i, k, k
    if i < len(t) and t[i] not in STOPS and t[i] != "#":
        k = i
        while k < len(t) and t[k] not in STOPS:
            k += 1
        if k == len(t) or t[k] not in "([":
            return "bare", i, k, k
    return None


def read_all(t):
    known, found, i = {}, [], 0
    while i < len(t):
        target = read_target(t, i)
        if not target:
            i += 1
            continue
        name, at = target
        begin, end, refs, spans, quoted = at, at, [], [], False
        while term := read_term(t, at):
            kind, a, b, end = term
            quoted |= kind == "quoted"
            short = t[a:b].rpartition(".")[2]
            if kind == "name" and short in known:
                refs.append(known[short])
            else:
                spans.append((a, b))
            k = end
            while k < len(t) and t[k] in " \t":
                k += 1
            step = 1 if t.startswith("+", k) else 2 if t.startswith("..", k) else 0
            if not step:
                break
            k += step
            while k < len(t) and t[k] in " \t":
                k += 1
            at = k
        if refs or spans:
            known[name.rpartition(".")[2]] = len(found)
            found.append((name, refs, spans))
        i = begin if quoted else max(end, begin)
    return found


SYNTAX = st.lists(st.sampled_from(["password", "x", "r", "b", " ", " = ", ":", "=", "=>", ":=", '"', "'", "]", "[", "(", "+", " + ", "..", ".", "\\", "\n", "&", "?", "#", "9", "-", "é", ";", SECRET]), max_size=24).map("".join)


@settings(max_examples=3000, deadline=None)
@given(SYNTAX)
def test_against_a_lexer_by_characters(text):
    assert secrets.lex(text) == read_all(text)


@settings(max_examples=500, deadline=None)
@given(SYNTAX)
def test_spans_do_not_overlap(text):
    spans = sorted(secrets.lexed_spans(text))
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("part", ["token=ab1C&", "x=x", "password='", 'a="', 'k="v"+', "a='b=\"x\"+", "token:", "[token]=", 'secret="q=', "token=" + SECRET + "?"])
def test_a_megabyte_without_white_space(part):
    """Query strings and minified sources: seconds, not hours."""
    text = part * (1_000_000 // len(part))
    began = time.process_time()
    spans = sorted(secrets.lexed_spans(text))
    assert time.process_time() - began < 5
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("text", ["password = value.strip()", "token = tokens[0]", "secret=fetch('x')[0]"])
def test_calls_and_lookups_are_no_literals(text):
    assert secrets.lexed_spans(text) == {}


def test_query_strings():
    text = f"http://host/?user=me&token={SECRET.replace('#', '7')}&password=Ab3dEf6hIj"
    assert [text[a:b] for a, b in sorted(secrets.lexed_spans(text))] == [SECRET.replace("#", "7"), "Ab3dEf6hIj"]
