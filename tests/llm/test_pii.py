from __future__ import annotations

import hashlib
import random
import re

import pytest

from stallwise.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def fits(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    return {
        "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if fits(k, m.group())] for k, p in PATTERNS.items()}


def test_plain_spans_equal_the_patterns():
    r = random.Random(11)
    for alphabet in ("ab1.@_- +", "0123456789. -", "+()12 .-5@", "4 1-"):
        for _ in range(4000):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert pii.detected(text) == brute(text), text
    assert pii.detected("4111 1111 1111 1111")["card"] == [(0, 19)]


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("mail jo.b [at] mail dot com now", "email", "jo.b [at] mail dot com"),
        ("write to jo at mail dot example dot com please", "email", "jo at mail dot example dot com"),
        ("x (at) y.com", "email", "x (at) y.com"),
        ("jо@mаil.com", "email", "jо@mаil.com"),  # Cyrillic о and а
        ("call plus one five five five one two three four five six now", "phone", "plus one five five five one two three four five six"),
        ("at 192 dot 168 dot 1 dot 10 ok", "ip", "192 dot 168 dot 1 dot 10"),
        ("１２３.４.５.６", "ip", "１２３.４.５.６"),
        ("so " + "four " + "one " * 15, "card", "four " + "one " * 14 + "one"),
        ("j​o@ma​il.com", "email", "j​o@ma​il.com"),
    ],
)
def test_disguised_spans_map_back(text, kind, shown):
    plain, every = pii.spans(text)
    assert [text[a:b] for a, b in every[kind]] == [shown]
    assert not plain[kind]


SIGNS = [(f"{a}{o}{s}{sign}{s}{c}{a}", sign) for a in ("", " ") for o, c in ("[]", "()", "{}", "<>") for s in ("", " ") for sign in ("at", "@", "dot", ".")]


@pytest.mark.parametrize(
    "shown",
    ["jo.ann @ mail.example", "jo\t@\nmail.example", "jo at mail dot example", "jo@mail dot example"]
    + [f"jo{form}mail.example" if sign in ("at", "@") else f"jo@mail{form}example" for form, sign in SIGNS],
)
def test_each_form_of_an_address_is_found_alone(shown):
    text = f"to: {shown}, please"
    found = pii.spans(text)[1]
    assert [text[a:b] for a, b in found["email"]] == [shown]
    assert pii.redacted(text, found) == "to: [email], please"


@pytest.mark.parametrize("text", ["look at example.com dot", "one two three and four", "at the dot of it", "the un of dos", "naïve café über"])
def test_clean_texts_stay_clean(text):
    assert pii.listed(pii.spans(text)[1]) == ""


def test_every_normalised_character_keeps_its_source():
    r = random.Random(2)
    parts = ["jo", " at ", "[at]", " dot ", "x.com", "five five five five five", "і", "​", "１", "+1 ", " ", "\n"]
    for _ in range(500):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        t = pii.normalised(text)
        if t is not None:
            assert len(t.text) == len(t.starts) == len(t.ends)
            assert all(a < b for a, b in zip(t.starts, t.ends)) and t.starts == sorted(t.starts)
        plain, every = pii.spans(text)
        assert all(set(plain[k]) <= set(every[k]) for k in pii.KINDS)


@pytest.mark.parametrize("before,after", [('"', '"'), ("(", ")"), ("[", "]"), ("", "!"), ("", "?"), ("“", "”"), ("/", "/"), ("", ""), ("-", ";")])
def test_spelled_digits_whatever_stands_around_them(before, after):
    text = f"call {before}plus 4 4 2 0 7 oh seven nine 4 6 1{after} now"
    (start, end), = pii.spans(text)[1]["phone"]
    assert text[start:end] == "plus 4 4 2 0 7 oh seven nine 4 6 1"


def test_addresses_of_many_parts():
    text = "to a dot b dot c dot d dot e dot f at g1 dot h1 dot i1 dot j1 dot k1 dot l1 dot com today"
    (start, end), = pii.spans(text)[1]["email"]
    assert text[start:end] == text[3:-6]


def test_long_runs_are_read_once():
    for text in ("a" * 300_000, "1" * 300_000, "a.1" * 100_000, "+1" * 100_000, "@" * 200_000, "one " * 50_000, "a dot " * 50_000, "1 " * 100_000, "a.b" * 50_000 + " dot c"):
        pii.spans(text)


def test_query_columns_and_redaction(spark, documents, awkward, clashing, nothing):
    text = "a jo@x.example.com b 1.2.3.4 c [at] d"
    row = pii.find(documents([text])).first()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 0, 0)
    assert row["spans"] == "email:2:18,ip:21:28"
    assert row["base_sha256"] == hashlib.sha256(b"email:2:18,ip:21:28").hexdigest()
    hidden = pii.redact(documents([text])).first()
    assert hidden["text"] == "a [email] b [ip] c [at] d" and hidden["n_chars"] == len(hidden["text"])
    assert pii.find(awkward).count() == 16 and pii.find(clashing).where("other = 'own other'").count() == 16
    same = pii.redact(clashing)
    assert same.columns == clashing.columns
    assert sorted(map(repr, same.collect())) == sorted(map(repr, clashing.collect()))
    assert pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0
