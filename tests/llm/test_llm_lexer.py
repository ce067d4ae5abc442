"""The secret lexer: syntax it reads, constants against following them one by one, time on long texts, extra columns."""

from __future__ import annotations

import random
import time

import pytest

from stroma.llm import secret_scan

V, W = "X9kLm2Qp7RtZ4vB1", "Kp4Qs8Zt2Lw6Hn0d"


def lexed(text: str) -> list[str]:
    return [text[s:e] for s, _, e in secret_scan.lexed_spans(text)]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (f"auth:\n  user: bob\n  value: {V}\nother: {W}", [V]),
        (f"auth:\n  # a comment\n  value: {V}\n\n  more: 1\n", [V]),
        (f'{{"credentials": {{"value": "{V}", "n": 3}}, "note": "{W}"}}', [V]),
        (f"[secret_store]\nvalue = '{V}'\n[paths]\nvalue = '{W}'", [V]),
        (f'private_token = """\n{V}\n{W}"""', [V, W]),
        (f"private_key: |\n  {V}\n  {W}\nnote: {V[::-1]}", [V, W]),
        ('db_pwd = ("X9kLm2Qp"\n   "7RtZ4vB1")', ["X9kLm2Qp", "7RtZ4vB1"]),
        ("clientPwd := 'p4ssW' + 'w0rd-Long9x'", ["p4ssW", "w0rd-Long9x"]),
        (f"// db_pwd = '{V}'\n/* jwt: {W} */", [V, W]),
        (f"don't say it's db_pwd = '{V}', isn't it", [V]),
        (f"a('db_pwd=\"{V}\"')", [V]),
        (f"note: 'set db_pwd={V} now'", [V]),
        (f"client.setPwdToken('{V}')", [V]),
        (f"run --auth-token={V} --name {W}", [V]),
        (f"x = 'a' + y\ndb_pwd = x\ny = '{V}'", [V]),
        (f"auth:\n  value: SHARED\n\nSHARED = '{V}'", [V]),
        (f"a = b\nb = a\njwt = a\nb = '{V}'", [V]),
        (f"db_pwd = 'your-{V}'\npassword_hint = '{V}'\npublic_example_key = '{V}'", []),
        (f"f(secret_sauce: [\n\nthen: {V}", []),
        (f"a:\n b:\n  jwt:\n   d:\n    e:\n     f:\n      g:\n       v: '{V}'", [V]),
        (f"jwt: {{a: {{b: {{c: {{d: {{e: '{V}'}}}}}}}}}}", [V]),
        ("jwt = qWeRtYuIoPaSdFgHjKlZxCvBnMqWeRtYuIoPaSdF", ["qWeRtYuIoPaSdFgHjKlZxCvBnMqWeRtYuIoPaSdF"]),
        ("jwt = getUserPasswordFromDatabase", []), ("jwt_pin = current_working_directory_of_the_service_that_is_to_be_started_by_the_host_of_it", []),
        ("db_pwd =", []), ("db_pwd = '", []), ('db_pwd = """', []), ("db_pwd: |", []), ("db_pwd = (", []), ("--", []), ("[a", []), ("", []),
    ],
)
def test_syntax(text, found):
    assert lexed(text) == found


def test_constants_are_followed_as_one_by_one():
    rng = random.Random(1)
    for _ in range(300):
        names = [f"n{chr(97 + k)}" for k in range(9)]
        own = {n: float(rng.randrange(5)) for n in names}
        given = {n: set(rng.sample(names, rng.randrange(3))) for n in names}
        got = secret_scan.best_scores(own, given)
        for n in names:
            seen, todo = set(), [n]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += given[x]
            assert got[n] == max(own[x] for x in seen)


def chain(n: int) -> str:
    name = lambda k: "v_" + "".join(chr(97 + int(c)) for c in str(k))
    return "\n".join(f"{name(k + 1)} = {name(k)}" for k in range(n)) + f"\ndb_pwd = {name(n)}\n{name(0)} = '{V}'"


@pytest.mark.parametrize("make", [chain, lambda n: "\n".join(f"token = {V}{k}\njwt_pin = '{V}{k}'" for k in range(n)), lambda n: "x: '" * n, lambda n: "a='b c=\"d e=`" * n, lambda n: "a:\n" + "".join(" " * (k % 50) + "b:\n" for k in range(n)), lambda n: "k: {" * n, lambda n: "[a]\nb: |\n c d=e\n" * n])
def test_time_is_linear(make):
    took = []
    for n in (8_000, 32_000):
        text = make(n)
        began = time.process_time()
        secret_scan.spans(text)
        took.append((time.process_time() - began) / len(text))
    assert took[1] < 2 * took[0] + 2e-7 and took[1] < 8e-6


def test_long_chain_is_followed():
    assert lexed(chain(20_000)) == [V]


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, f"db_pwd = '{V}'", "x", 2), (2, None, None, None)], "doc_id long, text string, _secrets_struct string, secrets int")
    got = secret_scan.scan(docs)
    assert sorted(got.columns) == sorted(docs.columns) and [r._secrets_struct for r in got.orderBy("doc_id").collect()] == ["x", None]
    assert secret_scan.redact(docs).columns == docs.columns


@pytest.mark.parametrize(
    ("text", "hidden"),
    [('password = "Zx9kLmQ2wX$7abYtR9pQvvKK"', "Zx9kLmQ2wX$7abYtR9pQvvKK"), ("api_key: abcdefgh!QWERTYsecretTAIL99", "abcdefgh!QWERTYsecretTAIL99"), ('"token": "abcdefgh,ijk$lmnopqr12"', "abcdefgh,ijk$lmnopqr12")],
)
def test_nothing_is_left_behind_a_base_span(spark, text, hidden):
    spans = secret_scan.spans(text)
    assert (text.index(hidden), 3, text.index(hidden) + len(hidden)) in spans and spans[0][1] == 0
    left = secret_scan.redact(spark.createDataFrame([(1, f"a {text} b")], "doc_id long, text string"), "#").first().text
    assert not any(hidden[k : k + 4] in left for k in range(len(hidden) - 3)) and left.startswith("a ") and left.endswith(" b")


def test_redacted_texts_have_no_character_of_a_span(spark):
    rng = random.Random(4)
    names = ["password", "db_pwd", "token", "jwt", "secret_key", "note", "api_key", "auth"]
    value = lambda: "".join(rng.choice("abcXYZ0189$!,+/=_-#") for _ in range(rng.randint(3, 40)))
    texts = []
    for _ in range(400):
        quote = rng.choice(["", '"', "'"])
        texts.append(rng.choice(["", "x\n", "auth:\n  "]) + " ".join(f"{rng.choice(names)}{rng.choice([': ', ' = ', '='])}{quote}{value()}{quote}" for _ in range(rng.randint(1, 3))) + rng.choice(["", " end"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.redact(docs, "\x01").collect():
        text, covered = texts[r.doc_id], set()
        for s, _, e in [*secret_scan.base_spans(text), *secret_scan.lexed_spans(text)]:
            covered.update(range(s, e))
        assert r.text.replace("\x01", "") == "".join(c for k, c in enumerate(text) if k not in covered)
