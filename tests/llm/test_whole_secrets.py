"""Assignments of any spacing, name and length are lexed, in linear time."""

from __future__ import annotations

import time

import numpy as np
import pytest

from stroma.llm import secret_scan

VALUE = "X9kLm2Qp7RtZ4vB1"


def lexed(text: str) -> list[str]:
    return [text[s:e] for s, _, e in secret_scan.lexed_spans(text)]


@pytest.mark.parametrize("before", ["db_pwd\t=\t'", "db_pwd" + " " * 30 + "= '", "db.pwd. = '", "db.pwd- = '", "x." * 60 + "pwd = '", "x." * 60 + "set_pwd('", "1a.b.setPwdToken('", "--" + "x-" * 60 + "pwd='"])
def test_secrets_of_any_name_and_spacing(before):
    assert lexed(before + VALUE + ("')" if "(" in before else "'")) == [VALUE]


@pytest.mark.parametrize("quote", "\"'`")
def test_secrets_of_any_length(quote):
    value = "".join(np.random.default_rng(0).choice(list("ABCDEFGHJKMPQ23456789bcdfghjkmpqz"), 20_000))
    assert lexed(f"signing_secret_key := {quote}{value}{quote}") == [value]


def test_a_long_bare_word_stays_a_value():
    value = "aB/cD".replace("/", "") * 30
    assert lexed(f"client_token_pwd_key = {value}") == [value]


@pytest.mark.parametrize("part", ["a.", "ab", "a", "<", "a='", 'f("', "x\\", "a=\\\"", " ", "\t", "-", "a-", "0.", "name:'", "=`", "a+", "set_"])
def test_lexing_takes_linear_time(part):
    for text in (part * 100_000, f"db_pwd = '{part * 100_000}'", f"a: {part * 100_000}"):
        began = time.process_time()
        secret_scan.lexed_spans(text)
        assert time.process_time() - began < 10
