"""Secrets in wrapped, prefixed, damaged, long and concatenated encoded runs."""

import base64
import gzip
import random
import re
import zlib

import pytest

from tideline.llm import secrets

SECRET = "password=hunter2abcdef"
RNG = random.Random(4)
PROSE = " ".join("".join(RNG.choices("abcdefghij", k=7)) for _ in range(60))


def found(text):
    return [text[a:b] for kind, a, b in secrets.scan(text)[1] if kind == "assign"]


def wrap(run, width, end="\n"):
    return end.join(run[i : i + width] for i in range(0, len(run), width))


@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("width", [64, 76, 50])
@pytest.mark.parametrize("pack", [bytes, zlib.compress, gzip.compress])
def test_wrapped_base64(width, end, pack):
    for at in range(30, 90, 7):
        run = wrap(base64.b64encode(pack(f"{PROSE[:at]} {SECRET} {PROSE}".encode())).decode(), width, end)
        text = f"see\n{run}\n\nend"
        assert run in found(text)
        assert secrets.hidden(text).count("hunter2") == 0 and run[:60] not in secrets.hidden(text)


@pytest.mark.parametrize("prefix", ["data/", "id-", "a_b_", "x", "xy", "xyz"])
@pytest.mark.parametrize("pack", [bytes, zlib.compress, gzip.compress])
def test_prefix_before_base64(prefix, pack):
    text = prefix + base64.b64encode(pack(f"{PROSE} {SECRET} {PROSE}".encode())).decode()
    assert found(text) == [text]


def test_layers_with_other_bytes():
    raw = b"\xff\x00\x81" * 40 + f"\x00 {SECRET}\x00".encode() + bytes(range(128, 256))
    for pack in (bytes, zlib.compress):
        text = base64.b64encode(pack(raw)).decode()
        assert found(text) == [text]


def test_a_run_before_a_word_keeps_its_span():
    run = base64.b64encode(f"{PROSE} {SECRET} {PROSE}".encode()).decode().rstrip("=")
    assert found(f"see {run}\nNext words")[0] == run


@pytest.mark.parametrize("lead", [(1 << 26) + 5, (1 << 26) - 9, (1 << 26) - 1])
def test_secrets_behind_64_mb(lead):
    for fill in (b"\n", "é".encode()):
        raw = fill * (lead // len(fill)) + SECRET.encode()
        text = base64.b64encode(zlib.compress(raw, 9)).decode()
        assert found(text) == [text]


def test_secrets_in_later_members():
    for pack in (gzip.compress, zlib.compress):
        raw = pack(PROSE.encode()) + pack(b"x") + pack(pack(f" {SECRET}".encode()))
        text = base64.b64encode(raw).decode()
        assert found(text) == [text]


def test_matches_across_chunks():
    for at in range(0, len(SECRET) + 1, 3):
        raw = b"ab " * ((secrets.CHUNK - at) // 3) + SECRET.encode()
        text = base64.b64encode(zlib.compress(raw)).decode()
        assert found(text) == [text]


def test_deep_nesting_and_binary_data_end_soon():
    import os
    import time

    start = time.time()
    for deep in ("%" + "25" * 100_000 + "70assword=hunter2abc", "\\" + "u005c" * 30_000 + "u0070assword=hunter2abc"):
        assert ("assign", 0, len(deep)) in secrets.scan(deep)[1]
    mixed = "%" + "5cu0025" * 300 + "70assword=hunter2abc"
    assert ("assign", 0, len(mixed)) in secrets.scan(mixed)[1]
    assert time.time() - start < 20
    noise = base64.b64encode(os.urandom(3_000_000)).decode()
    start = time.time()
    secrets.scan(noise)
    assert time.time() - start < 60
    packed = base64.b64encode(os.urandom(30_000) + b"" ).decode()
    inside = base64.b64encode(zlib.compress(b"password=hunter2abc")).decode()
    text = packed + "/" + inside
    assert any(kind == "assign" for kind, _, _ in secrets.scan(text)[1])


@pytest.mark.parametrize("text", ["\\U00000070assword=abcdefg", "\\u{70}assword=abcdefg", "&#112;assword=abcdefg", "&#x70;assword=abcdefg", "%26%23112;assword=abcdefg"])
def test_other_spellings_of_a_character(text):
    assert ("assign", 0, len(text)) in secrets.scan(text)[1]


def test_base_spans_by_force_over_random_texts():
    rng = random.Random(11)
    words = ["password", "PassWD", "secret", "token", "api_key", "APIkey", "AKIA", '"', "'", " ", "  ", ":", "=", "abc", "ABCDEF0123456789", "0a1b2c3d4e5f", "%41", "\n", "é", "/", "-", "AKIAKIA", "f" * 24]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for _ in range(4000):
        text = "".join(rng.choices(words, k=rng.randrange(1, 14)))
        want = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        base, spans = secrets.scan(text)
        assert base == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert set(base) <= set(spans)
