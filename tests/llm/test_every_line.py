import random
import string

import pytest

from thicket.llm import secrets
from thicket.llm.secret_examples import Maker

LINES = ['    connect("slot", "Willow-replica5936+")', '    sign_in("pillar", "flintSegment!80")', '  signIn("pillar", "_EcpvnoUGD2mNOB");', '    root_pw = "cinder.contract.drain77"', '    let root_pw = "isle.contract.seed78";']


@pytest.mark.parametrize("line", LINES)
def test_lines_without_a_cue(line):
    text = f"def f():\n{line}\n    return 1\n"
    (spans,) = secrets.find_spans([text], secrets.trained())
    assert [text[a:b] for a, b in spans] == [line.split('"')[-2]]


def test_every_line_is_a_unit():
    text = "a = 1\n\n  b(\n c)\npassword =\n  'x'\n"
    assert [text[a:b] for a, b in secrets.units(text)] == ["a = 1", "  b(", " c)", "password =\n  'x'"]


def test_tagger_agrees_with_the_plain_labels():
    crf, maker = secrets.trained(), Maker(99)
    tagger = secrets.Tagger(crf)
    sequences = [secrets.TOKEN.findall("".join(p[1] if isinstance(p, tuple) else p for p in parts)) for parts in (*(maker.example() for _ in range(200)), *(maker.ordinary() for _ in range(200)))]
    sequences = [s for s in sequences if s]
    kinds = [tuple(tagger.kind(t) for t in s) for s in sequences]
    tagger.label([(secrets.START, k) for k in kinds])
    for s, k, path in zip(sequences, kinds, crf.label([secrets.token_features(s) for s in sequences]), strict=True):
        assert (tagger.paths[secrets.START, k] or bytes(len(s))) == path.astype("int8").tobytes()


@pytest.mark.parametrize(("lines", "head"), [(13, ""), (25, ""), (49, ""), (200, ""), (25, "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,0F3A\n\n")])
def test_no_character_of_a_private_key_is_left(lines, head):
    r = random.Random(lines)
    tagger = secrets.Tagger(secrets.trained())
    for _ in range(20):
        body = ["".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(64)) for _ in range(lines)]
        text = f"a = 1\n-----BEGIN RSA PRIVATE KEY-----\n{head}" + "\n".join(body) + "\n-----END RSA PRIVATE KEY-----\nb = 2\n"
        ((span, *more),) = secrets.find_spans([text], tagger)
        assert not more and not any(line in secrets.masked(text, [span]) for line in body) and text[span[1] - 64 : span[1]] == body[-1]
        kept = secrets.masked(text, [span])
        assert kept.startswith("a = 1\n-----BEGIN RSA PRIVATE KEY-----\n") and kept.endswith("-----END RSA PRIVATE KEY-----\nb = 2\n") and kept.count("\n") == text.count("\n")


def test_state_is_handed_on_in_long_lines():
    crf = secrets.trained()
    line = "x = [" + "1, " * 600 + '"a"]; password = "Willow-stone4411!"; y = [' + "2, " * 600 + "]"
    (spans,) = secrets.find_spans([line], crf)
    assert [line[a:b] for a, b in spans] == ["Willow-stone4411!"]
    parts = secrets._windows(tuple(secrets.Tagger(crf).kind(t) for t in secrets.TOKEN.findall('k = "' + "ab1 " * 900)))
    assert len(parts) > 2 and all(state[2] == '"' for state, _ in parts[1:])
