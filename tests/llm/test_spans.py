"""Personal data, secrets and quality rules against plain implementations."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import pii, quality, secrets

LUHN = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
DIGITS = lambda s: re.sub(r"[^0-9]", "", s)
PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(DIGITS(m[0])) <= 19 and LUHN(DIGITS(m[0]))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(DIGITS(m[0])) <= 15),
}
SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
}


def plain(kinds, text):
    found = [(m.start(), k, name, m.end()) for k, (name, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, text, re.A) if ok(m)]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def check(rows, texts, kinds):
    assert rows
    for r in rows:
        want = plain(kinds, texts[r.doc_id])
        assert r.base_sha256 == sha(want)
        for k in kinds:
            assert r[f"n_{k}"] == sum(s[0] == k for s in want)
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))


def test_pii(docs, texts, none):
    rows = pii.detect(docs).collect()
    assert len(rows) == docs.count()
    check(rows, texts, PII)
    assert any(r.n_iban for r in rows)
    assert pii.detect(none).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text("12390.+-@ab (A%", max_size=60))
def test_pii_any_text(text):
    assert [s[:3] for s in pii.find(text) if s[0] in PII] == plain(PII, text)


def test_pii_added_kinds():
    assert "iban:5:32" not in pii.joined(pii.find("IBAN DE89 3704 0044 0532 0130 01"))
    assert [s[0] for s in pii.find("my SSN is 123-45-6789")] == ["ssn"]
    assert pii.find("part 123-45-6789 of it") == []
    assert pii.redact("a b@c.de f", pii.find("a b@c.de f")) == "a [EMAIL] f"
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


def test_iban_whose_bank_code_has_letters():
    for code in ("GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "IT60X0542811101000000123456", "DE89 3704 0044 0532 0130 00", "MT84MALT011000012345MTLCAST001S"):
        for before, after in (("", ""), ("Pay to ", ", please"), ("IBAN: ", " BIC"), ("AB12 ", "."), ("_", " Thanks")):
            text = before + code + after
            assert ("iban", len(before), len(before) + len(code)) in [x[:3] for x in pii.find(text)]
            assert pii.redact(text, pii.find(text)) == f"{before}[IBAN]{after}"
        assert not [x for x in pii.find("é" + code) if x[0] == "iban"]
    assert pii.find("NL92ABNA0417164300") == [] and pii.find("GB82 WEST") == []
    pii.find("GB82" * 50_000)
    pii.find("GB82 " * 40_000)


def test_long_runs_are_linear():
    for t in ("a" * 200_000, "1" * 200_000, "+1" + " " * 200_000, "@" * 200_000, "1." * 100_000, "secret" + " " * 200_000):
        pii.find(t)
        secrets.find(t, secrets.Novelty())


def test_secrets(docs, texts, none):
    rows = secrets.detect(docs).collect()
    assert len(rows) == docs.count()
    check(rows, texts, SECRETS)
    assert secrets.detect(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("secrtTokn=: \"'aA0KIſ1b", max_size=80))
def test_secrets_any_text(text):
    assert [s for s in secrets.find(text, secrets.Novelty()) if s[0] != "novel"] == plain(SECRETS, text)


def test_novelty():
    n = secrets.Novelty()
    token = "Zx81mQpT7vLr92KsWq04Hd6YbNc3"
    assert [s[0] for s in secrets.find(f"Authorization: Bearer {token}", n)] == ["novel"]
    assert secrets.find(f"just words {token}", n) == []
    assert secrets.find("auth token authorization_environment_variable", n) == []
    repeated = f"auth {token} auth {token} "
    assert n.bits(repeated, token, "") < 2 < n.bits("auth ", token, "")


def test_novelty_of_unquoted_assignments():
    n = secrets.Novelty()
    value = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQ81mTpL3v"
    names = ("export AWS_SECRET_ACCESS_KEY", "private_key", "secret_key", "auth", "session", "cookie", "signature", "credential", "https://a.example/x?user=me&signature", "MY_AUTH_" + "LONG_" * 20 + "NAME")
    for name in names:
        for tail in ("", "=", "=="):
            for sep in ("=", "='", '="'):
                start = len(name) + len(sep)
                found = secrets.find(f"{name}{sep}{value}{tail}{sep[1:]} # comment", n)
                assert found == [("novel", start, start + len(value + tail))], (name, sep, tail)
    assert secrets.find(f"colour={value}", n) == []
    far = "auth " + "a=" * 40 + value
    assert secrets.find(far, n) == [("novel", len(far) - len(value), len(far))]
    secrets.find("abcdefghijklmnop=" * 20_000, n)
    secrets.find("key" + "=" * 200_000 + "a", n)


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(twice)


def test_quality(docs, texts, none):
    rows = quality.rules(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if len(texts[r.doc_id]) < 9000:
            want = plain_quality(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
            assert not (r.base_failed and r.kept)
    assert quality.rules(none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\n \té", max_size=60), min_size=1, max_size=4))
def test_quality_any_texts(texts):
    import numpy as np

    raw = [t.encode() for t in texts]
    m = quality.measure(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        assert tuple(int(m[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_quality(t)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["GB", "NL", "IT", "MT", "DE", "NO", "BG", "LV"]), st.text("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", min_size=11, max_size=30), st.integers(0, 3), st.booleans())
def test_any_iban(country, rest, group, wrong):
    """Codes whose check digits are computed apart from the operator, in groups of four or whole."""
    plain = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    check = 98 - plain % 97
    code = f"{country}{(check + wrong - 2) % 97 + 2:02}{rest}"
    code = " ".join(code[i : i + 4] for i in range(0, len(code), 4)) if group == 0 else code
    found = [x[1:3] for x in pii.find(f"to {code}, now") if x[0] == "iban"]
    assert ((3, 3 + len(code)) in found) != wrong
