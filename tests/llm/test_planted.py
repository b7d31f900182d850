"""Planted secrets that no base pattern finds, and ordinary code near sensitive words."""

import random
import string

from plumbline.llm import secrets

#: Names that are sensitive without the words of the assign pattern, as they stand before a value.
PLACES = ("private-key {}", "session {}", "Authorization: Bearer {}", "export AWS_CREDENTIAL={}", "set cookie {} now", "?signature={}&x=1", "auth = [{}]", '"credential": "{}"', "# signature {}")
CODE = ("def load_configuration_from_environment(path, default=None):", "import com.example.service.AuthenticationManagerFactory", "session.query(UserAccountPreferences).filter_by(identifier)", "return private_storage_directory_listing", "<div class='cookie-consent-banner-container'>", "https://example.org/auth/documentation/getting-started.html", "class CredentialProviderConfiguration(BaseConfiguration):")
ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789ABCDEF", string.ascii_lowercase + string.digits)


def planted(n=400, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        value = "".join(rng.choices(ALPHABETS[i % len(ALPHABETS)], k=rng.randint(24, 64)))
        place = PLACES[i % len(PLACES)]
        lines = [rng.choice(CODE) for _ in range(rng.randint(0, 4))] + [place.format(value)] + [rng.choice(CODE) for _ in range(rng.randint(0, 4))]
        text = "\n".join(lines)
        yield text, text.index(value), text.index(value) + len(value)


def test_recall_of_planted_values():
    novelty, hit, n = secrets.Novelty(), 0, 0
    for text, a, b in planted():
        n += 1
        hit += any(x <= a and b <= y for _, x, y in secrets.find(text, novelty))
    assert hit >= 0.97 * n, hit / n


def test_ordinary_code_is_left_alone():
    rng, novelty, found = random.Random(2), secrets.Novelty(), 0
    for _ in range(400):
        text = "\n".join(rng.choices(CODE, k=rng.randint(2, 9)))
        found += len(secrets.find(text, novelty))
    assert found <= 4, found


def test_a_copy_of_a_nearby_string_is_no_news():
    """What stands in the surroundings already adds little, however random it looks."""
    rng, novelty = random.Random(3), secrets.Novelty()
    value = "".join(rng.choices(ALPHABETS[0], k=40))
    assert novelty.bits("", value, "") > secrets.LEAST_BITS > novelty.bits(f"session {value} ", value, "")


def test_names():
    rng = random.Random(4)
    for name in ("UserAccountPreferences", "load_configuration_from", "SOME_CONSTANT_NAME_HERE", "https://example.org/auth/path", "incomprehensibilities", "Incomprehensibilities", "cookie-consent-banner"):
        assert secrets.is_name(name), name
    assert not any(secrets.is_name(x) for x in ("QWERTZUIOPASDFGHJKL", "wJalrXUtnFEMI/K7MDENG", "a1b2c3d4e5f6a7b8c9", "", "................"))
    assert sum(secrets.is_name("".join(rng.choices(string.ascii_letters, k=24))) for _ in range(1000)) < 60
