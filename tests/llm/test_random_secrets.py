"""Random strings as secrets, in any surroundings."""

import random
import string

import public_tokenizers
import pytest
from postlens.llm import secrets

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
KEY = "Zk3qT9vXw1LmP8rB2nYc7Hd"


def found(text):
    return [text[s:e] for s, e in ((s, e) for s, _, e in secrets.random_spans(text, secrets.encoding(RANKS), 2.1))]


@pytest.mark.parametrize("text", [
    f"The key is {KEY}.", f"see https://api.example.com/{KEY}", f"see https://api.example.com/v1/{KEY}/list.", f"{KEY}.json",
    f"at api.example.com/{KEY}", f"https://user:{KEY}@example.com/",
])
def test_keys_beside_dots_and_in_addresses(text):
    assert any(s in (KEY, f"//user:{KEY}") for s in found(text))


def test_tokens_of_three_parts():
    token = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIn0.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    assert found(f"Bearer {token}.") == token.split(".")


def test_letters_only_and_hyphenated_keys_are_decided_by_tokens():
    draw = random.Random(8)
    assert found("key X7K2P-9QW3Z-M4T8R-B6N1V-C5H0J end") == ["X7K2P-9QW3Z-M4T8R-B6N1V-C5H0J"]
    keys = ["".join(draw.choices(letters, k=32)) for letters in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase) for _ in range(50)]
    assert sum(found(f"the {k} key") == [k] for k in keys) >= 140


@pytest.mark.parametrize("text", [
    "internationalization_of_configuration_parameters", "MAX_BUFFER_SIZE_LIMIT_BYTES", "path/to/some/module/with/names.",
    "https://documentation.example.com/getting-started/installation-guide.html", "Donaudampfschifffahrtsgesellschaft",
    "https://d3f8k2j9x7q1m5zw4v8n.cloudfront.net/index.html", "/usr/local/lib/python/site-packages/numpy/core",
    "AbstractSingletonProxyFactoryBean", "mail some@d3f8k2j9x7q1m5zw4v8n.example.com", "=====================", "2024-01-01-0000-1111-2222",
])
def test_words_and_hosts_are_not_secrets(text):
    assert not found(text)


def spans(text):
    return [text[a:b] for a, _, b in secrets.scan(text, secrets.encoding(RANKS), 2.1)]


def test_the_rest_of_a_string_around_a_base_span():
    text = f"key {KEY}0123456789abcdef0123456789Qw end"
    assert spans(text) == [f"{KEY[:-1]}", "d0123456789abcdef0123456789", "Qw"]
    # too little besides the base span
    assert spans("id abc-0123456789abcdef01234567-x end") == ["0123456789abcdef01234567"]


def test_rules_of_one_or_two_characters_are_none():
    assert not spans("q" * 5000) and not spans("xX" * 40)


def test_very_many_spans_end_soon():
    import time

    draw = random.Random(1)
    keys = " ".join("".join(draw.choices(string.ascii_letters + string.digits, k=32)) + " " + "".join(draw.choices("0123456789abcdef", k=30)) for _ in range(40_000))
    start = time.time()
    found_ = secrets.scan(keys, secrets.encoding(RANKS), 2.1)
    assert len(found_) > 70_000 and time.time() - start < 20
    assert all(a[0] <= b[0] for a, b in zip(found_, found_[1:]))
