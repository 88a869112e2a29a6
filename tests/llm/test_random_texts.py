"""Whole texts of random characters."""

import random
import string

import pytest
from postlens.llm import quality

ALPHABETS = {"base64": string.ascii_letters + string.digits + "+/", "alnum": string.ascii_lowercase + string.digits, "letters": string.ascii_lowercase}


@pytest.mark.parametrize("name, size", [
    *[("base64", n) for n in (300, 700, 1000, 2000, 5000, 20_000)], *[("alnum", n) for n in (300, 700, 1000, 2000, 5000, 20_000)],
    *[("letters", n) for n in (1000, 2000, 5000, 20_000)],
])
def test_texts_of_random_characters_are_rejected(name, size):
    draw, press = random.Random(size), quality.zstandard.ZstdCompressor(level=3)
    for _ in range(10):
        text = ""
        while len(text) < size:
            text += "".join(draw.choices(ALPHABETS[name], k=draw.randint(3, 10))) + " "
        row = quality.measure(text[:size].encode(), quality.Bands(), press, 20, 8, 30)
        assert not row[5] and not row[-1]


def test_other_scripts_keep_their_limits():
    draw = random.Random(3)
    text = "".join(chr(draw.randrange(0x4E00, 0x5500)) + " " * (draw.random() < 0.3) for _ in range(600))
    press = quality.zstandard.ZstdCompressor(level=3)
    data = text.encode()
    ratio = len(press.compress(data)) / len(data)
    assert quality.Bands().within(data, ratio) and not quality.Bands().within(b"x" * len(data), ratio)
