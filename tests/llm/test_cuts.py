"""Where texts are cut before they are encoded."""

import random

import numpy as np

from marketlens.llm import bpe

SPACES = " \t\n\x0b\x0c\r"


class Counted(np.ndarray):
    """An array that counts what is looked up in it by place."""

    looked_up = 0

    def __getitem__(self, key):
        out = np.asarray(self)[key]
        if isinstance(key, np.ndarray) and key.dtype != bool:
            Counted.looked_up += key.size
        return out


def test_same_as_character_by_character():
    rng = random.Random(3)
    letters = [*SPACES, *"ab\x1c\x1f\u0085   ​　﻿é日🙂"]
    for _ in range(200):
        text = "".join(rng.choices(letters, k=rng.randint(0, 60)))
        want, place = [], 0
        for before, c in zip(" " + text, text, strict=False):
            if place and c in SPACES and not (before.isspace() or before in "᠎​⁠﻿" or before in " "):
                want.append(place)
            place += len(c.encode())
        assert sorted(bpe.cuts(np.frombuffer(text.encode(), np.uint8)).tolist()) == want, repr(text)


def test_only_places_after_other_bytes_are_looked_at_for_other_spaces():
    raw = np.frombuffer(("plain words " * 5000 + "é ").encode(), np.uint8)
    assert len(bpe.cuts(raw.view(Counted))) == 10_001
    assert Counted.looked_up < 3 * 10_001
