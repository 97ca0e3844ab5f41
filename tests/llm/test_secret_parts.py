"""Credentials glued to a name or a path."""

import random

import pytest
from lodestrata.llm import secrets


def test_parts_of_runs_are_scored():
    auto, rng = secrets.infer(secrets.labelled_credentials()), random.Random(5)
    made = [s for k, s in secrets.labelled_credentials(seed=9, each=20) if k in ("forge_token", "chat_token", "pay_key", "long_secret")]
    for glue in ("AWS_SECRET_ACCESS_KEY={}", "auth={}", "path/to/{}", "path/{}/next"):
        hit = 0
        for s in made:
            text = "see " + glue.format(s) + " now"
            hit += any(a <= text.index(s) and b >= text.index(s) + len(s) for a, b, _ in secrets.inferred_spans(text, auto))
        assert hit >= 0.9 * len(made), (glue, hit, len(made))
    long = "".join(rng.choice("abcXYZ019/=+") for _ in range(400))
    for a in auto.values():
        assert a.tails(long, [0, 3, 100, 390]) == pytest.approx([a.score(secrets.symbols(long[i:])) for i in (0, 3, 100, 390)])
