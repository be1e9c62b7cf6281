import random

import pytest

LONG = "alpha beta gamma delta " * 20_000


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def long_text():
    return LONG
