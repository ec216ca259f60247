import pytest


@pytest.fixture
def words():
    """Invented sentences that share no long runs."""

    def make(seed: int, n: int) -> str:
        import random

        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8))) for _ in range(n))

    return make
