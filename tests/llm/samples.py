"""Texts that the tests share."""

WORDS = "the quick brown fox jumps over lazy dogs while seven wizards mix potions under pale moons and old towers".split()


def running_text(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ed", "ing", "ly"]) for _ in range(n))


ODD_TEXTS = [None, "", " \n\t ", "x", "naïve café 東京 😀", "a" * 3000, "#$% 12 | <b>"]
