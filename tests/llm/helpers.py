import random

WORDS = "the of and to in harbour river boat lamp night wind stone bread letter garden winter summer road bridge tower window candle silver paper story".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))
