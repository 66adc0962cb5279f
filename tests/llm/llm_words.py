import random


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


#: Texts that every operator has to take.
ODD = [None, "", " ", "\n\t\r ", "a", "A B", "a b", "\u0000", "é İ ß ﬁ K", "<|endoftext|>", "x" * 20_000, "漢字 🤷 ▁", "'s it's 'r", "CC BY cc-by"]
