"""Texts that are hard to handle, and made-up prose."""

import random

HARD = [
    None,
    "",
    " ",
    "\n\n \t",
    "one",
    "a  b   c \n d\n\n e ",
    " starts with a space",
    "ends with spaces   ",
    "tabs\tand\x0bother\x0cblanks\x85 　here",
    "don't she'll we've I'M he's 'tis ''s",
    "Éclair naïve İstanbul ΑΣ ὈΔΥΣΣΕΎΣ été ½ ² ٣ 日本語のテキスト 🙂👩‍👩‍👧 x​y",
    "numbers 12345 3.14 1,000 ...!!! ??? #$%^&*()_+ __init__ a_b",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "word" * 2000,
    "before <|endoftext|> after<|startoftext|>x\n <|endoftext|>",
    "\x00\x01 control \x1c\x1d\x1e\x1f \x7f",
    "tie tie tie tie tie",
]


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    parts = ["the", "of", "and", "in", "er", "tion", "an", "st", "re", "on", "ing", "wh", "é", "ß"]
    made = []
    for _ in range(words):
        word = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 4)))
        made.append(word.capitalize() + draw.choice(["", ".", ",", ".\n"]) if draw.random() < 0.1 else word)
    return " ".join(made)
