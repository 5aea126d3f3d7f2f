"""Rows that several test modules make."""
import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))
