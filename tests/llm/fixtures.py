"""Small frames that hold what every operator must bear."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=("the", "a", "fox", "dog", "house", "of", "and", "river", "blue", "stone", "walks", "sings")):
    return " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))


def doc(doc_id, text, lang="en", source="src"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def odd_rows():
    """Null id, null text, nulls all over, empty and blank texts, repeated rows, one very long text."""
    rng = random.Random(5)
    long_text = prose(rng, 30_000)
    return [
        doc(None, prose(rng, 30)), doc(900, None), (None, None, None, None, None), doc(901, ""), doc(902, " \n\t "),
        doc(903, "one"), doc(903, "one"), doc(904, long_text), doc(905, "É ß 日本 — 'tis <|endoftext|> don't stop"),
    ]
