"""Small documents with every awkward case, and helpers shared by the tests of the text operators."""

import random

CLASHING = (
    "fp component_id least a b row n_words hit_starts items bucket block tokens sums anchor version packed starts spans base "
    "kind score held_out predicted _quality _label size source_size target copies copy place key ordering embedding vid rank "
    "_id _tid _fp _row _copies _group _least copy_"
).split()
WORDS = "the of and harbour stone wall sea storm vote plan council money Zürich été naïve 北京 mail".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, ties, repeated rows, a repeated id with another text, one very long text."""
    rng = random.Random(7)
    passage = " ".join(f"w{k}" for k in range(70))
    long = sentence(rng, 30_000)
    return [
        (1, passage),
        (2, f"before that {passage} and after"),
        (3, f"{passage} {passage}"),
        (4, None),
        (5, ""),
        (6, " \t\n\x0b\x0c\r "),
        (7, "One"),
        (8, "one two three"),
        (9, long),
        (10, long),
        (10, long),
        (11, long + " end"),
        (None, passage),
        (None, None),
        (12, "A b C d E f G h"),
        (13, "a B c D e F g H"),
        (12, f"other {passage}"),
        (14, "x" * 100_000),
        (15, "naïve 北京 " * 40),
    ]
