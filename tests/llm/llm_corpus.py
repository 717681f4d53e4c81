"""A small corpus with the cases that operators must stand."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int = 7) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared lines and passages, null and empty texts, repeated rows, a very long text, a null id."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, line = say(70), "  This Line repeats in MANY documents  "
    rows: list[tuple[int | None, str | None]] = []
    for k in range(60):
        text = say(rng.randint(1, 150))
        if k % 5 == 0:
            text += "\n" + line
        if k % 7 == 0:
            text += " " + passage + " " + say(10)
        rows.append((k, text))
    rows += [(100 + k, rows[3][1]) for k in range(12)]  # copies
    base = say(300).split()
    for k in range(12):  # near copies
        own = list(base)
        own[rng.randrange(300)] = "changed"
        rows.append((200 + k, " ".join(own)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (303, "two words"), (304, line.upper() + "\n" + line), (305, say(60_000)), (306, "x" * 50_000), (None, rows[0][1]), rows[10], rows[10], (5, "another text under a known id")]
    return rows
