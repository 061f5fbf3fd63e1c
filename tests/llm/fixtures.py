"""Small texts for the operators, and what brute force says of them."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def prose(rng: random.Random, n: int, kinds: int = 400) -> str:
    out = []
    for k in range(n):
        w = "".join(rng.choice(["an", "the", "ti", "on", "er", "ou", "sh", "ré", "ge"]) for _ in range(rng.randint(1, 4))) + str(rng.randrange(kinds) if rng.random() < 0.05 else "")
        out.append(w.capitalize() + "," if rng.random() < 0.1 else w + rng.choice(["", "", "", "", ".", "\n"]))
    return " ".join(out)


def table(spark, rows: list[tuple]):
    """Documents of (doc_id, text), with the other columns filled in."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def edges() -> list[tuple]:
    """Nulls, empty and blank texts, one word, repeated rows, a shared doc_id, very long texts."""
    rng = random.Random(11)
    long = prose(rng, 30_000)
    return [(900, None), (901, ""), (902, " \n"), (903, "one"), (903, "one"), (904, "one"), (None, "one"), (None, None), (905, long), (906, long), (907, "x" * 300_000), (908, "é" * 50_000 + " 日本 😀"), (909, "same id"), (909, "other text")]


def corpus() -> list[tuple]:
    """Prose with near copies, exact copies and shared passages, and the edge cases."""
    rng = random.Random(5)
    rows = [(k, prose(rng, rng.randint(20, 260))) for k in range(60)]
    passage = prose(rng, 70)
    for k in range(60, 80):
        base = rows[rng.randrange(60)][1].split(" ")
        for _ in range(rng.randint(0, 4)):
            base[rng.randrange(len(base))] = "changed" + str(k)
        rows.append((k, " ".join(base)))
    for k in range(80, 90):
        rows.append((k, prose(rng, 30) + " " + passage + " " + prose(rng, 20)))
    rows += [(k, rows[k - 90][1]) for k in range(90, 100)]
    rows.append((100, rows[0][1] + " " + rows[0][1]))
    return rows + edges()
