"""Rows that every text operator must stand."""

import random

#: Column names that operators use inside, or return, besides those of documents.
CLASHING = "_key _gone _size _score _k _block _row _rest _ doc_key start size term pos fp u v node root value line w y score".split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def messy_rows(seed=0, count=60):
    """NULLs in every column, empty, blank and very long texts, repeated rows, near copies, shared lines."""
    rng = random.Random(seed)
    vocabulary = "the of and der die un la mouse river stone light paper seven green walked quickly über être niño idiot".split()
    shared = ["This line stands in many texts and says nothing new at all", "and this one follows it every time"]
    texts = []
    for i in range(count):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines[rng.randint(0, len(lines)):0] = shared
        texts.append("\n".join(lines))
    texts += [None, "", " ", "\n\n\n", "a", "the", "...!!!", "ÉCOLE É", "x" * 5000, "word " * 3000]
    texts += ["\n".join(f"row {i % 7} of a long text with lines" for i in range(2000)), texts[0], texts[1] + " tail"]
    rows = []
    for i, text in enumerate(texts):
        lang = rng.choice(["en", "fr", None])
        rows.append((i, text, lang, rng.choice(["a", "b", "B", None, ""]), None if text is None else len(text)))
    rows.append((None, "a text without an id and a few more words", "en", "a", 1))
    rows.append((None, None, None, None, None))
    rows += [rows[2], rows[2], rows[5]]
    return [r + tuple("7" if j % 2 else None for j in range(len(CLASHING))) for r in rows]
