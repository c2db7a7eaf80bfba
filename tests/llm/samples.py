"""Small documents and pages with awkward values."""

import random

_r = random.Random(7)
_w = ["".join(_r.choices(["the", "and", "ing", "tion", "er", "an", "re", "on", "es", "ment", "for", "in"], k=_r.randint(1, 3))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(_w, k=n))


PASSAGE = prose(40, 99)
_base = prose(400, 5)
DOCS = [
    (0, prose(120, 1), "en"),
    (1, prose(80, 2) + "\n" + PASSAGE + "\n" + prose(50, 3), "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n\x0b ", "fr"),
    (5, "Wort", "de"),
    (6, "zwei Wörter", "de"),
    (7, _base, "en"),
    (8, _base, "en"),
    (9, _base + " trailing", "en"),
    (9, _base + " trailing", "en"),
    (None, _base, "en"),
    (None, None, None),
    (10, "Zeile eins\nZeile eins\n\n\nZeile zwei " * 12, "de"),
    (11, "a" * 30000, None),
    (12, "новый текст о погоде " * 30, None),
    (13, "it's we'll I'd 'tis  two  spaces nbsp \r\n tab\t🙂🙂 éé́ ٣٤ 12345 !!??", "en"),
    (14, PASSAGE[: len(PASSAGE) // 2], "en"),
    (15, ("x$%# " * 200), "en"),
    (16, prose(3000, 8), "xx"),
]
ITEMS = [(3, PASSAGE), (20, prose(25, 77)), (3, PASSAGE), (100, "zwei wörter"), (7, None), (8, " .,"), (None, "wort"), (9, prose(12, 1)[:60])]
