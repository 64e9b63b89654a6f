"""What the tests of this folder share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, row string, size int, src string, k int, n int, label int, score int"


def lowered(text):
    return (text or "").translate(ASCII_LOWER)


def prose(seed, count, size=400):
    random_ = random.Random(seed)
    return " ".join(f"w{random_.randrange(size)}" for _ in range(count))


def edge_texts():
    """(doc_id, text, source): nulls, empty and very long texts, ties, repeated rows, copies."""
    base = prose(1, 300)
    near = base.split()
    near[150] = "other"
    rows = [(i, prose(10 + i, 20 + 7 * i), f"s{i % 4}") for i in range(30)]
    rows += [
        (100, base, "s0"), (101, base, "s1"), (102, " ".join(near), "s1"), (103, base.upper(), None),
        (104, " ".join(near[:140]), "s2"), (105, prose(99, 20_000, 3000), "s0"), (105, prose(98, 50), "s0"),
        (106, base, "s2"), (106, base, "s2"), (107, None, "s0"), (108, "", None), (109, " \t\n\x0b\x0c\r", "s9"),
        (110, "one", "s0"), (111, "One", "s0"), (112, "eins zwei drei", "s3"), (113, "eins zwei drei", None),
        (None, base, "s3"), (None, None, None), (None, prose(5, 60), None), (114, "Äpfel ÄPFEL é\u2028É " * 12, "s3"),
        (115, ("the same line here\n" * 30).strip(), "s1"), (116, "a###b <tag> $100 & more | x % y * z " * 10, "s1"),
        (-117, "\U0001f600 \U0001f600\u00a0x 1\u0663 don't " * 9, "s1"), (118, "\\", "s\u00e9"),
    ]
    return rows


def same_rows(found, wanted):
    key = lambda row: [(cell is None, str(cell)) for cell in row]
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)
