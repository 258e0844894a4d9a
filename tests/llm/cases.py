"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, h long, words string, rank long, start long"


def texts(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghié", k=rng.randrange(1, 9))) for _ in range(300)]

    def prose(n: int) -> str:
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\n", ", "]) for _ in range(n))

    base = [prose(rng.randrange(1, 200)) for _ in range(30)]
    shared = prose(60).replace("\n", " ")
    out = [*base, base[3], base[3], base[4] + " and more", "", None, " \n\t ", "x", "aaaa " * 300, "a" * 3000, prose(4000)]
    out += [prose(20) + "\n" + shared + "\n" + prose(20) for _ in range(4)]
    out += [base[5].replace(" ", "  ", 1), "Ünïcödé 漢字 text 🙂 " * 20, "don't stop't 12'3 <|endoftext|> a<|startoftext|>b"]
    rows = [(i, t) for i, t in enumerate(out)]
    return [*rows, rows[2], (None, "null id"), (None, "null id")]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}", len(t or ""), 7, 8, "clash", 9, 10) for i, t in rows], SCHEMA)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
