"""Documents with every odd case, and brute-force helpers."""

import random
import zlib

#: Extra columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, source string, body string, doc long, `block` int"

WORDS = "the a of river stone walks über café naïve 12 x! l'eau don't <|endoftext|>   日本語 end.".split(" ")


def odd_documents(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    passage = " ".join(rng.choice(WORDS) + str(i) for i in range(40))
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    for i in range(0, n, 3):
        texts[i] += " " + passage
    texts += [None, "", "   ", "\n\t ", "one", "one two", "x" * 3000, "no space but long " * 900, texts[3], texts[3], "a  b  c\r\nd \x1c e"]
    rows = [(i * 7 - 20, t, f"s{i % 3}" if i % 5 else None, "body", i, i) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[5], None, None, None, None), (None, texts[0], "s1", None, None, None), (10**15, texts[0], None, "b", 1, 1)]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA).repartition(5)


def words(text, lower=False):
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


def crc(value) -> int:
    return zlib.crc32(str(value).encode())


def lines(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
