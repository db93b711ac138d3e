"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
CLASH = "fp string, n string, sig string, rule string, key string, range string, text_sha256 string, score string, block string, chars string, lang string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def edge_docs(spark):
    """doc_id, text and columns with names that the operators use themselves."""
    rng = random.Random(3)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "changed", *words[61:]])
    far = " ".join(w if k % 4 else "x" + w for k, w in enumerate(words))
    rows = [
        (1, base), (2, base), (3, near), (4, far), (5, base.upper()), (6, "  " + base.replace(" ", "\n") + "\t"), (7, ""), (8, None), (9, " \t\n"),
        (10, "one"), (11, "one two"), (12, "ONE  two"), (13, prose(rng, 20_000)), (14, "é漢字😀 " * 30), (15, "é漢字😀 " * 30 + "x"), (16, "<|endoftext|> </s> it's  fine\u00a0\r\n"),
        (17, prose(rng, 50)), (17, prose(rng, 50)), (18, "twin text here"), (18, "twin text here"), (None, base), (None, None), (20, "a" * 5000), (21, "x\x00y\x0bz"),
    ]
    return spark.createDataFrame([(*r, *(["clash"] * 11)) for r in rows], f"doc_id long, text string, {CLASH}")


def empty_docs(spark):
    return edge_docs(spark).limit(0)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
