"""A small table with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept string, score string, _row string, "
          "class_id int, text_sha256 int, rank string, length string, bucket string, k string, c string, held_out string")
EXTRA = ("x", "y", "z", 1, 2, "r", "l", "b", "k", "c", "h")


def words(rng, n):
    syllables = ["th", "er", "in", "on", "at", "re", "nd", "es", "ti", "le", "qu", "ou", "ch", "ier"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


def rows():
    rng = random.Random(4)
    base = [words(rng, 60) for _ in range(12)]
    near = base[0].split()
    near[30] = "changed"
    texts = [*base, base[0], base[0], " ".join(near), base[1] + "\n" + words(rng, 30), base[1] + "\n" + words(rng, 25),
             None, None, "", "", "   ", "short", "12 34 !!", words(rng, 9000), "é" * 60 + " ünï " + "日本語" * 40]
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}", len(t) if t is not None else None, *EXTRA) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, base[2], None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA)]
    return out


def odd(spark, partitions=3):
    return spark.createDataFrame(rows(), SCHEMA).repartition(partitions)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
