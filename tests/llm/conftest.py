import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, id string, _row string, digest string, key string, "
    "n long, score double, kind string, `end` long, part string, label string"
)


def odd_texts() -> list:
    """Null, empty, blank, repeated, tied, long and mixed texts."""
    rng = random.Random(5)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) + str(k) for k in range(60)]
    line = " ".join(rng.choices(words, k=40))
    near = line.replace(line.split()[7], "zz", 1)
    passage = "First shared line here.\nSecond shared line here."
    return [
        None, None, "", "", "  \n\t ", "x", "X", "a b", "A  b", line, line, line + " ", near, near.upper(), passage + "\nown one", "own two\n" + passage,
        passage, "\n\n\n", "é" * 50 + " 門 😀 \x00 \x1c \x85 K ſ", "word " * 20_000, "y" * 60_000, "1 " * 5_000, "a@b.cd, 10.0.0.1; 4111 1111 1111 1111 +1 (555) 123-4567",
        "GNU General Public License; Apache License, CC BY-NC. MIT license! gnu general public", "<|endoftext|> <s> [UNK] '''s", "=cmd|' /C calc'!A0",
    ]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Odd documents with null and repeated ids, null columns and columns named like those the operators make."""
    texts = odd_texts()
    rows = [(i, t, None if i % 3 else "en", None if i % 4 else "s0", None, 7, "q", "r", "d", "k", 1, 0.5, "email", 3, "p", "l") for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, *rows[10][1:]), (None, "only null ids have this text", *rows[0][2:]), (3, "same id as another text", *rows[0][2:])]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(spark, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    odd.limit(0).write.parquet(path)
    return spark.read.parquet(path)
