import hashlib
import re

import pytest

SEPARATED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SENTENCE = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau "
    "upsilon phi chi psi omega"
)


def words(text):
    return SEPARATED.findall(text or "")


def plain_words(text):
    return PLAIN.findall((text or "").translate(UPPER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def varied(seed, n):
    """``n`` different words that no other seed makes."""
    return [f"w{seed}x{i * 7919 % 10007}" for i in range(n)]


def odd_documents():
    """(doc_id, text): copies, near copies, shared passages, odd and very long texts, repeated and null rows."""
    passage = SENTENCE
    base = varied(1, 300)
    near = list(base)
    near[150] = "changed"
    rows = [
        (1, " ".join(base)),
        (2, " ".join(base)),
        (3, " ".join(near)),
        (4, passage + " " + " ".join(varied(4, 60))),
        (5, " ".join(varied(5, 20)) + "\n" + passage + "\n" + " ".join(varied(5, 40))),
        (6, passage),
        (7, ""),
        (8, None),
        (9, "one two three"),
        (10, "one two three"),
        (11, " \t\n\r "),
        (12, "same same same " * 40),
        (13, "same same same " * 50),
        (14, " ".join(varied(14, 20000)) + " " + passage),
        (15, "Ünïcode wörds ñandú 漢字 \U0001f600 <|endoftext|> don't  stop here now\x00 " * 12),
        (16, "x" * 100_000),
        (None, " ".join(base)),
        (None, None),
        (17, " ".join(varied(17, 80))),
        (17, " ".join(varied(17, 80))),
    ]
    rows += [(100 + i, " ".join(varied(99, 120)[: 119 - i % 3]) + f" tail{i}") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents with further columns whose names clash with working columns."""
    return spark.createDataFrame(
        [(d, t, "en", "src0", len(t or ""), 7, "k") for d, t in odd_documents()],
        "doc_id long, text string, lang string, source string, n_chars long, n_words int, key string",
    )


@pytest.fixture(scope="session")
def no_documents(odd):
    return odd.limit(0)
