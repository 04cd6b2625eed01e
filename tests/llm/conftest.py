import random

import pytest

WORDS = "the of and to a in der die und le la de que river stone cloud window garden paper silver orange copper maple engine signal harbor canyon meadow".split()
#: Names that clash with columns that the operators make.
CLASH = "key long, n long, size long, range long, token long, label string, row string, node long, sid long, copies long, base double, score double"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice("abcdefgh") * rng.randint(0, 2)) for _ in range(n))


def rows(pairs):
    return [(i, t, "en", None if i is None else f"s{i % 3}", None if t is None else len(t), *[None] * 12) for i, t in pairs]


def texts():
    """Ids and texts: copies, edits, shared passages, blank, null and long ones, repeated rows, a null id."""
    rng = random.Random(11)
    base = ["\n".join(sentence(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))) for _ in range(24)]
    passage = sentence(rng, 60)
    out = list(enumerate(base))
    out += [(30, base[0]), (31, base[1] + " end"), (32, base[2].upper()), (33, passage + "\n" + base[3]), (34, base[4] + "\n" + passage)]
    out += [(40, ""), (41, None), (42, " \n\t "), (43, "x"), (44, "é ü \U0001f600 İ K"), (45, "the the the"), (46, "nul\x00 byte")]
    out += [(50, sentence(rng, 9000)), (51, base[5]), (51, base[5]), (None, base[6]), (60, "one two\nThe MIT License. Apache-license\nGNU General Public License")]
    return out


@pytest.fixture(scope="session")
def pairs():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, pairs):
    return spark.createDataFrame(rows(pairs), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
