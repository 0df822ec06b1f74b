import os
import random
import re

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, n long, key string, size long, found string"


@pytest.fixture(scope="session")
def llm_spark(spark):
    from adloom.llm.common import ship
    return ship(spark)


@pytest.fixture(scope="session")
def make_docs(llm_spark):
    """Documents from texts; columns that clash with the operators' own names come along."""
    def make(texts, ids=None, sources=None):
        rows = [(i if ids is None else ids[i], t, "en", "src0" if sources is None else sources[i],
                 None if t is None else len(t), 1, 2, "k", 3, "f") for i, t in enumerate(texts)]
        return llm_spark.createDataFrame(rows, DOC_SCHEMA)
    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, ties, repeated rows, long and symbol-laden texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(120)
    words = base.split(" ")
    near = " ".join(words[:100] + ["changed"] + words[101:])
    return [None, "", " \n\t ", "one", "a b c", base, base, near, near + " tail", text(60) + "\n" + text(60),
            "x y z " * 40, ("same line\n" * 30), text(3000), "#*$%&|<> " * 30, "é漢😀 " * 20 + base,
            "\x1c\x85\u2028 mixed\u00a0white \u3000space  and   blanks ", "the of and to " * 15, base.upper(), "a" * 900]
