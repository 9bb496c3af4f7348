import random

import pytest

LONG = "lorem ipsum dolor sit amet " * 180_000  # 4.9 MB, over one block
WORDS = {
    "en": "the of and house river water green tree stone light night morning walk talk bread".split(),
    "de": "der die und haus fluss wasser grün baum stein licht nacht morgen gehen sprechen brot".split(),
    "fr": "le la et maison rivière eau vert arbre pierre lumière nuit matin marcher parler pain".split(),
}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, fp string, component_id string, label string, block string, ids string, word string, v string"


def prose(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) of plain documents in three languages."""
    return [(100 * k + i, prose(lang, i, 60 + i), lang, f"s{i % 3}") for k, lang in enumerate(WORDS, 1) for i in range(25)]


@pytest.fixture(scope="session")
def edges(corpus):
    """Nulls in any column, empty and very long texts, repeated rows and ids, ties."""
    return corpus + [
        (1, None, None, None),
        (2, "", "en", "s0"),
        (3, " \n\t\x0b ", None, "s0"),
        (4, "!!! 123 ...", "en", None),
        (None, prose("en", 3), "en", "s1"),
        (5, LONG, None, "s2"),
        (6, prose("de", 7, 80), "de", "s1"),
        (6, prose("de", 7, 80), "de", "s1"),
        (7, prose("de", 7, 80), "de", "s1"),
        (8, "word", "en", "s0"),
        (9, "Ünïcode ß Σ İ 漢字 👍🏽 \u0000 é", "de", "s0"),
    ]


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a table with extra columns that clash with the operators' own names."""
    return lambda rows: spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "x", "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)
