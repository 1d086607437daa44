import random

import pytest

WORDS = "ka lo mi nu pe ro sa ti vu wa xe yo zu bran clo dre fli gro plu stra".split()


def sentence(rng, n):
    return " ".join("".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and very long texts, ties and repeated rows, copies, and columns with clashing names."""
    rng = random.Random(1)
    base = [sentence(rng, rng.randint(25, 160)) for _ in range(30)]
    shared = sentence(rng, 120)
    rows = []
    for i, t in enumerate(base):
        rows.append((i, t, "aa", "s1"))
    for i in range(30, 45):
        words = base[i - 30].split()
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), "aa", None))
    for i in range(45, 60):
        rows.append((i, sentence(rng, 20) + " " + shared + " " + sentence(rng, 5), None, "s2"))
    rows += [(60, base[0], "aa", "s2"), (61, base[0], "aa", "s2"), (62, None, None, None), (63, "", "bb", "s1"), (64, " \n\t ", "bb", "s1")]
    rows += [(65, "one", "bb", "s3"), (66, "one", "bb", "s3"), (67, "ONE", "bb", "s3"), (68, "é中 \U0001f600", "bb", "s3"), (69, "12 34 --", "bb", "s3")]
    rows += [(70, "x" * 3000, "bb", "s3"), (71, sentence(rng, 20000), "aa", "s1"), (72, "na " * 900, "aa", "s1"), (73, "na " * 901, "aa", "s1")]
    rows += [(None, base[3], "aa", "s1"), (74, base[5], None, "s1"), (74, base[5], None, "s1")]
    full = [(a, b, c, d, len(b or ""), 7, "k", 0.5, "t") for a, b, c, d in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, rank string, score double, slot string"
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def unique_docs(edge_docs):
    """The same without null and repeated ids."""
    return edge_docs.where("doc_id is not null and doc_id <> 74")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


@pytest.fixture(scope="session")
def as_dir(spark, tmp_path_factory):
    """Writes documents (and labels) as a folder of tables, as queries read them."""

    def write(docs, labels=None):
        path = str(tmp_path_factory.mktemp("sf"))
        docs.write.parquet(f"{path}/documents.parquet")
        if labels is not None:
            labels.write.parquet(f"{path}/labels.parquet")
        return path

    return write
