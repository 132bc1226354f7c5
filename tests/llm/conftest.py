"""Documents that hold every awkward case at once."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, {extra}"
#: Columns whose names the operators use for their own results.
CLASHES = (
    "hash long, size long, score double, ids string, start long, keep_id long, bits long, bucket long, owner long, "
    "anchor long, shard int, slot int, target double, label int, n long, component_id long, a long, b long, root long, "
    "position int, key string, passes int, below long, reference long, n_tokens long, decoded string"
)


def prose(rnd, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu été über niño".split()):
    return " ".join(rnd.choice(words) + str(rnd.randrange(30)) for _ in range(n))


def messy_rows():
    rnd = random.Random(5)
    passage, base = prose(rnd, 70), prose(rnd, 120)
    near = base.split(" ")
    rows = [(i, prose(rnd, rnd.randrange(1, 160)), f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, "the same text again", "hot") for i in range(30)]
    rows += [(200 + i, f"{prose(rnd, 20)} {passage}\n{prose(rnd, 15)}", None) for i in range(12)]
    rows += [(300 + i, " ".join([*near[:-1], f"last{i}"]), "hot") for i in range(12)]
    rows += [
        (400, None, "s0"), (401, "", "s1"), (402, " \t\r\n\x0b\x0c ", None), (403, None, None), (404, "Ab ab AB", "s2"),
        (405, "ab  AB\tab", "é"), (406, "x" * 30_000, "s3"), (407, prose(rnd, 9_000), "s3"), (408, "same " * 400, "s1"),
        (409, "ends with spaces  ", "s1"), (410, "a▁b \x00   中文 🙂 <|endoftext|> </s> é", "s2"),
        (410, "a▁b \x00   中文 🙂 <|endoftext|> </s> é", "s2"),  # a repeated row
        (None, "a text without id", "s0"), (None, "the same text again", None), (-7, passage, "s0"), (2**62, base, "s1"),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, "en", s, len(t or "")) + (None,) * len(CLASHES.split(", ")) for i, t, s in messy_rows()]
    return spark.createDataFrame(rows, SCHEMA.format(extra=CLASHES)).repartition(5).cache()


@pytest.fixture(scope="session")
def none(messy):
    """The same columns without rows."""
    return messy.filter("false")


@pytest.fixture(scope="session")
def messy_dir(messy, tmp_path_factory):
    """A folder of tables as the queries read it: only the columns of the real tables."""
    folder = str(tmp_path_factory.mktemp("messy"))
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.filter("doc_id < 60").selectExpr("doc_id", "cast(doc_id % 5 <> 0 as int) as quality", "0 as toxic").write.parquet(f"{folder}/labels.parquet")
    return folder
