import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


def edge_rows():
    base = prose(1, 120)
    lines = "\n".join(prose(50 + i, 12) for i in range(8))
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(2, 80)), (5, None), (6, ""), (7, " \n\t "), (8, "one two"), (9, "one two"),
        (10, "word " * 300), (11, prose(3, 4000)), (12, lines), (13, "intro line that is new here today\n" + lines + "\noutro"), (13, "a repeated id " + prose(4, 50)),
        (14, base + " " + base), (None, base), (None, None), (15, "ÀÉ x y \x1c z" + base), (16, base.upper()), (2, base),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, 7, "x", 1, [1], "k") for i, t in edge_rows()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, id int, h string, n int, lines array<int>, key string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, id int, h string, n int, lines array<int>, key string")
