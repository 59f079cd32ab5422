import duckdb
import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls in every column, empty and odd texts, ties, repeated rows, a long text; ids not in order.
EDGE = [
    (7, "the cat sat on the mat\nshared line\nthe end", "en", "a", 1), (3, "the cat sat on the mat\nshared line\nthe end", "en", "a", 1),
    (3, "the cat sat on the mat\nshared line\nthe end", "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (4, " \t\n\x0b ", "fr", "b", 4),
    (5, "le chat est sur la table\nshared line", "fr", "b", 1), (None, "no id here", "en", "a", 2), (6, "shared line", "en", "a", 3), (8, "é中😀 \x00 ▁▁ x  y   z ", "fr", None, 9),
    (9, "word " * 30000 + "end", "en", "a", 5), (10, "shared line\nother", "en", "a", 1), (11, "shared line\nmore of it", "en", "a", 1), (12, "123 !!", "de", "c", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DDL)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


SF = "/root/testdata/sf0.001"


def oracle(sql, **frames):
    """Rows of the SQL over the given frames, by sorted column name."""
    con = duckdb.connect()
    for name, df in frames.items():
        held = df.toArrow()
        con.register(name, held)
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted([tuple(r[i] for i in at) for r in rel.fetchall()], key=str)


def rows(df):
    return sorted([tuple(r[c] for c in sorted(df.columns)) for r in df.collect()], key=str)


def sf_dir(df, tmp_path, name="documents"):
    """A folder of tables that holds df alone."""
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)
